"""Readers: each gives a DataFrame with the stated columns; paths may be files, folders or globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import strip_sequence_suffix

FILE = "_metadata.file_name"


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").option("pathGlobFilter",
        "*.f*a").text(path).select(F.regexp_replace(F.col("value"), "^>", "").alias("r"), F.col(FILE).alias("file"))
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s+", "")
    return lines.select("file", head.alias("head"), body.alias("sequence")).where("head <> '' or sequence <> ''")


def read_fasta_dir(spark: SparkSession, path: str, id_remap: DataFrame | None = None) -> DataFrame:
    """SRC1: ``sample, seqid, description, sequence``; the sample is the file's stem, mapped by ``id_remap`` (``id, sample``), without which it is dropped."""
    df = _fasta(spark, path).select(strip_sequence_suffix("file").alias("sample"),
        F.split_part("head", F.lit(" "), F.lit(1)).alias("seqid"), F.col("head").alias("description"), "sequence")
    if id_remap is None:
        return df
    remap = id_remap.select(F.col("id").alias("sample"), F.col("sample").alias("new")).distinct()
    return df.join(remap, "sample").select(F.col("new").alias("sample"), "seqid", "description", "sequence")


def read_fasta(spark: SparkSession, path: str, header_style: str = "uniprot") -> DataFrame:
    """SRC2: ``id, sequence``, one row an id (the first sequence in order); the id is the second of fields split by ``|``, or the first word (``plain``)."""
    df = _fasta(spark, path)
    if header_style == "uniprot":
        id_ = F.split_part("head", F.lit("|"), F.lit(2))
        id_ = F.when(id_ == "", F.raise_error(F.concat(F.lit("no accession in header "), F.col("head"))).cast("string")).otherwise(id_)
    else:
        id_ = F.split_part("head", F.lit(" "), F.lit(1))
    return df.select(id_.alias("id"), "sequence").groupBy("id").agg(F.min("sequence").alias("sequence"))


BAKTA = "seqid string, type string, start long, stop long, strand string, locus_tag string, gene string, product string"


def read_bakta(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: annotation rows of each sample's report; comment lines and the header are dropped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv").text(path).select("value",
        F.regexp_replace(F.regexp_replace(FILE, r"\.tsv$", ""), r"[._]bakta$", "").alias("sample"))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select("sample", F.from_csv("value", BAKTA, {"sep": "\t", "mode": "PERMISSIVE"}).alias("r")).select("sample", "r.*")


def read_tabular(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC4: parquet, TSV or CSV by suffix; ``NA`` is null."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true").option("nullValue", "NA").option("sep", "\t" if ".tsv" in path or path.endswith(".txt")
        else ",")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


#: File-name endings of the report's sample column.
REPORT_SUFFIXES = (r"\.mapping\.potential\.ARG$", r"\.tsv\.amrfinderplus$", r"\.txt\.rgi$", r"\.abricate$")


def read_hamronization(spark: SparkSession, path: str, prefix: str = "hamr") -> DataFrame:
    """SRC5: ``sample, seqid, start, stop`` and five prefixed columns; the first row of each sequence by start, stop and gene."""
    df = spark.read.option("header", "true").option("sep", "\t").option("nullValue", "NA").csv(path)
    sample = F.col("input_file_name")
    for pattern in REPORT_SUFFIXES:
        sample = F.regexp_replace(sample, pattern, "")
    df = df.withColumn("sample", sample)
    seqid = F.regexp_replace(F.replace(F.col("input_sequence_id"), F.concat("sample", F.lit("_"))), "_seq.*", "")
    kept = ("gene_symbol", "resistance_mechanism", "predicted_phenotype", "antimicrobial_agent", "drug_class")
    out = df.select("sample", seqid.alias("seqid"), F.col("input_gene_start").cast("long").alias("start"),
        F.col("input_gene_stop").cast("long").alias("stop"), *[F.col(c).alias(f"{prefix}_{c}") for c in kept])
    w = Window.partitionBy("sample", "seqid").orderBy("start", "stop", f"{prefix}_gene_symbol")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_combgc(spark: SparkSession, path: str, prefix: str = "combgc") -> DataFrame:
    """SRC6: gene-cluster intervals of ``combgc_summary.tsv`` files."""
    df = spark.read.option("header", "true").option("sep", "\t").option("nullValue", "NA").option("recursiveFileLookup",
        "true").option("pathGlobFilter", "combgc_summary.tsv").csv(path)
    kept = ("PFAM_domains", "Product_class", "MIBiG_ID", "InterPro_ID")
    return df.select(F.col("sample_id").alias("sample"), F.col("contig_id").alias("seqid"), F.col("BGC_start").cast("long").alias("start"),
        F.col("BGC_end").cast("long").alias("stop"), *[F.col(c).alias(f"{prefix}_{c}") for c in kept], F.lit(True).alias("is_bgc"))


AMP = "sample_id string, contig_id string, CDS_start long, CDS_end long, transporter_protein string"


def read_ampcombi(spark: SparkSession, path: str, prefix: str = "ampcombi") -> DataFrame:
    """SRC7: peptide intervals; an empty file gives no rows."""
    df = spark.read.option("sep", "\t").text(path).select("value")
    head = df.where(F.col("value").startswith("sample_id")).limit(1).collect()  # one line
    names = head[0][0].split("\t") if head else AMP.replace(" string", "").replace(" long", "").split(", ")
    rows = df.where(~F.col("value").startswith("sample_id") & (F.trim("value") != "")).select(
        F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": "\t"}).alias("r")).select("r.*")
    return rows.select(F.col("sample_id").alias("sample"), F.col("contig_id").alias("seqid"),
        F.col("CDS_start").cast("long").alias("start"), F.col("CDS_end").cast("long").alias("stop"),
            F.col("transporter_protein").alias(f"{prefix}_transporter_protein"), F.lit(True).alias("is_amp"))


KRAKEN = "p_reads_covered double, n_reads_covered long, n_reads_direct long, rank string, taxid long, name string"


def read_kraken2(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: taxon reports without header, one a sample."""
    df = spark.read.option("sep", "\t").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace",
        "true").schema(KRAKEN).csv(path)
    return df.select(F.regexp_replace(FILE, r"\.kraken2\.report\.txt$", "").alias("sample"), *[f.split()[0] for f in KRAKEN.split(", ")])


def read_quast(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: assembly statistics by ``sample``."""
    df = spark.read.option("header", "true").option("sep", "\t").option("inferSchema", "true").csv(path)
    return df.withColumn("Assembly", F.regexp_replace("Assembly", r"\.scaffolds$", "")).withColumnRenamed("Assembly", "sample")


FASTANI = "query string, reference string, ANI double, bidirectional_fragments long, total_query_fragments long"


def read_fastani(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: identities without header; the sample is the query's file stem."""
    df = spark.read.option("sep", "\t").schema(FASTANI).csv(path)
    return df.withColumn("sample", strip_sequence_suffix("query"))


#: Columns of the taxonomy dump's nodes.
NODES = ("tax_id", "parent_tax_id", "rank", "embl_code", "division_id", "inherited_div_flag", "genetic_code_id", "inherited_gc_flag",
    "mitochondrial_genetic_code_id", "inherited_mgc_flag", "genbank_hidden_flag", "hidden_subtree_root_flag", "comments")
_TEXT_NODES = ("rank", "embl_code", "comments")


def read_taxdump(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: the tree's nodes, 13 typed columns."""
    parts = spark.read.text(path).where("value <> ''").select(F.split(F.regexp_replace("value", r"\s*\|\s*$", ""), r"\s*\|\s*").alias("p"))
    return parts.select(*[(F.trim(F.get("p", F.lit(i))) if n in _TEXT_NODES else F.try_to_number(F.trim(F.get("p", F.lit(i))),
        F.lit("9999999999")).cast("long")).alias(n) for i, n in enumerate(NODES)])


#: Columns of the gene-ontology annotation format.
GAF = ("db", "db_object_id", "db_object_symbol", "relation", "go_id", "db_reference", "evidence_code", "with_from", "aspect",
    "db_object_name", "db_object_synonym", "db_object_type", "taxon", "date", "assigned_by", "annotation_extension", "gene_product_form_id")


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: ontology annotations, lines with ``!`` dropped."""
    return spark.read.option("sep", "\t").option("comment", "!").schema(", ".join(f"{n} string" for n in GAF)).csv(path)


def parse_native_records(text: DataFrame, col: str = "value") -> DataFrame:
    """SRC13: records that begin ``number: ``, given whole, to ``acc, attrs``, a map of each name's values."""
    pair = r'/([^=\n"]+)="([^"]*)"'
    rows = text.where(F.col(col).rlike(r"^\s*\d+: ")).select(F.regexp_extract(col, r"Accession:\s*(\S+)", 1).alias("acc"),
        F.regexp_extract_all(col, F.lit(pair), F.lit(1)).alias("k"), F.regexp_extract_all(col, F.lit(pair), F.lit(2)).alias("v"))
    names = F.array_distinct(F.transform("k", lambda x: F.trim(x)))
    both = F.arrays_zip(F.transform("k", lambda x: F.trim(x)).alias("k"), F.col("v").alias("v"))
    values = F.transform(names, lambda n: F.transform(F.filter(both, lambda x: x["k"] == n), lambda x: x["v"]))
    return rows.select("acc", F.map_from_arrays(names, values).alias("attrs"))


def read_native_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC13 from a file: records are paragraphs."""
    return parse_native_records(spark.read.option("lineSep", "\n\n").text(path))


def parse_project_records(text: DataFrame, col: str = "value") -> DataFrame:
    """SRC14: paragraphs to ``acc, title, organism``."""
    got = lambda p: F.nullif(F.trim(F.regexp_extract(col, p, 1)), F.lit(""))
    return text.where(F.trim(F.col(col)) != "").select(got(r"Accession:\s*(\S+)").alias("acc"),
        got(r"^\s*(?:\d+\.\s*)?([^\n]*)").alias("title"), got(r"Organism:\s*([^\n]*)").alias("organism"))


def read_project_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC14 from a file."""
    return parse_project_records(spark.read.option("lineSep", "\n\n").text(path))


def read_assembly_details(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: tables after one preamble line that begins with ``#`` and a header, which each file has; a trailing empty column is dropped."""
    lines = spark.read.text(path).where("value <> ''")
    _, header = (r[0] for r in lines.limit(2).collect())  # two lines
    names = [n for n in header.lstrip("#").strip().split("\t") if n]
    schema = ", ".join(f"`{n.strip()}` string" for n in names) + ", `_rest` string"
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != header))  # preambles may differ between files
    return rows.select(F.from_csv("value", schema, {"sep": "\t"}).alias("r")).select("r.*").drop("_rest")


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC16: a saved dataset, its columns in this order."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC17: one id a line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()
