"""Queries of readers and writers: given tables are written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import sequences, store
from ..scratch import scratch_path
from ..sources import readers, writers
from .registry import drawn, drawn_unit, registry, rounded, table

QUERIES, ORACLE_SQL, query = registry()

_DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _path(s, name: str) -> str:
    return scratch_path(s, f"{name}-{uuid.uuid4().hex}")


def _lines(df: DataFrame, path: str, sep: str | None = None) -> str:
    """The column ``value`` as lines of text files; ``sep`` ends a record."""
    writer = df.select("value").write
    (writer.option("lineSep", sep) if sep else writer).text(path)
    return path


def _by_sample(df: DataFrame, path: str, sep: str | None = None) -> str:
    """Lines in a folder a sample."""
    writer = df.select("sample", "value").repartition("sample").write.partitionBy("sample")
    (writer.option("lineSep", sep) if sep else writer).text(path)
    return path


def _seq():
    return F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def _tsv(*cols) -> F.Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])


def _copy(s, src: str, out: str, suffix: str) -> None:
    """Text files of a folder once more, under names with a suffix that readers look for."""
    hadoop = s._jvm.org.apache.hadoop.fs
    conf = s.sparkContext._jsc.hadoopConfiguration()
    a, b = hadoop.Path(src), hadoop.Path(out)
    fs = a.getFileSystem(conf)
    fs.mkdirs(b)
    for i, f in enumerate(fs.listStatus(a)):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), hadoop.Path(b, f"part{i:05d}{suffix}"))


def _named(s, src: str, suffix: str) -> str:
    out = _path(s, "named")
    _copy(s, src, out, suffix)
    return out


@query(f"""SELECT doc_id AS id, {_DNA} AS sequence FROM documents WHERE {_DNA} <> ''""")
def read_fasta(s, d):
    docs = table(s, d, "documents").select("doc_id", _seq().alias("q")).where("q <> ''")
    wrapped = F.regexp_replace("q", "(.{60})", "$1\n")
    src = _lines(docs.select(F.concat(F.lit(">sp|"), "doc_id", F.lit("|X some words\n"), wrapped).alias("value")), _path(s, "fasta"))
    return readers.read_fasta(s, _named(s, src, ".fasta")).select(F.col("id").cast("long").alias("id"), "sequence")


@query(f"""SELECT 'c' || doc_id AS seqid, 'c' || doc_id || ' of ' || source AS description, {_DNA} AS sequence FROM documents WHERE {_DNA} <> ''""")
def read_fasta_dir(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", _seq().alias("q")).where("q <> ''")
    src = _named(s, _lines(docs.select(F.concat(F.lit(">c"), "doc_id", F.lit(" of "), "source", F.lit("\n"), "q").alias("value")),
        _path(s, "contigs")), ".fna")
    return readers.read_fasta_dir(s, src).where(F.col("sample").rlike("^part[0-9]+$")).select("seqid", "description", "sequence")


@query("""SELECT 'contig' || l_orderkey AS seqid, 'cds' AS type, l_partkey AS start, l_partkey + l_linenumber AS stop, CASE l_returnflag WHEN 'R' THEN '-' ELSE '+' END AS strand, 'L' || l_suppkey AS locus_tag, nullif(l_returnflag, 'N') AS gene, nullif(l_linestatus, 'O') AS product FROM lineitem""")
def read_bakta(s, d):
    li = table(s, d, "lineitem")
    strand = F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
    row = _tsv(F.concat(F.lit("contig"), "l_orderkey"), F.lit("cds"), "l_partkey", F.col("l_partkey") + F.col("l_linenumber"), strand,
        F.concat(F.lit("L"), "l_suppkey"), F.nullif("l_returnflag", F.lit("N")), F.nullif("l_linestatus", F.lit("O")))
    head = s.createDataFrame([(f"# comment {i}",) for i in range(5)]
        + [("#Sequence Id\tType\tStart\tStop\tStrand\tLocus Tag\tGene\tProduct",)], "value string")
    src = _named(s, _lines(head.unionByName(li.select(row.alias("value"))), _path(s, "bakta")), ".tsv")
    return readers.read_bakta(s, src).where(F.col("sample").rlike("^part[0-9]+$")).drop("sample")


@query("""WITH r AS (SELECT 's' || o_custkey AS sample, 'c' || o_orderkey % 5 AS seqid, o_orderkey AS start, o_orderkey + 30 AS stop,
 o_orderstatus AS gene, o_orderpriority AS cls FROM orders)
SELECT sample, seqid, start, stop, gene AS hamr_gene_symbol, NULL::VARCHAR AS hamr_resistance_mechanism, cls AS hamr_predicted_phenotype,
 NULL::VARCHAR AS hamr_antimicrobial_agent, 'x' AS hamr_drug_class FROM (SELECT *, row_number() OVER (PARTITION BY sample, seqid
 ORDER BY start, stop, gene) AS n FROM r) WHERE n = 1""")
def read_hamronization(s, d):
    sample = F.concat(F.lit("s"), "o_custkey")
    ending = F.when(F.col("o_orderkey") % 2 == 0, ".tsv.amrfinderplus").otherwise(".mapping.potential.ARG")
    o = table(s, d, "orders").select(
        F.concat(sample, ending).alias("input_file_name"), F.concat(sample, F.lit("_c"), (F.col("o_orderkey") % 5).cast("string"),
            F.lit("_seq1")).alias("input_sequence_id"),
        F.col("o_orderkey").alias("input_gene_start"), (F.col("o_orderkey") + 30).alias("input_gene_stop"),
            F.col("o_orderstatus").alias("gene_symbol"), F.lit(None).cast("string").alias("resistance_mechanism"),
        F.col("o_orderpriority").alias("predicted_phenotype"), F.lit(None).cast("string").alias("antimicrobial_agent"),
            F.lit("x").alias("drug_class"),
    )
    path = _path(s, "report")
    writers.write_table(o, path, "tsv")
    return readers.read_hamronization(s, path)


@query("""SELECT c_custkey::VARCHAR AS sample, 'c' || c_nationkey AS seqid, c_custkey AS start, c_custkey + 100 AS stop, c_mktsegment AS "combgc_PFAM_domains", c_name AS "combgc_Product_class", NULL::VARCHAR AS "combgc_MIBiG_ID", 'i' AS "combgc_InterPro_ID", true AS is_bgc FROM customer""")
def read_combgc(s, d):
    c = table(s, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.concat(F.lit("c"), "c_nationkey").alias("contig_id"),
            F.col("c_custkey").alias("BGC_start"), (F.col("c_custkey") + 100).alias("BGC_end"),
        F.col("c_mktsegment").alias("PFAM_domains"), F.col("c_name").alias("Product_class"), F.lit(None).cast("string").alias("MIBiG_ID"),
            F.lit("i").alias("InterPro_ID"),
    )
    path = _path(s, "combgc")
    writers.write_table(c, path, "tsv")
    hadoop, conf = s._jvm.org.apache.hadoop.fs, s.sparkContext._jsc.hadoopConfiguration()
    top = hadoop.Path(path)
    fs = top.getFileSystem(conf)
    for i, f in enumerate(fs.listStatus(top)):  # one folder a file, as the tool writes them
        if f.getPath().getName().startswith("part-"):
            fs.mkdirs(hadoop.Path(f"{path}/{i}"))
            fs.rename(f.getPath(), hadoop.Path(f"{path}/{i}/combgc_summary.tsv"))
    return readers.read_combgc(s, path)


@query("""SELECT s_suppkey::VARCHAR AS sample, 'c' || s_nationkey AS seqid, s_suppkey AS start, s_suppkey + 9 AS stop, s_name AS ampcombi_transporter_protein, true AS is_amp FROM supplier""")
def read_ampcombi(s, d):
    u = table(s, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.concat(F.lit("c"), "s_nationkey").alias("contig_id"),
        F.col("s_suppkey").alias("CDS_start"), (F.col("s_suppkey") + 9).alias("CDS_end"), F.col("s_name").alias("transporter_protein"))
    path = _path(s, "ampcombi")
    writers.write_table(u, path, "tsv")
    return readers.read_ampcombi(s, path)


@query("""SELECT 's' || o_custkey % 7 AS sample, o_totalprice AS p_reads_covered, o_orderkey AS n_reads_covered, o_custkey AS n_reads_direct, o_orderstatus AS rank, o_orderkey * 3 AS taxid, o_orderpriority AS name FROM orders""")
def read_kraken2(s, d):
    row = _tsv("o_totalprice", "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderkey") * 3,
        F.concat(F.lit("    "), "o_orderpriority"))
    o = table(s, d, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string")).alias("sample"), row.alias("value"))
    src = _by_sample(o, _path(s, "kraken"))
    return _sample_files(s, src, ".kraken2.report.txt", lambda path: readers.read_kraken2(s, path))


def _sample_files(s, src: str, suffix: str, read) -> DataFrame:
    """Files that bear their sample's name, read by ``read``."""
    hadoop, conf = s._jvm.org.apache.hadoop.fs, s.sparkContext._jsc.hadoopConfiguration()
    top, out = hadoop.Path(src), _path(s, "samples")
    fs = top.getFileSystem(conf)
    fs.mkdirs(hadoop.Path(out))
    for folder in fs.listStatus(top):  # one a sample
        name = folder.getPath().getName()
        if name.startswith("sample="):
            for f in fs.listStatus(folder.getPath()):
                fs.rename(f.getPath(), hadoop.Path(f"{out}/{name.removeprefix('sample=')}{suffix}"))
    return read(out)


@query("""SELECT 'a' || p_partkey AS sample, p_size AS contigs, p_retailprice AS "N50" FROM part""")
def read_quast(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("a"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".scaffolds").otherwise(""))
        .alias("Assembly"), F.col("p_size").alias("contigs"), F.col("p_retailprice").alias("N50"))
    path = _path(s, "quast")
    writers.write_table(p, path, "tsv")
    return readers.read_quast(s, path)


@query("""SELECT '/in/q' || l_orderkey || '.fna' AS query, '/ref/' || l_suppkey || '.fasta.gz' AS reference, l_quantity AS "ANI", l_partkey AS bidirectional_fragments, l_linenumber::BIGINT AS total_query_fragments, 'q' || l_orderkey AS sample FROM lineitem""")
def read_fastani(s, d):
    row = _tsv(F.concat(F.lit("/in/q"), "l_orderkey", F.lit(".fna")), F.concat(F.lit("/ref/"), "l_suppkey", F.lit(".fasta.gz")),
        "l_quantity", "l_partkey", "l_linenumber")
    return readers.read_fastani(s, _lines(table(s, d, "lineitem").select(row.alias("value")), _path(s, "ani")))


@query("""SELECT c_custkey AS tax_id, c_nationkey::BIGINT AS parent_tax_id, c_mktsegment AS rank, '' AS embl_code, 0::BIGINT AS division_id, 1::BIGINT AS inherited_div_flag, 11::BIGINT AS genetic_code_id, 1::BIGINT AS inherited_gc_flag, 0::BIGINT AS mitochondrial_genetic_code_id, 1::BIGINT AS inherited_mgc_flag, 0::BIGINT AS genbank_hidden_flag, 0::BIGINT AS hidden_subtree_root_flag, 'note ' || c_name AS comments FROM customer""")
def read_taxdump(s, d):
    parts = [F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment"), F.lit(""), *[F.lit(v) for v in (0, 1, 11, 1, 0, 1, 0, 0)],
        F.concat(F.lit("note "), "c_name")]
    row = F.concat(F.concat_ws("\t|\t", *[p.cast("string") for p in parts]), F.lit("\t|"))
    return readers.read_taxdump(s, _lines(table(s, d, "customer").select(row.alias("value")), _path(s, "nodes")))


@query("""SELECT 'UniProtKB' AS db, 'P' || l_partkey AS db_object_id, 'g' || l_suppkey AS db_object_symbol, 'enables' AS relation, 'GO:' || l_orderkey AS go_id, 'PMID:1' AS db_reference, 'IDA' AS evidence_code, NULL::VARCHAR AS with_from, l_linestatus AS aspect, 'a protein' AS db_object_name, NULL::VARCHAR AS db_object_synonym, 'protein' AS db_object_type, 'taxon:9' AS taxon, '20200101' AS date, l_returnflag AS assigned_by, NULL::VARCHAR AS annotation_extension, NULL::VARCHAR AS gene_product_form_id FROM lineitem""")
def read_gaf(s, d):
    row = _tsv(F.lit("UniProtKB"), F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("g"), "l_suppkey"), F.lit("enables"),
        F.concat(F.lit("GO:"), "l_orderkey"), F.lit("PMID:1"), F.lit("IDA"), F.lit(""), "l_linestatus", F.lit("a protein"), F.lit(""),
            F.lit("protein"), F.lit("taxon:9"), F.lit("20200101"), "l_returnflag", F.lit(""), F.lit(""))
    lines = table(s, d, "lineitem").select(row.alias("value"))
    return readers.read_gaf(s, _lines(s.createDataFrame([("!gaf-version: 2.2",)], "value string").unionByName(lines), _path(s, "gaf")))


@query("""SELECT 'SAMN' || c_custkey AS acc, list_value('iso ' || c_nationkey, c_mktsegment) AS strains, c_name AS host FROM customer""")
def read_native_records(s, d):
    c = table(s, d, "customer")
    text = F.concat(F.col("c_custkey").cast("string"), F.lit(": a sample\nAttributes:\n    /strain=\"iso "),
        F.col("c_nationkey").cast("string"), F.lit("\"\n    /host=\""), "c_name", F.lit("\"\n    /strain=\""), "c_mktsegment",
            F.lit("\"\nAccession: SAMN"), F.col("c_custkey").cast("string"), F.lit("\tID: 1"))
    found = readers.read_native_records(s, _lines(c.select(text.alias("value")), _path(s, "records"), "\n\n"))
    return found.select("acc", F.col("attrs")["strain"].alias("strains"), F.get(F.col("attrs")["host"], F.lit(0)).alias("host"))


@query("""SELECT 'PRJ' || p_partkey AS acc, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS organism FROM part""")
def read_project_records(s, d):
    p = table(s, d, "part")
    organism = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Organism: "), "p_type", F.lit("\n"))).otherwise("")
    text = F.concat(F.col("p_partkey").cast("string"), F.lit(". "), "p_name", F.lit("\n"), organism, F.lit("Accession: PRJ"),
        F.col("p_partkey").cast("string"))
    return readers.read_project_records(s, _lines(p.select(text.alias("value")), _path(s, "projects"), "\n\n"))


@query("""SELECT 'GCA_' || s_suppkey AS assembly_accession, s_name AS organism_name, s_nationkey::VARCHAR AS species_taxid FROM supplier""")
def read_assembly_details(s, d):
    rows = table(s, d, "supplier").select(F.lit(2).alias("o"), _tsv(F.concat(F.lit("GCA_"), "s_suppkey"), "s_name", "s_nationkey",
        F.lit("")).alias("value"))
    head = s.createDataFrame([(0, "##  see the list of columns"), (1, "#assembly_accession\torganism_name\tspecies_taxid\t")],
        "o int, value string")
    lines = head.unionByName(rows).repartitionByRange(1, "o").sortWithinPartitions("o")
    return readers.read_assembly_details(s, _lines(lines, _path(s, "assemblies")))


@query("""SELECT DISTINCT c_mktsegment AS id FROM customer""")
def read_id_list(s, d):
    lines = table(s, d, "customer").select(F.concat(F.lit("  "), "c_mktsegment").alias("value")).unionByName(
        table(s, d, "customer").select(F.lit("  ").alias("value")))
    return readers.read_id_list(s, _lines(lines, _path(s, "ids")))


@query(f"""WITH k AS (SELECT doc_id, nullif(lang, 'en') AS gene, {_DNA} AS q, row_number() OVER (ORDER BY doc_id, {_DNA}) AS n FROM documents WHERE lang <> 'en') SELECT 'MM' || n AS id, q AS sequence, doc_id, gene FROM k""")
def write_fasta(s, d):
    docs = table(s, d, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("gene"), _seq().alias("sequence"))
    path = _path(s, "out")
    meta = writers.write_fasta(docs, path, required=("gene",), uid="doc_id")
    found = readers.read_fasta(s, _named(s, path, ".fasta"), "plain")
    return found.join(meta.withColumnRenamed("accession", "id"), "id").select("id", "sequence", "doc_id", "gene")


def _store_rows(s, d, lo: int, hi: int, shift: float = 0.0) -> DataFrame:
    e = table(s, d, "embeddings").where((F.col("label") >= lo) & (F.col("label") < hi))
    token = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return e.select(F.col("vec_id").cast("string").alias("key"), F.transform("embedding", lambda v: (v + shift).cast("float")).alias("seq"),
        token.alias("token"), F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")).alias("token_idx"),
            F.lit(None).cast("array<float>").alias("token_pr"))


@query("""SELECT vec_id::VARCHAR AS key, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings""")
def store_append(s, d):
    path = _path(s, "store")
    for lo, hi in ((0, 3), (3, 7), (7, 1 << 30)):
        writers.store_append(path, _store_rows(s, d, lo, hi))
    total = F.aggregate("seq", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rounded(store.open_store(s, path).select("key", total.alias("total")), "total", places=5)


@query(f"""SELECT vec_id::VARCHAR AS key, {drawn_unit(0, 'token', 'vec_id')} < 0.4 AS has_token, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings""")
def store_rewrite(s, d):
    path, out = _path(s, "store"), _path(s, "rewritten")
    for _ in range(2):  # every key twice
        writers.store_append(path, _store_rows(s, d, 0, 1 << 30))
    writers.store_rewrite(s, path, out, 100, token_prop=0.4)
    total = F.aggregate("seq", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rounded(store.open_store(s, out).select("key", (F.col("token").isNotNull() & F.col("token_idx").isNotNull()).alias("has_token"),
        total.alias("total")), "total", places=5)


@query("""SELECT vec_id::VARCHAR AS key, 8 AS tokens FROM embeddings""")
def store_combine(s, d):
    a, b, out = _path(s, "store"), _path(s, "store"), _path(s, "combined")
    writers.store_append(a, _store_rows(s, d, 0, 6))
    writers.store_append(b, _store_rows(s, d, 4, 1 << 30))
    writers.store_combine(s, [a, b], out)
    return store.open_store(s, out).select("key", F.size("token").alias("tokens"))


@query("""WITH k AS (SELECT vec_id, label, unnest(range(0, 8)) AS i, embedding FROM embeddings) SELECT vec_id, label, i AS token_idx, round(list_sum(CAST(embedding[i * 8 + 1:i * 8 + 8] AS DOUBLE[])), 5) AS total FROM k""")
def token_dataset(s, d):
    keys = table(s, d, "embeddings").select("vec_id", "label", F.col("vec_id").cast("string").alias("k"),
        F.lit(None).cast("string").alias("never"))
    tokens = store.to_dataset(keys, "k", _store_rows(s, d, 0, 1 << 30), "token")
    if "never" in tokens.columns:
        raise AssertionError("a column without a value stays")
    return rounded(tokens.select("vec_id", "label", "token_idx",
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")), "total", places=5)


@query(f"""WITH k AS (SELECT vec_id, {drawn(0, 'one', 'vec_id')} % 8 AS i, embedding FROM embeddings) SELECT vec_id::VARCHAR AS key, CAST(i AS INTEGER) AS index, round(list_sum(CAST(embedding[i * 8 + 1:i * 8 + 8] AS DOUBLE[])), 5) AS total FROM k""")
def one_token(s, d):
    one = store.token_view(_store_rows(s, d, 0, 1 << 30), one_per_key=True)
    return rounded(one.select("key", "index", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")), "total",
        places=5)


@query("""WITH k AS (SELECT vec_id, unnest(range(0, 8)) AS i, embedding FROM embeddings)
SELECT vec_id::VARCHAR AS key, CAST(i AS INTEGER) AS index, round(list_sum(CAST(embedding[i * 8 + 1:i * 8 + 8] AS DOUBLE[])), 5) AS total FROM k""")
def all_tokens(s, d):
    """Every token of every key of a store as a row."""
    path = _path(s, "store")
    writers.store_append(path, _store_rows(s, d, 0, 1 << 30))
    every = store.token_view(store.open_store(s, path))
    return rounded(every.select("key", "index", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")), "total",
        places=5)


@query(f"""WITH k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY {drawn(0, 'token', 'vec_id', 'i')}, i) AS r FROM (SELECT vec_id, unnest(range(0, 8)) AS i FROM embeddings)) SELECT vec_id::VARCHAR AS key, list(i ORDER BY i) AS token_idx FROM k WHERE r <= 3 GROUP BY 1""")
def sample_tokens(s, d):
    return sequences.sample_tokens(_store_rows(s, d, 0, 1 << 30), 3).select("key", "token_idx")


@query("""SELECT 'c' || l_orderkey || '_' || l_suppkey || ':' || l_partkey || '-' || l_partkey + 9 AS uid, 'f' || l_suppkey AS stem FROM lineitem""")
def uids(s, d):
    li = table(s, d, "lineitem").select(F.concat(F.lit("c"), "l_orderkey").alias("sample"), F.col("l_suppkey").alias("seqid"),
        F.col("l_partkey").alias("start"), (F.col("l_partkey") + 9).alias("stop"))
    return li.select(C.make_uid().alias("uid"), C.strip_sequence_suffix(F.concat(F.lit("/a/b/f"), "seqid", F.lit(".fna.gz"))).alias("stem"))


@query("""SELECT doc_id, coalesce(lang, 'unknown') AS lang FROM documents""")
def fill_label(s, d):
    return table(s, d, "documents").select("doc_id", C.fill_label("lang").alias("lang"))


@query("""SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN v > 0.2 OR v < -0.2 THEN 0 ELSE v END)), 6) AS total FROM embeddings""")
def clean_vectors(s, d):
    spoilt = F.transform("embedding", lambda v: F.when(v > 0.2, float("nan")).when(v >= -0.2, v.cast("double")))
    clean = table(s, d, "embeddings").select("vec_id", C.clean_vector(spoilt).alias("x"))
    return rounded(clean.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


@query("""SELECT p_partkey, round(CASE p_size % 6 WHEN 0 THEN 1.2 WHEN 1 THEN 1.2 WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 WHEN 4 THEN 1.0 END * CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 1.0 END * CASE p_partkey % 5 WHEN 0 THEN 1.2 WHEN 1 THEN 1.3 WHEN 2 THEN 1.1 WHEN 3 THEN 1.0 END * p_retailprice, 4) AS score FROM part""")
def genome_score(s, d):
    names = lambda table, at: F.get(F.array(*[F.lit(k) for k in table], F.lit("something else")), at)
    p = table(s, d, "part").select("p_partkey", names(C.ANI_STATUS_FACTORS, F.col("p_size") % 6).alias("status"),
        F.when(F.col("p_partkey") % 2 == 0, "reference genome").alias("category"),
            names(C.LEVEL_FACTORS, (F.col("p_partkey") % 5).cast("int")).alias("level"), F.col("p_retailprice").alias("ani"))
    return rounded(p.select("p_partkey", C.genome_score("status", "category", "level", "ani").alias("score")), "score", places=4)


_GROUPS = {c: "vowel" if c in "AEIOU" else "other" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@query(f"""WITH s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark), l AS (SELECT item_id,
 generate_subscripts(x, 1) - 1 AS i, unnest(x) AS c FROM (SELECT item_id, string_split(seq, '') AS x FROM s WHERE length(seq) > 0)),
 g AS (SELECT *, CASE WHEN c IN ('A', 'E', 'I', 'O', 'U') THEN 'AEIOU' ELSE 'BCDFGHJKLMNPQRSTVWXYZ' END AS same FROM l),
o AS (SELECT *, replace(same, c, '') AS others, {drawn_unit(0, 'where', 'item_id', 'i')} < 0.1 AS change,
 {drawn_unit(0, 'which', 'item_id', 'i')} AS u FROM g)
SELECT item_id, string_agg(CASE WHEN change THEN substr(others, CAST(floor(u * length(others)) AS BIGINT) + 1, 1) ELSE c END, ''
 ORDER BY i) AS seq FROM o GROUP BY 1""")
def substitute(s, d):
    b = table(s, d, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")).where("seq <> ''")
    return sequences.substitute(b, "item_id", "seq", {}, rate=0.1, groups=_GROUPS)


_RESIDUE = f"substr('{C.CODE_RESIDUES}', CAST(16 * strpos('TCAG', substr(c, 1, 1)) + 4 * strpos('TCAG', substr(c, 2, 1)) + strpos('TCAG', substr(c, 3, 1)) - 20 AS BIGINT), 1)"


@query(f"""WITH q AS (SELECT doc_id, {_DNA} AS q FROM documents), l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS c
 FROM (SELECT doc_id, regexp_extract_all(q, '.{{3}}') AS x FROM q)), u AS (SELECT c, {_RESIDUE} AS r, count(*) AS n FROM l GROUP BY ALL),
 b AS (SELECT r, c AS best FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, c) AS k FROM u) WHERE k = 1),
w AS (SELECT doc_id, string_agg(best, '' ORDER BY i) AS body FROM l JOIN u USING (c) JOIN b USING (r) GROUP BY 1) SELECT doc_id,
 md5(coalesce(body, '') || substr(q, length(q) // 3 * 3 + 1)) AS digest FROM q LEFT JOIN w USING (doc_id)""")
def best_codon(s, d):
    q = table(s, d, "documents").select("doc_id", _seq().alias("q"))
    done = sequences.best_codon(q, "q", sequences.codon_usage(q, "q"))
    return done.select("doc_id", F.md5(F.col("q").cast("binary")).alias("digest"))
