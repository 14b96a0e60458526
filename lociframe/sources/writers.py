"""Sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seeded import unit


def write_table(df: DataFrame, path: str, fmt: str = "parquet", null_value: str = "NA", mode: str = "overwrite") -> None:
    """SNK1: parquet, csv or tsv; nulls of text formats are written as ``null_value``."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", "true").option("nullValue", null_value).option("sep", "\t" if fmt == "tsv" else ",").csv(path)


def write_fasta(df: DataFrame, path: str, seq_col: str = "sequence", required: tuple[str, ...] = ("gene", "product", "type"),
    uid: str = "uid") -> DataFrame:
    """SNK2: rows with any of ``required`` as FASTA text; the metadata with their accessions comes back.

    Accessions ``MM<n>`` number the rows by ``uid`` over range partitions, not in one task.
    """
    from ..operators.windows import row_index

    kept = row_index(df.where(F.coalesce(*[F.col(c).cast("string") for c in required]).isNotNull()), [uid, seq_col], "n")
    kept = kept.withColumn("accession", F.concat(F.lit("MM"), F.col("n").cast("string"))).drop("n")
    kept.select(F.concat(F.lit(">"), "accession", F.lit("\n"), F.col(seq_col)).alias("value")).write.mode("overwrite").text(path)
    return kept.drop(seq_col)


def store_append(store: str, df: DataFrame) -> None:
    """SNK3: vectors as new files of the store, by the buckets of their keys."""
    from ..operators.store import write_rows

    write_rows(df, store)


def _unique(df: DataFrame, key: str = "key") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    w = Window.partitionBy(key).orderBy(F.xxhash64(*rest))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def store_rewrite(spark: SparkSession, store: str | list[str], out: str, n_rows: int = 100_000, token_prop: float | None = None,
    seed: int = 0) -> None:
    """SNK4: one row a key in files of at most ``n_rows``, written to a new path; a share of token matrices may be kept, the rest nulled."""
    from ..operators.store import write_rows

    each = [spark.read.option("mergeSchema", "true").parquet(p) for p in ([store] if isinstance(store, str) else store)]
    each = [e.select(*[c for c in e.columns if not c.startswith("bucket_")]) for e in each]
    df = _unique(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each))
    if token_prop is not None:
        keep = unit(seed, "token", "key") < token_prop
        for c in ("token", "token_idx"):
            if c in df.columns:
                df = df.withColumn(c, F.when(keep, F.col(c)))
    write_rows(df, out, mode="errorifexists", most=n_rows)


def store_combine(spark: SparkSession, stores: list[str], out: str, n_rows: int = 100_000) -> None:
    """SNK5: the union of stores, one row a key."""
    store_rewrite(spark, stores, out, n_rows)


def merge_runs(dfs: list[DataFrame], key: list[str] | None = None) -> DataFrame:
    """SNK6: union of all columns, then one row a key (the first by a hash of the rest)."""
    from ..operators.sets import dedup, union

    df = union(dfs, diagonal=True)
    return dedup(df, key) if key else df


def stack(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
