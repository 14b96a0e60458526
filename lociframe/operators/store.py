"""The content-addressed embedding store (EM, UD1): ``key, seq, token, token_idx, token_pr``.

A store is laid out by a hash of the key: a folder ``bucket_<n>=<b>`` for each of ``n`` buckets, rows sorted by key. What is asked
for names its buckets, at most ``n`` numbers, and the others' files are not read; a flat folder of files is a store as well, read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from .curate import drop_null_columns
from .sequences import expand_max_len, one_token, permute_seq, pool_pieces, random_seq, substitute
from .sets import dedup

SCHEMA = "key string, seq array<float>, token array<array<float>>, token_idx array<long>, token_pr array<float>"
#: Buckets of a new store: enough that a few keys read a small share, few enough that each is more than a file.
BUCKETS = 64
Embedder = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray | None]]]


def _embed(fn: Embedder, level: str, pooling: str, amount: int | float | None, save_proba: bool,
    batch: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("key", pa.string()), ("seq", pa.list_(pa.float32())), ("token", pa.list_(pa.list_(pa.float32()))),
        ("token_idx", pa.list_(pa.int64())), ("token_pr", pa.list_(pa.float32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                keys = whole.column(0).slice(i, batch).to_pylist()
                rows = []
                for key, (tokens, proba) in zip(keys, fn(keys), strict=True):
                    tokens = np.asarray(tokens, np.float32)
                    seq = None
                    if level in ("seq", "both") and len(tokens):
                        seq = getattr(tokens, pooling)(axis=0)
                    idx = np.arange(len(tokens))
                    if level in ("token", "both") and amount is not None:
                        n = amount if isinstance(amount, int) else int(np.ceil(len(tokens) * amount))
                        seed = int.from_bytes(__import__("hashlib").sha256(key.encode()).digest()[:8], "little")
                        idx = np.sort(np.random.default_rng(seed).permutation(len(tokens))[:n])
                    token = tokens[idx] if level in ("token", "both") else None
                    rows.append({"key": key, "seq": None if seq is None else seq.tolist(), "token": None if token is None
                        else token.tolist(), "token_idx": None if token is None else idx.tolist(),
                            "token_pr": np.asarray(proba, float)[idx].tolist() if save_proba and proba is not None else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def layout(store: DataFrame) -> int | None:
    """The number of buckets of a store's rows as read, None for a flat one."""
    named = [int(m[1]) for c in store.columns if (m := re.fullmatch(r"bucket_(\d+)", c))]
    return named[0] if named else None


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("store"), F.col(key) if isinstance(key, str) else key), F.lit(buckets)).cast("int")


def open_store(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows, none where nothing has been written yet; a laid-out store's bucket is a column more."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMA).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def write_rows(df: DataFrame, store: str, buckets: int = BUCKETS, mode: str = "append", most: int | None = None) -> None:
    """Rows of the store's columns written as it is laid out, or in ``buckets`` if it is new; files have at most ``most`` rows."""
    spark = df.sparkSession
    there = open_store(spark, store)
    old, flat = layout(there), bool(there.inputFiles())
    n = old or buckets
    rows = df.select(*[c for c in df.columns if not c.startswith("bucket_")])
    if mode == "append" and flat and old is None:
        rows.write.mode(mode).parquet(store)
        return
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"bucket_{n}"
    # a bucket is one task, or several where there are more tasks than buckets
    dealt = rows.withColumn(name, bucket_of("key", n)).repartition(parts, name,
        F.pmod(F.hash("key"), F.lit(max(1, parts // n)))).sortWithinPartitions(name, "key")
    writer = dealt.write.mode(mode).partitionBy(name)
    (writer.option("maxRecordsPerFile", most) if most else writer).parquet(store)


def with_buckets_of(store: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A laid-out store without the files of buckets that none of ``wanted``'s keys has; a flat one as it is."""
    n = layout(store)
    if not n:
        return store
    held = [r[0] for r in wanted.where(F.col(key).isNotNull()).select(bucket_of(key, n).alias("b")).distinct()
        .collect()]  # n numbers at most
    return store.where(F.col(f"bucket_{n}").isin(held)) if len(held) < n else store


def asked_for(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The store's rows whose key is among ``keys``; of a laid-out store only the keys' buckets are read."""
    wanted = keys.select(F.col(key).cast(store.schema["key"].dataType).alias("_key")).where("_key is not null").distinct()
    if layout(store):
        wanted = materialise(wanted)
    return with_buckets_of(store, wanted, "_key").join(wanted, F.col("key") == F.col("_key"), "left_semi")


def embed_missing(df: DataFrame, text: str, store: str, fn: Embedder, level: str = "seq", pooling: str = "mean",
    token_amount: int | float | None = None, save_proba: bool = False, batch: int = 256) -> None:
    """EM1: distinct texts that the store lacks, embedded in batches by ``fn`` and appended."""
    spark = df.sparkSession
    texts = df.select(F.col(text).alias("key")).where("key is not null").distinct()
    have = asked_for(open_store(spark, store), texts, "key").select("key")
    todo = texts.join(have, "key", "left_anti")
    todo = todo.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key")
    write_rows(todo.mapInArrow(_embed(fn, level, pooling, token_amount, save_proba, batch), SCHEMA), store)


def embed_long(df: DataFrame, text: str, id: str, store: str, fn: Embedder, max_len: int, pooling: str = "mean",
    agg: str = "mean") -> DataFrame:
    """EM2: texts cut to the model's length, embedded, and pooled back to ``id, x``."""
    embed_missing(expand_max_len(df, text, id, max_len).where("piece is not null"), "piece", store, fn, "seq", pooling)
    return pool_pieces(df, open_store(df.sparkSession, store), text, id, max_len, agg)


def to_dataset(df: DataFrame, key: str, store: DataFrame, level: str = "seq") -> DataFrame:
    """EM3: rows with their vectors as ``x``, a row a token at token level; columns without a value are dropped."""
    one = dedup(asked_for(store, df, key).select(*[c for c in store.columns if not c.startswith("bucket_")]),
        ["key"]).withColumnRenamed("key", "_key")
    joined = df.join(one, F.col(key) == F.col("_key")).drop("_key")
    if level == "seq":
        return drop_null_columns(joined.withColumnRenamed("seq", "x").drop("token", "token_idx", "token_pr"))
    rows = joined.select(*df.columns, F.explode(F.arrays_zip("token", "token_idx")).alias("t")).select(*df.columns,
        F.col("t.token").alias("x"), F.col("t.token_idx").alias("token_idx"))
    return drop_null_columns(rows)


def token_view(df: DataFrame, one_per_key: bool = False, seed: int = 0) -> DataFrame:
    """EM4: all tokens of a key as rows, or a stable single one."""
    if one_per_key:
        return one_token(df, seed)
    return df.select(*[c for c in df.columns if not c.startswith("token")], F.posexplode("token").alias("index", "x"))


def variants(df: DataFrame, id: str, seq: str, specs: Sequence[Mapping], seed: int = 0) -> DataFrame:
    """EM5: the texts as they are and changed by each spec, told apart by ``variation`` and ``method``."""
    out = df.withColumn("variation", F.lit("natural")).withColumn("method", F.lit("none"))
    for spec in specs:
        kind, kw = spec["method"], {k: v for k, v in spec.items() if k not in ("method", "variation")}
        made = {"permute": permute_seq, "random": random_seq, "substitute": substitute}[kind](df, id, seq, seed=seed, **kw)
        out = out.unionByName(made.withColumn("variation", F.lit(spec.get("variation", "perturbed"))).withColumn("method", F.lit(kind)))
    return out
