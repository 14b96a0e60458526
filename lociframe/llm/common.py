"""Helpers shared by the operators of this subpackage: staging, text blocks, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task holds as arrays at a time.
BLOCK_BYTES = 2 << 20
#: Rows of whole texts, or of their run sets, that reach a worker at a time where memory is short.
BATCH_ROWS = 512


_HELD: list[dict] = []


def held_by_worker(what: dict) -> dict:
    """A dictionary that a worker fills for later tasks, and that ``forget`` empties."""
    _HELD.append(what)
    return what


def forget() -> None:
    """A worker lives on from stage to stage: what other operators remembered there is let go, and free memory goes back to the system."""
    for what in _HELD:
        what.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a new local one only where that is unset and the session is local."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python workers get at most so many rows at a time: for rows that are large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever others there are."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_key(text: Column) -> Column:
    """What tells one text from another: a hash of it and its length; null is empty."""
    filled = F.coalesce(text, F.lit(""))
    return F.xxhash64(filled, F.octet_length(filled))


def rows_named(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``first`` (a written table of ``id, th, many``) names by ``doc_id`` and text; of equal ones (``many``) one.

    Whole texts are read once and meet ids; only where rows are repeated are those put together.
    """
    th = "__th"
    while th in docs.columns:
        th += "_"
    keyed = docs.withColumn(th, text_key(F.col("text")))

    def some(named: DataFrame) -> DataFrame:
        named = named.select(F.col("id").alias(f"{th}id"), F.col("th").alias(f"{th}own"))
        return keyed.join(named, (F.col(th) == F.col(f"{th}own")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{th}id")), "left_semi")

    if first.where("many").isEmpty():
        return some(first).drop(th)
    return some(first.where("not many")).unionByName(some(first.where("many")).dropDuplicates(["doc_id", th])).drop(th)


def buffers_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and bytes, of an Arrow array of strings or binaries."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(
        arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes) for runs of whole rows of about ``limit`` bytes of text; null texts are empty."""
    for batch in batches:
        arr = batch.column(batch.schema.get_field_index(column))
        if arr.null_count:
            arr = arr.fill_null("")
        if not len(arr):
            continue
        offs, raw = buffers_of(arr)
        at = 0
        while at < len(arr):
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), offs[at : end + 1] - offs[at], raw[offs[at] : offs[end]]
            at = end


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c,
        f in zip(columns, schema, strict=True)], schema=schema)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % n


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's edges, as edges to the smallest node."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                names=["a", "b"])


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the least neighbour of their ``a``; both are written tables, so that a node of very many edges can be split."""
    return edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of the edges ``a, b`` (longs): ``node, component`` (the smallest node).

    Alternating large-star and small-star rounds; each is a join and an aggregate on node ids whose
    result is written to the shared folder. Nodes without edges are not listed. Nulls are ignored. Rounds
    grow with the logarithm of a component's size; a ``RuntimeError`` tells if they did not suffice.
    """
    forward = only(edges, "a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(forward.mapInArrow(forest, "a long, b long").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        up = _stars(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(up.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct(), "large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        down = _stars(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")
    else:
        raise RuntimeError(f"components are not found after {max_rounds} rounds")
    each = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return each.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
