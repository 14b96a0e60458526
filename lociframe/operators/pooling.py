"""Pooling of vectors to groups (AG20-AG25), the vector aggregates by position or by Summarizer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import draw
from ..scratch import few_rows, materialise

#: The names of the scores.
SCORES = ("cosine_distance", "cosine_similarity", "dot_product", "euclidean_distance", "euclidean_similarity", "manhattan_distance")


def _summary(df: DataFrame, by: Sequence[str], x: str, what: str) -> DataFrame:
    v = array_to_vector(F.col(x).cast("array<double>"))
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(vector_to_array(getattr(Summarizer, what)(v)).alias("x"),
        F.count("*").alias("n"))


def pool_mean(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """AG20: partial sums of whole vectors, never exploded."""
    return _summary(df, by, x, "mean")


def pool_sum(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return _summary(df, by, x, "sum")


def pool_max(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return _summary(df, by, x, "max")


def pool_similarity(df: DataFrame, by: Sequence[str], x: str, metric: str = "euclidean_distance", agg: str = "mean",
    uid: str | None = None) -> DataFrame:
    """AG21: each vector times the mean, sum or max of its scores against its group (its own raw score counts as 0), then summed.

    Cosine and dot scores with mean or sum follow from the group's summed vector. The others compare
    all rows of a group: its vectors are dealt to chunks, pairs of chunks are compared in numpy, and
    weights are summed over chunks.
    """
    if metric not in SCORES or agg not in ("mean", "sum", "max"):
        raise ValueError(f"no such pooling: {metric}, {agg}")
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("array<double>").alias("_x"))
    if agg != "max" and metric in ("cosine_distance", "cosine_similarity", "dot_product"):
        return _by_sum(rows, list(by), metric, agg)
    return _pairwise(rows, by, metric, agg)


def _weighted_sum(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of ``_w`` times the vector ``_x``, multiplied by numpy a batch at a time."""
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def run(batches):
        for batch in batches:
            x, w = batch.column(batch.schema.get_field_index("_x")), batch.column(batch.schema.get_field_index("_w"))
            off = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            y = x.flatten().to_numpy(zero_copy_only=False) * np.repeat(w.to_numpy(zero_copy_only=False), np.diff(off))
            lists = pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array(y))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(b)) for b in by], lists], names=[*by, "_y"])

    return _summary(rows.select(*by, "_x", "_w").mapInArrow(run, f"{kinds}, _y array<double>"), by, "_y", "sum")


def _by_sum(rows: DataFrame, by: list[str], metric: str, agg: str) -> DataFrame:
    """Cosine and dot scores, each row's against the sum of its group's vectors, in one pass of numpy a row."""
    unit = metric != "dot_product"
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def norms(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_x")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_row_sums(batch.column(at), batch.column(at)))],
                names=[*batch.schema.names, "_n2"])

    named = rows.mapInArrow(norms, f"{kinds}, _x array<double>, _n2 double")
    scale = F.sqrt("_n2") if unit else F.lit(1.0)
    total = named.where(F.col("_n2") > 0) if unit else named
    total = total.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("_x"), (1 / scale) if unit else F.lit(1.0))).alias("_s"))
    total = total.join(rows.groupBy(*by).agg(F.count("*").alias("_k")), by)

    def weights(batches):
        for batch in batches:
            x, s, n2, k = (batch.column(batch.schema.get_field_index(c)) for c in ("_x", "_s", "_n2", "_k"))
            n2, k = n2.to_numpy(), k.to_numpy()
            raw = _row_sums(x, s)
            with np.errstate(divide="ignore", invalid="ignore"):
                raw = raw / np.sqrt(n2) - 1 if unit else raw - n2  # without its own
            score = k - raw if metric == "cosine_distance" else raw
            keep = [batch.column(batch.schema.get_field_index(b)) for b in by]
            yield pa.RecordBatch.from_arrays([*keep, x, pa.array(score / k if agg == "mean" else score)], names=[*by, "_x", "_w"])

    weighted = named.join(total, by).select(*by, "_x", "_s", "_n2", "_k").mapInArrow(weights, f"{kinds}, _x array<double>, _w double")
    return _weighted_sum(weighted, by)


def _row_sums(x: pa.Array, y: pa.Array) -> np.ndarray:
    """The dot product of each pair of lists, as double precision."""
    off = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    a, b = (v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in (x, y))
    if len(a) != len(b):
        raise ValueError("vectors of a group differ in length")
    row = np.repeat(np.arange(len(x)), np.diff(off))
    return np.bincount(row, a * b, len(x))


CHUNK_ROWS = 1024
#: Chunks that one chunk of rows is compared with where it is sent once.
RUN_CHUNKS = 32
#: Rows of two chunks that reach a worker at a time, and bytes of chunks that a file's part holds.
WORK_ROWS = 4
WORK_BYTES = 16 << 20


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of the one list of ``_id, _x`` in a column."""
    some = column.flatten()
    ids = some.field("_id").to_numpy()
    return ids, some.field("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(float)


def _pairwise(rows: DataFrame, by: Sequence[str], metric: str, agg: str) -> DataFrame:
    """Weights by pairs of chunks of a group: a chunk travels once to each ``RUN_CHUNKS`` chunks that it is compared with, and a weight a row is what leaves them."""
    keys, spark = list(by), rows.sparkSession
    sizes = materialise(rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_k", F.ceil(F.col("_n") / CHUNK_ROWS).cast("int")))
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()))  # ids stay as they are wherever rows are read
    dealt = rows.join(sizes, keys).withColumn("_chunk", F.pmod("_id", F.col("_k")).cast("int"))
    chunks = materialise(dealt.groupBy(*keys, "_k", "_n", "_chunk").agg(F.collect_list(F.struct("_id", "_x")).alias("_rows")), WORK_BYTES)
    runs = F.ceil(F.col("_k") / RUN_CHUNKS).cast("int")
    every = sizes.agg(F.sum(runs)).first()[0] or 1
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    deals = F.least(F.col("_k"), F.lit(max(1, min(RUN_CHUNKS // 2, -(-parts // every)))))
    left = chunks.select(*keys, "_n", "_chunk", "_rows", F.pmod("_chunk", deals).alias("_deal"),
        F.explode(F.sequence(F.lit(0), runs - 1)).alias("_run"))
    right = chunks.select(*[F.col(b).alias(f"_{b}") for b in keys], F.col("_chunk").alias("_chunk2"), F.col("_rows").alias("_rows2"),
        F.floor(F.col("_chunk") / RUN_CHUNKS).cast("int").alias("_run2"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("_deal2"))
    on = [F.col(b) == F.col(f"_{b}") for b in keys] + [F.col("_run") == F.col("_run2"), F.col("_deal") == F.col("_deal2")]
    pairs = left.join(right, on).select("_n", "_chunk", "_chunk2", "_rows", "_rows2")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                (ida, x), (idb, y) = _members(one.column("_rows")), _members(one.column("_rows2"))
                if metric.startswith("cosine") or metric == "dot_product":
                    u, v = (x, y) if metric == "dot_product" else (x / np.linalg.norm(x, axis=1, keepdims=True),
                        y / np.linalg.norm(y, axis=1, keepdims=True))
                    raw = u @ v.T
                elif metric.startswith("euclidean"):
                    raw = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
                else:
                    raw = np.stack([np.abs(y - r).sum(1) for r in x])
                if one.column("_chunk")[0].as_py() == one.column("_chunk2")[0].as_py():
                    raw[ida[:, None] == idb[None, :]] = 0
                score = 1 - raw if metric == "cosine_distance" else 1 / (1 + raw) if metric == "euclidean_similarity" else raw
                w = score.max(1) if agg == "max" else score.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ida), pa.array(np.full(len(ida), one.column("_n")[0].as_py())), pa.array(w)],
                    names=["_id", "_n", "_w"])

    with few_rows(spark, WORK_ROWS):
        merged = materialise(pairs.mapInArrow(run, "_id long, _n long, _w double").groupBy("_id", "_n").agg(
            (F.max if agg == "max" else F.sum)("_w").alias("_w")))
    weight = F.col("_w") / F.col("_n") if agg == "mean" else F.col("_w")
    return _weighted_sum(rows.join(merged.select("_id", weight.alias("_w")), "_id").select(*keys, "_x", "_w"), keys)


def pool_concat(df: DataFrame, by: Sequence[str], x: str, order: str = "seqindex") -> DataFrame:
    """AG22: a group's vectors end to end in ``order``, padded with zeros to the longest."""
    joined = df.groupBy(*by).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(x).alias("_x")))), lambda s: s["_x"])).alias("x"),
            F.count("*").alias("n"))
    longest = joined.agg(F.max(F.size("x")).alias("_max"))
    return joined.join(F.broadcast(longest)).select(*by,
        F.concat("x", F.array_repeat(F.lit(0.0).cast("double"), (F.col("_max") - F.size("x")).cast("int"))).alias("x"), "n")  # one row


def pool_priority(df: DataFrame, by: Sequence[str], x: str, label: str, priority: Sequence[str], how: str = "mean",
    order: str | None = None) -> DataFrame:
    """AG23: only a group's rows of the best label by ``priority`` (unlisted last): their mean or max, or the first row by ``order``."""
    place = reduce(lambda w, kv: w.when(F.col(label) == kv[1], kv[0]), enumerate(priority), F.when(F.lit(False), 0)).otherwise(
        len(priority))
    ranked = df.withColumn("_p", place)
    best = ranked.groupBy(*by).agg(F.min("_p").alias("_best"))
    top = ranked.join(best, list(by)).where("_p = _best")
    if how == "one":
        return top.groupBy(*by).agg(F.min_by(x, order or F.xxhash64(x)).alias("x"), F.count("*").alias("n"))
    return _summary(top, by, x, how)


def pool_random(df: DataFrame, by: Sequence[str], x: str, n_per: int, how: str = "mean", id: str = "uid", seed: int = 0) -> DataFrame:
    """AG24: ``n_per`` rows of each group by a seeded hash of their id."""
    w = Window.partitionBy(*by).orderBy(draw(seed, "pool", id), id)
    return _summary(df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n_per), by, x, how)


def pool(df: DataFrame, by: Sequence[str] | str, x: str, method: str = "mean", **kw) -> DataFrame:
    """AG20-AG24 by name."""
    by = [by] if isinstance(by, str) else list(by)
    return {"mean": pool_mean, "sum": pool_sum, "max": pool_max, "similarity": pool_similarity, "concat": pool_concat,
        "seq_subset": pool_priority, "random": pool_random}[method](df, by, x, **kw)


def pool_with_obs(df: DataFrame, by: Sequence[str], x: str, method: str, obs: Sequence[str], order: str, **kw) -> DataFrame:
    """AG25: pooled vectors with the first value of each observation by ``order``."""
    first = df.groupBy(*by).agg(*[F.min_by(o, order).alias(o) for o in obs])
    return pool(df, by, x, method, **kw).join(first, list(by))
