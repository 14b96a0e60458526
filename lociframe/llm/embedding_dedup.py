"""Operator 6: near-duplicate vectors by collision-counting projections.

Equal vectors are one class. Classes are projected on many random lines and, in every table, sorted along
them: a pair of vectors collides on a line if one lies in the window around the other, collisions are
counted over the ``WINDOWS`` lines of a table, and pairs with at least the calibrated count are verified by
cosine in double precision. The window of one line holds a fixed share of all vectors however many there
are, so each table first deals the vectors by the cells of further lines, as many as keep a cell at about
``CELL_ROWS`` vectors. Differences along a line are normally distributed with the pair's distance, so the
chance that a pair at the limit meets the count is known: ``calibrate`` takes the largest count that
``KEEP`` of such pairs reach, and so many tables that at most ``MISS`` of them fail in all.

A group of near copies would be pairs without number. Classes within the limit of the first one of
their cell are therefore a ball; balls meet as intervals along the lines, and two that meet are verified by
products of blocks of at most ``BLOCK`` members, which give link counts and a spanning forest in place of
pairs. Members within half the limit's angle of their leader are all linked to each other, which needs no
product. Cells with over ``SPLIT`` balls are split into pairs of parts.

Vectors that are null, empty, all zero or hold null, NaN or infinite components link with nothing and form a
component of their own; vectors of different lengths are never linked; repeated ids keep a row each, a
row without an id has a null component unless it is linked to one with an id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, components, only, parts, stage

COSINE = 0.95
CELL = 2.0
CELL_ROWS = 16
WINDOWS = 10
REACH = 1.5
KEEP = 0.96
MISS = 0.002
ROWS = 2048
BLOCK = 256
BLOCK_ROWS = 128
SPLIT = 8192
PAIR_ROWS = 1 << 18


def same_cell(cosine: float) -> float:
    """The chance of a pair at the limit to lie in one cell of a line."""
    far = math.sqrt(2 - 2 * cosine)
    steps = np.linspace(0, CELL, 401)
    density = np.exp(-((steps / far) ** 2) / 2) * 2 / (far * math.sqrt(2 * math.pi))
    return float(np.sum(density * (1 - steps / CELL)) * (steps[1] - steps[0]))


def reaches(count: int, cosine_windows: int = WINDOWS) -> float:
    """The chance of a pair at the limit to collide on at least ``count`` of the lines."""
    q = math.erf(REACH / math.sqrt(2))
    return sum(math.comb(cosine_windows, i) * q**i * (1 - q) ** (cosine_windows - i) for i in range(count, cosine_windows + 1))


def calibrate(n: int, cosine: float, keep: float = KEEP, miss: float = MISS) -> tuple[int, int, int]:
    """(lines that deal a table, tables, least count of collisions) for ``n`` vectors."""
    lines = max(4, math.ceil(math.log(max(2, n / CELL_ROWS)) / math.log(2.5)))
    count = max(c for c in range(WINDOWS + 1) if reaches(c) >= keep)
    p = same_cell(cosine) ** lines * reaches(count)
    return lines, max(1, math.ceil(math.log(miss) / math.log(1 - p))), count


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrices(batch: pa.RecordBatch, at: int, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as unit vectors) for each width in a batch."""
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            yield some, unit(batch.column(at).take(pa.array(some)).flatten().to_numpy().reshape(-1, w).astype(float))


def _cells(u: np.ndarray, lines: int, tables: int, seed: int) -> np.ndarray:
    """A number for the cell of each vector in each table (rows x tables)."""
    rng = np.random.default_rng([seed, u.shape[1]])
    axes, shift = rng.normal(size=(u.shape[1], lines * tables)), rng.uniform(0, CELL, (tables, lines))
    mix = rng.integers(1, 1 << 62, lines) | 1
    return (np.floor(((u @ axes).reshape(-1, tables, lines) + shift) / CELL).astype(np.int64) * mix).sum(2)


def cell_rows(lines: int, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (c, w, x) to (c, w, cell, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(1).to_numpy()
            cell = np.zeros(batch.num_rows, np.int64)
            for rows, u in matrices(batch, 2, width):
                cell[rows] = _cells(u, lines, 1, seed)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), batch.column(2)], names=["c", "w", "cell", "x"])

    return run


def lead_rows(cosine: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (c, w, lead, x, y) to (c, ball, inner): the leader's ball where it is near enough, else one's own."""
    half = math.cos(math.acos(cosine) / 2 - 1e-6)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, lead = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cos = np.zeros(len(c))
            for (rows, u), (_, v) in zip(matrices(batch, 3, batch.column(1).to_numpy()), matrices(batch, 4, batch.column(1).to_numpy()), strict=True):
                cos[rows] = (u * v).sum(1)
            near = (cos >= cosine) | (c == lead)
            inner = (cos >= half) | (c == lead) | ~near
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(near, lead, c)), pa.array(inner)], names=["c", "ball", "inner"])

    return run


def project_rows(lines: int, tables: int, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (ball, w, x), those of a ball together, to (w, tab, cell, ball, lo0, hi0, ...): the ball's interval on each line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls = batch.column(0).to_numpy()
            for rows, u in matrices(batch, 2, batch.column(1).to_numpy()):
                w, ball = u.shape[1], balls[rows]
                rng = np.random.default_rng([seed + 1, w])
                z = (u @ rng.normal(size=(w, tables * WINDOWS))).reshape(-1, tables, WINDOWS).astype(np.float32)
                cell = _cells(u, lines, tables, seed)
                for t in range(tables):
                    order = np.lexsort((cell[:, t], ball))
                    b, k, v = ball[order], cell[order, t], z[order, t]
                    first = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
                    lo, hi = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
                    cols = [pa.array(np.full(len(first), w, np.int32)), pa.array(np.full(len(first), t, np.int32)), pa.array(k[first]), pa.array(b[first])]
                    cols += [pa.array(x[:, j]) for j in range(WINDOWS) for x in (lo, hi)]
                    yield pa.RecordBatch.from_arrays(cols, names=["w", "tab", "cell", "ball", *[f"{x}{j}" for j in range(WINDOWS) for x in ("lo", "hi")]])

    return run


def collide_rows(reach: float, count: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (w, tab, cell, part, ball, lo0, hi0, ...), sorted by group and ``lo0``, to pairs of balls that collide often enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(5 + 2 * WINDOWS)]
            if not len(new[0]):
                continue
            old = 0 if held is None else len(held[0])
            if held is not None:
                new = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)]
            m, ball, lo, hi = len(new[0]), new[4], new[5::2], new[6::2]
            edge = np.zeros(m, bool)
            for x in new[:4]:
                edge[1:] |= x[1:] != x[:-1]
            group = np.cumsum(edge)
            wide = float((hi[0] - lo[0]).max())
            span = float(hi[0].max() - lo[0].min()) + 4 * (reach + wide)
            line = lo[0].astype(float) - float(lo[0].min()) + group * span
            first = np.searchsorted(line, line - reach - wide, "left")  # pairs of a row with rows before it
            some = np.arange(m) - first
            some[:old] = 0
            ends, done = np.cumsum(some), 0
            while done < m:
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIR_ROWS, "right")))
                k = some[done:upto]
                b = np.repeat(np.arange(done, min(upto, m)), k)
                a = np.repeat(first[done:upto], k) + np.arange(len(b)) - np.repeat(np.cumsum(k) - k, k)
                met = np.zeros(len(a), np.int8)
                for j in range(WINDOWS):
                    met += (lo[j][b] - hi[j][a] <= reach) & (lo[j][a] - hi[j][b] <= reach)
                keep = met >= count
                x, y = ball[a[keep]], ball[b[keep]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                done = upto
            keep = int(first[-1])
            held = [x[keep:] for x in new]

    return run


def linked(m: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number of each row's and column's component in a matrix of links."""
    la, lb = ca.copy(), cb.copy()
    none = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(m, lb[None, :], none).min(1, initial=none))
        nb = np.minimum(lb, np.where(m, na[:, None], none).min(0, initial=none))
        if (na == la).all() and (nb == lb).all():
            return na, nb
        la, lb = na, nb


def _members(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = column[row].values
    c, n = some.field("c").to_numpy(), some.field("n").to_numpy()
    return c, n, unit(some.field("x").flatten().to_numpy().reshape(len(c), -1).astype(float))


def verify_rows(cosine: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (same, left, right), blocks of members, to (c, k, low): vectors linked to a class, and the least class it is joined to.

    ``same``: the blocks are one and the same.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            same = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                ca, na, a = _members(batch.column(1), i)
                cb, nb, b = _members(batch.column(2), i)
                m = a @ b.T >= cosine
                if same[i]:
                    np.fill_diagonal(m, False)
                if not m.any():
                    continue
                la, lb = linked(m, ca, cb)
                for c, k, low in ((ca, m @ nb, la), (cb, na @ m, lb)) if not same[i] else ((ca, m @ nb, la),):
                    hit = k > 0
                    for col, v in zip(out, (c[hit], k[hit], low[hit]), strict=True):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["c", "k", "low"])

    return run


def classes_of(vectors: DataFrame, id: str = "vec_id", x: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with their class's vector, or null), and the classes ``h, x, first_id, n`` of usable vectors."""
    rows = only(vectors, id, x).select(F.col(id).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.withColumn("x", F.when((F.size("x") > 0) & ~bad & F.exists("x", lambda v: v != 0), F.col("x")))
    rows = rows.withColumn("h", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    return rows, rows.where("x is not null").groupBy("h", "x").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def balls_of(classes: DataFrame, n: int, cosine: float, seed: int) -> DataFrame:
    """``c, w, n, x, ball, inner`` of the classes: each in the ball of its cell's first class if that is within the limit."""
    lines = max(6, math.ceil(math.log(max(2, n)) / math.log(2.5)))
    dealt = stage(classes.select("c", "w", "x").mapInArrow(cell_rows(lines, seed), "c long, w int, cell long, x array<double>"), "dealt")
    leads = stage(dealt.groupBy("w", "cell").agg(F.min_by(F.struct("c", "x"), "c").alias("l"), F.count("*").alias("k")).where("k > 1").select("w", "cell", F.col("l.c").alias("lead"), F.col("l.x").alias("y")), "leads")
    met = dealt.join(leads, ["w", "cell"]).select("c", "w", "lead", "x", "y").mapInArrow(lead_rows(cosine), "c long, ball long, inner boolean")
    named = classes.join(met, "c", "left")
    return stage(named.select("c", "w", "n", "x", F.coalesce("ball", "c").alias("ball"), F.coalesce("inner", F.lit(True)).alias("inner")), "balls")


def candidate_balls(members: DataFrame, n: int, cosine: float, seed: int) -> DataFrame:
    """Pairs ``a, b`` of balls that collide often enough in some table."""
    spark = members.sparkSession
    lines, tables, count = calibrate(n, cosine)
    sides = [f"{x}{j}" for j in range(WINDOWS) for x in ("lo", "hi")]
    schema = "w int, tab int, cell long, ball long, " + ", ".join(f"{s} float" for s in sides)
    dealt = members.select("ball", "w", "x").sortWithinPartitions("ball").mapInArrow(project_rows(lines, tables, seed), schema)
    dealt = dealt.groupBy("w", "tab", "cell", "ball").agg(*[(F.min if s[0] == "l" else F.max)(s).alias(s) for s in sides])
    dealt = stage(dealt, "intervals")
    sizes = stage(dealt.groupBy("w", "tab", "cell").agg(F.count("*").alias("k")).where("k > 1"), "cells")
    split = F.ceil(F.col("k") / SPLIT).cast("int")
    own = F.pmod(F.xxhash64("ball"), split).cast("int")
    part = F.transform(F.sequence(F.lit(0), split - 1), lambda t: F.least(own, t) * 65536 + F.greatest(own, t))
    keyed = dealt.join(sizes, ["w", "tab", "cell"]).withColumn("part", F.explode(F.when(F.col("k") <= SPLIT, F.array(F.lit(0))).otherwise(part)))
    keyed = keyed.select("w", "tab", "cell", "part", "ball", *sides).repartition(parts(spark), "w", "tab", "cell", "part")
    met = keyed.sortWithinPartitions("w", "tab", "cell", "part", "lo0").mapInArrow(collide_rows(REACH * math.sqrt(2 - 2 * cosine), count), "a long, b long")
    return met.distinct()


def near_duplicates(vectors: DataFrame, id: str = "vec_id", x: str = "embedding", cosine: float = COSINE, seed: int = 6) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    rows, classes = classes_of(vectors, id, x)
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("w", F.size("x")), "classes")
    n = classes.count()
    members = balls_of(classes, n, cosine, seed)
    pairs = stage(candidate_balls(members, n, cosine, seed + 100), "pairs")
    sizes = members.groupBy("ball", "inner").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("inside"))
    sizes = stage(sizes, "sizes")
    sized = members.join(sizes, ["ball", "inner"])
    blocks = sized.groupBy("ball", "inner", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("c", "n", "x")).alias("rows"))
    blocks = stage(blocks, "blocks")  # at most about BLOCK members in each
    left, right = (blocks.select(*[F.col(k).alias(f"{k}_{s}") for k in blocks.columns]) for s in "ab")
    selves = members.where("not inner").select("ball").distinct().select(F.col("ball").alias("a"), F.col("ball").alias("b"))
    met = pairs.unionByName(selves).join(left, F.col("a") == F.col("ball_a")).join(right, F.col("b") == F.col("ball_b"))
    place = lambda s: F.struct(f"inner_{s}", f"block_{s}")
    met = met.where((F.col("a") != F.col("b")) | (~(F.col("inner_a") & F.col("inner_b")) & (place("a") <= place("b"))))
    same = (F.col("a") == F.col("b")) & (place("a") == place("b"))
    verified = met.select(same.alias("same"), "rows_a", "rows_b").mapInArrow(verify_rows(cosine), "c long, k long, low long")
    with arrow_rows(spark, BLOCK_ROWS):
        links = stage(verified, "links")
    inner = sized.where("inner").select("c", (F.col("inside") - F.col("n")).alias("k"), F.col("ball").alias("low"))  # all of them are linked to each other
    degree = links.unionByName(inner).groupBy("c").agg(F.sum("k").alias("k"))
    near = members.where("ball <> c").select(F.col("c").alias("a"), F.col("ball").alias("b"))
    found = components(links.select(F.col("c").alias("a"), F.col("low").alias("b")).unionByName(near))
    marked = classes.join(degree, "c", "left").join(found.withColumnRenamed("node", "c"), "c", "left")
    marked = marked.select("h", F.col("x").alias("cx"), "first_id", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("comp"))
    marked = stage(marked, "marked")
    least = marked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = stage(marked.join(least, "comp").select("h", "cx", "n_links", "component_id"), "named")
    out = rows.join(named, (F.col("x") == F.col("cx")) & (rows["h"] == named["h"]), "left")
    component = F.coalesce("component_id", "id")
    kept = F.coalesce(component == F.col("id"), F.lit(False))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
