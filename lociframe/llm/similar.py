"""Near-duplicate texts by the similarity of their word runs, for the pipeline.

Two texts are linked if the Jaccard similarity of their sets of ``WORDS``-word runs is at least 0.8. Texts
of equal sets are one class. Candidates share one of ``BANDS`` bands of ``LINES`` min-hashes (a pair at the
limit is missed in 1 of 12,000 cases) and have numbers of runs that allow the similarity; each is verified on
the whole sets, which are made once. In bands shared by more than ``CROWD`` classes all are compared with
two of them first. Where that leaves several components, their members are joined by prefixes of their sets:
runs in an order that puts seldom ones first, of which two similar sets share one among so many that follow
from their sizes. That finds every similar pair, and texts that share a template but too little else meet
in none of its runs.

Null texts are empty; texts of fewer words than a run use all their words; all texts without words are
equal; of repeated rows one is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_rows, components, forget, only, rows_named, stage, text_blocks, text_key

WORDS = 5
SEED = 42
BANDS = 40
LINES = 7
CROWD = 4
CLASS_RATIO = 1.05
#: Least similarity as a fraction of whole numbers, so that the limit itself is exact.
OVER, UNDER = 4, 5
FITS = f"{UNDER} * least(n_a, n_b) >= {OVER} * greatest(n_a, n_b)"


def run_sets(off: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word runs of each text of a block."""
    from xxhash import xxh64_intdigest

    raw = data.tobytes().lower()
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        w = raw[a:b].split()
        runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
        out.append(np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64)))
    return out


def band_rows(words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, th, text) to (id, th, key, n, bands): the set's digest, its size and its band values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        forget()
        rng = np.random.default_rng(SEED)
        factor, mask = (rng.integers(0, 1 << 64, (BANDS, LINES), np.uint64) for _ in range(2))
        factor |= np.uint64(1)
        mix = rng.integers(0, 1 << 64, (BANDS, LINES), np.uint64) | np.uint64(1)
        for rows, off, data in text_blocks(batches):
            sets = run_sets(off, data, words)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            bands = np.zeros((len(n), BANDS), np.uint64)
            if len(full):
                h = np.concatenate(sets)
                starts = (np.cumsum(n) - n)[full]
                for i in range(BANDS):
                    value = np.full(len(full), i, np.uint64)
                    for j in range(LINES):
                        low = np.minimum.reduceat((h ^ mask[i, j]) * factor[i, j], starts)
                        value = (value ^ (low >> np.uint64(7)) ^ low) * mix[i, j]
                        value ^= value >> np.uint64(32)
                    bands[full, i] = value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS),
                pa.array(bands.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1),
                pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(n), lists],
                    names=["id", "th", "key", "n", "bands"])

    return run


def set_rows(words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (c, text) to (c, runs)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows, off, data in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in run_sets(off, data, words)], pa.binary())],
                names=["c", "runs"])

    return run


def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (a, b, x, y) to the pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(UNDER * both >= OVER * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], names=["a", "b"])


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(CLASS_RATIO) + 1e-9)


def slot_counts(slots: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (c, runs, comp) to how many runs fall into each of ``slots`` by their hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(slots, np.int64)
        for batch in batches:
            for x in batch.column(1):
                count += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(slots)).astype(np.int64), minlength=slots)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], names=["slot", "n"])

    return run


def prefix_rows(load: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (c, runs, comp) to (key, side, c, n, comp): for each class of sizes that a partner may have, the runs of which a similar one shares one.

    Runs are in one order everywhere, those of seldom used slots first. Of two sets with ``o`` runs in common, all but the last ``o - 1``
    of each share one; the least ``o`` follows from both sizes, of the partner's the least of its class.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for c, x, comp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(x)
                x = x[np.lexsort((x, load[(x % np.uint64(len(load))).astype(np.int64)]))]
                own, least, most = size_class(n), -(-OVER * n // UNDER), UNDER * n // OVER
                for other in range(size_class(least), size_class(most) + 1):
                    m = max(least, math.floor(CLASS_RATIO**other))
                    part = x[: max(1, n + 1 + (-OVER * (n + m)) // (OVER + UNDER))]
                    low, high = min(own, other), max(own, other)
                    key = (part ^ np.uint64(low * 2_654_435_761 + high)) * np.uint64(0x9E3779B97F4A7C15)
                    out[0].append((key ^ (key >> np.uint64(29))).view(np.int64))
                    for col, v in zip(out[1:], (2 if own == other else int(own > other), c, n, comp), strict=True):
                        col.append(np.full(len(part), v, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["key", "side", "c", "n", "comp"])

    return run


def across_components(sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different components of ``c, runs, comp`` that may be similar: those that share a run of their prefixes."""
    spark = sets.sparkSession
    sets = sets.select("c", "runs", "comp").where(F.octet_length("runs") > 0)
    slots = 1 << min(20, max(12, sets.count().bit_length() + 2))
    found = sets.mapInArrow(slot_counts(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2**20 rows at most
    load = np.zeros(slots, np.int64)
    load[found["slot"].to_numpy()] = found["n"].to_numpy()
    with arrow_rows(spark, BATCH_ROWS):
        keyed = stage(sets.mapInArrow(prefix_rows(load), "key long, side long, c long, n long, comp long"), "prefixes")
    twice = stage(keyed.groupBy("key").agg(F.count("*").alias("k"), (F.min("comp") != F.max("comp")).alias("open")).where("open").select("key"), "met")
    keyed = stage(keyed.join(twice, "key", "left_semi"), "shared")
    side = lambda k: keyed.select("key", F.col("side").alias(f"side_{k}"), F.col("c").alias(k), F.col("n").alias(f"n_{k}"), F.col("comp").alias(f"comp_{k}"))
    both = side("a").join(side("b"), "key").where(f"comp_a <> comp_b AND (side_a = 0 AND side_b = 1 OR side_a = 2 AND side_b = 2 AND a < b) AND {FITS}")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(texts: DataFrame, classes: DataFrame, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` of ``c``, with the components of all similar pairs; ``classes`` has ``c, own, many, n, bands``."""

    def run_sets_of(met: DataFrame) -> DataFrame:
        owners = classes.join(met, "c").select("c", "many", F.col("own.id").alias("own_id"), F.col("own.th").alias("own_th"))
        rows = texts.join(owners, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own_id"))).select("c", "many", "text")
        if repeated:
            rows = rows.where("not many").unionByName(rows.where("many").dropDuplicates(["c"]))
        rows = rows.select("c", "text")
        with arrow_rows(texts.sparkSession, BATCH_ROWS):
            return stage(rows.mapInArrow(set_rows(words), "c long, runs binary"), "sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("c").alias(k), F.col("runs").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        with arrow_rows(texts.sparkSession, BATCH_ROWS):
            return stage(met.mapInArrow(alike, "a long, b long"), "links")

    repeated = not classes.where("many").isEmpty()
    ends = lambda pairs: pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    keyed = classes.select("c", "n", F.explode("bands").alias("val")).where("n > 0")
    sizes = stage(keyed.groupBy("val").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = stage(keyed.join(sizes, "val"), "bands")
    side = lambda df, k, *more: df.select("val", F.col("c").alias(k), F.col("n").alias(f"n_{k}"), *more)
    few, many = shared.where(F.col("size") <= crowd), shared.where(F.col("size") > crowd)
    near = side(few, "a").join(side(few, "b"), "val").where(f"a < b AND {FITS}").select("a", "b")
    hubs = many.groupBy("val").agg(F.array(F.min(F.struct("c", "n")), F.max(F.struct("c", "n"))).alias("hubs")).select("val",
        F.explode("hubs").alias("hub")).select("val", F.col("hub.c").alias("b"), F.col("hub.n").alias("n_b"))
    stars = side(many, "a").join(hubs, "val").where(f"a <> b AND {FITS}").select(F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"))
    pairs = stage(near.unionByName(stars).distinct(), "pairs")
    met = stage(ends(pairs), "met")
    sets = run_sets_of(met)
    found = verified(pairs, sets)
    if many.isEmpty():
        return found
    member = stage(many.join(components(found), F.col("c") == F.col("node"), "left").select("val", "c", "n",
        F.coalesce("component", "c").alias("comp")), "members")
    open_bands = member.groupBy("val").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").select("val")
    left_over = stage(member.join(open_bands, "val", "left_semi").select("c", "comp").distinct(), "open")
    more = stage(left_over.select("c").join(met, "c", "left_anti"), "more")
    if not more.isEmpty():
        sets = sets.unionByName(run_sets_of(more))
    across = stage(across_components(sets.join(left_over, "c")).join(pairs, ["a", "b"], "left_anti"), "across")
    return found.unionByName(verified(across, sets))


def one_of_each(docs: DataFrame, words: int = WORDS, crowd: int = CROWD, among: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, with one row of each group of similar texts: the one of the least ``doc_id``.

    ``among`` names the rows to choose from, by ``id, th`` (``common.text_key``): by default all. What is decided is decided on ids,
    text hashes and bands; whole texts are read again where pairs are verified, and once at the end.
    """
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("th"),
        F.coalesce("text", F.lit("")).alias("text"))
    marked = texts.mapInArrow(band_rows(words), "id long, th long, key binary, n long, bands array<long>")
    if among is not None:
        named = among.select(F.col("id").alias("_id"), F.col("th").alias("_th"))
        marked = marked.join(named, (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        marked = stage(marked, "marked")
    classes = marked.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("own"),
        F.first("n").alias("n"), F.first("bands").alias("bands"))
    again = marked.groupBy("id", "th").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("_id"),
        F.col("th").alias("_th"))
    classes = classes.join(again, (F.col("own.th") == F.col("_th")) & F.col("own.id").eqNullSafe(F.col("_id")), "left").select("own", "n",
        "bands", F.col("_th").isNotNull().alias("many"))
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    found = components(links(texts, classes, words, crowd))
    first = classes.join(found, F.col("c") == F.col("node"), "left").groupBy(F.coalesce("component", "c").alias("component")).agg(
        F.min(F.struct("own", "many")).alias("m"))
    first = first.select(F.col("m.own.id").alias("id"), F.col("m.own.th").alias("th"), F.col("m.many").alias("many"))
    return rows_named(docs, stage(first, "first"))
