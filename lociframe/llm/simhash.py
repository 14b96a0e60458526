"""Operator 1: near-duplicate groups by SimHash fingerprints.

Distinct fingerprints within ``MAX_BITS`` differing bits are linked. Two fingerprints that differ in at
most two bits agree in one of three blocks of bits; rows that share a block value are compared by a
pivot distance table: each has its Hamming distances to ``PIVOTS`` reference fingerprints, a pair whose
distances to any reference differ by more than ``MAX_BITS`` is discarded (triangle inequality), and
the survivors are verified. Where over ``CROWD`` fingerprints share a block value they are dealt again by
three blocks of their other bits, one of which any linked pair shares as well, and so on: every level is
exact, and after ``LEVELS`` of them the bits left over bound a group's size.

Null texts are empty; a text without words has fingerprint zero and is linked like any other; texts of
fewer words than a shingle use all their words; repeated rows and ids keep a row each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_rows, components, forget, only, parts, rows_named, stage, text_blocks, text_key

WORDS = 3
SEED = 42
MAX_BITS = 2
PIVOTS = 16
CROWD = 512
LEVELS = 4
PAIR_ROWS = 1 << 20


def masks(level: int) -> list[list[int]]:
    """For each mask of the level above (for the first: all of no bits) the three masks that add a block of the bits left over."""
    above = [0] if not level else [m for some in masks(level - 1) for m in some]
    out = []
    for m in above:
        rest = [i for i in range(64) if not m >> i & 1]
        third = [rest[len(rest) * k // 3 : len(rest) * (k + 1) // 3] for k in range(3)]
        out.append([m | sum(1 << i for i in some) for some in third])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_rows(words: int, seed: int, name: str, keep_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        forget()
        for rows, off, data in text_blocks(batches):
            raw = data.tobytes().lower()
            hashes: list[int] = []
            counts = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                w = raw[a:b].split()
                size = len(hashes)
                if len(w) >= words:
                    hashes += map(xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), repeat(seed))
                elif w:
                    hashes.append(xxh64_intdigest(b" ".join(w), seed))
                counts.append(len(hashes) - size)
            n = np.asarray(counts, np.int64)
            ends = np.cumsum(n)
            h = np.asarray(hashes, np.uint64)
            out = np.zeros(len(n), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                starts = (ends - n)[full]
                for bit in range(64):
                    ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), starts)
                    out[full] |= (2 * ones.astype(np.int64) > n[full]).astype(np.uint64) << np.uint64(bit)
            kept = [i for i, n in enumerate(rows.schema.names) if keep_text or n != "text"]
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in kept], pa.array(out.view(np.int64), pa.int64())], names=[*[rows.schema.names[i] for i in kept], name])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, name: str = "fp", keep_text: bool = True) -> DataFrame:
    """``docs``, all columns or all but ``text``, with the fingerprint of ``text`` as a signed long."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != "text")
    return docs.mapInArrow(fingerprint_rows(words, seed, name, keep_text), f"{kinds}, `{name}` long")


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)


def close_pairs(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``max_bits``: windows over the first pivot's distances, then the largest difference over all pivots, then the bits."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    n = np.searchsorted(first, first + max_bits, "right") - np.arange(len(order)) - 1
    ends, done, left, right = np.cumsum(n), 0, [], []
    while done < len(order):  # some rows at a time, so that memory stays bounded
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIR_ROWS, "right")))
        k = n[done:upto]
        a = np.repeat(np.arange(done, min(upto, len(order))), k)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        a, b = order[a], order[b]
        for j in range(1, table.shape[1]):
            if not len(a):
                break
            keep = np.abs(table[a, j] - table[b, j]) <= max_bits
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        left.append(a[keep])
        right.append(b[keep])
        done = upto
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def linked_rows(pivots: np.ndarray, max_bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (blk, val, fp), sorted by block value, to links."""

    def link(block: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (value[1:] != value[:-1]), True])
        table = pivot_table(fp.view(np.uint64), pivots)
        left, right = [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s > 1:
                a, b = close_pairs(fp[s:e].view(np.uint64), table[s:e], max_bits)
                left.append(fp[s:e][a])
                right.append(fp[s:e][b])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1]) + 1 if ((held[0] != held[0][-1]) | (held[1] != held[1][-1])).any() else 0
            yield from link(*(h[:last] for h in held)) if last else ()
            held = [h[last:] for h in held]
        if len(held[0]):
            yield from link(*held)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, crowd: int = CROWD, seed: int = SEED) -> DataFrame:
    """All links ``a, b`` of distinct ``fp`` within ``max_bits`` (0 to 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("three blocks find pairs of up to two differing bits")
    spark = fps.sparkSession
    table = np.random.default_rng(seed).integers(0, 1 << 64, pivots, np.uint64, endpoint=False)
    crowded, out = fps.select("fp", F.lit(0).alias("group")), None
    for level in range(LEVELS):  # ``group`` is the number of the mask that the crowd shares
        add = F.array(*[F.array(*[F.struct(F.lit(3 * g + k).alias("blk"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("val")) for k, m in enumerate(some)]) for g, some in enumerate(masks(level))])
        keyed = crowded.select("fp", F.explode(F.element_at(add, F.col("group") + 1)).alias("k")).select("k.blk", "k.val", "fp").distinct()
        sizes = stage(keyed.groupBy("blk", "val").agg(F.count("*").alias("n")).where("n > 1"), "sizes")  # written, so that a hot value can be split
        shared = stage(keyed.join(sizes, ["blk", "val"]), "blocks")
        last = level == LEVELS - 1
        few = shared if last else shared.where(F.col("n") <= crowd)
        near = few.select("blk", "val", "fp").repartition(parts(spark), "blk", "val").sortWithinPartitions("blk", "val")
        near = near.mapInArrow(linked_rows(table, max_bits), "a long, b long")
        out = near if out is None else out.unionByName(near)
        crowded = shared.where(F.col("n") > crowd).select("fp", F.col("blk").alias("group"))
        if last or not sizes.where(F.col("n") > crowd).limit(1).count():
            break
    return out


def classes(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, first_id, component_id`` of the distinct fingerprints of ``doc_id, fp``: the least id of each, and of all that it reaches by links."""
    each = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(links(each.select("fp"), max_bits))
    low = each.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = low.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return stage(low.join(least, "component").select("fp", "first_id", "component_id", "component"), "named")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` of every row of ``doc_id, text``."""
    marked = fingerprints(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), words, keep_text=False)
    marked = stage(marked, "fingerprints")
    named = classes(marked, max_bits).select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``id, th, many``: the row of the least id of each near-duplicate group, by its id and ``text_key``, and whether several rows are equal to it; a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), F.col("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        marked = stage(fingerprints(rows, words, keep_text=False), "marked")
    named = classes(marked, max_bits)
    first = named.where(F.col("first_id").eqNullSafe(F.col("component_id"))).groupBy("component", "component_id").agg(F.min("fp").alias("first_fp"))
    met = marked.join(first, (F.col("fp") == F.col("first_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = met.groupBy("doc_id", "fp").agg(F.min("th").alias("th"), F.count("*").alias("k"))
    return stage(least.select(F.col("doc_id").alias("id"), "th", (F.col("k") > 1).alias("many")), "first")


def one_of_each(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate group: the one of the least ``doc_id``."""
    return rows_named(docs, first_of_each(docs, words, max_bits))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
