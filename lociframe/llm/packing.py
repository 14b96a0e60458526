"""Operator 9: packing of token ids into training sequences of a fixed length.

Documents are encoded where they are read; their ids are dealt at random (a hash of id and content) to
groups of about ``GROUP_DOCS``, in a stated order, so that the result does not depend on partitioning.
Within a group the full sequences of long documents stand alone and the rest is packed by first-fit
decreasing over a tournament tree of bin capacities. Its bins stand as they are but for the emptiest,
which are cut up to fill the room that the others have, and the last, which is cut into lengths that
are powers of two and need no padding.

Null or empty texts give a piece with the end id alone; repeated rows are packed again; an empty table
gives no pieces. A null id is a document like any other; documents of one id are told apart by ``sequence_id``
and ``offset`` alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32, only, parts
from .wordids import default_tokenizer, encoder, id_rows

END_ID = 1
LENGTH = 2048
GROUP_DOCS = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Room left in each of ``n`` bins; finds the first bin with enough of it in log(n) steps."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        node, room = 1, self.room
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        bin_id = node - self.size
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_id


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by bin; every size is at most ``capacity``."""
    tree, bins = CapacityTree(max(1, len(sizes)), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.place(sizes[i])
        while b >= len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(lengths: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each id of each document once."""
    done = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    at, last = 0, len(bins) - 1
    while at < last:
        room = capacity - sum(p[2] for p in bins[at])
        while room and at < last:
            d, s, n = bins[last].pop()
            take = min(room, n)
            bins[at].append((d, s, take))
            room -= take
            if take < n:
                bins[last].append((d, s + take, n - take))
            elif not bins[last]:
                last -= 1
        if not room:
            at += 1
    done += bins[:last]
    if bins and bins[last]:
        pieces, left = bins[last][::-1], sum(p[2] for p in bins[last])
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            done.append([])
            while room:
                d, s, n = pieces.pop()
                take = min(room, n)
                done[-1].append((d, s, take))
                room -= take
                if take < n:
                    pieces.append((d, s + take, n - take))
    return done


def pack_partition(dtype: str, capacity: int, group_docs: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (group, doc_id, ids), sorted, to pieces; a group of over four times ``group_docs`` is packed in runs of that many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        group, held, done = None, [], 0

        def close() -> pa.RecordBatch:
            nonlocal done
            out: list[list] = [[] for _ in range(7)]
            sizes = [len(x) // width for _, x in held]
            packed = pack_group(sizes, capacity)
            for k, seq in enumerate(packed, done):
                offset = 0
                for d, s, n in seq:
                    doc, ids = held[d]
                    piece = np.frombuffer(ids, dtype, n, s * width).astype("<u4").tobytes()
                    for col, v in zip(out, (doc, s, n, crc32(piece), sizes[d], (group << 32) + k, offset), strict=True):
                        col.append(v)
                    offset += n
            done += len(packed)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

        for batch in batches:
            for g, d, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if g != group or len(held) >= 4 * group_docs:
                    if held:
                        yield close()
                    done = done if g == group else 0
                    group = g
                held.append((d, ids))
        if held:
            yield close()

    return run


def pack(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 9
) -> DataFrame:
    """Pieces of the sequences that hold all ids of ``doc_id, text``."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    groups = max(1, -(-docs.count() // group_docs))
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = rows.mapInArrow(id_rows(path, end_id), "doc_id long, n_tokens long, ids binary")
    dealt = ids.select(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "ids"), F.lit(groups)).alias("grp"), "doc_id", "ids")
    held = dealt.repartition(parts(spark), "grp").sortWithinPartitions("grp", "doc_id", "ids")
    return held.mapInArrow(pack_partition(np.dtype(encoder(path).dtype).str, capacity, group_docs), SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
