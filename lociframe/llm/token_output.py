"""Operator 2: token ids of a corpus in compact binary blocks.

``write_tokens`` encodes every text, counts ids over the whole corpus, builds one canonical
length-limited Huffman code and writes blocks in ascending order of the id column; ``read_tokens``
decodes the blocks, each on its own, by table look-up from many bit offsets at once.

Format (a folder): ``code`` has ``token, length`` (canonical codes follow from the lengths), ``blocks``
has one row per block: ``part, block`` (order), ``ids_before`` (ids of the part before it), ``n_ids``,
``checkpoints`` (little-endian uint64 bit offsets, one per ``STEP`` ids), ``doc_ids``, ``doc_counts``,
and ``payload`` (big-endian 64-bit words of codes, most significant bit first).

Null or empty texts give the end id alone; repeated rows are written again, and rows of one id are in
the order of their ids' bytes; rows without an id come first; an empty table gives an empty folder with
an empty code.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers_of, crc32, only, parts, shared_dir, stage
from .wordids import default_tokenizer, encoder, id_rows

END_ID = 2
MAX_BITS = 20
STEP = 128
BLOCK_IDS = 1 << 18


def count_ids(dtype: str, size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (ids) to (token, n), the counts of a partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            _, data = buffers_of(batch.column(0))
            for i in range(0, len(data), 1 << 22):
                total += np.bincount(data[i : i + (1 << 22)].view(dtype), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["token", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; 0 where the count is 0.

    Over-long codes are cut to the limit and the Kraft sum is mended by lengthening the rarest codes
    that are still below it, then room that is left shortens the most frequent that fit.
    """
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts > 0)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    heap = [(int(counts[t]), i) for i, t in enumerate(used)]
    heapq.heapify(heap)
    parent = [0] * (2 * len(used) - 1)
    at = len(used)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = at
        heapq.heappush(heap, (a[0] + b[0], at))
        at += 1
    depth = [0] * at
    for i in range(at - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    length = np.minimum(np.asarray(depth[: len(used)]), limit)
    order = np.argsort(counts[used], kind="stable")  # the rarest first
    room = (1 << limit) - int((1 << (limit - length)).sum())
    while room < 0:
        for i in order:
            if length[i] < limit and room < 0:
                length[i] += 1
                room += 1 << (limit - length[i])
    for i in order[::-1]:
        while length[i] > 1 and (1 << (limit - length[i])) <= room:
            room -= 1 << (limit - length[i])
            length[i] -= 1
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for t in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[t]):
            code <<= n - last
            codes[t], last = code, n
            code += 1
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` end to end, and the bit offset of every ``step``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    word, low = start >> 6, 64 - (start & 63) - n  # low < 0: it runs on into the next word
    code = codes[ids]
    out = np.zeros((int(end[-1]) + 63 >> 6) + 1, np.uint64)
    here = np.where(low >= 0, code << np.maximum(low, 0).astype(np.uint64), code >> np.maximum(-low, 0).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.add.reduceat(here, first)
    over = np.flatnonzero(low < 0)
    out[word[over] + 1] += code[over] << (64 + low[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), start[::step].astype(np.uint64)


def decode_table(lengths: np.ndarray, codes: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For each value of the next ``limit`` bits: id * 64 + code length."""
    order = [t for t in np.lexsort((np.arange(len(lengths)), lengths)) if lengths[t]]
    if not order:
        return np.zeros(1 << limit, np.int64)
    order = np.asarray(order)
    table = np.repeat(order * 64 + lengths[order], 1 << (limit - lengths[order]))
    return np.r_[table, np.zeros((1 << limit) - len(table), np.int64)].astype(np.int64)


def unpack_bits(payload: bytes, checkpoints: np.ndarray, n_ids: int, table: np.ndarray, step: int = STEP, limit: int = MAX_BITS) -> np.ndarray:
    """The ids of a block: all checkpoints are decoded side by side, a code at a time."""
    if not n_ids:
        return np.zeros(0, np.int64)
    words = np.frombuffer(payload, ">u8").astype(np.uint64)
    words = np.r_[words, np.zeros(2, np.uint64)]
    at, out = checkpoints.astype(np.int64), np.zeros((step, len(checkpoints)), np.int64)
    last = len(words) - 2
    for k in range(step):
        w, b = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
        bits = (words[w] << b) | ((words[w + 1] >> np.uint64(1)) >> (np.uint64(63) - b))
        hit = table[(bits >> np.uint64(64 - limit)).astype(np.int64)]
        out[k] = hit >> 6
        at += hit & 63
    return out.T.reshape(-1)[:n_ids]


def blocks_of(dtype: str, lengths: np.ndarray, codes: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted batches of (doc_id, n_tokens, ids) to blocks of whole documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[object, int, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, size
            ids = np.frombuffer(b"".join(x[2] for x in held), dtype).astype(np.int64)
            payload, marks = pack_bits(ids, lengths, codes)
            row = {"part": part, "block": block, "ids_before": before, "n_ids": len(ids), "checkpoints": marks.tobytes(), "doc_ids": [x[0] for x in held], "doc_counts": [x[1] for x in held], "payload": payload}
            block, before, size = block + 1, before + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for batch in batches:
            for d, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((d, n, ids))
                size += n
                if size >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    return run


BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("checkpoints", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCKS_SQL = "part int, block long, ids_before long, n_ids long, checkpoints binary, doc_ids array<long>, doc_counts array<long>, payload binary"


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes ``doc_id, text`` of ``docs`` to the folder ``out`` in the format above."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    enc = encoder(path)
    dtype, size = np.dtype(enc.dtype).str, max(enc.size, end_id + 1)
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = stage(rows.mapInArrow(id_rows(path, end_id), "doc_id long, n_tokens long, ids binary"), "ids")
    totals = ids.select("ids").mapInArrow(count_ids(dtype, size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in totals.collect():  # a row per id of the vocabulary at most
        counts[r["token"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(t), int(lengths[t])) for t in used], "token long, length int").coalesce(1).write.parquet(f"{out}/code")
    dealt = ids.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = dealt.mapInArrow(blocks_of(dtype, lengths, canonical(lengths)), BLOCKS_SQL)
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written folder, or ``ids_crc32`` in place of ``ids``."""
    code = spark.read.schema("token long, length int").parquet(f"{path}/code").collect()  # a row per id of the vocabulary at most
    lengths = np.zeros(max([r["token"] for r in code], default=0) + 1, np.int64)
    for r in code:
        lengths[r["token"]] = r["length"]
    codes = canonical(lengths)
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks")
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row per written part
    at, begin = 0, {}
    for part, n in totals:
        begin[part], at = at, at + n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, codes)
        for batch in batches:
            for row in range(batch.num_rows):
                b = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                ids = unpack_bits(b["payload"], np.frombuffer(b["checkpoints"], np.uint64), b["n_ids"], table).astype("<u4")
                n = np.asarray(b["doc_counts"], np.int64)
                end = np.cumsum(n)
                texts = [ids[e - k : e].tobytes() for e, k in zip(end.tolist(), n.tolist(), strict=True)]
                last = pa.array([crc32(x) for x in texts], pa.int64()) if digest else pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(end - n + begin[b["part"]] + b["ids_before"], pa.int64()), pa.array(n, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_tokens(spark, out, digest=True)
