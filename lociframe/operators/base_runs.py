"""Runs of bases (AG5, AG6) as whole numbers of two bits a base, counted in blocks before anything is shuffled.

A run is the lesser of itself and its reverse complement. A block of sequences is cut into super-runs, stretches of runs whose
least part of ``MINIMISER`` bases (by a hash) is one and the same; equal runs share it, whichever strand they are read from.
Short runs (of at most ``SHORT`` bases there are few) are counted in the block; longer ones are mostly different and go to the
shuffle as super-runs, packed bases dealt by sample and minimiser, and are counted where they arrive: a byte holds four bases,
and a stretch of many runs repeats none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 31
SHORT = 11
MINIMISER = 9
BLOCK_BASES = 1 << 21

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _i


def _built(bases: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` bases; no closure that names itself, as only the collector of cycles, which seldom comes, would free its arrays."""
    if size == 1:
        return bases, 3 - bases
    half = size // 2
    f, r = _built(bases, half)
    m = len(bases) - 2 * half + 1
    f, r = (f[:m] << 2 * half) | f[half : half + m], (r[half : half + m] << 2 * half) | r[:m]
    if size % 2:
        m = len(bases) - size + 1
        f, r = (f[:m] << 2) | bases[size - 1 : size - 1 + m], ((3 - bases[size - 1 : size - 1 + m]) << 2 * (size - 1)) | r[:m]
    return f, r


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``k`` codes as numbers, and their reverse complements; made from halves, so in log k passes."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _built(codes.astype(np.int64) & 3, k)


def _blocks(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(samples, row of each letter, codes) for blocks of about ``BLOCK_BASES`` letters; a long sequence is several blocks that overlap by ``k - 1``."""
    for batch in batches:
        samples, seqs = batch.column(0), batch.column(1).fill_null("")
        held, size = [], 0
        for i in range(len(seqs)):
            text = np.frombuffer(seqs[i].as_buffer(), np.uint8) if len(seqs[i].as_buffer()) else np.zeros(0, np.uint8)
            for at in range(0, max(1, len(text) - k + 1), BLOCK_BASES):
                piece = text[at : at + BLOCK_BASES + k - 1]
                held.append((i, piece))
                size += len(piece)
                if size >= BLOCK_BASES:
                    yield _joined(samples, held)
                    held, size = [], 0
        if held:
            yield _joined(samples, held)


def _joined(samples: pa.Array, held: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces with a letter that is no base after each."""
    end = np.full(1, 4, np.uint8)
    codes = np.concatenate([x for _, p in held for x in (_CODE[p], end)])
    return samples, np.repeat([i for i, _ in held], [len(p) + 1 for _, p in held]), codes


def _valid(codes: np.ndarray, k: int) -> np.ndarray:
    bad = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes > 3, out=bad[1:])
    return bad[k:] == bad[:-k] if len(codes) >= k else np.zeros(0, bool)


def _counted(rows: np.ndarray, runs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, run) and how often each is met; one number stands for both where they fit."""
    bits = 2 * k
    top = int(rows.max(initial=0)) + 1
    if top << bits <= 1 << 22:
        n = np.bincount(rows << bits | runs, minlength=1)
        both = np.nonzero(n)[0]
        return both >> bits, both & ((1 << bits) - 1), n[both]
    if top.bit_length() + bits < 63:
        both = np.sort(rows << bits | runs)
        starts = np.nonzero(np.append(True, both[1:] != both[:-1]))[0]
        return both[starts] >> bits, both[starts] & ((1 << bits) - 1), np.diff(np.append(starts, len(both)))
    order = np.lexsort((runs, rows))
    rows, runs = rows[order], runs[order]
    starts = np.nonzero(np.append(True, (rows[1:] != rows[:-1]) | (runs[1:] != runs[:-1])))[0]
    return rows[starts], runs[starts], np.diff(np.append(starts, len(rows)))


def _count_blocks(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for samples, rows, codes in _blocks(batches, k):
            f, r = windows(codes, k)
            ok = _valid(codes, k)
            # rows of one sample are counted together
            names = samples.dictionary_encode("encode")
            of = names.indices.to_numpy(zero_copy_only=False)[rows[: len(f)][ok]]
            if not len(of):
                continue
            at, runs, n = _counted(of.astype(np.int64), np.minimum(f, r)[ok], k)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(at)), pa.array(runs), pa.array(n)],
                names=["sample", "run", "n"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _super_runs(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sample, minimiser, bases, packed): stretches whose runs have one minimiser, four bases a byte."""
    m = MINIMISER

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for samples, rows, codes in _blocks(batches, k):
            ok = _valid(codes, k)
            if not ok.any():
                continue
            f, r = windows(codes, m)
            least = np.lib.stride_tricks.sliding_window_view(_mixed(np.minimum(f, r)), k - m + 1).min(axis=1)
            new = np.append(True, (least[1:] != least[:-1]) | (rows[1 : len(ok)] != rows[: len(ok) - 1]) | ~ok[:-1]) & ok
            starts = np.nonzero(new)[0]
            stop = np.nonzero(ok & np.append(new[1:] | ~ok[1:], True))[0]
            sizes = stop - starts + k
            wide = -(-sizes // 4)
            offs = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(wide, out=offs[1:])
            # base j of stretch i goes to byte offs[i] + j // 4
            which = np.repeat(np.arange(len(starts)), sizes)
            j = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            packed = np.zeros(offs[-1], np.uint8)
            np.bitwise_or.at(packed, offs[which] + j // 4,
                (codes[starts[which] + j] << (6 - 2 * (j % 4)).astype(np.uint8)).astype(np.uint8))
            data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([samples.take(pa.array(rows[starts])), pa.array(least[starts]),
                pa.array(sizes.astype(np.int64)), data], names=["sample", "minimiser", "bases", "packed"])

    return run


def _count_super_runs(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 50_000):
                some = batch.slice(at, 50_000)
                names = some.column(0).dictionary_encode("encode")
                sizes = some.column(2).to_numpy()
                raw = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8)
                flat = (raw[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1)
                offs = np.cumsum(-(-sizes // 4) * 4) - (-(-sizes // 4) * 4)
                f, r = windows(flat, k)
                n = sizes - k + 1
                place = np.repeat(offs, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(names.indices.to_numpy(zero_copy_only=False), n)
                rows, runs, k_n = _counted(of.astype(np.int64), np.minimum(f, r)[place], k)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(rows)), pa.array(runs), pa.array(k_n)],
                    names=["sample", "run", "n"])

    return run


def run_counts(df: DataFrame, sample: str, seq: str, k: int) -> DataFrame:
    """``sample, run, n``: counts of all runs of ``k`` (at most ``LONGEST``) bases of a sample, letters that are no bases apart."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"runs have from 1 to {LONGEST} bases")
    kind = df.schema[sample].dataType.simpleString()
    rows = df.select(F.col(sample).alias("sample"), F.col(seq).cast("string").alias("seq"))
    schema = f"sample {kind}, run long, n long"
    if k <= max(SHORT, MINIMISER):
        counted = rows.mapInArrow(_count_blocks(k), schema)
    else:
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cut = rows.mapInArrow(_super_runs(k), f"sample {kind}, minimiser long, bases long, packed binary")
        counted = cut.repartition(parts, "sample", "minimiser").mapInArrow(_count_super_runs(k), schema)
    return counted.groupBy("sample", "run").agg(F.sum("n").alias("n"))


def spelt(run: Column | str, k: int) -> Column:
    """The letters of a run."""
    return F.translate(F.lpad(F.conv((F.col(run) if isinstance(run, str) else run).cast("string"), 10, 4), k, "0"), "0123", "ACGT")
