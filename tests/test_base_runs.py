from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lociframe.operators import aggregate
from lociframe.operators import base_runs as B

PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def brute(data, k):
    out: Counter = Counter()
    for s, q in data:
        q = (q or "").upper()
        for i in range(len(q) - k + 1):
            run = q[i : i + k]
            if set(run) <= set(PAIR):
                out[s, min(run, "".join(PAIR[c] for c in reversed(run)))] += 1
    return out


def sequences(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    long = "".join(rnd.choice("ACGT") for _ in range(900))
    back = "".join(PAIR[c] for c in reversed(long))
    return [("a", long), ("a", back[100:700]), ("b", long[:500].lower() + "N" + long[500:]), (None, "ACGTNNACGTAGG-ACC"), ("b", ""),
        ("c", None), ("c", "AC"), ("b", "é" + "A" * 200), ("a", "GATTACA" * 40)]


@pytest.mark.parametrize("k", [1, 2, 6, 11, 12, 17, 21, 31])
def test_counts_are_those_of_a_loop(spark, k, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BASES", 256)  # sequences are cut and overlap
    data = sequences(k)
    df = spark.createDataFrame(data, "s string, q string").repartition(3)
    want = brute(data, k)
    counts = B.run_counts(df, "s", "q", k)
    got = {(r["sample"], r["kmer"]): r["n"] for r in counts.select("sample", B.spelt("run", k).alias("kmer"), "n").collect()}
    assert got == dict(want)
    few = {(r["s"], r["kmer"]): r["n"] for r in aggregate.kmer_counts(df, "s", "q", k, cap=5).collect()}
    assert few == {p: min(n, 5) for p, n in want.items() if n >= 2}


def test_longer_runs_and_limits(spark):
    data = [("a", "ACGT" * 30)]
    df = spark.createDataFrame(data, "s string, q string")
    assert {(r["s"], r["kmer"]): r["n"] for r in aggregate.kmer_counts(df, "s", "q", 40).collect()} == {p: min(n, 255) for p,
        n in brute(data, 40).items() if n >= 2}
    with pytest.raises(ValueError):
        B.run_counts(df, "s", "q", 32)
    assert B.run_counts(df.limit(0), "s", "q", 21).count() == 0


def test_halves_make_whole_runs():
    codes = np.random.default_rng(0).integers(0, 4, 200).astype(np.uint8)
    for k in range(1, 32):
        f, r = B.windows(codes, k)
        want = [int("".join(map(str, codes[i : i + k])), 4) for i in range(200 - k + 1)]
        back = [int("".join(str(3 - c) for c in codes[i : i + k][::-1]), 4) for i in range(200 - k + 1)]
        assert f.tolist() == want and r.tolist() == back


def test_super_runs_are_fewer_bytes_than_runs():
    import pyarrow as pa

    text = "".join(random.Random(2).choice("ACGT") for _ in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([text])], names=["sample", "seq"])
    cut = list(B._super_runs(31)([batch]))
    packed = sum(len(p) for b in cut for p in b.column(3).to_pylist())
    assert packed + 16 * sum(len(b) for b in cut) < 4 * len(text) and sum(n - 30 for b in cut for n in b.column(2).to_pylist()) == len(
        text) - 30


def test_blocks_are_let_go_without_the_collector():
    import gc
    import tracemalloc

    codes = np.zeros(1 << 16, np.uint8)
    B.windows(codes, 6)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(20):
            B.windows(codes, 6)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held < 1 << 20
