from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import joins, stats


def _intervals(seed: int, n: int, span: int) -> list[tuple]:
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.randrange(span)
        out.append((f"i{i:04d}", rnd.choice(["c", "c", "c", "d", None]), s, s + rnd.choice([0, 1, 3, 10, 40, span])))
    out += [(f"n{i}", "c", None if i % 2 else 5, 7 if i % 2 else None) for i in range(2)]
    return out


@pytest.mark.parametrize(("seed", "bin_size"), [(1, 8), (2, 25), (3, 10_000)])
def test_first_match_is_that_of_all_pairs(spark, seed, bin_size):
    left, right = _intervals(seed, 150, 60), _intervals(seed + 10, 120, 60)
    l = spark.createDataFrame(left, "uid string, k string, start long, stop long")
    r = spark.createDataFrame([(k, s, e, u) for u, k, s, e in right], "k string, start long, stop long, note string").repartition(5)
    got = {x["uid"]: (x["start_right"], x["stop_right"]) for x in joins.interval_within(l, r, ["k"], bin_size=bin_size).collect()}
    for uid, k, s, e in left:
        near = [(a, b) for _, q, a, b in right if None not in (k, q, s, e, a, b) and q == k
            and ((a <= s and b >= e) or (a >= s and b <= e))]
        assert got[uid] == (min(near) if near else (None, None)), uid
    assert len(got) == len(left)


def test_deep_nests_leave_one_match_a_row(spark):
    """Features that all contain each other: matches that leave the sweeps grow with the rows, not with the pairs."""
    n = 1500
    nest = spark.range(n).select(F.col("id").cast("string").alias("uid"), F.lit("c").alias("k"), F.col("id").alias("start"),
        (F.lit(2 * n) - F.col("id")).alias("stop"))
    inner = nest.select("k", (F.col("start") + 0).alias("start"), "stop", F.col("uid").alias("note"))
    out = joins.interval_within(nest, inner, ["k"], bin_size=10_000)
    assert out.where("note = '0'").count() == n
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty_sides(spark):
    l = spark.createDataFrame([("a", "c", 1, 2)], "uid string, k string, start long, stop long")
    r = spark.createDataFrame([], "k string, start long, stop long, note string")
    assert [tuple(x) for x in joins.interval_within(l, r, ["k"]).select("uid", "note").collect()] == [("a", None)]
    assert joins.interval_within(l.limit(0), r, ["k"]).count() == 0


@pytest.mark.parametrize("metric", ["sqeuclidean", "cosine"])
def test_silhouettes_from_sums(spark, metric):
    rnd = np.random.default_rng(3)
    data = [(i, rnd.normal(size=4).round(3).tolist(), f"c{i % 3}") for i in range(60)] + [(100, [1.0, 2.0, 3.0, 4.0], "alone"),
        (101, None, "c0"), (102, [1.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(data, "id long, x array<double>, c string")
    known = [(i, np.array(x), c) for i, x, c in data if x and c]
    dist = (lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b))) if metric == "cosine" else (lambda a, b: ((a - b) ** 2).sum())
    got = {r["id"]: r["silhouette"] for r in stats.silhouette(df, "id", "x", "c", metric).collect()}
    assert set(got) == {i for i, _, _ in known}
    for i, x, c in known:
        own = [dist(x, y) for j, y, q in known if q == c and j != i]
        others = [np.mean([dist(x, y) for _, y, q in known if q == o]) for o in {q for _, _, q in known} - {c}]
        want = 0.0 if not own else (min(others) - np.mean(own)) / max(min(others), np.mean(own))
        assert abs(got[i] - want) < 1e-9
    assert {r["silhouette"] for r in stats.silhouette(df.where("c = 'c1'"), "id", "x", "c", metric).collect()} == {0.0}
