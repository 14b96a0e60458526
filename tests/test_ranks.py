from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import tails
from lociframe.operators import sampling, stats, windows

from .conftest import rows


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_running_sums_are_those_of_a_loop(spark, parts):
    rnd = random.Random(int(parts))
    data = [(rnd.choice([None, "a", "b", "None", "c"]), rnd.choice([1, 2, None]), i, rnd.choice([None, 1, 5, -2]), float(i % 7))
        for i in range(3000)] + [("hot", 1, 5000 + i, 1, 0.5) for i in range(4000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "g string, h int, i long, v long, w double")
        got = {r["i"]: (r["_run_v"], r["_run_w"]) for r in windows.running_sums(df, ["g", "h"], ["i"], ["v", "w"]).collect()}
        index = {r["i"]: r["n"] for r in windows.group_index(df, ["g"], [F.col("i").desc()], "n", start=0).collect()}
        whole = {r["i"]: r["n"] for r in windows.row_index(df, ["i"], start=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at: dict = {}
    for g, h, i, v, w in sorted(data, key=lambda r: r[2]):
        a, b = at.get((g, h), (0, 0.0))
        at[g, h] = (a + (v or 0), b + w)
        assert got[i][0] == at[g, h][0] and abs(got[i][1] - at[g, h][1]) < 1e-6
    seen: Counter = Counter()
    for g, _, i, _, _ in sorted(data, key=lambda r: -r[2]):
        assert index[i] == seen[g]
        seen[g] += 1
    assert [whole[i] for i in sorted(whole)] == list(range(3, 3 + len(data)))


def test_one_hot_group_is_many_tasks(spark):
    """A group of a million rows: no task sorts it whole, and ranks are right."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 1_000_003).alias("v")).unionByName(
        spark.range(10).select(F.lit("cold").alias("g"), F.col("id").alias("v")))
    index = windows.group_index(df, ["g"], ["v"], "n")
    plan = index._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan
    assert index.where("g = 'hot'").select(F.input_file_name().alias("f")).distinct().count() >= 3  # range partitions that hold it
    ranked = windows.avg_rank(df, "v", ["g"])
    got = ranked.groupBy("g").agg(F.sum("rank").alias("s"), F.count("*").alias("n")).collect()
    assert {r["g"]: (r["s"], r["n"]) for r in got} == {"hot": (1_000_000 * 1_000_001 / 2, 1_000_000), "cold": (55.0, 10)}


def test_grouped_ks_and_areas(spark):
    rnd = np.random.default_rng(1)
    data = [(g, float(v), bool(s)) for g in ("a", "b") for v, s in zip(rnd.integers(0, 20, 400), rnd.integers(0, 2, 400), strict=True)]
    df = spark.createDataFrame(data, "g string, v double, s boolean")
    for r in stats.ks_2samp(df, "v", "s", by=["g"]).collect():
        x, y = (np.sort([v for g, v, s in data if g == r["g"] and s == side]) for side in (True, False))
        every = np.arange(20)
        gap = np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y)).max()
        assert abs(r["statistic"] - gap) < 1e-12
    for r in stats.ranking_areas(df.withColumn("h", F.col("s").cast("double")), "v", "h", ["g"]).collect():
        pos = [v for g, v, s in data if g == r["g"] and s]
        neg = [v for g, v, s in data if g == r["g"] and not s]
        assert abs(r["auroc"] - np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])) < 1e-12


def test_log_factorials(spark):
    ks = [0, 1, 2, 31, 32, 33, 100, 10**6, 10**12]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select(stats.log_factorial(F.col("k")).alias("v")).collect()
    assert np.allclose([r["v"] for r in got], [math.lgamma(k + 1) for k in ks], rtol=1e-14, atol=1e-12)


@pytest.mark.parametrize(("n", "p"), [(0, 0.3), (1, 0.5), (7, 0.01), (40, 0.9), (500, 0.37)])
def test_binomial_quantiles(n, p):
    cdf = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    u = np.random.default_rng(n).random(500)
    want = [int(min(n, np.searchsorted(cdf, x))) for x in u]
    assert tails.binomial_quantile(np.full(500, n), p, u).tolist() == want
    assert tails.binomial_quantile(np.array([5, 6]), 1.0, np.array([0.1, 0.9])).tolist() == [5, 6]


def test_groups_of_a_million(spark):
    """Counts of a huge group that follow the shares are likely, and those that do not are not; no row stands for a member."""
    cats = spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)] * 2, "category string")
    sized = lambda g, c, n: spark.range(n).select(F.lit(g).alias("group"), F.lit(c).alias("category"))
    parts = [sized("fits", "x", 500_100), sized("fits", "y", 299_900), sized("fits", "z", 200_000), sized("off", "x", 503_000),
        sized("off", "y", 297_000), sized("off", "z", 200_000), sized("odd", "x", 2), sized("odd", "w", 1)]
    obs = parts[0]
    for more in parts[1:]:
        obs = obs.unionByName(more)
    out = stats.multinomial_test(obs, cats, 400)
    assert len(out._jdf.queryExecution().toString()) < 200_000
    got = {r["group"]: r for r in rows(out)}
    assert set(got) == {"fits", "off"}  # a category without a share has no probability
    assert got["fits"]["p"] > 0.3 and got["off"]["p"] == 1e-10
    want = math.lgamma(1_000_001) + sum(k * math.log(q) - math.lgamma(k + 1) for k, q in ((500_100, 0.5), (299_900, 0.3), (200_000, 0.2)))
    assert abs(got["fits"]["value"] - want) < 1e-6


def _made_anew(spark, n: int):
    """``id, g, x, y``, whose values differ in their last bits each time they are made, as sums do that meet in another order."""
    import pyarrow as pa

    def run(batches):
        rng = np.random.default_rng()
        for batch in batches:
            i = batch.column(0).to_numpy()
            x, y = ((i * k % 41 + 1.0) * (1 + 1e-15 * rng.integers(1, 1000, len(i))) for k in (7, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i % 2), pa.array(x), pa.array(y)], names=["id", "g", "x", "y"])

    return spark.range(n).mapInArrow(run, "id long, g long, x double, y double")


def test_ranks_meet_values_that_are_made_once(spark):
    df = _made_anew(spark, 40)
    assert stats.spearman(df, "x", "y").first()["n"] == 40
    assert [r["n"] for r in stats.spearman(df, "x", "y", ["g"]).collect()] == [20, 20]
    assert stats.wilcoxon(df, "x", "y").first()["n"] >= 39  # one pair is equal but for its last bits
    got = stats.mc_test_by(df, df, lambda t: t.select(F.col("x").alias("value")))
    assert got.count() == 40


def test_pooled_agreement_draws_from_all_pairs(spark):
    """As its SQL does: all pairs in the order of their draws, a null sample last."""
    from lociframe.functions.seeded import draw

    rng = np.random.default_rng(5)
    names = [None, *range(24)]
    seqs = spark.createDataFrame([(g, (rng.standard_normal(4) + 1).tolist()) for g in names for _ in range(3)], "g long, x array<double>")
    pairs = spark.range(25).selectExpr("id as l").join(spark.range(25).selectExpr("id as h"), F.col("l") < F.col("h"))
    want = [(r["l"], r["h"]) for r in pairs.orderBy(draw(0, "pair", "l", "h")).limit(30).collect()]
    got = {(r["a"], r["b"]) for r in sampling.random_pairs(seqs, "g", 30, 0, every=True).collect()}
    assert got == {(a, b if b < 24 else None) for a, b in want}
    pooled = seqs.groupBy("g").agg(F.first("x").alias("x"))
    assert stats.pooled_agreement(seqs, pooled, "g", "x", 30).first()["n"] == sum(b < 24 for _, b in want)
