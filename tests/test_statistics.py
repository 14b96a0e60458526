from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import tails
from lociframe.operators import latents, models, neighbors, stats, windows

# Activations, and the exact results expected of them below.
ACTS = [[0.1, 0.9, 0.2, 0.3, 0.1], [0.2, 0.3, 0.9, 0.0, 0.3], [0.9, 0.2, 0.3, 0.1, 0.1], [0.2, 0.1, 0.3, 0.8, 0.2],
    [0.8, 0.2, 0.1, 0.2, 0.9], [0.3, 0.3, 0.7, 0.1, 0.3]]


@pytest.fixture(scope="module")
def acts(spark):
    df = spark.createDataFrame([(i, [float(v) for v in x], c) for i, (x, c) in enumerate(zip(ACTS, "AAABBB", strict=True))],
        "sample int, x array<double>, label string")
    return latents.activations(df, "sample", "x"), df.select("sample", "label")


def test_tails():
    assert tails.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and tails.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.ks_two_sided(0.0, 5, 5) == 1.0


def test_class_max(acts):
    got = {(r["latent"], r["label"]): r["value"] for r in latents.pool_latents(*acts).collect()}
    assert [(got[i, "A"], got[i, "B"]) for i in range(5)] == [(0.9, 0.8), (0.9, 0.3), (0.9, 0.7), (0.3, 0.8), (0.3, 0.9)]


def test_latent_scores(acts):
    report = sorted((r["latent"], r["label"], r["sensitivity"]) for r in latents.latent_report(latents.latent_scores(*acts, 0.3)).collect())
    assert [r[1] for r in report] == ["B", "A", "A", "B", "B"]
    assert [r[2] for r in report] == pytest.approx([2 / 3, 2 / 3, 2 / 3, 1 / 3, 2 / 3])


def test_categories(spark, acts):
    dead = acts[0].unionByName(acts[0].select("sample").distinct().select("sample", F.lit(9).alias("latent"), F.lit(0.0).alias("act")))
    got = {r["latent"]: r["category"] for r in latents.latent_categories(dead).collect()}
    assert got[9] == "dead" and got[0] == "dense"
    assert latents.drop_latents(dead, latents.latent_categories(dead)).select("latent").distinct().count() == 5


def test_monte_carlo(spark):
    rng = np.random.default_rng(0)
    null = spark.createDataFrame([(float(v),) for v in rng.normal(size=2000)], "value double")
    at = lambda v, alternative: stats.mc_test(spark.createDataFrame([(v,)], "value double"), null, alternative).first()["p"]
    assert at(0.0, "two-sided") >= 0.05 and at(4.0, "greater") <= 0.05 and at(-4.0, "less") <= 0.05 and at(4.0, "less") == 1.0


def test_multinomial(spark):
    cats = spark.createDataFrame([(c,) for c in "abcdefghijklm" * 5], "category string")
    obs = spark.createDataFrame([("all", c) for c in "abcdefghijklm"] + [("one", "a")] * 13 + [("few", c) for c in "aaaabbbbcccdd"],
        "group string, category string")
    p = {r["group"]: r["p"] for r in stats.multinomial_test(obs, cats, 3000).collect()}
    assert p["all"] >= 0.05 and p["one"] <= 0.05 and p["few"] <= 0.05


def test_rank_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(a + b), i % 2 == 0) for i,
        (a, b) in enumerate(zip(x, rng.normal(size=300) * 0.1, strict=True))], "x double, y double, first boolean")
    assert stats.spearman(df, "x", "y").first()["p"] < 1e-6
    assert stats.wilcoxon(df.withColumn("y", F.col("x") + 1), "x", "y").first()["p"] < 1e-6
    assert stats.ks_2samp(df, "x", "first").first()["p"] > 0.01
    assert stats.ks_2samp(df.withColumn("x", F.col("x") + F.when(F.col("first"), -3.0).otherwise(0.0)), "x", "first",
        "greater").first()["p"] < 1e-6
    ranks = windows.avg_rank(spark.createDataFrame([(v,) for v in (3, 1, 3, 2)], "v int"), "v").orderBy("v").collect()
    assert [r["rank"] for r in ranks] == [1.0, 2.0, 3.5, 3.5]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4) + 4 * (i % 2)], "ab"[i % 2], "t1;t2" if i % 2 else "t3",
        float(i)) for i in range(60)], "id long, x array<double>, c string, anno string, pos double")


def test_neighbours(spark, points):
    one = neighbors.nn_proportions(points, "id", "x", ["c"], 5, rounds=9).first()
    assert one["share"] > 0.95 and one["p_value"] <= 0.11
    both = {r["randomized"]: r["share"] for r in neighbors.neighbor_metrics(points, "id", "x", ["c"], 5).collect()}
    assert both[False] > both[True]
    chi = neighbors.neighbor_chi_square(points, "id", "x", "c", [2.0, 4.0]).collect()
    assert np.median([r["p"] for r in chi]) < 0.05
    c = neighbors.annotation_coherence(points, "id", "x", "labels", 5) if "labels" in points.columns else neighbors.annotation_coherence(
        points.withColumn("labels", F.split("anno", ";")), "id", "x", "labels", 5)
    row = c.agg(F.avg("coherence").alias("a"), F.avg("random").alias("b")).first()
    assert row["a"] < row["b"]
    noise = points.select((F.col("id") + 1000).alias("id"), F.transform("x", lambda v: v + 100).alias("x"))
    assert neighbors.random_neighbor_score(points.select("id", "x"), noise, "id", "x", 5).first()["score"] == 0.0
    assert neighbors.neighbor_preserving(points.withColumn("contig", F.lit("c")), "id", "x", "contig", "pos", "pos",
        4).where("score < 0").count() == 0


def test_embedding_statistics(spark, points):
    assert stats.category_distance(points, "id", "x", "c", 10, metric="euclidean").first()["p"] < 0.05
    got = {r["covariate"]: r["rho"] for r in stats.embedding_correlations(points, "id", "x", 300,
        {"anno": ("anno", "functional"), "pos": ("pos", "number")}, metric="euclidean").collect()}
    assert got["anno"] > 0.5
    assert stats.pair_distribution(points, "id", "x", ["c"], 10, "euclidean").first()["statistic"] > 0.5
    assert stats.silhouette_mean(points.withColumn("k", (F.col("c") == "a").cast("int")), "x", "k") > 0.3
    assert stats.uniform_template(points, "x", 7).count() == 7


def test_evaluation(spark, points):
    small = models.classifier("forest", numTrees=5, maxDepth=3)
    cv = models.cross_validate(points, "x", "id", ["c"], 3, estimator=small)
    acc = cv.where("metric = 'acc'").agg(F.avg("value")).first()[0]
    assert acc > 0.9 and cv.where("metric = 'auroc'").agg(F.avg("value")).first()[0] > 0.9
    assert models.permutation_test(points, "x", "id", "c", rounds=3, k=2, estimator=small).first()["p"] <= 0.26
    weights = models.SaeWeights(np.eye(4), np.eye(4), np.zeros(4))
    assert models.sae_loss(points, "id", "x", weights).first()["dead_latents"] == 0
    gone = models.ablation(points.select("id", "x", "c"), "x", "id", ["c"], weights, [0, 1, 2, 3], "all", 2,
        estimator=small).where("metric = 'acc'").first()
    assert gone["before"] > gone["after"]


def test_codes_and_losses(spark):
    codes = spark.createDataFrame([("t", "d", c) for c in ("TP", "TP", "FP", "TN", "FN", None)], "tool string, drug string, code string")
    got = models.external_metrics(codes).first()
    assert got["acc"] == pytest.approx(0.6) and got["sensitivity"] == pytest.approx(2 / 3)
    p = spark.createDataFrame([("t", "a", {"a": 0.5, "b": 0.5})], "task string, y string, p map<string,double>")
    assert stats.cross_entropy(p, "y", "p").first()["loss"] == pytest.approx(np.log(2))
    done = spark.createDataFrame([(0.1,)], "error double")
    null = spark.createDataFrame([(0.4,), (0.05,), (0.5,)], "error double")
    assert stats.permutation_p(done, null).first()["p"] == pytest.approx(0.5)
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2)], "t string, p int")
    assert stats.clustering_agreement(df, "t", "p").first()["ari"] == pytest.approx(1.0)


def test_pooled_agreement_makes_no_pairs_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = {g: rng.standard_normal((6, 4)) + g for g in range(5)}
    seqs = spark.createDataFrame([(g, v.tolist()) for g, x in groups.items() for v in x], "g long, x array<double>")
    pooled = spark.createDataFrame([(g, x.mean(0).tolist()) for g, x in groups.items()], "g long, x array<double>")
    met, distance = [], stats.vec_distance
    monkeypatch.setattr(stats, "vec_distance", lambda x, y, metric: met.append((x, y)) or distance(x, y, metric))
    got = stats.pooled_agreement(seqs, pooled, "g", "x", 10).first()
    assert met == [("x_a", "x_b")]
    far = lambda a, b: 1 - (a / np.linalg.norm(a, axis=-1, keepdims=True)) @ (b / np.linalg.norm(b, axis=-1, keepdims=True)).T
    pairs = [(a, b) for b in range(5) for a in range(b)]
    cross = [far(groups[a], groups[b]).mean() for a, b in pairs]
    pool = [far(groups[a].mean(0), groups[b].mean(0)) for a, b in pairs]
    rank = lambda v: np.argsort(np.argsort(v))
    assert got["n"] == 10 and abs(got["rho"] - np.corrcoef(rank(cross), rank(pool))[0, 1]) < 1e-9


def test_silhouette_sends_a_block_once_to_many(spark, monkeypatch):
    from tests.test_curation import _shuffled

    monkeypatch.setattr(neighbors, "BLOCK", 8)
    rng = np.random.default_rng(4)
    x, c = rng.standard_normal((400, 16)), rng.integers(0, 3, 400)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, x array<double>, c int")
    got = {}
    assert _shuffled(spark, lambda: got.update({r["id"]: r["silhouette"] for r in stats.silhouette(df, "id", "x", "c").collect()})) < 1_000_000
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(400):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_pairwise_pooling_sends_a_chunk_once_to_many_and_keeps_vectors_out_of_its_weights(spark, monkeypatch):
    """Groups of many chunks and runs, as brute force has them; no row of partial weights carries a vector."""
    from lociframe.operators import pooling

    monkeypatch.setattr(pooling, "CHUNK_ROWS", 4)
    monkeypatch.setattr(pooling, "RUN_CHUNKS", 3)
    written, write = [], pooling.materialise
    monkeypatch.setattr(pooling, "materialise", lambda df, *a: written.append(df.columns) or write(df, *a))
    rng = np.random.default_rng(4)
    rows = [(g, rng.normal(size=3).tolist()) for g, n in (("a", 61), ("b", 4), ("c", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x array<double>").repartition(5)
    for metric, agg in (("euclidean_distance", "mean"), ("manhattan_distance", "max"), ("euclidean_similarity", "sum")):
        got = {r["g"]: r["x"] for r in pooling.pool_similarity(df, ["g"], "x", metric, agg).collect()}
        for g in "abc":
            x = np.array([v for k, v in rows if k == g])
            d = np.abs(x[:, None] - x[None]).sum(2) if metric.startswith("man") else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
            np.fill_diagonal(d, 0)
            score = 1 / (1 + d) if metric.endswith("similarity") else d
            w = {"mean": score.mean(1), "max": score.max(1), "sum": score.sum(1)}[agg]
            assert np.allclose(got[g], (w[:, None] * x).sum(0), atol=1e-6)
    assert ["_id", "_n", "_w"] in written


def test_metrics_of_permuted_labels_share_the_neighbours(spark, monkeypatch):
    """Labels are permuted, vectors are not: the neighbours are searched once."""
    calls, knn = [], neighbors.knn
    monkeypatch.setattr(neighbors, "knn", lambda *a, **kw: calls.append(1) or knn(*a, **kw))
    points = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 2) * 50 + i / 100, 1.0]) for i in range(40)], "id long, c string, x array<double>")
    got = {r["randomized"]: r for r in neighbors.neighbor_metrics(points, "id", "x", ["c"], 5).collect()}
    assert len(calls) == 1 and got[False]["share"] == 1.0 and got[True]["share"] < 1.0
    assert got[False]["distance"] == got[True]["distance"]
