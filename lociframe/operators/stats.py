"""Statistics (ST1-ST3, ST5, ST6, ST8, ST11, ST13, ST14, ST16-ST20, ST27, ST30); p-values are asymptotic."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.columns import abs_diff, kmer_distance, label_jaccard, split_labels, vec_distance
from ..functions.seeded import unit
from ..scratch import few_rows, materialise
from .joins import taxon_distance
from .sampling import random_pairs, related_pairs
from .sets import union
from .windows import avg_rank, running_sums, value_ranks



def _t_tail(r: float | None, n: int | None) -> float | None:
    if r is None or n is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else float(tails.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] | None = None) -> DataFrame:
    """ST1: ``rho, n, p`` over rows with both values, of the table or of each group.

    Values are written before they are ranked, as ranks meet their rows by value: a sum that is made anew can differ in its last bits.
    """
    rows = materialise(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*(by or []), F.col(x).alias("_x"),
        F.col(y).alias("_y")))
    ranked = avg_rank(avg_rank(rows, "_x", by, "_rx"), "_y", by, "_ry") if by else both_ranks(rows)
    out = ranked.groupBy(*(by or [])).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("p", tails.column(_t_tail, "rho", "n"))


def both_ranks(rows: DataFrame) -> DataFrame:
    """``_rx, _ry``, the average ranks of ``_x, _y`` (without nulls), from one ordering of the distinct values of both."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ("_x", "_y")]))
    ranks = value_ranks(rows.select(values.alias("s")).select("s.*"), "v", ["c"])
    for c, r in (("_x", "_rx"), ("_y", "_ry")):
        one = ranks.where(F.col("c") == c).select(F.col("value").alias(f"_v{c}"), (F.col("below") + (F.col("n") + 1) / 2).alias(r))
        rows = rows.join(one, F.col(c).cast("double") == F.col(f"_v{c}")).drop(f"_v{c}")
    return rows


def ks_2samp(df: DataFrame, value: str, group: str, alternative: str = "two-sided", by: Sequence[str] | None = None) -> DataFrame:
    """ST2: largest difference of the two samples' distributions, ``statistic, n1, n2, p``; ``group`` is true for the first sample.

    ``greater``: the first sample's distribution function lies above; ``less``: below.
    """
    by = list(by or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count_if(F.col(group)).alias("a"),
        F.count_if(~F.col(group)).alias("b"))
    run = running_sums(counts, by, ["_v"], ["a", "b"]).select(*by, F.col("_run_a").alias("ca"), F.col("_run_b").alias("cb"))
    sizes = counts.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    joined = run.join(sizes, by) if by else run.join(F.broadcast(sizes))  # one row
    diff = F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2")
    stat = {"two-sided": F.abs(diff), "greater": diff, "less": -diff}[alternative]
    out = joined.groupBy(*by, "n1", "n2").agg(F.greatest(F.max(stat), F.lit(0.0)).alias("statistic"))
    tail = tails.ks_two_sided if alternative == "two-sided" else tails.ks_one_sided
    return out.withColumn("p", tails.column(lambda d, n, m: tail(d, n, m) if n and m else None, "statistic", "n1", "n2"))


def wilcoxon(df: DataFrame, x: str, y: str, by: Sequence[str] | None = None) -> DataFrame:
    """ST3: signed ranks of the differences, zeros dropped: ``w_plus, w_minus, n, z, p`` (normal, ties corrected).

    Differences are written before they are ranked (``spearman``).
    """
    by = list(by or [])
    rows = materialise(df.select(*by, (F.col(x) - F.col(y)).alias("_d")).where("_d <> 0")).withColumn("_a", F.abs("_d"))
    ranked = avg_rank(rows, "_a", by or None, "_r")
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"))
    ties = rows.groupBy(*by, "_a").agg(F.count("*").alias("t")).groupBy(*by).agg(
        F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("_ties"))
    out = sums.join(ties, by) if by else sums.join(F.broadcast(ties))  # one row
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    out = out.withColumn("z", (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).drop("_ties")
    return out.withColumn("p", tails.column(lambda z: min(1.0, 2 * tails.normal_sf(abs(z))), "z"))


def mc_test(observed: DataFrame, null: DataFrame, alternative: str = "two-sided", value: str = "value") -> DataFrame:
    """ST5: observed rows with the null's distribution function at them, ``p`` and Bonferroni's ``p_adj``; zero is written as 1e-10.

    Observed and null values are counted together in the order of values, so neither is joined to all of the other.
    """
    every = null.select(F.col(value).alias("_v"), F.lit(1).alias("_null")).unionByName(observed.select(F.col(value).alias("_v"),
        F.lit(0).alias("_null")))
    cum = value_ranks(every.where("_null = 1"), "_v").select(F.col("value").alias("_v"), (F.col("below") + F.col("n")).alias("upto"))
    total = null.where(F.col(value).isNotNull()).count()
    points = observed.select(F.col(value).alias("_v")).where("_v is not null").distinct()
    merged = cum.unionByName(points.withColumn("upto", F.lit(None).cast("long"))).groupBy("_v").agg(F.max("upto").alias("upto"))
    parts = max(1, int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = materialise(merged.repartitionByRange(parts, "_v").withColumn("_p", F.spark_partition_id()))
    tops = sorted(keyed.groupBy("_p").agg(F.max("upto").alias("m")).collect())  # a row a partition
    pairs, best = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in tops:
        pairs += [F.lit(r["_p"]), F.lit(best).cast("long")]
        best = max(best, r["m"] or 0)
    w = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cdf = keyed.select("_v", (F.coalesce(F.max("upto").over(w), F.create_map(*pairs)[F.col("_p")]) / F.lit(float(max(1, total))))
        .alias("cdf"))
    p = {"less": F.col("cdf"), "greater": 1 - F.col("cdf"), "two-sided": 2 * F.least("cdf", 1 - F.col("cdf"))}[alternative]
    out = observed.join(cdf, F.col(value) == F.col("_v")).drop("_v").withColumn("p", F.when(p == 0, 1e-10).otherwise(p))
    least = out.agg(F.least(F.min("p") * F.count("*"), F.lit(1.0)).alias("p_adj"))
    return out.join(F.broadcast(least))  # one row


def mc_test_by(data: DataFrame, null_data: DataFrame, statistic: Callable[[DataFrame], DataFrame],
    alternative: str = "two-sided") -> DataFrame:
    """ST5 with a statistic (UD2): a callable from a table to ``value`` rows, applied to both; observed values are made once (``spearman``)."""
    return mc_test(materialise(statistic(data)), statistic(null_data), alternative)


_SMALL_LOG_FACTORIALS = 32


def log_factorial(k: Column) -> Column:
    """Natural logarithm of k!: a table up to 31, beyond it Stirling's series, whose error is below that of a double."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_SMALL_LOG_FACTORIALS)])
    x = k.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260
        * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(k < _SMALL_LOG_FACTORIALS, F.get(table, k.cast("int"))).otherwise(series)


def _multinomial_counts(probs: Sequence[float]) -> Callable:
    """Sizes and uniform numbers to counts by category: each category takes a binomial share of what those before it left."""
    import numpy as np
    import pyarrow as pa

    left = np.append(np.cumsum(probs[::-1])[::-1], 0.0)

    def run(batches):
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("_size")).to_numpy()
            if not len(n):
                continue
            u = batch.column(batch.schema.get_field_index("u"))
            u = u.flatten().to_numpy().reshape(len(n), -1)
            rest, out = n.copy(), np.zeros((len(n), len(probs)), np.int64)
            for c, p in enumerate(probs):
                last = c == len(probs) - 1
                out[:, c] = rest if last else tails.binomial_quantile(rest, min(1.0, p / left[c]), u[:, c])
                rest = rest - out[:, c]
            at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(probs))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_size")),
                pa.ListArray.from_arrays(at, pa.array(out.reshape(-1)))], names=["_size", "ks"])

    return run


def multinomial_test(obs: DataFrame, cats: DataFrame, n_resample: int = 10_000, seed: int = 0, group: str = "group",
    category: str = "category") -> DataFrame:
    """ST6: for each group of ``group, category`` rows the log-probability of its counts under the shares in ``cats``, and how much of as many drawn groups of its size has less.

    A drawn group is one row: a binomial draw a category (in order of names), whatever the group's size. Counts are summed in that
    order, so equal counts have equal values.
    """
    shares = sorted((r[category], r["n"]) for r in cats.groupBy(category).agg(F.count("*").alias("n")).collect())  # a row a category
    total = sum(n for _, n in shares)
    probs = [n / total for _, n in shares]
    if not shares:
        raise ValueError("there are no categories")
    place = F.create_map(*[F.lit(v) for i, (c, _) in enumerate(shares) for v in (c, i)])
    log_p = F.array(*[F.lit(math.log(p)) for p in probs])
    term = lambda i, k: k * F.get(log_p, i) - log_factorial(k)
    counts = obs.groupBy(group, category).agg(F.count("*").alias("k"))
    listed = counts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(place[F.col(category)], F.lit(-1)).alias("i"), "k")))
        .alias("cells"), F.sum("k").cast("long").alias("_size"))  # a cell a category
    known = F.forall("cells", lambda c: c["i"] >= 0)
    observed = listed.select(group, "_size",
        F.when(known, F.round(F.aggregate("cells", F.lit(0.0), lambda s, c: s + term(c["i"], c["k"])) + log_factorial(F.col("_size")), 9))
            .alias("value"))
    observed = materialise(observed)
    kinds = observed.where("value is not null").select("_size").distinct()
    parts = max(1, int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    draws = kinds.select("_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_resample - 1).cast("long"))).alias("id")).repartition(
        parts, "_size", "id")
    numbers = F.transform(F.sequence(F.lit(1), F.lit(len(shares))), lambda i: unit(seed, "multinomial", F.col("_size"), F.col("id"), i))
    drawn = draws.select("_size", numbers.alias("u")).mapInArrow(_multinomial_counts(probs), "_size long, ks array<long>")
    cells = F.transform("ks", lambda k, i: F.struct(i.alias("i"), k.alias("k")))
    null = drawn.select("_size",
        F.round(F.aggregate(cells, F.lit(0.0), lambda s, c: s + term(c["i"], c["k"])) + log_factorial(F.col("_size")), 9).alias("value"))
    points = null.groupBy("_size", "value").agg(F.count("*").alias("n")).unionByName(observed.where("value is not null").select("_size",
        "value", F.lit(0).cast("long").alias("n")).distinct()).groupBy("_size", "value").agg(F.sum("n").alias("n"))
    cdf = running_sums(points, ["_size"], ["value"], ["n"]).select("_size", "value",
        (F.col("_run_n") / F.lit(float(n_resample))).alias("cdf"))
    out = observed.join(cdf, ["_size", "value"]).withColumn("p", F.when(F.col("cdf") == 0, 1e-10).otherwise(F.col("cdf"))).drop("_size")
    least = out.agg(F.least(F.min("p") * F.count("*"), F.lit(1.0)).alias("p_adj"))
    return out.join(F.broadcast(least))  # one row


def pair_vectors(pairs: DataFrame, df: DataFrame, id: str, cols: Mapping[str, str]) -> DataFrame:
    """Pairs ``a, b`` with columns of both rows as ``<name>_a`` and ``<name>_b``."""
    left = df.select(F.col(id).alias("a"), *[F.col(c).alias(f"{n}_a") for n, c in cols.items()])
    right = df.select(F.col(id).alias("b"), *[F.col(c).alias(f"{n}_b") for n, c in cols.items()])
    return pairs.join(left, "a").join(right, "b")


def category_distance(df: DataFrame, id: str, x: str, label: str, n: int = 1000, seed: int = 0, metric: str = "cosine") -> DataFrame:
    """ST8: are pairs of one label nearer than pairs of different ones: KS, greater."""
    pairs = pair_vectors(related_pairs(df, id, label, n, seed), df, id, {"x": x})
    return ks_2samp(pairs.select("related", vec_distance("x_a", "x_b", metric).alias("d")), "d", "related", "greater")


def embedding_correlations(df: DataFrame, id: str, x: str, n: int, covariates: Mapping[str, tuple[str, str]], rounds: int = 1,
    seed: int = 0, metric: str = "cosine", tax: DataFrame | None = None) -> DataFrame:
    """ST11: Spearman correlation of vector distance with each covariate's over drawn pairs: ``round, covariate, rho, n, p``.

    A covariate is ``(column, kind)``: ``functional`` (labels split by ``;``), ``sequence``, ``number`` or ``taxonomic``.
    """
    pairs = reduce(DataFrame.unionByName, [random_pairs(df, id, n, seed + r).withColumn("round", F.lit(r)) for r in range(rounds)])
    both = pair_vectors(pairs, df, id, {"x": x} | {k: c for k, (c, _) in covariates.items()}).withColumn("d",
        vec_distance("x_a", "x_b", metric))
    out = []
    for name, (_, kind) in covariates.items():
        a, b = f"{name}_a", f"{name}_b"
        if kind == "taxonomic":
            rows = taxon_distance(both, tax, a, b).withColumn("c", F.col("distance").cast("double"))
        else:
            c = {"functional": lambda: label_jaccard(split_labels(a), split_labels(b)), "sequence": lambda: kmer_distance(a, b),
                "number": lambda: abs_diff(a, b)}[kind]()  # noqa: B023
            rows = both.withColumn("c", c.cast("double"))
        out.append(spearman(rows, "d", "c", ["round"]).select("round", F.lit(name).alias("covariate"), "rho", "n", "p"))
    return union(out, diagonal=False)


def pair_distribution(df: DataFrame, id: str, x: str, cols: Sequence[str], n_per: int = 100, metric: str = "cosine",
    seed: int = 0) -> DataFrame:
    """ST13: for each column the distances of related and unrelated pairs: their means, the KS statistic, and the relative entropy of rank-aligned normalised distances."""
    out = []
    for c in cols:
        pairs = pair_vectors(related_pairs(df, id, c, n_per, seed), df, id, {"x": x}).select("related",
            vec_distance("x_a", "x_b", metric).alias("d"))
        ks = ks_2samp(pairs, "d", "related", "greater").select("statistic", "p", "n1", "n2")
        means = pairs.agg(F.avg(F.when(F.col("related"), F.col("d"))).alias("related_mean"),
            F.avg(F.when(~F.col("related"), F.col("d"))).alias("unrelated_mean"))
        ranked = avg_rank(pairs.withColumn("d", F.greatest("d", F.lit(1e-12))), "d", ["related"], "r").withColumn("k", F.floor("r"))
        a = ranked.where("related").groupBy("k").agg(F.sum("d").alias("da"))
        b = ranked.where("not related").groupBy("k").agg(F.sum("d").alias("db"))
        both = a.join(b, "k")
        sums = both.agg(F.sum("da").alias("sa"), F.sum("db").alias("sb"))
        kl = both.join(F.broadcast(sums)).agg(
            F.sum(F.col("da") / F.col("sa") * F.ln((F.col("da") / F.col("sa")) / (F.col("db") / F.col("sb")))).alias("relative_entropy"))
        out.append(ks.join(F.broadcast(means)).join(F.broadcast(kl)).select(F.lit(c).alias("col"), "related_mean", "unrelated_mean",
            "statistic", "p", "relative_entropy"))  # one row each
    return union(out, diagonal=False)


def _mean_units(df: DataFrame, by: str, x: str) -> DataFrame:
    """``by, _u``: the mean of each group's vectors as unit vectors; those without a direction are left out."""
    y = F.col(x).cast("array<double>")
    norm = F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v))
    units = df.where(y.isNotNull() & (norm > 0)).select(by, F.posexplode(F.transform(y, lambda v: v / norm)).alias("_at", "_v"))
    means = units.groupBy(by, "_at").agg(F.avg("_v").alias("_v"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("_u"))


def pooled_agreement(seqs: DataFrame, pooled: DataFrame, sample: str, x: str, n: int, metric: str = "cosine", seed: int = 0) -> DataFrame:
    """ST14: Spearman correlation, over drawn sample pairs, of the mean distance between their rows and the distance of their pooled vectors.

    The mean cosine distance of all pairs of rows of two samples is 1 less the product of their mean unit vectors, so no pairs of rows
    are made; other distances have no such form and meet row by row. Samples are far fewer than rows: pairs are drawn from all of them.
    """
    pairs = random_pairs(pooled, sample, n, seed, every=True)
    if metric == "cosine":
        both = pair_vectors(pairs, _mean_units(seqs, sample, x).join(pooled.select(F.col(sample).alias("_s"), F.col(x).alias("_p")),
            F.col(sample) == F.col("_s")), sample, {"u": "_u", "x": "_p"})
        cross = F.lit(1.0) - F.aggregate(F.zip_with("u_a", "u_b", lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
        return spearman(both.select(cross.alias("cross"), vec_distance("x_a", "x_b", metric).alias("pooled")), "cross", "pooled")
    rows = pairs.join(seqs.select(F.col(sample).alias("a"), F.col(x).alias("_x")),
        "a").join(seqs.select(F.col(sample).alias("b"), F.col(x).alias("_y")), "b")
    cross = rows.groupBy("a", "b").agg(F.avg(vec_distance("_x", "_y", metric)).alias("cross"))
    both = pair_vectors(cross, pooled, sample, {"x": x}).withColumn("pooled", vec_distance("x_a", "x_b", metric))
    return spearman(both, "cross", "pooled")


def clustering_agreement(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """ST16: ``ari, homogeneity, completeness`` from the contingency table."""
    cells = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(truth, pred).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    ent = lambda c: F.sum(F.col(c).cast("double") * F.ln(F.col(c).cast("double")))
    t = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(two("n").alias("t2"), ent("n").alias("te"),
        F.sum("n").cast("double").alias("all"))
    p = cells.groupBy(pred).agg(F.sum("n").alias("n")).agg(two("n").alias("p2"), ent("n").alias("pe"))
    c = cells.agg(two("n").alias("c2"), ent("n").alias("ce"))
    one = c.join(F.broadcast(t)).join(F.broadcast(p))  # one row each
    all2 = F.col("all") * (F.col("all") - 1) / 2
    expected = F.col("t2") * F.col("p2") / all2
    ari = (F.col("c2") - expected) / ((F.col("t2") + F.col("p2")) / 2 - expected)
    log_all = F.ln("all")
    ht, hp = log_all - F.col("te") / F.col("all"), log_all - F.col("pe") / F.col("all")
    joint = log_all - F.col("ce") / F.col("all")
    mutual = ht + hp - joint
    return one.select(F.coalesce(ari, F.lit(1.0)).alias("ari"),
        F.coalesce(mutual / F.nullif(ht, F.lit(0.0)), F.lit(1.0)).alias("homogeneity"),
            F.coalesce(mutual / F.nullif(hp, F.lit(0.0)), F.lit(1.0)).alias("completeness"))


def silhouette_mean(df: DataFrame, x: str, cluster: str) -> float:
    """ST17: mean silhouette by squared Euclidean distance, from cluster sums."""
    rows = df.select(array_to_vector(F.col(x).cast("array<double>")).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


#: Cluster sums of up to so many bytes are sent to the workers; more are met by blocks of rows.
CLUSTER_BYTES = 64 << 20


def _silhouette_from_sums(metric: str, clusters: list, sums, squares, sizes) -> Callable:
    """Each row's mean distance to every cluster in closed form: squared Euclidean from sums and sums of squares, cosine from sums of unit vectors."""
    import numpy as np
    import pyarrow as pa

    from .vector_index import matrix

    place = {c: i for i, c in enumerate(clusters)}

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                x = matrix(some.column(1))
                own = np.array([place[c] for c in some.column(2).to_pylist()], np.int64)
                if metric == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        total = sizes - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ sums.T
                else:
                    total = sizes * (x**2).sum(1)[:, None] - 2 * x @ sums.T + squares
                rows = np.arange(len(x))
                n = sizes[own]
                a = np.where(n > 1, total[rows, own] / np.maximum(n - 1, 1), np.nan)
                total[rows, own] = np.inf
                b = (total / sizes).min(axis=1)
                with np.errstate(invalid="ignore"):
                    value = np.where(np.isfinite(b) & (n > 1), (b - a) / np.maximum(a, b), 0.0)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.nan_to_num(value))], names=["id", "silhouette"])

    return run


def silhouette_closed(df: DataFrame, id: str, x: str, cluster: str, metric: str = "sqeuclidean") -> DataFrame:
    """ST17: silhouette of every row by squared Euclidean (``sqeuclidean``) or cosine distance, from sums by cluster: one pass for the sums, one for the rows.

    Rows without a vector or cluster are left out; a cluster of one row scores 0, as does a row where there is one cluster. Sums that
    take over ``CLUSTER_BYTES`` raise an error: so many clusters need ``silhouette``.
    """
    import numpy as np

    if metric not in ("sqeuclidean", "cosine"):
        raise ValueError(f"no closed form for {metric}")
    rows = df.where(F.col(x).isNotNull() & F.col(cluster).isNotNull()).select(F.col(id).alias("id"),
        F.col(x).cast("array<double>").alias("x"), F.col(cluster).cast("string").alias("c"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit_x = F.transform("x", lambda v: v / norm) if metric == "cosine" else F.col("x")
    if metric == "cosine":
        rows = rows.where(norm > 0)
    shape = rows.agg(F.count_distinct("c").alias("k"), F.max(F.size("x")).alias("w"), F.min(F.size("x")).alias("least")).first()
    if not shape["k"]:
        return rows.select("id", F.lit(0.0).alias("silhouette"))
    if shape["w"] != shape["least"]:
        raise ValueError("vectors differ in length")
    if shape["k"] * shape["w"] * 8 > CLUSTER_BYTES:
        raise ValueError("the sums of so many clusters are too large to send: use silhouette")
    long = rows.select("c", F.posexplode(unit_x).alias("pos", "v"))
    cells = long.groupBy("c", "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n")).collect(
        )  # CLUSTER_BYTES or less
    clusters = sorted({r["c"] for r in cells})
    at = {c: i for i, c in enumerate(clusters)}
    sums, squares, sizes = np.zeros((len(clusters), shape["w"])), np.zeros(len(clusters)), np.zeros(len(clusters))
    for r in cells:
        sums[at[r["c"]], r["pos"]] = r["s"]
        squares[at[r["c"]]] += r["q"]
        sizes[at[r["c"]]] = r["n"]
    return rows.mapInArrow(_silhouette_from_sums(metric, clusters, sums, squares, sizes),
        f"id {df.schema[id].dataType.simpleString()}, silhouette double")


#: Blocks that one block of rows is compared with where it is sent once.
RUN_BLOCKS = 32
#: Bytes of blocks that a file's part holds.
WORK_BYTES = 16 << 20


def silhouette(df: DataFrame, id: str, x: str, cluster: str, metric: str = "euclidean") -> DataFrame:
    """ST17: exact silhouette of every row; squared Euclidean and cosine distance have a closed form, others go by pairs of blocks.

    A block of rows travels once to each ``RUN_BLOCKS`` blocks that it is compared with, and a row a cluster with the sum of all those
    distances is what leaves them. The work still grows with the square of the rows.
    """
    if metric in ("sqeuclidean", "cosine"):
        return silhouette_closed(df, id, x, cluster, metric)
    import numpy as np
    import pyarrow as pa

    from .neighbors import BLOCK, _blocks
    from .vector_index import WORK_ROWS
    from .vector_index import distances as _distances

    rows = df.select(F.col(id), F.struct(F.col(x).cast("array<double>").alias("x"), F.col(cluster).cast("double").alias("c")).alias("s"))
    flat = rows.select(id, F.concat(F.array("s.c"), "s.x").alias("_x"))
    kind, n = df.schema[id].dataType.simpleString(), flat.count()
    blocks = materialise(_blocks(flat, id, "_x", n), WORK_BYTES)
    each = max(1, -(-n // BLOCK))
    runs = -(-each // RUN_BLOCKS)
    deals = max(1, min(each, RUN_BLOCKS // 2, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // runs)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mine = blocks.select("block", "ids", "xs", (F.col("block") % deals).cast("int").alias("deal"), every(runs).alias("run"))
    theirs = blocks.select(F.col("xs").alias("rxs"), F.floor(F.col("block") / RUN_BLOCKS).cast("int").alias("run"),
        every(deals).alias("deal"))
    pairs = mine.join(theirs, ["run", "deal"]).select("block", "run", "ids", "xs", "rxs")

    def summed(ids, own, sums):
        kinds = list(sums)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), len(kinds)))),
            pa.array(np.repeat(own, len(kinds))), pa.array(np.tile(np.array(kinds), len(ids))),
                pa.array(np.stack([sums[c] for c in kinds], 1).reshape(-1))], names=["id", "own", "c", "s"])

    def run(batches):
        now, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                ids, xs, rxs = (batch.column(c)[i].values for c in range(2, 5))
                wid = len(xs.flatten()) // max(1, len(xs))
                a, b = (v.flatten().to_numpy(zero_copy_only=False).reshape(-1, wid) for v in (xs, rxs))
                if key != now:
                    if held:
                        yield summed(*held)
                    now, held = key, (ids, a[:, 0], {})
                d = _distances(a[:, 1:], b[:, 1:], metric)
                kinds, at = np.unique(b[:, 0], return_inverse=True)
                for j, c in enumerate(kinds.tolist()):
                    held[2][c] = held[2].get(c, 0.0) + d[:, at == j].sum(1)
        if held:
            yield summed(*held)

    with few_rows(df.sparkSession, WORK_ROWS):
        sums = materialise(pairs.mapInArrow(run, f"id {kind}, own double, c double, s double").groupBy("id", "own", "c")
            .agg(F.sum("s").alias("s")))
    sizes = df.groupBy(F.col(cluster).cast("double").alias("c")).agg(F.count("*").alias("k"))
    w = sums.join(sizes, "c")
    a = F.max(F.when((F.col("c") == F.col("own")) & (F.col("k") > 1), F.col("s") / (F.col("k") - 1)))
    b = F.min(F.when(F.col("c") != F.col("own"), F.col("s") / F.col("k")))
    return w.groupBy("id").agg(a.alias("a"), b.alias("b")).select("id", F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"),
        F.lit(0.0)).alias("silhouette"))


def calinski_harabasz(df: DataFrame, x: str, cluster: str) -> DataFrame:
    """ST17: between- over within-cluster scatter, from sums by cluster and component."""
    long = df.select(F.col(cluster).alias("_c"), F.posexplode(x).alias("_p", "_v")).withColumn("_v", F.col("_v").cast("double"))
    cells = long.groupBy("_c", "_p").agg(F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"), F.count("*").alias("n"))
    per = cells.groupBy("_p").agg((F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"),
        (F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return per.agg((F.sum("between") / (F.max("k") - 1) / (F.sum("within") / (F.max("n") - F.max("k")))).alias("ch"))


def regression_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ("task",)) -> DataFrame:
    """ST18: ``metric, value`` rows of mse, pearson, spearman and nrmse for each group."""
    by = list(by)
    one = df.groupBy(*by).agg(F.avg((F.col(truth) - F.col(pred)) * (F.col(truth) - F.col(pred))).alias("mse"),
        F.corr(truth, pred).alias("pearson"), (F.max(truth) - F.min(truth)).alias("_range"))
    rho = spearman(df, truth, pred, by).select(*by, F.col("rho").alias("spearman"))
    wide = one.join(rho, by, "left").withColumn("nrmse", F.sqrt("mse") / F.nullif("_range", F.lit(0))).drop("_range")
    return wide.unpivot(by, ["mse", "pearson", "spearman", "nrmse"], "metric", "value")


def classification_metrics(df: DataFrame, truth: str, pred: str, scores: str | None = None, by: Sequence[str] = ("task",)) -> DataFrame:
    """ST19: ``metric, value`` rows: acc, kappa, mcc, normalised mcc, and with ``scores`` (a map from label to probability) macro one-versus-rest auroc and aupr."""
    by = list(by)
    cells = df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(*by, F.col("t").alias("l")).agg(F.sum("n").alias("nt"))
    cols = cells.groupBy(*by, F.col("p").alias("l")).agg(F.sum("n").alias("np"))
    margins = rows.join(cols, [*by, "l"], "full").na.fill(0.0, ["nt", "np"]).groupBy(*by).agg(F.sum(F.col("nt") * F.col("np")).alias("tp"),
        F.sum(F.col("nt") * F.col("nt")).alias("tt"), F.sum(F.col("np") * F.col("np")).alias("pp"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"))
    m = total.join(margins, by) if by else total.join(F.broadcast(margins))  # one row
    s, c = F.col("s"), F.col("c")
    mcc = F.coalesce((c * s - F.col("tp")) / F.nullif(F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt"))), F.lit(0.0)), F.lit(0.0))
    chance = F.col("tp") / (s * s)
    wide = m.select(*by, (c / s).alias("acc"), F.coalesce((c / s - chance) / F.nullif(1 - chance, F.lit(0.0)), F.lit(0.0)).alias("kappa"),
        mcc.alias("mcc"), ((mcc + 1) / 2).alias("mcc_normalised"))
    names = ["acc", "kappa", "mcc", "mcc_normalised"]
    if scores:
        each = df.select(*by, F.col(truth).alias("t"), F.explode(scores).alias("label", "score")).withColumn("hit",
            (F.col("t") == F.col("label")).cast("double"))
        areas = ranking_areas(each, "score", "hit", [*by, "label"])
        macro = areas.groupBy(*by).agg(F.avg("auroc").alias("auroc"), F.avg("aupr").alias("aupr"))
        wide = wide.join(macro, by, "left") if by else wide.join(F.broadcast(macro))  # one row
        names += ["auroc", "aupr"]
    return wide.unpivot(by, names, "metric", "value")


def ranking_areas(df: DataFrame, score: str, hit: str, by: Sequence[str]) -> DataFrame:
    """``auroc`` by rank sums and ``aupr`` (average precision) of each group; ties share a threshold."""
    by = list(by)
    levels = df.groupBy(*by, F.col(score).alias("v")).agg(F.sum(hit).alias("pos"), F.count("*").cast("double").alias("n"))
    run = running_sums(levels.withColumn("pos", F.coalesce("pos", F.lit(0.0)).cast("double")), by, ["v"], ["n", "pos"])
    all_of = levels.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("n").alias("_n"),
        F.coalesce(F.sum("pos"), F.lit(0.0)).alias("_pos"))
    run = run.join(all_of, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else run.join(F.broadcast(all_of))  # one row
    down = lambda c: F.col(f"_{c}") - F.col(f"_run_{c}") + F.col(c)
    x = run.select(*by, "v", "pos", "n", (F.col("_run_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), down("pos").alias("cp"),
        down("n").alias("cn"))
    g = x.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("n").alias("N"), F.sum(F.col("pos") * F.col("rank")).alias("R"),
        F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("A"))
    neg = F.col("N") - F.col("P")
    return g.select(*by, ((F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / F.nullif(F.col("P") * neg, F.lit(0.0))).alias("auroc"),
        (F.col("A") / F.nullif("P", F.lit(0.0))).alias("aupr"))


def permutation_p(original: DataFrame, randomised: DataFrame, error: str = "error") -> DataFrame:
    """ST20: ``p``: for each original error the share of randomised ones at or below it (one added to both), averaged; both are a row a fit."""
    k = randomised.count()
    null = mc_test(original.withColumnRenamed(error, "value"), randomised.withColumnRenamed(error, "value"), "less")
    return null.agg(F.avg((F.round(F.col("cdf") * k) + 1) / (k + 1)).alias("p"))


def uniform_template(df: DataFrame, x: str, n: int, seed: int = 0) -> DataFrame:
    """ST27: ``n`` rows ``id, x`` uniform between each component's least and greatest value."""
    long = df.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.min("v").cast("double").alias("lo"),
        F.max("v").cast("double").alias("hi"))
    bounds = long.agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("b"))  # a row a component
    rows = df.sparkSession.range(n).join(F.broadcast(bounds))
    return rows.select("id", F.transform("b", lambda s, i: s["lo"] + (s["hi"] - s["lo"]) * unit(seed, "uniform", F.col("id"), i))
        .alias("x"))


def cross_entropy(df: DataFrame, truth: str, proba: str, by: Sequence[str] = ("task",), weights: Column | None = None) -> DataFrame:
    """ST30: (weighted) mean of the negative log of the true label's probability in a map."""
    w = F.lit(1.0) if weights is None else weights
    p = F.greatest(F.coalesce(F.try_element_at(F.col(proba), F.col(truth)), F.lit(0.0)), F.lit(1e-15))
    return df.groupBy(*by).agg((F.sum(-F.ln(p) * w) / F.sum(w)).alias("loss"))
