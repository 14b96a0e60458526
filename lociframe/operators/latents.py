"""Labels and latents (AG26-AG28, ST21-ST26); activations are long: ``sample, latent, act``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import split_labels
from .joins import overlap_join
from .windows import topk_labels


def activations(df: DataFrame, sample: str, x: str) -> DataFrame:
    """Vectors to long activations, null and NaN as zero; all positions are kept so that means are over all."""
    return df.select(F.col(sample).alias("sample"), F.posexplode(x).alias("latent", "act")).withColumn("act",
        F.coalesce(F.nanvl(F.col("act").cast("double"), F.lit(0.0)), F.lit(0.0)))


def pool_latents(acts: DataFrame, labels: DataFrame, agg: str = "max", sample: str = "sample", label: str = "label") -> DataFrame:
    """AG26, AG27: ``latent, label, value`` by max, mean or sum over the label's samples."""
    fn = {"max": F.max, "mean": F.avg, "sum": F.sum}[agg]
    return acts.join(labels.select(F.col(sample).alias("sample"), F.col(label).alias("label")), "sample").groupBy("latent",
        "label").agg(fn("act").alias("value"))


def latent_categories(acts: DataFrame, active_threshold: float = 0.0, dense: float = 0.1, dead: float = 0.0) -> DataFrame:
    """AG28: ``latent, frac_active, category``: dead where never active, dense above a share, else sparse."""
    frac = acts.groupBy("latent").agg(F.avg((F.col("act") > active_threshold).cast("double")).alias("frac_active"))
    return frac.withColumn("category", F.when(F.col("frac_active") <= dead, "dead").when(F.col("frac_active") > dense, "dense")
        .otherwise("sparse"))


def drop_latents(acts: DataFrame, categories: DataFrame, drop: Sequence[str] = ("dead",), include_samples: bool = True,
    active_threshold: float = 0.0) -> DataFrame:
    """AG28: latents of these categories go, and samples with no active latent left."""
    kept = acts.join(categories.where(~F.col("category").isin(list(drop))).select("latent"), "latent", "left_semi")
    if not include_samples:
        return kept
    live = kept.where(F.col("act") > active_threshold).select("sample").distinct()
    return kept.join(live, "sample", "left_semi")


def latent_scores(acts: DataFrame, labels: DataFrame, threshold: float, label: str = "label", sep: str | None = ";",
    label_mean: bool = False) -> DataFrame:
    """ST21: one-versus-rest metrics of each latent for each label, and the label's share of its activation.

    Activation of a sample is divided among its labels; with ``label_mean`` the label's mean activation
    is taken instead. Only active cells are joined; the other margins follow by subtraction.
    """
    pairs = labels.select("sample", (F.explode(split_labels(label, sep)) if sep else F.col(label)).alias("label")).where(
        "label is not null").distinct()
    n = acts.select("sample").distinct().count()
    per_sample = pairs.groupBy("sample").agg(F.count("*").alias("k"))
    sizes = pairs.join(acts.select("sample").distinct(), "sample", "left_semi").groupBy("label").agg(F.count("*").alias("n_label"))
    hits = acts.where(F.col("act") >= threshold)
    tp = hits.join(pairs, "sample").groupBy("latent", "label").agg(F.count("*").alias("tp"))
    active = hits.groupBy("latent").agg(F.count("*").alias("n_active"))
    grid = acts.select("latent").distinct().join(F.broadcast(sizes))  # a row a label
    weight = F.col("act") / F.col("k") if not label_mean else F.col("act")
    sums = acts.where("act <> 0").join(pairs.join(per_sample, "sample"), "sample").groupBy("latent", "label").agg(F.sum(weight).alias("s"))
    m = grid.join(tp, ["latent", "label"], "left").join(active, "latent", "left").join(sums, ["latent", "label"], "left").na.fill(0,
        ["tp", "n_active"]).na.fill(0.0, ["s"])
    if label_mean:
        m = m.withColumn("s", F.col("s") / F.col("n_label"))
    totals = m.groupBy("latent").agg(F.sum("s").alias("_all"), F.avg((F.col("s") > 0).cast("double")).alias("frac_active"))
    m = m.join(totals, "latent").withColumn("fp", F.col("n_active") - F.col("tp")).withColumn("fn",
        F.col("n_label") - F.col("tp")).withColumn("tn", F.lit(n) - F.col("n_label") - F.col("n_active") + F.col("tp"))
    over = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return m.select(
        "latent", "label", "tp", "fp", "fn", "tn", over("tp", "fn").alias("sensitivity"), over("tn", "fp").alias("specificity"),
            over("fp", "tn").alias("fpr"), over("fn", "tp").alias("fnr"),
        over("tp", "fp").alias("precision"), over("tn", "fn").alias("npv"), ((F.col("tp") + F.col("tn")) / F.lit(n)).alias("accuracy"),
            (F.col("s") / F.nullif("_all", F.lit(0.0))).alias("activation_prop"), "frac_active",
    )


def latent_report(scores: DataFrame, k: int = 1, by: str = "activation_prop") -> DataFrame:
    """ST22: the ``k`` best labels of each latent by a metric, ties by label, with all metrics."""
    return topk_labels(scores, "latent", by, k)


def pair_cooccurrence(labels: DataFrame, report: DataFrame, max_fpr: float = 1.0, label: str = "label", sep: str | None = ";") -> DataFrame:
    """ST23: for the pairs of each latent's two best labels (up to a false-positive rate) the samples that have both and their share."""
    two = report.where((F.col("rank") <= 2) & (F.coalesce(F.col("fpr"), F.lit(0.0)) <= max_fpr)).groupBy("latent").agg(
        F.array_sort(F.collect_set("label")).alias("l")).where(F.size("l") == 2)
    wanted = two.select(F.get("l", F.lit(0)).alias("a"), F.get("l", F.lit(1)).alias("b")).groupBy("a",
        "b").agg(F.count("*").alias("n_latents"))
    pairs = labels.select("sample", (F.explode(split_labels(label, sep)) if sep else F.col(label)).alias("label")).distinct()
    n = labels.select("sample").distinct().count()
    met = wanted.join(pairs.withColumnRenamed("label", "a"), "a").join(pairs.withColumnRenamed("label", "b"), ["sample", "b"]).groupBy("a",
        "b").agg(F.count("*").alias("n"))
    return wanted.join(met, ["a", "b"], "left").na.fill(0, ["n"]).withColumn("share", F.col("n") / F.lit(max(1, n)))


def cooccurrence(labels: DataFrame, sample: str, label: str) -> DataFrame:
    """``a, b, n`` samples that have both labels, a before b; a sample's own list makes its pairs."""
    lists = labels.where(F.col(label).isNotNull()).groupBy(sample).agg(F.array_sort(F.collect_set(label)).alias("l"))
    pairs = F.flatten(F.transform("l",
        lambda a: F.transform(F.filter("l", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def transactions(labels: DataFrame, sample: str, label: str, sep: str | None = None) -> DataFrame:
    """A row a sample with its distinct items, sorted."""
    item = F.explode(split_labels(label, sep)) if sep else F.col(label)
    return labels.select(sample, item.alias("item")).where("item is not null").groupBy(sample).agg(
        F.array_sort(F.collect_set("item")).alias("items"))


def frequent_sets(tx: DataFrame, min_support: float) -> DataFrame:
    """ST24: ``items, support, share`` of item sets in at least a share of transactions."""
    n = tx.count()
    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(tx).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"),
        (F.col("freq") / F.lit(max(1, n))).alias("share"))


def transaction_stats(tx: DataFrame) -> DataFrame:
    """ST24: size, lengths, number of items, density and sparsity of transactions."""
    items = tx.select(F.explode("items").alias("i")).agg(F.count_distinct("i").alias("n_items"))
    s = F.size("items")
    one = tx.agg(F.count("*").alias("size"), F.avg(s).alias("mean_len"), F.min(s).alias("min_len"), F.max(s).alias("max_len"),
        F.stddev_pop(s).alias("std_len"), F.var_pop(s).alias("var_len"), F.sum(s).alias("total"))
    density = F.col("total") / (F.col("size") * F.col("n_items"))
    return one.join(F.broadcast(items)).withColumn("density", density).withColumn("sparsity", 1 - F.col("density")).drop("total")  # one row


def item_frequencies(tx: DataFrame) -> DataFrame:
    """ST24."""
    return tx.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def length_histogram(tx: DataFrame) -> DataFrame:
    """ST24."""
    return tx.groupBy(F.size("items").alias("length")).agg(F.count("*").alias("n"))


def sets_vs_latents(report: DataFrame, sets: DataFrame, p_overlap: float) -> DataFrame:
    """ST25: latents whose best labels hold a share of a frequent set."""
    left = report.groupBy(F.col("latent").alias("left_id")).agg(F.collect_set("label").alias("labels"))
    right = sets.select(F.array_join("items", ";").alias("right_id"), "items")
    return overlap_join(left, right, "labels", "items", p_overlap).select(F.col("left_id").alias("latent"),
        F.col("right_id").alias("items"), "common", "overlap")


def activation_hist(acts: DataFrame, labels: DataFrame, latents: Sequence[int], bins: int, lo: float, hi: float) -> DataFrame:
    """ST26: counts of activations of some latents by label and bin; bin 0 and ``bins`` + 1 lie outside."""
    rows = acts.where(F.col("latent").isin(list(latents))).join(labels.select("sample", "label"), "sample")
    return rows.groupBy("latent", "label", F.width_bucket("act", F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(
        F.count("*").alias("n"))


