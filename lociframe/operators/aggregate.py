"""Aggregations (AG1-AG19, AG29-AG38)."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.columns import kmers, reverse_complement, split_labels
from .curate import filter_ops
from .sets import dedup, union
from .base_runs import LONGEST, run_counts, spelt


def pivot_first(df: DataFrame, index: Sequence[str], names: str, values: str, columns: Sequence[str], order: str | None = None,
    suffix: str = "") -> DataFrame:
    """AG1: one column a listed name with the first value by ``order`` (else the least value)."""
    wide = df.groupBy(*index).pivot(names, list(columns)).agg(F.min_by(values, order or values))
    return wide.withColumnsRenamed({c: c + suffix for c in columns}) if suffix else wide


def binary_form(df: DataFrame, sample: str, label: str, sep: str = ";", wide: bool = False,
    labels: Sequence[str] | None = None) -> DataFrame:
    """AG2: distinct ``sample, label`` pairs (a sample without labels keeps a row of null), or 0/1 columns for ``labels``."""
    long = df.select(sample, F.explode_outer(F.array_distinct(split_labels(label, sep))).alias("label")).distinct()
    if not wide:
        return long
    return long.groupBy(sample).agg(*[F.max((F.coalesce(F.col("label") == v, F.lit(False))).cast("int")).alias(v) for v in labels or []])


def expand_annotations(df: DataFrame, id: str, col: str, sep: str = ";") -> DataFrame:
    """AG3."""
    return binary_form(df, id, col, sep)


def feature_presence(df: DataFrame, sample: str, cols: Sequence[str], recode: DataFrame | None = None) -> DataFrame:
    """AG4: distinct ``sample, feature`` pairs of the values of ``cols``, or their ``new`` names by ``recode`` (``value, new``)."""
    values = df.select(sample, F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("feature")).where("feature is not null")
    if recode is not None:
        values = values.join(recode.select(F.col("value").alias("feature"), "new"), "feature").select(sample, F.col("new").alias("feature"))
    return values.distinct()


def presence_vectors(presence: DataFrame, sample: str, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """AG4: ``sample`` and the sorted positions of its features (a sparse 0/1 vector), and the index ``feature, pos``."""
    from .windows import row_index

    index = row_index((features if features is not None else presence).select("feature").distinct(), ["feature"], "pos", start=0)
    return presence.join(index, "feature").groupBy(sample).agg(F.array_sort(F.collect_set("pos")).alias("positions")), index


def _kmer_rows(df: DataFrame, sample: str, seq: str, k: int) -> DataFrame:
    """Runs of up to 31 bases are counted as numbers in blocks; longer ones as text, of which only a sample's distinct ones are made canonical."""
    if k <= LONGEST:
        return run_counts(df, sample, seq, k).select(F.col("sample").alias(sample), "run", "n")
    runs = df.select(sample, F.explode(kmers(F.upper(seq), k)).alias("kmer")).groupBy(sample, "kmer").agg(F.count("*").alias("n"))
    plain = runs.where(F.col("kmer").rlike("^[ACGT]+$"))
    return plain.groupBy(sample, F.least("kmer", reverse_complement("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))


def kmer_counts(df: DataFrame, sample: str, seq: str, k: int, cap: int = 255, min_count: int = 2) -> DataFrame:
    """AG5: counts of each sample's runs of ``k`` bases and their reverse complements as one; rare ones dropped, high ones capped."""
    kept = _kmer_rows(df, sample, seq, k).where(F.col("n") >= min_count)
    return kept.select(sample, spelt("run", k).alias("kmer") if k <= LONGEST else "kmer", F.least("n", F.lit(cap)).alias("n"))


def kmer_stats(df: DataFrame, sample: str, seq: str, k: int, min_count: int = 2) -> DataFrame:
    """AG6: total, distinct, and kept runs of each sample before the cap."""
    return _kmer_rows(df, sample, seq, k).groupBy(sample).agg(F.sum("n").alias("total"), F.count("*").alias("n_distinct"),
        F.count_if(F.col("n") >= min_count).alias("kept"), F.max("n").alias("max_count"))


def external_calls(df: DataFrame, known_drugs: DataFrame, sample: str = "sample", tool: str = "tool", drugs: str = "drugs",
    sep: str = ";") -> DataFrame:
    """AG7: ``sample, tool, drug, n``: reported drugs, unknown ones as ``other_drug``, and all genes of a tool as ``any``."""
    rows = df.select(sample, tool, F.explode_outer(split_labels(drugs, sep)).alias("raw"))
    named = rows.where("raw is not null").withColumn("drug", F.regexp_replace(F.lower("raw"), "[ -]+", "_"))
    known = known_drugs.select(F.col("drug").alias("_known")).distinct()
    calls = named.join(known, F.col("drug") == F.col("_known"), "left").select(sample, tool,
        F.when(F.col("_known").isNull(), "other_drug").otherwise(F.col("drug")).alias("drug"))
    return calls.unionByName(df.select(sample, tool, F.lit("any").alias("drug"))).groupBy(sample, tool, "drug").agg(F.count("*").alias("n"))


def confusion_codes(calls: DataFrame, ast: DataFrame, min_args: int = 1, tools: DataFrame | None = None) -> DataFrame:
    """AG8: TP, FP, FN, TN for each tool and observed phenotype (``sample, drug, class``); null where the phenotype is unknown."""
    names = tools if tools is not None else calls.select("tool").distinct()
    grid = ast.select("sample", "drug", "class").join(F.broadcast(names))  # a row a tool
    got = grid.join(calls.select("sample", "tool", "drug", "n"), ["sample", "tool", "drug"], "left")
    hit, bad = F.coalesce(F.col("n"), F.lit(0)) >= min_args, F.col("class") == "resistant"
    return got.withColumn("code", F.when(F.col("class").isNull(), F.lit(None)).when(hit & bad, "TP").when(hit, "FP").when(bad,
        "FN").otherwise("TN")).drop("n")


def common_features(df: DataFrame, sample: str, cols: Sequence[str], count: int) -> DataFrame:
    """AG9: values in most samples, ties by value."""
    rows = df.select(sample, F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("feature")).where(
        "feature is not null").distinct()
    return rows.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(count)


def count_table(df: DataFrame, sample: str, col: str, sep: str | None = None) -> DataFrame:
    """AG10: samples with each value and their share of all samples."""
    values = F.explode(split_labels(col, sep)) if sep else F.col(col)
    total = df.agg(F.count_distinct(sample).alias("total"))
    rows = df.select(sample, values.alias("value")).where("value is not null").distinct()
    return rows.groupBy("value").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("value", "n",
        (F.col("n") / F.col("total")).alias("share"))  # total is one row


def distinct_per_sample(df: DataFrame, sample: str, cols: Sequence[str]) -> DataFrame:
    """AG11."""
    return df.groupBy(sample).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def null_profile(df: DataFrame) -> DataFrame:
    """AG12: ``column, n_null, share`` of every column, in one pass."""
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.select("_all", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in df.columns]))
        .alias("r")).select("r.column", "r.n_null", (F.col("r.n_null") / F.nullif("_all", F.lit(0))).alias("share"))


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """AG13."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_total")))).select(col, "n",
        (F.col("n") / F.col("_total")).alias("share"))  # the total is one row


def confounding_score(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG14: for each pair of columns, in both directions: for each level of ``y`` how far the shares of ``x`` levels are from even, 0 to 1, and the pair's average."""
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            for x, y in ((a, b), (b, a)):
                cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("string").alias("xv"),
                    F.col(y).cast("string").alias("level")).agg(F.count("*").alias("n"))
                levels = df.where(F.col(x).isNotNull()).agg(F.count_distinct(x).alias("k"))
                per = cells.groupBy("level").agg(F.sum("n").alias("total"), F.collect_list("n").alias("ns"),
                    F.count("*").alias("present")).join(F.broadcast(levels))  # one row
                even = 1 / F.col("k")
                dev = F.aggregate("ns", F.lit(0.0), lambda acc, v: acc + F.abs(v / F.col("total") - even)) + (F.col("k")
                    - F.col("present")) * even
                top = even * (F.col("k") - 1) + (1 - even)
                out.append(per.select(F.lit(f"{a}|{b}").alias("pair"), F.lit(x).alias("x"), F.lit(y).alias("y"), "level",
                    (dev / top).alias("score")))
    scores = reduce(DataFrame.unionByName, out)
    side = scores.groupBy("pair", "x").agg(F.avg("score").alias("s")).groupBy("pair").agg(F.avg("s").alias("avg"))
    return scores.join(side, "pair").drop("pair")


def cluster_rollup(df: DataFrame, cluster: str, cols: Sequence[str], sep: str = "@") -> DataFrame:
    """AG15: size of each cluster, and for each column its number of distinct values and their joined text."""
    sets = [F.array_sort(F.collect_set(c)) for c in cols]
    return df.groupBy(cluster).agg(F.count("*").alias("size"), *[F.size(s).alias(f"n_{c}") for c, s in zip(cols, sets, strict=True)],
        *[F.array_join(s, sep).alias(c) for c, s in zip(cols, sets, strict=True)])


def cluster_summary(rollup: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG15: descriptive statistics of the counts."""
    return rollup.select("size", *[f"n_{c}" for c in cols]).summary("count", "mean", "stddev", "min", "50%", "max")


def cluster_recode(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """AG16: the first cluster of each value of ``cols``, one row a cluster."""
    return dedup(df.groupBy(*cols).agg(F.min(cluster).alias("new")), ["new"], list(cols))


def qc_kraken2(reports: DataFrame, expected: DataFrame, min_expected: float, max_other: float) -> DataFrame:
    """AG17: samples whose expected taxon (``sample, taxid``) has at least ``min_expected`` and no other of its rank more than ``max_other`` (percent of reads)."""
    e = expected.select("sample", F.col("taxid").alias("_want"))
    mine = reports.join(e, "sample").where(F.col("taxid") == F.col("_want")).select("sample", "_want", F.col("rank").alias("_rank"),
        F.col("p_reads_covered").alias("_share"))
    others = reports.join(mine, "sample").where((F.col("rank") == F.col("_rank")) & (F.col("taxid") != F.col("_want"))).groupBy(
        "sample").agg(F.max("p_reads_covered").alias("other"))
    return mine.join(others, "sample", "left").where((F.col("_share") >= min_expected)
        & (F.coalesce(F.col("other"), F.lit(0.0)) <= max_other)).select("sample")


def qc_fastani(df: DataFrame, spec: Mapping[str, tuple[str, float]]) -> DataFrame:
    """AG18: samples that meet all of ``avg``, ``all`` and ``any`` conditions ``(operator, value)`` on ANI."""
    from .curate import _OPS

    of = {"avg": lambda op, v: _OPS[op](F.avg("ANI"), F.lit(v)), "all": lambda op, v: F.bool_and(_OPS[op](F.col("ANI"), F.lit(v))),
        "any": lambda op, v: F.bool_or(_OPS[op](F.col("ANI"), F.lit(v)))}
    return df.groupBy("sample").agg(*[of[k](*v).alias(f"_{k}") for k, v in spec.items()]).where(
        reduce(operator.and_, [F.col(f"_{k}") for k in spec])).select("sample")


def qc_quast(df: DataFrame, filters: Sequence[tuple]) -> DataFrame:
    """AG19."""
    return filter_ops(df, filters).select("sample")


def bootstrap_rollup(df: DataFrame, by: Sequence[str] = ("metric", "method", "name", "dataset")) -> DataFrame:
    """AG29: mean, standard deviation, median of ``value`` and Fisher's combined ``p`` of each group."""
    rows = df.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.median("value").alias("median"),
        (-2 * F.sum(F.ln(F.greatest("p", F.lit(1e-300))))).alias("fisher"), F.count("p").alias("k"))
    # the tail of chi-square with 2k degrees of freedom is a sum of k Poisson terms, kept as logarithms
    half = F.col("fisher") / 2
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"))

    def more(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln(half) - F.ln(i)
        return F.struct(term.alias("term"), (F.greatest(a["sum"], term) + F.log1p(F.exp(-F.abs(a["sum"] - term)))).alias("sum"))

    log = F.aggregate(F.slice(F.sequence(F.lit(0), F.col("k").cast("int")), F.lit(2), F.greatest(F.col("k").cast("int") - 1, F.lit(0))),
        start, more)["sum"]
    p = F.when(half <= 0, 1.0).otherwise(F.least(F.exp(log - half), F.lit(1.0)))
    return rows.withColumn("combined_p", F.when(F.col("k") > 0, p)).drop("fisher")


def eval_summary(df: DataFrame, by: Sequence[str] = ("task", "metric", "dataset", "model"), wide: Sequence[str] | None = None) -> DataFrame:
    """AG30: mean, std, min, max of ``value``; with dataset names, one column a dataset of ``mean``."""
    out = df.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return out if wide is None else out.groupBy(*[b for b in by if b != "dataset"]).pivot("dataset", list(wide)).agg(F.first("mean"))


def gather(dfs: Sequence[DataFrame], params: Sequence[Mapping]) -> DataFrame:
    """AG31: runs stacked, each with its parameters as columns."""
    return union([df.withColumns({k: F.lit(v) for k, v in p.items()}) for df, p in zip(dfs, params, strict=True)], diagonal=True)


def share_within(df: DataFrame, n: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """AG32."""
    return df.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def first_group(df: DataFrame, id: str, group: str, order: Sequence[str]) -> DataFrame:
    """AG33: the first of ``order`` among each id's groups; unlisted groups last, by name."""
    place = reduce(lambda w, kv: w.when(F.col(group) == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))
    return df.groupBy(id).agg(F.min(F.struct(place.alias("p"), F.col(group).alias("g"))).alias("m")).select(id, F.col("m.g").alias(group))


def confusion_summary(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """AG34: for each label over all confusion matrices (``by``): true positives summed and their standard deviation and mean, total, accuracy, share."""
    cells = df.groupBy(*by, truth).agg(F.count("*").alias("total"), F.count_if(F.col(truth) == F.col(pred)).alias("tp"))
    out = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("tp").alias("tp"), F.stddev("tp").alias("tp_std"),
        F.avg("tp").alias("tp_mean"), F.sum("total").alias("total"))
    return out.join(F.broadcast(out.agg(F.sum("total").alias("_all")))).select("label", "tp", "tp_std", "tp_mean", "total",
        (F.col("tp") / F.col("total")).alias("accuracy"), (F.col("total") / F.col("_all")).alias("share"))  # one row


def gini(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """AG35: 1 less the sum of squared shares of labels in each group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def data_spec(df: DataFrame, x: str, tasks: Sequence[str]) -> DataFrame:
    """AG36: width of the vectors and number of classes of each task."""
    return df.agg(F.max(F.size(x)).alias("width"), F.min(F.size(x)).alias("least_width"),
        *[F.count_distinct(t).alias(f"n_{t}") for t in tasks])


def vector_health(df: DataFrame, x: str) -> DataFrame:
    """AG37: rows with NaN or infinite components, and the share of such components."""
    nan = F.size(F.filter(x, lambda v: F.isnan(v)))
    inf = F.size(F.filter(x, lambda v: F.abs(v) == float("inf")))
    n = F.sum(F.greatest(F.size(x), F.lit(0)))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(nan > 0).alias("nan_rows"), F.count_if(inf > 0).alias("inf_rows"),
        (F.sum(F.when(F.col(x).isNotNull(), nan)) / n).alias("nan_share"),
            (F.sum(F.when(F.col(x).isNotNull(), inf)) / n).alias("inf_share"))


def priority_groups(ast_long: DataFrame, taxa: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """AG38: ``sample, group`` by rules ``group, taxon, drug`` (a drug or drug class): any rank of the sample's taxa (``sample, taxon``) matches and it resists any such drug."""
    bad = ast_long.where(F.col("class") == "resistant").select("sample", "drug").distinct()
    by_class = bad.join(classes.select("drug", "drug_class"), "drug").select("sample", F.col("drug_class").alias("drug"))
    any_drug = bad.unionByName(by_class).distinct()
    return taxa.select("sample", "taxon").join(rules.select("group", "taxon", "drug"), "taxon").join(any_drug,
        ["sample", "drug"]).select("sample", "group").distinct()


def fisher_combined(ps: Sequence[float]) -> float:
    """Fisher's combination of a few p-values."""
    import math

    return tails.chi2_sf(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))
