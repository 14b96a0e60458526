"""Exact nearest and radius neighbours over a metric index (WN10, WN11), and measures over them."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.columns import label_jaccard, vec_distance
from ..functions.seeded import draw, unit
from ..scratch import materialise
from . import vector_index as V
from .aggregate import gini

BLOCK = 1024


def _blocks(df: DataFrame, id: str, x: str, n: int) -> DataFrame:
    """Vectors dealt by a hash of the id to blocks of about ``BLOCK`` rows, an array each."""
    k = max(1, -(-n // BLOCK))
    rows = df.where(F.col(x).isNotNull()).select(F.col(id).alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.groupBy(F.pmod(draw(0, "block", "id"), F.lit(k)).alias("block")).agg(F.collect_list("id").alias("ids"),
        F.collect_list("x").alias("xs"))


def knn(queries: DataFrame, refs: DataFrame, id: str, x: str, k: int, metric: str = "euclidean") -> DataFrame:
    """WN10: ``id, neighbor, distance, rank`` of the ``k`` nearest rows with other ids, ties (to 12 places) by id.

    Only cells of a metric index are compared that can hold one of a query's nearest (``vector_index``). Equal vectors are compared once.
    """
    index, asked = _indexes(queries, refs, id, x, metric)
    found = V.nearest_entries(index, k + 1, asked)
    order = [F.round("distance", 12), F.col("neighbor")]
    best = lambda df, by, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(
        F.col("rank") <= n)
    ids = best(found.join(V.first_members(index.members, k + 1).withColumnRenamed("id", "neighbor"), "entry").drop("entry"), "query",
        k + 1).drop("rank")
    rows = ids.join((asked or index).members.withColumnRenamed("entry", "query"), "query").where("id <> neighbor")
    return best(rows.select("id", "neighbor", "distance"), "id", k)


def _indexes(queries: DataFrame, refs: DataFrame, id: str, x: str, metric: str) -> tuple[V.Index, V.Index | None]:
    """The index of ``refs``, and the queries' entries if these are another table."""
    index = V.build(refs, id, x, metric)
    if queries is refs:
        return index, None
    entries, members = V.distinct_vectors(queries, id, x)
    return index, dataclasses.replace(index, id_type=queries.schema[id].dataType.simpleString(), entries=entries, members=members,
        chunks=V.placed_chunks(entries, index))


def knn_summary(neighbors: DataFrame) -> DataFrame:
    """WN10: max, mean, min, std, var and median distance of each row."""
    d = "distance"
    return neighbors.groupBy("id").agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.stddev_pop(d).alias("std"),
        F.var_pop(d).alias("var"), F.median(d).alias("median"))


def radius_neighbors(queries: DataFrame, refs: DataFrame, id: str, x: str, radius: float, metric: str = "euclidean") -> DataFrame:
    """WN11: ``id, neighbor, distance`` of all rows with other ids within ``radius``."""
    index, asked = _indexes(queries, refs, id, x, metric)
    found = V.entries_within(index, radius, asked)
    near = found.join(index.members.withColumnRenamed("id", "neighbor"), "entry")
    return near.join((asked or index).members.withColumnRenamed("entry", "query"), "query").where("id <> neighbor").select("id", "neighbor",
        "distance")


def radius_counts(queries: DataFrame, refs: DataFrame, id: str, x: str, radii: Sequence[float], metric: str = "euclidean",
    label: str | None = None) -> DataFrame:
    """WN11 counted: ``id, radius, label, n`` of rows with other ids within each radius, by label where one is named (else null); counts of 0 are no rows.

    What leaves a comparison is a count a query, radius and label, never a pair.
    """
    index, asked = _indexes(queries, refs, id, x, metric)
    named = None if label is None else refs.select(F.col(id).alias("id"), F.col(label).alias("label"))
    found = V.counts_within(index, radii, named, asked).join((asked or index).members.withColumnRenamed("entry", "query"),
        "query").drop("query")
    r = refs.select(F.col(id).alias("_id"), F.col(x).cast("array<double>").alias("_y"),
        (F.lit(None).cast("string") if label is None else F.col(label)).alias("label"))
    own = queries.select(F.col(id).alias("id"), F.col(x).cast("array<double>").alias("_x")).join(r, F.col("id") == F.col("_id"))
    d = F.when(F.col("_x") == F.col("_y"), vec_distance("_x", "_x", metric) * 0.0).otherwise(vec_distance("_x", "_y", metric))
    own = own.select("id", "label", d.alias("d"), F.explode(F.array(*[F.lit(float(v)) for v in radii])).alias("radius")).where(
        "d <= radius")
    every = found.select("id", "radius", "label", "n").unionByName(own.select("id", "radius", "label", F.lit(-1).cast("long").alias("n")))
    return every.groupBy("id", "radius", "label").agg(F.sum("n").alias("n")).where("n > 0")


def neighbor_labels(neighbors: DataFrame, df: DataFrame, id: str, label: str) -> DataFrame:
    """Neighbour rows with the row's and the neighbour's label."""
    labels = df.select(F.col(id).alias("_id"), F.col(label).alias("_l"))
    return neighbors.join(labels.withColumnsRenamed({"_id": "id", "_l": "label"}),
        "id").join(labels.withColumnsRenamed({"_id": "neighbor", "_l": "neighbor_label"}), "neighbor")


def nn_proportions(df: DataFrame, id: str, x: str, cols: Sequence[str], k: int = 10, metric: str = "euclidean", rounds: int = 0,
    seed: int = 0, found: DataFrame | None = None) -> DataFrame:
    """ST7: ``col, share, impurity, distance`` and, with rounds, the p-value of the share against labels permuted in each round.

    Share is that of neighbours with the row's own label; impurity is the mean Gini of a row's neighbours' labels.
    ``found`` are the written neighbours, where they are known.
    """
    from .sampling import permute
    from .sets import union

    if found is None:
        found = materialise(knn(df, df, id, x, k, metric))
    out = []
    for c in cols:
        both = neighbor_labels(found, df, id, c)
        impurity = gini(both, ["id"], "neighbor_label").agg(F.avg("gini").alias("impurity"))
        one = both.agg(F.avg((F.col("label") == F.col("neighbor_label")).cast("double")).alias("share"),
            F.avg("distance").alias("distance"))
        row = one.join(F.broadcast(impurity)).select(F.lit(c).alias("col"), "share", "impurity", "distance")  # one row each
        if rounds:
            nulls = [neighbor_labels(found, permute(df.select(id, c), id, [c], seed=seed + r), id,
                c).agg(F.avg((F.col("label") == F.col("neighbor_label")).cast("double")).alias("null")) for r in range(rounds)]
            null = union(nulls, diagonal=False)
            p = null.join(F.broadcast(one.select("share"))).agg(((F.count_if(F.col("null") >= F.col("share")) + 1) / (F.count("*") + 1))
                .alias("p_value"))
            row = row.join(F.broadcast(p))
        out.append(row)
    return union(out, diagonal=False)


def neighbor_chi_square(df: DataFrame, id: str, x: str, label: str, radii: Sequence[float], queries: DataFrame | None = None,
    metric: str = "euclidean", min_expected: float = 5.0) -> DataFrame:
    """ST4: for each query the chi-square of its neighbours' labels against the shares in the table, at the least of ``radii`` where every expected count suffices (else the largest): ``id, radius, n, chi2, df, p, p_adj``."""
    q = df if queries is None else queries
    shares = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = shares.agg(F.sum("_n").alias("_all"))
    shares = shares.join(F.broadcast(total)).select(F.col(label).alias("_l"), (F.col("_n") / F.col("_all")).alias("_share"))  # one row
    rows = shares.collect()  # a row a label
    least, kinds = min(r["_share"] for r in rows), len(rows)
    near = materialise(radius_counts(q, df, id, x, radii, metric, label).select("id", "radius", F.col("label").alias("_l"),
        F.col("n").alias("o")))
    sizes = near.groupBy("id", "radius").agg(F.sum("o").alias("n"))
    good = sizes.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("n") * least >= min_expected, F.col("radius"))), F.max("radius"))
        .alias("radius"))
    counts = near.join(good, ["id", "radius"])
    stat = counts.join(shares, "_l").join(sizes, ["id", "radius"])
    # absent labels add their expected counts: the sum of o^2/e, less n
    out = stat.groupBy("id", "radius", "n").agg((F.sum(F.col("o") * F.col("o") / (F.col("n") * F.col("_share"))) - F.col("n"))
        .alias("chi2")).withColumn("df", F.lit(kinds - 1))
    m = q.count()
    return out.withColumn("p", tails.column(lambda v: tails.chi2_sf(v, kinds - 1), "chi2")).withColumn("p_adj",
        F.least(F.col("p") * m, F.lit(1.0)))


def annotation_coherence(df: DataFrame, id: str, x: str, labels: str, k: int = 10, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """ST9: ``id, coherence, random``: mean pairwise label distance among a row's neighbours, and among as many drawn rows."""
    from .windows import row_index

    near = knn(df, df, id, x, k, metric).select("id", F.col("neighbor").alias("m"))
    index = row_index(df.select(id), [id], "_i", start=0)
    n = index.count()
    drawn = df.select(F.col(id).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_d")).select("id",
        F.floor(unit(seed, "neighbour", "id", "_d") * n).alias("_i")).join(index.withColumnRenamed(id, "m"), "_i").select("id", "m")
    sets = df.select(F.col(id).alias("m"), F.col(labels).alias("_s"))

    def mean(pairs: DataFrame, name: str) -> DataFrame:
        lists = pairs.join(sets, "m").groupBy("id").agg(F.collect_list(F.struct("m", "_s")).alias("g"))  # k rows a group
        every = F.flatten(F.transform("g", lambda a,
            i: F.transform(F.filter("g", lambda _, j: j > i), lambda b: label_jaccard(a["_s"], b["_s"]))))
        kept = F.filter(every, lambda v: v.isNotNull())
        return lists.select("id", (F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(kept), F.lit(0))).alias(name))

    return mean(near, "coherence").join(mean(drawn, "random"), "id", "left")


def random_neighbor_score(natural: DataFrame, random: DataFrame, id: str, x: str, k: int = 10, prop: float = 1.0, iters: int = 1,
    seed: int = 0, metric: str = "euclidean") -> DataFrame:
    """ST12: ``iter, score``: share of random rows among the neighbours of natural ones, each round with a drawn share of both; rounds are one job a round's neighbours."""
    from .sets import union

    every = natural.select(F.concat(F.lit("n"), F.col(id).cast("string")).alias("id"), x, F.lit(False).alias("is_random")).unionByName(
        random.select(F.concat(F.lit("r"), F.col(id).cast("string")).alias("id"), x, F.lit(True).alias("is_random")))
    out = []
    for i in range(iters):
        some = every.where(unit(seed, "round", F.lit(i), "id") < prop) if prop < 1 else every
        near = knn(some.where("not is_random"), some, "id", x, k, metric)
        out.append(near.join(some.select(F.col("id").alias("neighbor"), "is_random"), "neighbor").agg(F.lit(i).alias("iter"),
            F.avg(F.col("is_random").cast("double")).alias("score")))
    return union(out, diagonal=False)


def neighbor_preserving(df: DataFrame, id: str, x: str, contig: str, start: str, stop: str, k: int = 10, metric: str = "euclidean",
    seed: int = 0) -> DataFrame:
    """ST15: ``id, overlap, random_overlap, score``: common members of vector and genomic neighbours, those of a drawn query, and their log10 ratio (one added to both)."""
    from .stats import uniform_template

    near = knn(df, df, id, x, k, metric).groupBy("id").agg(F.collect_set("neighbor").alias("v"))
    w = Window.partitionBy(contig).orderBy(start, stop, id)
    side = [F.lead(id, j).over(w) for j in range(1, k // 2 + 1)] + [F.lag(id, j).over(w) for j in range(1, k // 2 + 1)]
    along = df.select(F.col(id).alias("id"), F.array_compact(F.array(*side)).alias("g"))
    fake = uniform_template(df, x, df.count(), seed).select((-F.col("id") - 1).alias(id), "x")
    drawn = knn(fake.withColumnRenamed("x", x), df.select(id, x), id, x, k, metric).groupBy("id").agg(F.collect_set("neighbor").alias("u"))
    from .windows import row_index

    numbered = row_index(df.select(F.col(id).alias("id")), ["id"], "_i", start=0).join(drawn.select((-F.col("id") - 1).alias("_i"), "u"),
        "_i", "left")
    o, r = F.size(F.array_intersect("v", "g")), F.size(F.array_intersect("u", "g"))
    return along.join(near, "id").join(numbered, "id").select("id", o.alias("overlap"), r.alias("random_overlap"),
        F.greatest(F.log10((o + 1) / (r + 1)), F.lit(0.0)).alias("score"))


def neighbor_metrics(df: DataFrame, id: str, x: str, cols: Sequence[str], k: int = 10, metric: str = "euclidean",
    seed: int = 0) -> DataFrame:
    """ST10: ST7 on the labels as they are and permuted, told apart by ``randomized``."""
    from .sampling import permute

    found = materialise(knn(df, df, id, x, k, metric))  # the vectors of both are the same
    natural = nn_proportions(df, id, x, cols, k, metric, found=found).withColumn("randomized", F.lit(False))
    shuffled = materialise(permute(df.select(id, *cols), id, list(cols), seed=seed))
    return natural.unionByName(nn_proportions(shuffled, id, x, cols, k, metric, found=found).withColumn("randomized", F.lit(True)))
