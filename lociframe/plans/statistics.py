"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, models, sampling, stats, windows
from .registry import drawn, drawn_unit, normal_tail, random_pairs_sql, registry, rounded, student_tail, table

QUERIES, ORACLE_SQL, query = registry()

_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"""SELECT l_orderkey, l_linenumber, {_RANK.format('l_quantity')} AS rank FROM lineitem""")
def avg_rank(s, d):
    return windows.avg_rank(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey",
        "l_linenumber", "rank")


@query(f"""WITH r AS (SELECT corr(x, y) AS rho, count(*) AS n FROM (SELECT {_RANK.format('l_quantity')} AS x, {_RANK.format('l_extendedprice')} AS y FROM lineitem)), t AS (SELECT rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM r) SELECT round(rho, 6) AS rho, n, round({student_tail('t', '(n - 2)')}, 6) AS p FROM t""")
def spearman(s, d):
    return rounded(stats.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select("rho", "n", "p"), "rho", "p")


@query("""WITH t AS (SELECT l_extendedprice AS v, CAST(l_returnflag = 'R' AS INTEGER) AS a FROM lineitem), c AS (SELECT v,
 sum(sum(a)) OVER (ORDER BY v) AS ca, sum(sum(1 - a)) OVER (ORDER BY v) AS cb FROM t GROUP BY v), n AS (SELECT sum(a) AS n1,
 sum(1 - a) AS n2 FROM t), m AS (SELECT n1, n2, max(abs(ca / n1 - cb / n2)) AS d FROM c, n GROUP BY n1, n2)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(d, 6) AS statistic, round(least(1, (SELECT 2 * sum((CASE
 WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * d * d * n1 * n2 / (n1 + n2))) FROM range(1, 101) q(k))), 6) AS p FROM m""")
def ks_2samp(s, d):
    li = table(s, d, "lineitem").withColumn("first", F.col("l_returnflag") == "R")
    return rounded(stats.ks_2samp(li, "l_extendedprice", "first").select("n1", "n2", "statistic", "p"), "statistic", "p")


@query("""WITH t AS (SELECT l_linenumber AS g, l_extendedprice AS v, CAST(l_returnflag = 'R' AS INTEGER) AS a FROM lineitem), c AS (SELECT g, v, sum(sum(a)) OVER (PARTITION BY g ORDER BY v) AS ca, sum(sum(1 - a)) OVER (PARTITION BY g ORDER BY v) AS cb FROM t GROUP BY g, v), n AS (SELECT g, sum(a) AS n1, sum(1 - a) AS n2 FROM t GROUP BY g), m AS (SELECT g, n1, n2, greatest(max(ca / n1 - cb / n2), 0) AS d FROM c JOIN n USING (g) GROUP BY g, n1, n2) SELECT g, round(d, 6) AS statistic, round(exp(-2 * d * d * n1 * n2 / (n1 + n2)), 6) AS p FROM m""")
def ks_by_line(s, d):
    li = table(s, d, "lineitem").select(F.col("l_linenumber").alias("g"), "l_extendedprice", (F.col("l_returnflag") == "R").alias("first"))
    return rounded(stats.ks_2samp(li, "l_extendedprice", "first", "greater", ["g"]).select("g", "statistic", "p"), "statistic", "p")


@query(f"""WITH d AS (SELECT l_quantity - l_linenumber * 5 AS d FROM lineitem WHERE l_quantity <> l_linenumber * 5), r AS (SELECT d,
 {_RANK.format('abs(d)')} AS r FROM d), t AS (SELECT sum(CAST(k AS DOUBLE) * k * k - k) AS ties FROM (SELECT count(*) AS k FROM d
 GROUP BY abs(d))), z AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus,
 count(*) AS n, (least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r
 ELSE 0 END)) - count(*) * (count(*) + 1) / 4.0) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) + 1) * (2 * count(*) + 1) / 24 - any_value(ties) / 48) AS z FROM r, t)
SELECT w_plus, w_minus, n, round(z, 6) AS z, round({normal_tail('z')}, 6) AS p FROM z""")
def wilcoxon(s, d):
    li = table(s, d, "lineitem").select("l_quantity", (F.col("l_linenumber") * 5).alias("y"))
    return rounded(stats.wilcoxon(li, "l_quantity", "y").select("w_plus", "w_minus", "n", "z", "p"), "z", "p")


@query("""WITH l AS (SELECT quality AS t, toxic AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
 n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (t = p)::DOUBLE AS c, count(*) FILTER (t = 1)::DOUBLE AS t1,
 count(*) FILTER (p = 1)::DOUBLE AS p1 FROM l), m AS (SELECT n, c, t1 * p1 + (n - t1) * (n - p1) AS tp, t1 * t1 + (n - t1) * (n - t1) AS tt,
 p1 * p1 + (n - p1) * (n - p1) AS pp FROM n),
v AS (SELECT c / n AS acc, (c / n - tp / (n * n)) / (1 - tp / (n * n)) AS kappa, (c * n - tp) / sqrt((n * n - pp) * (n * n - tt)) AS mcc
 FROM m)
SELECT 'x' AS task, metric, round(value, 6) AS value FROM (SELECT acc, kappa, mcc, (mcc + 1) / 2 AS mcc_normalised
 FROM v) UNPIVOT (value FOR metric IN (acc, kappa, mcc, mcc_normalised))""")
def confusion_metrics(s, d):
    la = table(s, d, "labels").where("quality is not null and toxic is not null").select(F.lit("x").alias("task"), "quality", "toxic")
    return rounded(stats.classification_metrics(la, "quality", "toxic"), "value")


@query("""WITH b AS (SELECT l_linenumber AS k, CAST(l_returnflag AS VARCHAR) AS t, CASE WHEN l_quantity > 30 THEN 'R'
 WHEN l_quantity > 10 THEN 'N' ELSE 'A' END AS p FROM lineitem), c AS (SELECT k, t, count(*) AS total, count(*) FILTER (t = p) AS tp FROM b
 GROUP BY ALL)
SELECT t AS label, CAST(sum(tp) AS BIGINT) AS tp, round(stddev(tp), 6) AS tp_std, round(avg(tp), 6) AS tp_mean,
 CAST(sum(total) AS BIGINT) AS total, sum(tp) / sum(total) AS accuracy, sum(total) / (SELECT count(*) FROM b) AS share FROM c GROUP BY t""")
def confusion_summary(s, d):
    li = table(s, d, "lineitem").withColumn("p", F.when(F.col("l_quantity") > 30, "R").when(F.col("l_quantity") > 10, "N").otherwise("A"))
    return rounded(aggregate.confusion_summary(li, "l_returnflag", "p", ["l_linenumber"]), "tp_std", "tp_mean")


@query(f"""WITH t AS (SELECT l_linenumber AS task, l_extendedprice AS t, l_quantity * 1000 AS p FROM lineitem), s AS (SELECT task, corr(a,
 b) AS spearman FROM (SELECT task, rank() OVER (PARTITION BY task ORDER BY t) + (count(*) OVER (PARTITION BY task, t) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY task ORDER BY p) + (count(*) OVER (PARTITION BY task, p) - 1) / 2.0 AS b FROM t) GROUP BY task),
 m AS (SELECT task, avg((t - p) * (t - p)) AS mse, corr(t, p) AS pearson, sqrt(avg((t - p) * (t - p))) / (max(t) - min(t)) AS nrmse FROM t
 GROUP BY task)
SELECT task, metric, round(value, 4) AS value FROM (SELECT task, mse, pearson, spearman, nrmse FROM m
 JOIN s USING (task)) UNPIVOT (value FOR metric IN (mse, pearson, spearman, nrmse))""")
def regression_metrics(s, d):
    li = table(s, d, "lineitem").select(F.col("l_linenumber").alias("task"), "l_extendedprice", (F.col("l_quantity") * 1000).alias("p"))
    return rounded(stats.regression_metrics(li, "l_extendedprice", "p"), "value", places=4)


@query("""WITH t AS (SELECT l_linenumber AS task, l_quantity AS v, CAST(l_returnflag = 'R' AS DOUBLE) AS h FROM lineitem),
 l AS (SELECT task, v, sum(h) AS pos, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY task
 ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r, sum(pos) OVER (PARTITION BY task
 ORDER BY v DESC) AS cp, sum(n) OVER (PARTITION BY task ORDER BY v DESC) AS cn FROM l)
SELECT task, round((sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auroc,
 round(sum(pos * cp / cn) / sum(pos), 6) AS aupr FROM x GROUP BY task""")
def ranking_areas(s, d):
    li = table(s, d, "lineitem").select(F.col("l_linenumber").alias("task"), "l_quantity",
        (F.col("l_returnflag") == "R").cast("double").alias("h"))
    return rounded(stats.ranking_areas(li, "l_quantity", "h", ["task"]), "auroc", "aupr")


@query("""WITH n AS (SELECT l_quantity AS v FROM lineitem WHERE l_linenumber <> 1), o AS (SELECT DISTINCT l_quantity AS value FROM lineitem
 WHERE l_linenumber = 1), c AS (SELECT value, (SELECT count(*) FROM n WHERE v <= value) / (SELECT count(*) FROM n) AS cdf FROM o)
SELECT value, round(cdf, 9) AS cdf, round(CASE WHEN cdf = 1 THEN 1e-10 ELSE 1 - cdf END, 9) AS p FROM c""")
def mc_test(s, d):
    li = table(s, d, "lineitem")
    out = stats.mc_test(li.where("l_linenumber = 1").select(F.col("l_quantity").alias("value")).distinct(),
        li.where("l_linenumber <> 1").select(F.col("l_quantity").alias("value")), "greater")
    return rounded(out.select("value", "cdf", "p"), "cdf", "p", places=9)


@query(f"""WITH RECURSIVE s AS (SELECT f, count(*) AS n, sum(count(*)) OVER () AS all_n,
 sum(count(*)) OVER (ORDER BY f) / sum(count(*)) OVER () AS upto FROM (SELECT l_returnflag AS f FROM lineitem) GROUP BY f),
 o AS (SELECT l_orderkey AS grp, l_returnflag AS f, count(*) AS k FROM lineitem GROUP BY ALL), sz AS (SELECT grp, sum(k) AS size FROM o
 GROUP BY 1),
q AS (SELECT f, n, all_n, row_number() OVER (ORDER BY f) AS i, n::DOUBLE / sum(n) OVER (ORDER BY f DESC) AS p FROM s),
d AS (SELECT size, id, i, p, {drawn_unit(0, 'multinomial', 'CAST(size AS BIGINT)', 'id', 'i')} AS u
 FROM (SELECT DISTINCT CAST(size AS BIGINT) AS size FROM sz), range(0, 2000) a(id), q),
b AS (SELECT m, r.i AS i, k, exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)) AS pmf FROM (SELECT i,
 p FROM q WHERE p < 1) r, range(0, (SELECT max(size) + 1 FROM sz)::BIGINT) ms(m), range(0, (SELECT max(size) + 1 FROM sz)::BIGINT) ks(k)
 WHERE k <= m),
bc AS (SELECT m, i, k, sum(pmf) OVER (PARTITION BY m, i ORDER BY k) AS upto FROM b),
bl AS (SELECT m, i, list(upto ORDER BY k) AS steps FROM bc GROUP BY ALL),
ch AS (SELECT DISTINCT size, id, 0::BIGINT AS i, size AS rest, 0::BIGINT AS k FROM d UNION ALL
 SELECT h.size, h.id, d.i, h.rest - t.k, t.k FROM ch h JOIN d ON d.size = h.size AND d.id = h.id AND d.i = h.i + 1 LEFT
 JOIN bl ON bl.m = h.rest AND bl.i = d.i, LATERAL (SELECT CASE WHEN d.p >= 1 THEN h.rest ELSE len(list_filter(bl.steps, lambda v: v < d.u
 AND v < 1 - 1e-12))::BIGINT END AS k) t),
dk AS (SELECT size, id, f, k FROM ch JOIN q USING (i) WHERE k > 0),
ov AS (SELECT grp, size, round(lgamma(any_value(size) + 1) + sum(k * ln(n / all_n) - lgamma(k + 1)), 9) AS v FROM o JOIN sz USING (grp)
 JOIN s USING (f) GROUP BY grp, size), nv AS (SELECT size, id, round(lgamma(any_value(size) + 1) + sum(k * ln(n / all_n) - lgamma(k + 1)),
 9) AS v FROM dk JOIN s USING (f) GROUP BY size, id),
c AS (SELECT size, v, (SELECT count(*) FROM nv WHERE nv.size = x.size AND nv.v <= x.v) / 2000 AS cdf FROM (SELECT DISTINCT size, v
 FROM ov) x), r AS (SELECT grp, v, CASE WHEN cdf = 0 THEN 1e-10 ELSE cdf END AS p FROM ov JOIN c USING (size, v)) SELECT grp AS "group",
 round(v, 6) AS value, round(p, 6) AS p FROM r""")
def multinomial_test(s, d):
    li = table(s, d, "lineitem")
    obs = li.select(F.col("l_orderkey").alias("group"), F.col("l_returnflag").alias("category"))
    return rounded(stats.multinomial_test(obs, obs.select("category"), 2000).select("group", "value", "p"), "value", "p")


@query("""SELECT l_linenumber AS task, l_returnflag AS metric, round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY ALL""")
def eval_summary(s, d):
    li = table(s, d, "lineitem").select(F.col("l_linenumber").alias("task"), F.col("l_returnflag").alias("metric"),
        F.col("l_quantity").alias("value"))
    return rounded(aggregate.eval_summary(li, ["task", "metric"]), "mean", "std")


@query(f"""WITH g AS (SELECT l_suppkey AS metric, avg(l_quantity) AS mean, stddev(l_quantity) AS std, median(l_quantity) AS median,
 -sum(ln((l_discount * 100 + 1) / 12.5)) AS h, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, median, round((SELECT sum(exp(-h + i * ln(h) - lgamma(i + 1))) FROM range(0,
 k) q(i)), 6) AS combined_p FROM g""")
def bootstrap_rollup(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("metric"), F.col("l_quantity").alias("value"),
        ((F.col("l_discount") * 100 + 1) / 12.5).alias("p"))
    return rounded(aggregate.bootstrap_rollup(li, ["metric"]).select("metric", "mean", "std", "median", "combined_p"), "mean", "std",
        "combined_p")


@query(f"""WITH {random_pairs_sql('embeddings', 'vec_id', 300, 0, 'p0')}, {random_pairs_sql('embeddings', 'vec_id', 300, 1, 'p1')},
 p AS (SELECT 0 AS round, * FROM p0 UNION ALL SELECT 1, * FROM p1), d AS (SELECT round, list_cosine_distance(CAST(x.embedding AS DOUBLE[]),
 CAST(y.embedding AS DOUBLE[])) AS d, CAST(x.label <> y.label AS DOUBLE) AS label,
 abs(CAST(x.embedding[1] AS DOUBLE) - CAST(y.embedding[1] AS DOUBLE)) AS first FROM p JOIN embeddings x ON x.vec_id = p.a
 JOIN embeddings y ON y.vec_id = p.b),
u AS (SELECT round, 'label' AS covariate, d, label AS c FROM d UNION ALL SELECT round, 'first', d, first FROM d), k AS (SELECT round,
 covariate, rank() OVER (PARTITION BY round, covariate ORDER BY d) + (count(*) OVER (PARTITION BY round, covariate, d) - 1) / 2.0 AS x,
 rank() OVER (PARTITION BY round, covariate ORDER BY c) + (count(*) OVER (PARTITION BY round, covariate, c) - 1) / 2.0 AS y FROM u),
r AS (SELECT round, covariate, corr(x, y) AS rho, count(*) AS n FROM k GROUP BY ALL) SELECT CAST(round AS INTEGER) AS round, covariate,
 round(rho, 6) AS rho, n, round({student_tail('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}, 6) AS p FROM r""")
def embedding_correlations(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"),
        F.get("embedding", F.lit(0)).cast("double").alias("first"))
    return rounded(stats.embedding_correlations(e, "vec_id", "embedding", 300,
        {"label": ("label", "functional"), "first": ("first", "number")}, rounds=2), "rho", "p")


@query(f"""SELECT round, o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY round, o_custkey ORDER BY {drawn(0, 'round', 'round', 'o_orderkey')}, o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, unnest(range(0, 3))::INTEGER AS round FROM orders)) WHERE r <= 2""")
def bootstrap_rounds(s, d):
    return sampling.bootstrap(table(s, d, "orders"), "o_custkey", 3, 2, id="o_orderkey").select("round", "o_custkey", "o_orderkey")


@query()
def random_label_baseline(s, d):
    return models.random_label_baseline(table(s, d, "embeddings"), "embedding", "vec_id", 2, 2,
        estimator=models.classifier("forest", numTrees=5, maxDepth=3))
