"""Queries of models, label codes, splits and neighbourhood reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate, latents, models, neighbors, pooling, stats
from .registry import drawn, drawn_unit, registry, rounded, table

QUERIES, ORACLE_SQL, query = registry()


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS s, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS k FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT c_custkey, CAST(coalesce(k, (SELECT count(*) FROM c)) AS BIGINT) AS code, s AS back FROM customer LEFT JOIN c ON c_mktsegment = s""")
def encode_labels(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    _, fitted = models.encode_labels(c.where("c_mktsegment <> 'BUILDING'"), ["c_mktsegment"])
    coded = fitted["c_mktsegment"].transform(c)
    known = coded.where(F.col("c_mktsegment_code") < len(fitted["c_mktsegment"].labels))
    back = models.decode_labels(known, "c_mktsegment_code", fitted["c_mktsegment"], "back").select("c_custkey", "back")
    return coded.join(back, "c_custkey", "left").select("c_custkey", F.col("c_mktsegment_code").cast("long").alias("code"), "back")


@query("""WITH o AS (SELECT DISTINCT avg(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey),
 v AS (SELECT avg(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey), n AS (SELECT avg(l_quantity) AS value
 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey),
c AS (SELECT value, (SELECT count(*) FROM n WHERE n.value <= o.value) / (SELECT count(*) FROM n) AS cdf FROM o), p AS (SELECT v.value, CASE
 WHEN 2 * least(cdf, 1 - cdf) = 0 THEN 1e-10 ELSE 2 * least(cdf, 1 - cdf) END AS p FROM v JOIN c ON v.value = c.value)
SELECT round(value, 6) AS value, round(p, 9) AS p, round(least((SELECT min(p) * count(*) FROM p), 1), 9) AS p_adj FROM p""")
def mc_test_by(s, d):
    li = table(s, d, "lineitem")
    means = lambda t: t.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("value")).select("value")
    out = stats.mc_test_by(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), means)
    return rounded(rounded(out.select("value", "p", "p_adj"), "value"), "p", "p_adj", places=9)


@query(f"""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'test' ELSE 'train' END AS by_condition, CASE WHEN c_nationkey = 3 THEN 'test'
 ELSE 'train' END AS by_column, CASE WHEN {drawn_unit(4, 'split', 'c_custkey')} < 0.3 THEN 'test' ELSE 'train' END AS by_share,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' ELSE 'train' END AS by_rules, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders
 WHERE o_orderstatus = 'P') THEN 'test' ELSE 'train' END AS by_table, CASE WHEN c_custkey IN (1, 5, 9) THEN 'test'
 ELSE 'train' END AS by_list, CASE WHEN c_acctbal < (SELECT avg(c_acctbal) FROM customer) THEN 'test' ELSE 'train' END AS by_function
 FROM customer""")
def split_rows(s, d):
    c = table(s, d, "customer").withColumn("flag", F.col("c_nationkey") == 3)
    listed = table(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    below = lambda t: F.col("c_acctbal") < t.agg(F.avg("c_acctbal")).first()[0]
    specs = {"condition": F.col("c_acctbal") > 5000, "column": "flag", "share": 0.3, "rules": {"c_mktsegment": {"EXACT": ["BUILDING"]}},
        "table": listed, "list": [1, 5, 9], "function": below}
    for name, spec in specs.items():
        c = curate.split_rows(c, spec, "c_custkey", seed=4, name=f"by_{name}")
    return c.select("c_custkey", *[f"by_{n}" for n in specs])


_ACTS = "SELECT vec_id AS sample, generate_subscripts(embedding, 1) - 1 AS latent, CAST(unnest(embedding) AS DOUBLE) AS act FROM embeddings"


@query(f"""WITH f AS (SELECT latent, {drawn(0, 'fold', 'sample')} AS h, act FROM ({_ACTS})), g AS (SELECT latent, h % 32 AS d, sum(CASE WHEN (h >> 40) % 2 = 0 THEN act ELSE -act END) AS v FROM f GROUP BY ALL) SELECT CAST(latent AS INTEGER) AS latent, CAST(arg_max(d, v) AS BIGINT) AS cluster, round(max(v), 6) AS top FROM g GROUP BY latent""")
def cluster_latents_by(s, d):
    largest = lambda rows: rows.select("latent", (F.array_position("x", F.array_max("x")) - 1).alias("cluster"))
    acts = latents.activations(table(s, d, "embeddings"), "vec_id", "embedding")
    found = models.cluster_latents(acts, 5, dims=32, clusterer=largest)
    return rounded(found.select("latent", "cluster", F.array_max("x").alias("top")), "top")


@query(f"""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY vec_id) AS i
 FROM embeddings), b AS (SELECT label AS shuffled, row_number() OVER (ORDER BY {drawn(2, 'permute', 'vec_id')}, vec_id) AS i
 FROM embeddings), z AS (SELECT id, x, label, shuffled FROM e JOIN b USING (i)),
k AS (SELECT * FROM (SELECT a.id, a.label AS l, b.label AS nl, a.shuffled AS s, b.shuffled AS ns, q.d, row_number() OVER (PARTITION BY a.id
 ORDER BY round(q.d, 12), b.id) AS r FROM (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.id <> b.id) q
 JOIN z a ON a.id = q.i JOIN z b ON b.id = q.j) WHERE r <= 5),
u AS (SELECT false AS randomized, id, l, nl, d FROM k UNION ALL SELECT true, id, s, ns, d FROM k), c AS (SELECT randomized, id, nl,
 count(*) AS n FROM u GROUP BY ALL), g AS (SELECT randomized, id, 1 - sum(n * n) / (sum(n) * sum(n)) AS gini FROM c GROUP BY ALL),
 i AS (SELECT randomized, avg(gini) AS impurity FROM g GROUP BY 1)
SELECT 'label' AS col, randomized, round(avg(CAST(l = nl AS DOUBLE)), 6) AS share, round(any_value(impurity), 6) AS impurity, round(avg(d),
 6) AS distance FROM u JOIN i USING (randomized) GROUP BY randomized""")
def neighbor_metrics(s, d):
    found = neighbors.neighbor_metrics(table(s, d, "embeddings"), "vec_id", "embedding", ["label"], 5, seed=2)
    return rounded(found.select("col", "randomized", "share", "impurity", "distance"), "share", "impurity", "distance")


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS (SELECT label, generate_subscripts(x,
 1) AS p, unnest(x) AS v FROM e), m AS (SELECT label, list(v ORDER BY p) AS x FROM (SELECT label, p, avg(v) AS v FROM l GROUP BY ALL)
 GROUP BY 1), i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM m),
o AS (SELECT x.i AS h, y.i AS l FROM i x JOIN i y ON y.i < x.i), c AS (SELECT l, h FROM o ORDER BY {drawn(0, 'pair', 'l', 'h')}, l,
 h LIMIT 30), p AS (SELECT a.label AS a, b.label AS b FROM c JOIN i a ON a.i = c.l JOIN i b ON b.i = c.h),
r AS (SELECT a, b, avg(list_cosine_distance(x.x, y.x)) AS cr FROM p JOIN e x ON x.label = p.a JOIN e y ON y.label = p.b GROUP BY ALL),
 w AS (SELECT cr, list_cosine_distance(x.x, y.x) AS po FROM r JOIN m x ON x.label = a JOIN m y ON y.label = b)
SELECT round(corr(u, v), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY cr) AS u, rank() OVER (ORDER BY po) AS v FROM w)""")
def pooled_agreement(s, d):
    e = table(s, d, "embeddings")
    pooled = pooling.pool(e, "label", "embedding", "mean").select("label", F.col("x").alias("embedding"))
    return rounded(stats.pooled_agreement(e, pooled, "label", "embedding", 30).select("rho", "n"), "rho")


@query(f"""WITH a AS ({_ACTS}), l AS (SELECT vec_id AS sample, CAST(label AS VARCHAR) AS label FROM embeddings), z AS (SELECT a.latent,
 l.label, sum(act) AS s FROM a JOIN l USING (sample) GROUP BY ALL), t AS (SELECT latent, label FROM (SELECT *,
 row_number() OVER (PARTITION BY latent ORDER BY s / (SELECT sum(s) FROM z y WHERE y.latent = x.latent) DESC, label) AS r FROM z x)
 WHERE r <= 3),
u AS (SELECT sample, label AS i FROM l UNION SELECT vec_id, CAST((label + 1 + vec_id % 3) % 10 AS VARCHAR) FROM embeddings), q AS (SELECT
 i AS items, i AS x, i AS y, count(*) AS n FROM u GROUP BY i UNION ALL SELECT a.i || ';' || b.i, a.i, b.i, count(*) FROM u a
 JOIN u b ON a.sample = b.sample AND a.i < b.i GROUP BY ALL), f AS (SELECT * FROM q WHERE n >= ceil(0.01 * (SELECT count(*)
 FROM embeddings)))
SELECT CAST(latent AS INTEGER) AS latent, items, count(*) AS common, count(*) / any_value(CASE WHEN x = y THEN 1 ELSE 2 END) AS overlap
 FROM t JOIN f ON t.label = f.x OR t.label = f.y GROUP BY latent, items HAVING count(*) / any_value(CASE WHEN x = y THEN 1
 ELSE 2 END) >= 0.5""")
def sets_vs_latents(s, d):
    e = table(s, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("sample"), F.col("label").cast("string").alias("label"))
    report = latents.latent_report(latents.latent_scores(latents.activations(e, "vec_id", "embedding"), labels, 0.0), 3, "activation_prop")
    second = ((F.col("label").cast("int") + 1 + F.col("sample") % 3) % 10).cast("string")
    both = labels.withColumn("label", F.concat_ws(";", "label", second))
    return latents.sets_vs_latents(report, latents.frequent_sets(latents.transactions(both, "sample", "label", ";"), 0.01), 0.5)


def _two(s, d):
    """Embeddings with a label of two kinds that the vectors tell."""
    e = table(s, d, "embeddings")
    return e.withColumn("task", F.when(F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1)) > 0, "up").otherwise("down"))


_FOLDS = "SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x, (row_number() OVER (ORDER BY {h}, vec_id) - 1) % {k} AS fold FROM embeddings"


def _folds(k: int) -> str:
    return _FOLDS.format(h=drawn(0, "fold", "0", "vec_id"), k=k)


@query(f"""WITH e AS (SELECT id, fold, x[1] AS x, 2 * x[2] + x[1] * x[1] AS y FROM ({_folds(3)})), f AS (SELECT DISTINCT fold FROM e),
 m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f JOIN e ON e.fold <> f.fold GROUP BY f.fold),
p AS (SELECT fold, y AS t, a * x + b AS p FROM e JOIN m USING (fold)), r AS (SELECT fold, t, p, rank() OVER (PARTITION BY fold
 ORDER BY t) + (count(*) OVER (PARTITION BY fold, t) - 1) / 2.0 AS u, rank() OVER (PARTITION BY fold
 ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS v FROM p),
s AS (SELECT fold, avg((t - p) * (t - p)) AS mse, corr(t, p) AS pearson, corr(u, v) AS spearman,
 sqrt(avg((t - p) * (t - p))) / (max(t) - min(t)) AS nrmse FROM r GROUP BY fold)
SELECT 'level' AS task, CAST(fold AS INTEGER) AS iter, metric, round(value, 6) AS value FROM s UNPIVOT (value FOR metric IN (mse, pearson,
 spearman, nrmse))""")
def linear_cv(s, d):
    """A least-squares line, whose fit and errors in each fold SQL can follow."""
    from pyspark.ml.regression import LinearRegression

    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(s, d, "embeddings").select("vec_id", F.array(at(0)).alias("x"), (2 * at(1) + at(0) * at(0)).alias("level"))
    return rounded(models.cross_validate(e, "x", "vec_id", ["level"], 3, regression=True, estimator=LinearRegression(solver="normal"))
        .select("task", "iter", "metric", "value"), "value")


@query(f"""WITH e AS (SELECT id, fold, x[1] + x[2] > 0 AS b, CASE WHEN label < 3 THEN 'low' WHEN label < 7 THEN 'middle' ELSE 'top' END AS t
 FROM ({_folds(3)})), f AS (SELECT DISTINCT fold FROM e), c AS (SELECT f.fold, b, t, count(*) AS n FROM f JOIN e ON e.fold <> f.fold
 GROUP BY ALL),
m AS (SELECT fold, b, t AS p FROM c QUALIFY row_number() OVER (PARTITION BY fold, b ORDER BY n DESC, t) = 1), q AS (SELECT fold, t, p,
 count(*) AS n FROM e JOIN m USING (fold, b) GROUP BY ALL), s AS (SELECT fold, sum(n) AS s, sum(n) FILTER (t = p) AS c FROM q GROUP BY 1),
a AS (SELECT fold, t AS l, sum(n) AS nt FROM q GROUP BY ALL), z AS (SELECT fold, p AS l, sum(n) AS np FROM q GROUP BY ALL),
 g AS (SELECT fold, sum(coalesce(nt, 0) * coalesce(np, 0)) AS tp, sum(coalesce(nt, 0) ** 2) AS tt, sum(coalesce(np, 0) ** 2) AS pp
 FROM a FULL JOIN z USING (fold, l) GROUP BY fold),
w AS (SELECT fold, c / s AS acc, (c / s - tp / (s * s)) / nullif(1 - tp / (s * s), 0) AS kappa,
 (c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0) AS mcc FROM s JOIN g USING (fold))
SELECT 'kind' AS task, CAST(fold AS INTEGER) AS iter, metric, round(value, 6) AS value FROM (SELECT fold, acc, coalesce(kappa, 0) AS kappa,
 coalesce(mcc, 0) AS mcc, (coalesce(mcc, 0) + 1) / 2 AS mcc_normalised FROM w) UNPIVOT (value FOR metric IN (acc, kappa, mcc,
 mcc_normalised))""")
def stump_cv(s, d):
    """A tree of one question, which answers with the commonest kind on each side, as SQL can count."""
    from pyspark.ml.classification import DecisionTreeClassifier

    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    kind = F.when(F.col("label") < 3, "low").when(F.col("label") < 7, "middle").otherwise("top")
    e = table(s, d, "embeddings").select("vec_id", F.array((at(0) + at(1) > 0).cast("double")).alias("x"), kind.alias("kind"))
    found = models.cross_validate(e, "x", "vec_id", ["kind"], 3, estimator=lambda width: DecisionTreeClassifier(maxDepth=1))
    return rounded(found.where("metric NOT IN ('auroc', 'aupr')").select("task", "iter", "metric", "value"), "value")


def _stump_scores(rows: str) -> str:
    """Common tables that end with ``w``: a one-question tree's ``acc, kappa, mcc`` in each fold of ``rows`` (``g, fold, b, t``: group, fold, answer, label)."""
    return f"""e AS ({rows}), f AS (SELECT DISTINCT g, fold FROM e), c AS (SELECT f.g, f.fold, b, t, count(*) AS n FROM f JOIN e ON e.g = f.g AND e.fold <> f.fold GROUP BY ALL),
m AS (SELECT g, fold, b, t AS p FROM c QUALIFY row_number() OVER (PARTITION BY g, fold, b ORDER BY n DESC, t) = 1), q AS (SELECT g, fold, t, p, count(*) AS n FROM e JOIN m USING (g, fold, b) GROUP BY ALL),
s AS (SELECT g, fold, sum(n) AS s, coalesce(sum(n) FILTER (t = p), 0) AS c FROM q GROUP BY ALL), a AS (SELECT g, fold, t AS l, sum(n) AS nt FROM q GROUP BY ALL), z AS (SELECT g, fold, p AS l, sum(n) AS np FROM q GROUP BY ALL),
h AS (SELECT g, fold, sum(coalesce(nt, 0) * coalesce(np, 0)) AS tp, sum(coalesce(nt, 0) ** 2) AS tt, sum(coalesce(np, 0) ** 2) AS pp FROM a FULL JOIN z USING (g, fold, l) GROUP BY ALL),
w AS (SELECT g, fold, c / s AS acc, coalesce((c / s - tp / (s * s)) / nullif(1 - tp / (s * s), 0), 0) AS kappa, coalesce((c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0) AS mcc FROM s JOIN h USING (g, fold))"""


def _stump(width: int):
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(maxDepth=1)


def _kinds(s, d):
    """Embeddings by one answer ``x``, with a label that leans on it and a name."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    task = F.when(at(0) + at(2) > 0.02, "up").otherwise("down")
    return table(s, d, "embeddings").select("vec_id", F.array((at(0) > 0).cast("double")).alias("x"), task.alias("task"), F.col("label").cast("string").alias("name"))


_KINDS = """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) > 0 AS b, CASE WHEN CAST(embedding[1] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) > 0.02 THEN 'up' ELSE 'down' END AS t, CAST(label AS VARCHAR) AS name FROM embeddings"""


def _fold_of(seed: int, k: int) -> str:
    return f"(row_number() OVER (ORDER BY {drawn(seed, 'fold', '0', 'id')}, id) - 1) % {k}"


_PERMUTED = " UNION ALL ".join(
    [f"SELECT -1 AS g, {_fold_of(0, 2)} AS fold, b, t FROM k"]
    + [f"SELECT {r} AS g, {_fold_of(r, 2)} AS fold, b, u AS t FROM (SELECT id, b, row_number() OVER (ORDER BY id) AS i FROM k) JOIN (SELECT t AS u, row_number() OVER (ORDER BY {drawn(r, 'permute', 'id')}, id) AS i FROM k) USING (i)" for r in range(3)]
)


@query(f"""WITH k AS ({_KINDS}), {_stump_scores(_PERMUTED)}, x AS (SELECT g, 1 - avg(acc) AS error FROM w GROUP BY g)
SELECT round(avg(((SELECT count(*) FROM x n WHERE n.g >= 0 AND n.error <= o.error) + 1) / 4), 6) AS p FROM x o WHERE g = -1""")
def stump_permutation(s, d):
    return rounded(models.permutation_test(_kinds(s, d), "x", "vec_id", "task", 1, 3, 2, estimator=_stump), "p")


@query(f"""WITH k AS ({_KINDS}), o AS (SELECT t, row_number() OVER (ORDER BY {drawn(0, 'goal', 't')}, t) - 1 AS i FROM (SELECT DISTINCT t FROM k)), v AS (SELECT name, {drawn(0, 'control', 'name')} AS h, row_number() OVER (ORDER BY {drawn(0, 'control', 'name')}, name) - 1 AS j FROM (SELECT DISTINCT name FROM k)),
y AS (SELECT name, o.t AS fake FROM (SELECT name, CASE WHEN j < n THEN j ELSE h % n END AS i FROM v, (SELECT count(*) AS n FROM o)) JOIN o USING (i)),
{_stump_scores(f"SELECT 0 AS g, {_fold_of(0, 2)} AS fold, b, t FROM k UNION ALL SELECT 1, {_fold_of(0, 2)}, b, fake FROM k JOIN y USING (name)")}
SELECT 'task' AS task, CAST(fold AS INTEGER) AS iter, g = 1 AS control, metric, round(value, 6) AS value FROM (SELECT g, fold, acc, kappa, mcc FROM w) UNPIVOT (value FOR metric IN (acc, kappa, mcc))""")
def stump_control(s, d):
    found = models.control_cv(_kinds(s, d), "x", "vec_id", "task", "name", 2, estimator=_stump)
    return rounded(found.where("metric IN ('acc', 'kappa', 'mcc')").select("task", "iter", "control", "metric", "value"), "value")


_RANDOM_LABELS = " UNION ALL ".join(f"SELECT {r} AS g, {_fold_of(r, 3)} AS fold, b, CAST({drawn(0, 'label', str(r), 'id')} % 2 AS VARCHAR) AS t FROM k" for r in range(3))


@query(f"""WITH k AS ({_KINDS}), {_stump_scores(_RANDOM_LABELS)} SELECT CAST(g AS INTEGER) AS iter, round(avg(mcc), 6) AS mcc FROM w GROUP BY g""")
def stump_random_labels(s, d):
    return rounded(models.random_label_baseline(_kinds(s, d), "x", "vec_id", 3, 3, estimator=_stump), "mcc")


@query(f"""SELECT id, CAST(fold AS INTEGER) AS iter, 'task' AS task, CASE WHEN x[1]::FLOAT + x[2]::FLOAT > 0 THEN 'up' ELSE 'down' END AS truth, true AS known, 1.0 AS total FROM ({_folds(2)})""")
def cv_predictions(s, d):
    """Each row is predicted once, in its own fold, with a label of its task and probabilities that sum to 1."""
    done = models.cv_predictions(_two(s, d), "embedding", "vec_id", ["task"], 2,
        estimator=models.classifier("forest", numTrees=5, maxDepth=3))
    total = F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, v: a + v)
    return rounded(done.select("id", "iter", "task", "truth", F.col("pred").isin("up", "down").alias("known"), total.alias("total")),
        "total")


@query("""WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
 c AS (SELECT a.p AS i, b.p AS j, covar_samp(a.x, b.x) AS v FROM l a JOIN l b USING (vec_id) GROUP BY ALL),
q AS (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY ALL)
SELECT 1 AS power, round(sum(v), 6) AS value FROM c WHERE i = j UNION ALL SELECT 2, round(sum(v), 6) FROM q WHERE i = j UNION ALL SELECT 3,
 round(sum(q.v * c.v), 6) FROM q JOIN c ON q.i = c.j AND q.j = c.i""")
def pca_variances(s, d):
    """The variances of all components are the eigenvalues of the covariance matrix: sums of their powers are traces of its powers."""
    e = table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    width = e.select(F.size("embedding")).first()[0]
    pcs = models.pca(e, "embedding", width).select(F.posexplode("pc").alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v"))
    powers = F.explode(F.array(*[F.struct(F.lit(p).alias("power"), F.pow("v", F.lit(float(p))).alias("x")) for p in (1, 2, 3)]))
    return rounded(pcs.select(powers.alias("r")).groupBy("r.power").agg(F.sum("r.x").alias("value")), "value")


@query()
def perceptron_cv(s, d):
    return models.cross_validate(_two(s, d), "embedding", "vec_id", ["task"], 2,
        estimator=lambda width: models.perceptron([width, 8, 2], maxIter=20))


@query()
def regression_cv(s, d):
    e = table(s, d, "embeddings").withColumn("level", F.get("embedding", F.lit(0)).cast("double"))
    return models.cross_validate(e, "embedding", "vec_id", ["level"], 2, regression=True)


@query()
def permutation_test(s, d):
    forest = models.classifier("forest", numTrees=5, maxDepth=3)
    return models.permutation_test(_two(s, d), "embedding", "vec_id", "task", 1, 2, 2, estimator=forest).unionByName(
        models.permutation_test(_two(s, d), "embedding", "vec_id", "task", 2, 2, 2, estimator=forest))


@query()
def latent_ablation(s, d):
    from .labels import _weights

    return models.ablation(_two(s, d), "embedding", "vec_id", ["task"], _weights(), [0, 5], k=2,
        estimator=models.classifier("forest", numTrees=5, maxDepth=3))


@query()
def perturbation_report(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    turned = e.withColumn("embedding", F.transform("embedding", lambda v, i: F.when(i % 8 == 0, -v).otherwise(v)))
    drawn_rows = stats.uniform_template(e, "embedding", e.count(), 1).select(F.col("id").alias("vec_id"),
        F.col("x").cast("array<float>").alias("embedding"))
    return models.perturbation_report(e, turned, drawn_rows, "vec_id", "embedding", k=2,
        estimator=models.classifier("forest", numTrees=5, maxDepth=3))
