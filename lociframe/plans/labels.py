"""Queries of labels, latents and item sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, curate, latents, models, windows
from .registry import long_vector, registry, rounded, table

QUERIES, ORACLE_SQL, query = registry()


@query("""SELECT DISTINCT l_suppkey AS supplier, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey""")
def feature_presence(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("supplier"), "p_brand", "p_type")
    return aggregate.feature_presence(rows, "supplier", ["p_brand", "p_type"])


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS s, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey), i AS (SELECT f, dense_rank() OVER (ORDER BY f) - 1 AS pos FROM (SELECT DISTINCT f FROM f)) SELECT s AS supplier, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM f JOIN i USING (f) GROUP BY 1""")
def presence_vectors(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("supplier"), "p_brand")
    vectors, _ = aggregate.presence_vectors(aggregate.feature_presence(rows, "supplier", ["p_brand"]), "supplier")
    return vectors.select("supplier", F.size("positions").cast("long").alias("n"),
        F.aggregate("positions", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("""SELECT p_type AS feature, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, feature LIMIT 10""")
def common_features(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("supplier"), "p_type")
    return aggregate.common_features(rows, "supplier", ["p_type"], 10)


@query("""SELECT DISTINCT o_orderkey AS "order", p_type AS label FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def binary_form(s, d):
    items = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.array_join(F.collect_list("p_type"), ";").alias("types"))
    o = table(s, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("order"),
        "types")
    return aggregate.binary_form(o, "order", "types")


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS o, p_brand AS l FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.l AS a, y.l AS b, count(*) AS n FROM x JOIN x y ON x.o = y.o AND x.l < y.l GROUP BY ALL""")
def cooccurrence(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("sample"), F.col("p_brand").alias("label"))
    return latents.cooccurrence(rows, "sample", "label")


_TX = "SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey"


def _transactions(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("o"), F.col("p_brand").alias("i"))
    return latents.transactions(rows, "o", "i")


@query(f"""WITH RECURSIVE x AS ({_TX}), n AS (SELECT count(DISTINCT o) AS n FROM x), s(o, last, items) AS (SELECT o, i, i FROM x UNION ALL SELECT s.o, x.i, s.items || ';' || x.i FROM s JOIN x ON s.o = x.o AND x.i > s.last) SELECT items, count(*) AS support, count(*) / any_value(n) AS share FROM s, n GROUP BY items HAVING count(*) >= ceil(0.002 * any_value(n))""")
def frequent_itemsets(s, d):
    found = latents.frequent_sets(_transactions(s, d), 0.002)
    return found.select(F.array_join("items", ";").alias("items"), "support", "share")


@query(f"""WITH t AS (SELECT o, count(*) AS k FROM ({_TX}) GROUP BY 1), v AS (SELECT count(DISTINCT i) AS n_items FROM ({_TX})) SELECT count(*) AS size, round(avg(k), 6) AS mean_len, CAST(min(k) AS INTEGER) AS min_len, CAST(max(k) AS INTEGER) AS max_len, round(stddev_pop(k), 6) AS std_len, round(var_pop(k), 6) AS var_len, any_value(n_items) AS n_items, round(sum(k) / (count(*) * any_value(n_items)), 6) AS density, round(1 - sum(k) / (count(*) * any_value(n_items)), 6) AS sparsity FROM t, v""")
def transaction_stats(s, d):
    return rounded(latents.transaction_stats(_transactions(s, d)), "mean_len", "std_len", "var_len", "density", "sparsity")


@query(f"""SELECT i AS item, count(*) AS n FROM ({_TX}) GROUP BY 1""")
def item_frequencies(s, d):
    return latents.item_frequencies(_transactions(s, d))


@query(f"""SELECT CAST(k AS INTEGER) AS length, count(*) AS n FROM (SELECT count(*) AS k FROM ({_TX}) GROUP BY o) GROUP BY 1""")
def length_histogram(s, d):
    return latents.length_histogram(_transactions(s, d))


_ACTS = "SELECT vec_id AS sample, label, generate_subscripts(embedding, 1) - 1 AS latent, CAST(unnest(embedding) AS DOUBLE) AS act FROM embeddings"
_SCORES = f"""WITH a AS ({_ACTS}), g AS (SELECT latent, label FROM (SELECT DISTINCT latent FROM a) CROSS JOIN (SELECT DISTINCT label
 FROM embeddings)), z AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT label, count(*) AS nl FROM embeddings GROUP BY 1),
h AS (SELECT latent, label, count(*) FILTER (act >= 0.1) AS tp, sum(act) AS s FROM a GROUP BY ALL), t AS (SELECT latent, sum(tp) AS na,
 sum(s) AS alls FROM h GROUP BY 1),
m AS (SELECT latent, label, tp, na - tp AS fp, nl - tp AS fn, n - nl - na + tp AS tn, n, s / alls AS activation_prop FROM g
 JOIN h USING (latent, label) JOIN t USING (latent) JOIN k USING (label), z)"""


def _scores(s, d):
    e = table(s, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("sample"), F.col("label").cast("string").alias("label"))
    return latents.latent_scores(latents.activations(e, "vec_id", "embedding"), labels, 0.1)


@query(_SCORES + " SELECT CAST(latent AS INTEGER) AS latent, CAST(label AS VARCHAR) AS label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round((tp + tn) / n, 6) AS accuracy FROM m")
def latent_scores(s, d):
    cols = ("sensitivity", "specificity", "precision", "accuracy")
    return rounded(_scores(s, d).select("latent", "label", "tp", "fp", "fn", "tn", *cols), *cols)


@query(_SCORES + " SELECT CAST(latent AS INTEGER) AS latent, CAST(label AS VARCHAR) AS label, CAST(r AS INTEGER) AS rank, round(q, 6) AS sensitivity FROM (SELECT latent, label, tp / (tp + fn) AS q, row_number() OVER (PARTITION BY latent ORDER BY tp / (tp + fn) DESC, CAST(label AS VARCHAR)) AS r FROM m) WHERE r <= 2")
def latent_report(s, d):
    return rounded(latents.latent_report(_scores(s, d), 2, "sensitivity").select("latent", "label", "rank", "sensitivity"), "sensitivity")


@query(_SCORES + """, r AS (SELECT latent, label, row_number() OVER (PARTITION BY latent ORDER BY tp / (tp + fn) DESC,
 CAST(label AS VARCHAR)) AS r FROM m), p AS (SELECT latent, min(CAST(label AS VARCHAR)) AS a, max(CAST(label AS VARCHAR)) AS b FROM r
 WHERE r <= 2 GROUP BY 1), w AS (SELECT a, b, count(*) AS n_latents FROM p GROUP BY ALL), u AS (SELECT vec_id AS sample,
 CAST(label AS VARCHAR) AS l FROM embeddings UNION SELECT vec_id, CAST((label + 1 + vec_id % 3) % 10 AS VARCHAR) FROM embeddings),
 met AS (SELECT x.l AS a, y.l AS b, count(*) AS n FROM u x JOIN u y USING (sample) GROUP BY ALL)
SELECT w.a, w.b, n_latents, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM embeddings), 9) AS share FROM w LEFT
 JOIN met ON w.a = met.a AND w.b = met.b""")
def pair_cooccurrence(s, d):
    second = (F.col("label") + 1 + F.col("vec_id") % 3) % 10
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("sample"),
        F.concat_ws(";", F.col("label").cast("string"), second.cast("string")).alias("label"))
    return rounded(latents.pair_cooccurrence(labels, latents.latent_report(_scores(s, d), 2, "sensitivity")), "share", places=9)


@query(f"""SELECT CAST(latent AS INTEGER) AS latent, label, max(act) AS value FROM ({_ACTS}) GROUP BY ALL""")
def max_by_label(s, d):
    e = table(s, d, "embeddings")
    return latents.pool_latents(latents.activations(e, "vec_id", "embedding"), e.withColumnRenamed("vec_id", "sample"))


@query(f"""SELECT CAST(latent AS INTEGER) AS latent, avg(CAST(act > 0.15 AS DOUBLE)) AS frac_active, CASE WHEN avg(CAST(act > 0.15 AS DOUBLE)) <= 0 THEN 'dead' WHEN avg(CAST(act > 0.15 AS DOUBLE)) > 0.1 THEN 'dense' ELSE 'sparse' END AS category FROM ({_ACTS}) GROUP BY 1""")
def latent_categories(s, d):
    return latents.latent_categories(latents.activations(table(s, d, "embeddings"), "vec_id", "embedding"), 0.15)


@query(f"""WITH a AS ({_ACTS}), c AS (SELECT latent FROM a GROUP BY 1 HAVING avg(CAST(act > 0.2 AS DOUBLE)) <= 0.1 AND avg(CAST(act > 0.2 AS DOUBLE)) > 0), k AS (SELECT a.* FROM a JOIN c USING (latent)), l AS (SELECT DISTINCT sample FROM k WHERE act > 0.2) SELECT sample, count(*) AS n FROM k WHERE sample IN (SELECT sample FROM l) GROUP BY 1""")
def drop_latents(s, d):
    acts = latents.activations(table(s, d, "embeddings"), "vec_id", "embedding")
    kept = latents.drop_latents(acts, latents.latent_categories(acts, 0.2), ("dead", "dense"), True, 0.2)
    return kept.groupBy("sample").agg(F.count("*").alias("n"))


@query(f"""SELECT CAST(latent AS INTEGER) AS latent, label, CASE WHEN act < -0.4 THEN 0 WHEN act >= 0.4 THEN 9 ELSE CAST(floor((act + 0.4) / 0.1) AS BIGINT) + 1 END AS bin, count(*) AS n FROM ({_ACTS}) WHERE latent IN (0, 5) GROUP BY ALL""")
def activation_hist(s, d):
    e = table(s, d, "embeddings")
    return latents.activation_hist(latents.activations(e, "vec_id", "embedding"), e.select(F.col("vec_id").alias("sample"), "label"),
        [0, 5], 8, -0.4, 0.4)


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS i FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS i
 FROM lineitem), k AS (SELECT c, count(*) AS n FROM r GROUP BY 1)
SELECT s AS left_id, r.c AS right_id, count(*) AS common, count(*) / any_value(n) AS overlap FROM l JOIN r USING (i) JOIN k ON k.c = r.c
 GROUP BY s, r.c HAVING count(*) / any_value(n) >= 0.6""")
def overlap_join(s, d):
    """Suppliers that could deliver most parts of an order."""
    from ..operators.joins import overlap_join as join

    li = table(s, d, "lineitem")
    left = li.groupBy(F.col("l_suppkey").alias("left_id")).agg(F.collect_set("l_partkey").alias("a"))
    right = li.groupBy(F.col("l_orderkey").alias("right_id")).agg(F.collect_set("l_partkey").alias("b"))
    return join(left, right, "a", "b", 0.6)


@query("""WITH e AS (SELECT l_suppkey AS s, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL) SELECT s AS supplier, 1 - sum(n * n) / (sum(n) * sum(n)) AS gini FROM e GROUP BY 1""")
def gini(s, d):
    return aggregate.gini(table(s, d, "lineitem").withColumnRenamed("l_suppkey", "supplier"), ["supplier"], "l_returnflag")


@query("""WITH x AS (SELECT l_suppkey % 3 AS tool, l_orderkey AS sample, l_returnflag AS f FROM lineitem), g AS (SELECT DISTINCT sample
 FROM x), t AS (SELECT DISTINCT tool FROM x), c AS (SELECT tool, sample, count(*) AS n FROM x WHERE f = 'R' GROUP BY ALL)
SELECT t.tool AS tool, g.sample AS sample, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN NULL WHEN coalesce(n, 0) >= 1
 AND o_orderstatus = 'F' THEN 'TP' WHEN coalesce(n, 0) >= 1 THEN 'FP' WHEN o_orderstatus = 'F' THEN 'FN' ELSE 'TN' END AS code FROM g CROSS
 JOIN t JOIN orders ON o_orderkey = g.sample LEFT JOIN c ON c.tool = t.tool AND c.sample = g.sample""")
def confusion_codes(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 3).alias("tool"), "l_returnflag")
    calls = aggregate.external_calls(li.withColumn("drugs", F.when(F.col("l_returnflag") == "R", "big drug")),
        li.limit(1).select(F.lit("big_drug").alias("drug"))).where("drug = 'big_drug'")
    ast = li.select("sample").distinct().join(table(s, d, "orders"), F.col("sample") == F.col("o_orderkey")).select("sample",
        F.lit("big_drug").alias("drug"), F.when(F.col("o_orderstatus") == "F", "resistant").when(F.col("o_orderstatus") == "O",
            "susceptible").alias("class"))
    return aggregate.confusion_codes(calls, ast, tools=li.select("tool").distinct()).select("tool", "sample", "code")


@query()
def model_cv(s, d):
    e = table(s, d, "embeddings").withColumn("task", (F.col("label") % 2).cast("string"))
    return models.cross_validate(e, "embedding", "vec_id", ["task"], 3, stratify="task")


@query()
def control_cv(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).cast("string").alias("target"),
        F.col("label").cast("string").alias("name"))
    return models.control_cv(e, "embedding", "vec_id", "target", "name", 2)


@query()
def pca(s, d):
    return models.pca(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 4).select("vec_id", "pc")


@query()
def cluster_latents(s, d):
    return models.cluster_latents(latents.activations(table(s, d, "embeddings"), "vec_id", "embedding"), 5).select("latent", "cluster")


_SAE = f"""WITH x AS (SELECT sample, latent AS i, act AS v FROM ({_ACTS})), j AS (SELECT unnest(range(0, 24)) AS j), b AS (SELECT unnest(range(0, 64)) AS i), h AS (SELECT sample, j, greatest(sum((v - ((i % 5) - 2) / 50.0) * sin(7.0 * i + 3 * j) / 4), 0) AS a FROM x, j GROUP BY ALL)"""


def _weights():
    """Encoder, decoder and bias from a rule that SQL repeats."""
    import numpy as np

    i, j = np.arange(64)[:, None], np.arange(24)[None, :]
    return models.SaeWeights(np.sin(7.0 * i + 3 * j) / 4, (np.cos(2.0 * i + 5 * j) / 6).T, (np.arange(64) % 5 - 2) / 50)


@query(_SAE + " SELECT sample AS id, CAST(j AS INTEGER) AS latent, round(a, 6) AS act FROM h WHERE a > 0 AND a >= 0.1")
def sae_encode(s, d):
    return rounded(models.sae_encode(table(s, d, "embeddings"), "vec_id", "embedding", _weights(), 0.1), "act")


@query(_SAE + """, k AS (SELECT sample, j, CASE WHEN a >= 0.1 THEN a ELSE 0 END AS a FROM h), r AS (SELECT sample, i,
 sum(a * cos(2.0 * i + 5 * j) / 6) + ((i % 5) - 2) / 50.0 AS y FROM k, b GROUP BY sample, i), m AS (SELECT sample,
 avg((v - y) * (v - y)) AS mse FROM x JOIN r USING (sample, i) GROUP BY 1), l AS (SELECT sample, sum(a) AS l1, count(*) FILTER (a > 0) AS l0
 FROM k GROUP BY 1)
SELECT round(avg(mse), 6) AS mse, round(avg(l1), 6) AS mean_l1, round(avg(l0), 6) AS mean_l0, (SELECT count(*) FROM (SELECT j FROM k
 GROUP BY j HAVING max(a) <= 0)) AS dead_latents FROM m JOIN l USING (sample)""")
def sae_loss(s, d):
    return rounded(models.sae_loss(table(s, d, "embeddings"), "vec_id", "embedding", _weights(), 0.1), "mse", "mean_l1", "mean_l0")


@query(_SAE + """, k AS (SELECT sample, j, CASE WHEN j IN (3, 8) THEN 0 ELSE a END AS a FROM h) SELECT sample AS id, CAST(i AS INTEGER) AS pos, round(sum(a * cos(2.0 * i + 5 * j) / 6) + ((i % 5) - 2) / 50.0, 6) AS value FROM k, b GROUP BY sample, i""")
def sae_ablated(s, d):
    return long_vector(models.sae_reconstruct(table(s, d, "embeddings"), "vec_id", "embedding", _weights(), ablate=[3, 8]), "id", x="recon")


@query(f"""SELECT l_partkey AS part, l_returnflag AS feature, count(*) AS value FROM lineitem GROUP BY ALL UNION ALL SELECT DISTINCT l_partkey, 'odd', CAST(l_partkey % 2 AS BIGINT) FROM lineitem""")
def drop_constant_features(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("feature"))
    parts = li.select("part").distinct()
    long = li.groupBy("part", "feature").agg(F.count("*").alias("value"))
    for name, value in (("all", F.lit(7)), ("none", F.lit(0)), ("odd", F.col("part") % 2)):
        long = long.unionByName(parts.select("part", F.lit(name).alias("feature"), value.cast("long").alias("value")))
    return curate.drop_constant_features(long, sample="part")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS group_size FROM lineitem""")
def with_group_size(s, d):
    return windows.with_group_size(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"])
