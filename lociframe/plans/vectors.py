"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregate, curate, neighbors, pooling, sampling, stats
from .registry import drawn, long_vector, pairs_sql, registry, rounded, table

QUERIES, ORACLE_SQL, query = registry()

_LONG = "SELECT label, pos - 1 AS pos, x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings)"


_PAIRS = pairs_sql(0, 10)


def _pool_sql(agg: str) -> str:
    return f"SELECT label, CAST(pos AS INTEGER) AS pos, round({agg}(CAST(x AS DOUBLE)), 6) AS value, count(*) AS n FROM ({_LONG}) GROUP BY ALL"


def _pooled(s, d, method):
    return long_vector(pooling.pool(table(s, d, "embeddings"), "label", "embedding", method), "label", "n").select("label", "pos", "value",
        "n")


@query(_pool_sql("avg"))
def pool_mean(s, d):
    return _pooled(s, d, "mean")


@query(_pool_sql("sum"))
def pool_sum(s, d):
    return _pooled(s, d, "sum")


@query(_pool_sql("max"))
def pool_max(s, d):
    return _pooled(s, d, "max")


@query("""WITH e AS (SELECT label, vec_id % 7 AS grp, vec_id, embedding FROM embeddings), r AS (SELECT *, CASE label WHEN 3 THEN 0
 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS p FROM e),
b AS (SELECT *, min(p) OVER (PARTITION BY grp) AS best FROM r), l AS (SELECT grp, generate_subscripts(embedding, 1) - 1 AS pos,
 unnest(embedding) AS x FROM b WHERE p = best)
SELECT grp, CAST(pos AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM l GROUP BY ALL""")
def pool_priority(s, d):
    e = table(s, d, "embeddings").withColumn("grp", F.col("vec_id") % 7).withColumn("name", F.col("label").cast("string"))
    return long_vector(pooling.pool_priority(e, ["grp"], "embedding", "name", ["3", "1", "4"]), "grp").select("grp", "pos", "value")


@query("""WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
 FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM l GROUP BY 1),
u AS (SELECT l.*, x / norm AS u FROM l JOIN n USING (vec_id)), s AS (SELECT label, pos, sum(u) AS s FROM u GROUP BY ALL),
 c AS (SELECT label, count(*) AS k FROM embeddings GROUP BY 1),
w AS (SELECT u.vec_id, (sum(u.u * s.s) - 1) / any_value(c.k) AS w FROM u JOIN s ON u.label = s.label AND u.pos = s.pos
 JOIN c ON c.label = u.label GROUP BY 1)
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(x * w), 6) AS value FROM u JOIN w USING (vec_id) GROUP BY ALL""")
def pool_similarity_cosine(s, d):
    return long_vector(pooling.pool_similarity(table(s, d, "embeddings"), ["label"], "embedding", "cosine_similarity"),
        "label").select("label", "pos", "value")


@query("""WITH l AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
 FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.vec_id AS other, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist FROM l a JOIN l b ON a.label = b.label
 AND a.pos = b.pos GROUP BY ALL),
w AS (SELECT vec_id, avg(dist) AS w FROM p GROUP BY 1) SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(x * w), 4) AS value FROM l
 JOIN w USING (vec_id) GROUP BY ALL""")
def pool_similarity_euclidean(s, d):
    return long_vector(pooling.pool_similarity(table(s, d, "embeddings"), ["label"], "embedding", "euclidean_distance"), "label",
        places=4).select("label", "pos", "value")


@query(f"""WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY {drawn(0, 'pool', 'vec_id')}, vec_id) AS r
 FROM embeddings), k AS (SELECT * FROM r WHERE r <= 20), x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos,
 unnest(embedding) AS v FROM k), c AS (SELECT label, count(*) AS n FROM k GROUP BY 1)
SELECT label, any_value(n) AS n, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM x JOIN c USING (label)
 GROUP BY label, pos""")
def pool_random(s, d):
    return long_vector(pooling.pool_random(table(s, d, "embeddings"), ["label"], "embedding", 20, id="vec_id"), "label", "n")


@query("""WITH l AS (SELECT label, min(vec_id) AS first_vec, any_value(k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY label) AS k
 FROM embeddings) GROUP BY 1),
x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings) SELECT x.label,
 CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS value, first_vec, any_value(n) AS n FROM x JOIN l USING (label)
 GROUP BY x.label, pos, first_vec""")
def pool_with_obs(s, d):
    e = table(s, d, "embeddings").withColumn("first_vec", F.col("vec_id"))
    return long_vector(pooling.pool_with_obs(e, ["label"], "embedding", "mean", ["first_vec"], "vec_id"), "label", "first_vec",
        "n").select("label", "pos", "value", "first_vec", "n")


@query(f"""WITH x AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 o AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS pos, v FROM x), n AS (SELECT label, count(*) AS n
 FROM embeddings GROUP BY 1), g AS (SELECT label, n, unnest(range(0, 64 * (SELECT max(n) FROM n))) AS pos FROM n)
SELECT g.label, g.n, CAST(g.pos AS INTEGER) AS pos, round(coalesce(v, 0), 6) AS value FROM g LEFT JOIN o ON g.label = o.label
 AND g.pos = o.pos""")
def pool_concat(s, d):
    c = pooling.pool_concat(table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), ["label"],
        "embedding", "vec_id")
    return long_vector(c, "label", "n")


@query("""WITH p AS (SELECT a.vec_id AS id, b.label AS nl, a.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(d, 12),
 b.vec_id) AS r, d FROM (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_distance(CAST(a.embedding AS DOUBLE[]),
 CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) q JOIN embeddings a ON a.vec_id = i
 JOIN embeddings b ON b.vec_id = j),
k AS (SELECT * FROM p WHERE r <= 10), c AS (SELECT id, nl, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT id,
 1 - sum(n * n) / (sum(n) * sum(n)) AS gini FROM c GROUP BY 1)
SELECT 'label' AS col, round(avg(CAST(l = nl AS DOUBLE)), 6) AS share, round((SELECT avg(gini) FROM g), 6) AS impurity, round(avg(d),
 6) AS distance FROM k""")
def knn_label_share(s, d):
    return rounded(neighbors.nn_proportions(table(s, d, "embeddings"), "vec_id", "embedding", ["label"], 10, "cosine"), "share", "impurity",
        "distance")


@query("""WITH q AS (SELECT a.vec_id AS id, sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]),
 CAST(b.embedding AS DOUBLE[])), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d, b.vec_id AS j FROM embeddings a
 JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), j) AS r FROM q) WHERE r <= 5)
SELECT id, round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(min(d), 6) AS min, round(median(d), 6) AS median FROM k GROUP BY id""")
def knn_distances(s, d):
    e = table(s, d, "embeddings")
    return rounded(neighbors.knn_summary(neighbors.knn(e, e, "vec_id", "embedding", 5)).select("id", "max", "mean", "min", "median"), "max",
        "mean", "min", "median")


@query("""SELECT a.vec_id AS id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 0.7 GROUP BY 1""")
def radius_counts(s, d):
    e = table(s, d, "embeddings")
    return neighbors.radius_counts(e, e, "vec_id", "embedding", [0.7], "cosine").select("id", "n")


@query("""WITH v AS (SELECT pos, var_pop(CAST(x AS DOUBLE)) AS v FROM (""" + _LONG + """) GROUP BY pos), q AS (SELECT quantile_cont(v,
 0.3) AS b FROM v), k AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, pos AS source FROM v, q WHERE v >= b)
SELECT CAST(k.pos AS INTEGER) AS pos, round(sum(CAST(x AS DOUBLE)), 6) AS total FROM (""" + _LONG + """) l JOIN k ON l.pos = k.source
 GROUP BY k.pos""")
def variance_filter(s, d):
    e = table(s, d, "embeddings")
    kept = curate.variance_transform(e, "embedding", curate.variance_fit(e, "embedding", 0.3))
    return rounded(kept.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos")
        .agg(F.sum(F.col("x").cast("double")).alias("total")), "total")


@query("""WITH p AS (SELECT CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y, a.vec_id FROM embeddings a
 JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_cosine_distance(x, y), 6) AS cosine, round(list_distance(x, y), 6) AS euclidean,
 round(list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2]))), 6) AS manhattan FROM p""")
def vecdist_pairs(s, d):
    e = table(s, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"),
        F.col("embedding").alias("y")), "vec_id")
    return rounded(p.select("vec_id", *[C.vec_distance("x", "y", m).alias(m) for m in ("cosine", "euclidean", "manhattan")]), "cosine",
        "euclidean", "manhattan")


@query("""SELECT CAST(max(len(embedding)) AS INTEGER) AS width, CAST(min(len(embedding)) AS INTEGER) AS least_width, count(DISTINCT label) AS n_label FROM embeddings""")
def data_spec(s, d):
    return aggregate.data_spec(table(s, d, "embeddings"), "embedding", ["label"])


@query(f"""WITH l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), r AS (SELECT vec_id, count(*) AS n,
 count(*) FILTER (v > 0.3) AS a, count(*) FILTER (v < -0.35) AS b FROM l GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (a > 0) AS nan_rows, count(*) FILTER (b > 0) AS inf_rows, round(sum(a) / sum(n), 9) AS nan_share,
 round(sum(b) / sum(n), 9) AS inf_share FROM r""")
def vector_health(s, d):
    spoilt = F.transform("embedding", lambda v: F.when(v > 0.3, float("nan")).when(v < -0.35, float("-inf")).otherwise(v.cast("double")))
    return rounded(aggregate.vector_health(table(s, d, "embeddings").select(spoilt.alias("embedding")), "embedding"), "nan_share",
        "inf_share", places=9)


@query("""WITH l AS (SELECT label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 c AS (SELECT label, p, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT p, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(q) - sum(s * s / n) AS w, count(*) AS k, sum(n) AS n FROM c GROUP BY p)
SELECT round(sum(b) / (max(k) - 1) / (sum(w) / (max(n) - max(k))), 6) AS ch FROM t""")
def calinski_harabasz(s, d):
    return rounded(stats.calinski_harabasz(table(s, d, "embeddings"), "embedding", "label"), "ch")


@query("""WITH p AS (SELECT a.vec_id AS id, a.label AS own, b.label AS c, list_distance(CAST(a.embedding AS DOUBLE[]),
 CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings b),
s AS (SELECT id, own, c, sum(d) AS s, count(*) AS k FROM p GROUP BY ALL), g AS (SELECT id, max(CASE WHEN c = own
 AND k > 1 THEN s / (k - 1) END) AS a, min(CASE WHEN c <> own THEN s / k END) AS b FROM s GROUP BY id)
SELECT id, round((b - a) / greatest(a, b), 5) AS silhouette FROM g""")
def silhouette_rows(s, d):
    return rounded(stats.silhouette(table(s, d, "embeddings"), "vec_id", "embedding", "label"), "silhouette", places=5)


def _silhouette_sql(distance: str) -> str:
    return f"""WITH p AS (SELECT a.vec_id AS id, a.label AS own, b.label AS c, {distance} AS d FROM (SELECT vec_id, label,
 CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a, (SELECT label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b),
s AS (SELECT id, own, c, sum(d) AS s, count(*) AS k FROM p GROUP BY ALL), g AS (SELECT id, max(CASE WHEN c = own THEN k END) AS n, max(CASE
 WHEN c = own AND k > 1 THEN s / (k - 1) END) AS a, min(CASE WHEN c <> own THEN s / k END) AS b FROM s GROUP BY id)
SELECT id, round(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM g"""


@query(_silhouette_sql("list_cosine_distance(x, y)"))
def silhouette_cosine(s, d):
    return rounded(stats.silhouette(table(s, d, "embeddings"), "vec_id", "embedding", "label", "cosine"), "silhouette", places=5)


@query(_silhouette_sql("list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"))
def silhouette_squared(s, d):
    return rounded(stats.silhouette(table(s, d, "embeddings"), "vec_id", "embedding", "label", "sqeuclidean"), "silhouette", places=5)


@query("""WITH e AS (SELECT label AS t, CAST(floor(embedding[1] * 8) AS BIGINT) AS p FROM embeddings), c AS (SELECT t, p, count(*) AS n
 FROM e GROUP BY ALL), a AS (SELECT t, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT p, sum(n) AS n FROM c GROUP BY 1),
 z AS (SELECT count(*)::DOUBLE AS n FROM e),
v AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS c2, (SELECT sum(n * (n - 1) / 2.0) FROM a) AS t2, (SELECT sum(n * (n - 1) / 2.0)
 FROM b) AS p2, z.n * (z.n - 1) / 2 AS a2, ln(z.n) - (SELECT sum(n * ln(n)) FROM a) / z.n AS ht, ln(z.n) - (SELECT sum(n * ln(n))
 FROM b) / z.n AS hp, ln(z.n) - (SELECT sum(n * ln(n)) FROM c) / z.n AS hj FROM z)
SELECT round((c2 - t2 * p2 / a2) / ((t2 + p2) / 2 - t2 * p2 / a2), 6) AS ari, round((ht + hp - hj) / ht, 6) AS homogeneity,
 round((ht + hp - hj) / hp, 6) AS completeness FROM v""")
def clustering_agreement(s, d):
    e = table(s, d, "embeddings").select(F.col("label").alias("t"), F.floor(F.get("embedding", F.lit(0)).cast("double") * 8).alias("p"))
    return rounded(stats.clustering_agreement(e, "t", "p"), "ari", "homogeneity", "completeness")


@query(f"""{_PAIRS}, d AS (SELECT related, list_cosine_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d FROM p
 JOIN embeddings x ON p.a = x.vec_id JOIN embeddings y ON p.b = y.vec_id), c AS (SELECT d,
 sum(sum(CAST(related AS INTEGER))) OVER (ORDER BY d) AS ca, sum(sum(CAST(NOT related AS INTEGER))) OVER (ORDER BY d) AS cb FROM d
 GROUP BY d), n AS (SELECT count(*) FILTER (related) AS n1, count(*) FILTER (NOT related) AS n2 FROM d), t AS (SELECT n1, n2,
 greatest(max(ca / n1 - cb / n2), 0) AS statistic FROM c, n GROUP BY ALL)
SELECT n1, n2, round(statistic, 6) AS statistic, round(exp(-2 * statistic * statistic * n1 * n2 / (n1 + n2)), 6) AS p FROM t""")
def category_distance(s, d):
    return rounded(stats.category_distance(table(s, d, "embeddings"), "vec_id", "embedding", "label", 10), "statistic", "p")


@query(f"""{_PAIRS} SELECT a, b, related FROM p""")
def related_pairs(s, d):
    return sampling.related_pairs(table(s, d, "embeddings"), "vec_id", "label", 10)
