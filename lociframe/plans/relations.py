"""Queries of sources, look-ups, splits, label columns and neighbourhood tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregate, curate, joins, models, neighbors, sampling, sequences, stats, windows
from ..scratch import scratch_path
from ..sources import readers, writers
from .registry import chi2_tail, drawn, drawn_unit, pairs_sql, random_pairs_sql, registry, rounded, table

QUERIES, ORACLE_SQL, query = registry()


# -- sources and sinks -------------------------------------------------------------------------------


@query("""SELECT p_type, p_partkey FROM part""")
def load_columns(s, d):
    return readers.load(s, f"{d}/part.parquet", ["p_type", "p_partkey"])


@query("""SELECT c_custkey, c_name, c_mktsegment, c_acctbal, CASE WHEN c_nationkey > 4 THEN c_nationkey END AS nation, 'csv' AS format FROM customer
 UNION ALL SELECT c_custkey, c_name, c_mktsegment, c_acctbal, CASE WHEN c_nationkey > 4 THEN c_nationkey END, 'parquet' FROM customer""")
def table_formats(s, d):
    """A table with nulls, names with commas and quotes in between, as CSV and as parquet, each read by its suffix."""
    c = table(s, d, "customer")
    rows = c.select("c_custkey", F.concat(F.lit('a "b", '), "c_name").alias("c_name"), "c_mktsegment", "c_acctbal",
        F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("nation"))
    out = []
    for fmt in ("csv", "parquet"):
        path = scratch_path(s, f"table-{uuid.uuid4().hex}.{fmt}")
        writers.write_table(rows, path, fmt)
        read = readers.read_tabular(s, path).withColumn("format", F.lit(fmt))
        out.append(read.select(*[F.col(n).cast(rows.schema[n].dataType) for n in rows.columns], "format"))
    return out[0].unionByName(out[1]).withColumn("c_name", F.substring("c_name", 8, 1000))


@query("""SELECT p_partkey, p_name, nullif(p_brand, 'Brand#1') AS p_brand, p_size, p_retailprice FROM part""")
def table_round_trip(s, d):
    path = scratch_path(s, f"part-{uuid.uuid4().hex}.tsv")
    p = table(s, d, "part").select("p_partkey", "p_name", F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"), "p_size", "p_retailprice")
    writers.write_table(p, path, "tsv")
    return readers.read_tabular(s, path, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def merge_runs(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return writers.merge_runs([c, c], ["c_custkey"])


@query("""SELECT c_custkey AS sample, c_name AS name, c_acctbal, c_mktsegment AS c_class, 'shop' AS dataset FROM customer""")
def source_spec(s, d):
    spec = {"sample": "c_custkey", "rename": {"c_name": "name"}, "drop": ["c_nationkey"], "class_suffix": "_mktsegment"}
    return curate.apply_source_spec(table(s, d, "customer"), spec, "shop")


# -- projections and filters -------------------------------------------------------------------------


_TITLE = "CASE p_type WHEN 'ECONOMY' THEN 'a NARMS project' WHEN 'PROMO' THEN 'Vet-LIRN' ELSE 'GenomeTrakr: ' || p_name END"


@query(f"""SELECT p_partkey, CASE WHEN t LIKE '%NARMS%' THEN 'NARMS' WHEN t LIKE '%Vet-LIRN%' THEN 'Vet-LIRN' WHEN t LIKE '%GenomeTrakr%' THEN 'GenomeTrakr' END AS umbrella, CASE WHEN t LIKE '%NARMS%' THEN 'NARMS' ELSE p_brand END AS tester FROM (SELECT *, {_TITLE} AS t FROM part)""")
def project_groups(s, d):
    p = table(s, d, "part").withColumn("t", F.expr(_TITLE))
    return p.select("p_partkey", C.project_group("p_name", "t").alias("umbrella"), C.tested_by("p_name", "t", "p_brand").alias("tester"))


@query("""SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def drop_null_columns(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", F.lit(None).cast("string").alias("note"))
    return curate.drop_null_columns(docs.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left"))


@query("""SELECT doc_id, lang AS gene_a, quality AS gene_b, lang IS NOT NULL OR quality IS NOT NULL AS in_gene FROM documents LEFT JOIN labels USING (doc_id)""")
def in_gene(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return curate.in_gene(docs.select("doc_id", F.col("lang").alias("gene_a"), F.col("quality").alias("gene_b")))


@query("""SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10""")
def min_group_size(s, d):
    return curate.min_group_size(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def keep_known_keys(s, d):
    return curate.keep_known_keys(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey",
        table(s, d, "orders").select(F.col("o_custkey").alias("key")))


@query("""SELECT doc_id, CASE WHEN lang IS NOT NULL AND quality IS NOT DISTINCT FROM 1 THEN 'download' ELSE 'assemble' END AS list FROM documents LEFT JOIN labels USING (doc_id)""")
def split_candidates(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")
    good, rest = curate.split_candidates(docs, "lang", "quality", ok=1)
    return good.select("doc_id", F.lit("download").alias("list")).unionByName(rest.select("doc_id", F.lit("assemble").alias("list")))


@query("""SELECT p_partkey, regexp_replace(trim(lower(p_type)), '[ -]+', '_', 'g') AS antibiotic FROM part""")
def clean_drug_names(s, d):
    return sequences.clean_drug_names(table(s, d, "part").select("p_partkey",
        F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")).alias("antibiotic")))


# -- joins -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey""")
def store_lookup(s, d):
    path = scratch_path(s, f"balances-{uuid.uuid4().hex}")
    writers.store_append(path, table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"),
        F.array(F.col("c_acctbal")).alias("seq")))
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    found = joins.store_lookup(orders, "o_custkey", s.read.parquet(path), strict=False)
    return found.select("o_orderkey", F.get("seq", F.lit(0)).alias("balance"))


@query("""SELECT vec_id AS id, embedding[1] AS first, embedding[len(embedding)] AS last, -embedding[1] AS negative FROM embeddings""")
def align_pairs(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    out = joins.align_pairs(e, e.withColumn("x", F.reverse("x")), e.withColumn("x", F.transform("x", lambda v: -v)))
    return out.select("id", F.get("natural", F.lit(0)).alias("first"), F.get("perturbed", F.lit(0)).alias("last"),
        F.get("random", F.lit(0)).alias("negative"))


@query("""SELECT DISTINCT s_name AS l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def remap_accessions(s, d):
    return joins.remap_accessions(table(s, d, "lineitem").select("l_suppkey", "l_partkey"), table(s, d, "supplier"), "l_suppkey",
        "s_suppkey", "s_name")


@query("""SELECT o_orderkey AS member, min(o_orderkey) OVER (PARTITION BY o_custkey) AS rep, nullif(o_orderpriority, '') AS o_orderpriority, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_rep FROM orders""")
def cluster_metadata(s, d):
    o = table(s, d, "orders")
    reps = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("rep"))
    clusters = o.join(reps, "o_custkey").select(F.col("o_orderkey").alias("member"), "rep")
    return joins.cluster_metadata(o.select(F.col("o_orderkey").alias("accession"), "o_orderpriority"), clusters)


@query("""WITH c AS (SELECT p_type, min(p_brand) AS b FROM part WHERE p_size > 48 GROUP BY 1), j AS (SELECT p_partkey, part.p_type AS drug,
 coalesce(b, part.p_type) AS drug_class FROM part LEFT JOIN c USING (p_type))
SELECT p_partkey, drug, drug_class, CASE WHEN regexp_matches(drug_class, '(?i)brand#1') THEN 'ones' WHEN regexp_matches(drug_class,
 '(?i)(brand|promo)') THEN 'others' END AS interest FROM j""")
def drug_classes(s, d):
    p = table(s, d, "part")
    compounds = p.where("p_size > 48").select(F.col("p_type").alias("drug"), F.col("p_brand").alias("drug_class"))
    custom = p.select(F.col("p_type").alias("drug"), F.col("p_type").alias("drug_class"))
    return joins.drug_classes(p.select("p_partkey", F.col("p_type").alias("drug")), compounds, custom,
        {"ones": "brand#1", "others": "(brand|promo)"})


# -- aggregates and windows --------------------------------------------------------------------------


@query("""WITH g AS (SELECT p_brand, p_type, min(p_size) AS new FROM part GROUP BY ALL) SELECT p_brand, p_type, new FROM g QUALIFY row_number() OVER (PARTITION BY new ORDER BY p_brand, p_type) = 1""")
def cluster_recode(s, d):
    return aggregate.cluster_recode(table(s, d, "part").select("p_brand", "p_type", F.col("p_size").alias("cluster")),
        ["p_brand", "p_type"])


@query("""SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part""")
def expand_annotations(s, d):
    return aggregate.expand_annotations(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", " ")


@query("""SELECT l_returnflag, NULL AS l_linestatus, count(*) AS n, 'flag' AS run FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, l_linestatus, count(*), 'status' FROM lineitem GROUP BY 2""")
def gather_runs(s, d):
    li = table(s, d, "lineitem")
    runs = [li.groupBy(c).agg(F.count("*").alias("n")) for c in ("l_returnflag", "l_linestatus")]
    return aggregate.gather(runs, [{"run": "flag"}, {"run": "status"}])


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_orders(s, d):
    return windows.top_n(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


# -- label and interval columns ----------------------------------------------------------------------


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a,
 list_distinct(string_split(lower(p_type) || ' small red', ' ')) AS b FROM part), n AS (SELECT *, len(list_intersect(a, b)) AS k FROM w)
SELECT p_partkey, CAST(k AS INTEGER) AS common, (len(a) + len(b) - 2 * k) / (len(a) + len(b) - k) AS distance FROM n""")
def label_distance(s, d):
    p = table(s, d, "part").select("p_partkey", C.split_labels("p_name", " ").alias("a"),
        C.split_labels(F.concat(F.lower("p_type"), F.lit(" small red")), " ").alias("b"))
    return p.select("p_partkey", C.overlap_size("a", "b").alias("common"), C.label_jaccard("a", "b").alias("distance"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, CASE WHEN a.f = b.f THEN greatest(b.lo - a.hi, a.lo - b.hi, 0) ELSE 1000 END AS gap,
 abs(a.lo - b.lo) AS diff FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def gap_distance(s, d):
    i = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("lo"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("hi"))
    after = i.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"),
        *[F.col(c).alias(f"{c}_b") for c in ("f", "lo", "hi")])
    both = i.join(after, ["l_orderkey", "l_linenumber"])
    return both.select("l_orderkey", "l_linenumber", C.gap_distance("lo", "hi", "lo_b", "hi_b", F.col("f") == F.col("f_b"), F.lit(1000.0))
        .alias("gap"), C.abs_diff("lo", "lo_b").alias("diff"))


@query("""SELECT doc_id, greatest(length(text) // 4 - 10, 0) AS cut_start, least(length(text) // 2 + 20, length(text)) AS cut_stop, md5(substr(text, greatest(length(text) // 4 - 10, 0) + 1, least(length(text) // 2 + 20, length(text)) - greatest(length(text) // 4 - 10, 0))) AS piece FROM documents WHERE text IS NOT NULL""")
def cut_features(s, d):
    contigs = table(s, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("sequence"))
    n = F.length("sequence").cast("long")
    features = contigs.select("doc_id", F.floor(n / 4).alias("chunk_start"), F.floor(n / 2).alias("chunk_stop"))
    cut = sequences.cut_features(contigs, features, up=10, down=20, by=["doc_id"])
    return cut.select("doc_id", "cut_start", "cut_stop", F.md5(F.col("sequence").cast("binary")).alias("piece"))


# -- samples and splits ------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_acctbal, c_mktsegment, t AS test_set, CASE WHEN CASE t WHEN 'segment' THEN c_mktsegment = 'BUILDING' ELSE c_acctbal > 5000 END THEN 'test' ELSE 'train' END AS split, i AS iter FROM customer, (VALUES ('segment'), ('rich')) v(t), (VALUES (0), (1)) w(i)""")
def holdout_plan(s, d):
    spec = {"segment": {"c_mktsegment": {"EXACT": "BUILDING"}}, "rich": {"c_acctbal": {"GT": 5000}}}
    return sampling.holdout_plan(table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", spec, bootstrap=2)


@query(f"""SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {drawn(3, 'sample', 'c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 25""")
def sample_sizes(s, d):
    return sampling.sample_n(table(s, d, "customer"), "c_custkey", n=25, by=["c_mktsegment"], seed=3).select("c_mktsegment", "c_custkey")


@query(f"""SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY {drawn(0, 'sample', 'doc_id')}, doc_id) AS r FROM labels) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balanced_sizes(s, d):
    return sampling.balance(table(s, d, "labels"), "quality", id="doc_id").select("quality", "doc_id")


@query(f"""WITH {random_pairs_sql('customer', 'c_custkey', 500, 5)} SELECT a, b FROM p""")
def random_pairs(s, d):
    return sampling.random_pairs(table(s, d, "customer"), "c_custkey", 500, seed=5)


@query(f"""SELECT c_custkey, c_mktsegment, CASE WHEN {drawn_unit(5, 'split', 'c_custkey')} < 0.2 THEN 'test' WHEN {drawn_unit(5, 'validation', 'c_custkey')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM customer""")
def train_test(s, d):
    return sampling.train_test(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.2, seed=5, validation=0.1)


# -- statistics --------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT source AS task, quality, 1 / (1 + n_chars / 1000.0) AS p FROM documents JOIN labels USING (doc_id)) SELECT task, round(avg(-ln(greatest(CASE quality WHEN 1 THEN p ELSE 1 - p END, 1e-15))), 6) AS loss FROM p GROUP BY 1""")
def cross_entropy(s, d):
    p = 1 / (1 + F.col("n_chars") / 1000.0)
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("source").alias("task"), "quality",
        F.create_map(F.lit(1), p, F.lit(0), 1 - p).alias("proba"))
    return rounded(stats.cross_entropy(rows, "quality", "proba"), "loss")


@query("""WITH c AS (SELECT source AS tool, coalesce(lang, 'none') AS drug, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp,
 count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fn,
 count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT tool, drug, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS acc,
 round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
 round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM c""")
def external_metrics(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    code = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "TP").when((F.col("quality") == 1) & (F.col("toxic") == 0),
        "FP").when((F.col("quality") == 0) & (F.col("toxic") == 1), "FN").when((F.col("quality") == 0) & (F.col("toxic") == 0), "TN")
    codes = rows.select(F.col("source").alias("tool"), F.coalesce("lang", F.lit("none")).alias("drug"), code.alias("code"))
    return rounded(models.external_metrics(codes), "acc", "mcc", "sensitivity", "specificity")


@query("""WITH o AS (SELECT avg(c_acctbal) AS e FROM customer GROUP BY c_mktsegment), r AS (SELECT avg(c_acctbal) AS e FROM customer GROUP BY c_nationkey), c AS (SELECT (SELECT count(*) FROM r WHERE r.e <= o.e) AS k FROM o) SELECT round(avg((k + 1) / ((SELECT count(*) FROM r) + 1)), 6) AS p FROM c""")
def permutation_p(s, d):
    by = lambda c: table(s, d, "customer").groupBy(c).agg(F.avg("c_acctbal").alias("error")).select("error")
    return rounded(stats.permutation_p(by("c_mktsegment"), by("c_nationkey")), "p")


_RADII = (1.2, 1.35, 1.5)


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), w AS (SELECT label,
 count(*) / (SELECT count(*) FROM e) AS share FROM e GROUP BY 1), p AS (SELECT a.vec_id AS id, b.label, list_distance(a.x, b.x) AS d
 FROM e a JOIN e b ON a.vec_id <> b.vec_id), q AS (SELECT id, label, r FROM p, (VALUES ({_RADII[0]}), ({_RADII[1]}), ({_RADII[2]})) v(r)
 WHERE d <= r),
z AS (SELECT id, r, count(*) AS n FROM q GROUP BY ALL), g AS (SELECT id, coalesce(min(CASE WHEN n * (SELECT min(share)
 FROM w) >= 5 THEN r END), max(r)) AS r FROM z GROUP BY 1), o AS (SELECT id, r, label, count(*) AS o FROM q JOIN g USING (id, r)
 GROUP BY ALL), x AS (SELECT id, CAST(r AS DOUBLE) AS radius, n, sum(o * o / (n * share)) - n AS chi2, (SELECT count(*) - 1 FROM w) AS df
 FROM o JOIN z USING (id, r) JOIN w USING (label) GROUP BY id, r, n), t AS (SELECT *, {chi2_tail('greatest(chi2, 1e-9)', 'df')} AS p FROM x)
SELECT id, radius, n, round(chi2, 6) AS chi2, CAST(df AS INTEGER) AS df, round(p, 5) AS p, round(least(1, p * (SELECT count(*) FROM e)),
 3) AS p_adj FROM t""")
def neighbor_chi_square(s, d):
    e = table(s, d, "embeddings")
    found = neighbors.neighbor_chi_square(e, "vec_id", "embedding", "label", list(_RADII)).select("id", "radius", "n", "chi2", "df", "p",
        "p_adj")
    return rounded(rounded(rounded(found, "chi2"), "p", places=5), "p_adj", places=3)


@query("""WITH e AS (SELECT 'n' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, 0.0::DOUBLE AS f FROM embeddings UNION ALL SELECT 'r' || vec_id, CAST(list_reverse(embedding) AS DOUBLE[]), 1.0 FROM embeddings), p AS (SELECT a.id, b.f, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 12), b.id) AS k FROM e a JOIN e b ON a.f = 0 AND a.id <> b.id) SELECT 0 AS iter, round(avg(f), 6) AS score FROM p WHERE k <= 5""")
def random_neighbor_score(s, d):
    e = table(s, d, "embeddings")
    return rounded(neighbors.random_neighbor_score(e, e.withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding", 5), "score")


@query(f"""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), near AS (SELECT id, list(j) AS v
 FROM (SELECT a.id, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM e a
 JOIN e b ON a.id <> b.id) WHERE r <= 6 GROUP BY 1),
o AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM e), along AS (SELECT a.id,
 list(b.id) FILTER (b.id IS NOT NULL) AS g FROM o a LEFT JOIN o b ON a.label = b.label AND a.k <> b.k AND abs(a.k - b.k) <= 3 GROUP BY 1),
l AS (SELECT id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v FROM e), b AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM l
 GROUP BY 1), f AS (SELECT q.id, list(lo + (hi - lo) * {drawn_unit(1, 'uniform', 'q.id', 'pos')} ORDER BY pos) AS x FROM range(0,
 (SELECT count(*) FROM e)) q(id), b GROUP BY 1),
dr AS (SELECT i, list(j) AS u FROM (SELECT f.id AS i, e.id AS j, row_number() OVER (PARTITION BY f.id ORDER BY list_distance(f.x, e.x),
 e.id) AS r FROM f, e) WHERE r <= 6 GROUP BY 1), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM e),
z AS (SELECT n.id, len(list_intersect(v, coalesce(g, []))) AS o, len(list_intersect(u, coalesce(g, []))) AS r FROM n JOIN near USING (id)
 JOIN along USING (id) JOIN dr USING (i)) SELECT id, CAST(o AS INTEGER) AS overlap, CAST(r AS INTEGER) AS random_overlap,
 round(greatest(log10((o + 1) / (r + 1)), 0), 6) AS score FROM z""")
def neighbor_preserving(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", "label", F.col("vec_id").alias("start"),
        (F.col("vec_id") + 1).alias("stop"))
    return rounded(neighbors.neighbor_preserving(e, "vec_id", "embedding", "label", "start", "stop", k=6, seed=1), "score")


@query(f"""WITH e AS (SELECT vec_id AS id, label, embedding[1] > 0 AS up, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 near AS (SELECT id, j FROM (SELECT a.id, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r
 FROM e a JOIN e b ON a.id <> b.id) WHERE r <= 5),
n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM e), dr AS (SELECT a.id, d, b.id AS j FROM (SELECT id,
 d, CAST(floor({drawn_unit(1, 'neighbour', 'id', 'd')} * n) AS BIGINT) AS i FROM n, range(1, 6) q(d)) a JOIN n b USING (i)),
s AS (SELECT 'c' AS kind, id, j AS k, j FROM near UNION ALL SELECT 'r', id, d, j FROM dr), m AS (SELECT x.kind, x.id, avg(CASE
 WHEN a.label = b.label AND a.up = b.up THEN 0.0 WHEN a.label = b.label OR a.up = b.up THEN 2 / 3.0::DOUBLE ELSE 1.0 END) AS v FROM s x
 JOIN s y ON x.kind = y.kind AND x.id = y.id AND x.k < y.k JOIN e a ON a.id = x.j JOIN e b ON b.id = y.j GROUP BY ALL)
SELECT c.id, round(c.v, 6) AS coherence, round(r.v, 6) AS random FROM m c LEFT JOIN m r ON r.kind = 'r' AND c.id = r.id
 WHERE c.kind = 'c'""")
def annotation_coherence(s, d):
    e = table(s, d, "embeddings").withColumn("words",
        F.array(F.col("label").cast("string"), F.when(F.get("embedding", F.lit(0)) > 0, "up").otherwise("down")))
    return rounded(neighbors.annotation_coherence(e, "vec_id", "embedding", "words", k=5, seed=1), "coherence", "random")


@query(f"""{pairs_sql(1, 10)}, d AS (SELECT related, list_cosine_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d
 FROM p JOIN embeddings x ON p.a = x.vec_id JOIN embeddings y ON p.b = y.vec_id), c AS (SELECT d,
 sum(sum(CAST(related AS INTEGER))) OVER (ORDER BY d) AS ca, sum(sum(CAST(NOT related AS INTEGER))) OVER (ORDER BY d) AS cb FROM d
 GROUP BY d), n AS (SELECT count(*) FILTER (related) AS n1, count(*) FILTER (NOT related) AS n2, avg(d) FILTER (related) AS rm,
 avg(d) FILTER (NOT related) AS um FROM d), t AS (SELECT n1, n2, rm, um, greatest(max(ca / n1 - cb / n2), 0) AS s FROM c, n GROUP BY ALL),
k AS (SELECT related, greatest(d, 1e-12) AS d, floor(rank() OVER (PARTITION BY related ORDER BY d) + (count(*) OVER (PARTITION BY related,
 d) - 1) / 2.0) AS k FROM d), b AS (SELECT k, sum(d) FILTER (related) AS da, sum(d) FILTER (NOT related) AS db FROM k GROUP BY k
 HAVING count(*) FILTER (related) > 0 AND count(*) FILTER (NOT related) > 0), z AS (SELECT sum(da) AS sa, sum(db) AS sb FROM b),
 q AS (SELECT sum(da / sa * ln((da / sa) / (db / sb))) AS kl FROM b, z)
SELECT 'label' AS col, round(rm, 6) AS related_mean, round(um, 6) AS unrelated_mean, round(s, 6) AS statistic,
 round(exp(-2 * s * s * n1 * n2 / (n1 + n2)), 6) AS p, round(kl, 6) AS relative_entropy FROM t, q""")
def pair_distribution(s, d):
    found = stats.pair_distribution(table(s, d, "embeddings"), "vec_id", "embedding", ["label"], n_per=10, seed=1)
    return rounded(found, "related_mean", "unrelated_mean", "statistic", "p", "relative_entropy")


