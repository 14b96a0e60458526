"""Queries of curation: projections, filters, joins, counts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregate, curate, joins, sampling, sets, windows
from .registry import drawn, drawn_unit, registry, rounded, table

QUERIES, ORACLE_SQL, query = registry()


@query("""SELECT user_id, min(CASE WHEN event_type = 'click' THEN value END) AS click, min(CASE WHEN event_type = 'view' THEN value END) AS view, min(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY user_id""")
def pivot_first(s, d):
    return aggregate.pivot_first(table(s, d, "events"), ["user_id"], "event_type", "value", ["click", "view", "purchase"])


_CLASSES = "CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'N' THEN 'not defined' ELSE 'R' END"


@query(f"""WITH w AS (SELECT l_orderkey, l_linenumber, {_CLASSES} AS c FROM lineitem), x AS (SELECT *, CASE c WHEN 'S' THEN 'susceptible'
 WHEN 'R' THEN 'resistant' END AS p FROM w)
SELECT l_orderkey, l_linenumber, CASE p WHEN 'resistant' THEN 'R' WHEN 'susceptible' THEN 'S' END AS flag_resistant FROM x""")
def class_codes(s, d):
    li = table(s, d, "lineitem")
    raw = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "N",
        "not defined").otherwise("R").alias("flag_class"))
    return curate.class_codes(curate.recode_phenotype(raw))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS a_class, CAST(l_linestatus = 'O' AS INTEGER) AS b_class, l_returnflag = 'R' OR l_linestatus = 'O' AS any_resistant, l_returnflag = 'A' OR l_linestatus = 'F' AS any_susceptible FROM lineitem""")
def binarize(s, d):
    li = table(s, d, "lineitem")
    w = lambda c, r, ok: F.when(F.col(c) == r, "resistant").when(F.col(c) == ok, "susceptible").otherwise("intermediate")
    return curate.binarize_phenotype(li.select("l_orderkey", "l_linenumber", w("l_returnflag", "R", "A").alias("a_class"),
        w("l_linestatus", "O", "F").alias("b_class")))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice) -
 1 AS i FROM orders), b AS (SELECT max(CASE WHEN i = CAST(round_even(0.3 * (n - 1), 0) AS BIGINT) THEN o_totalprice END) AS lo, max(CASE
 WHEN i = CAST(round_even(0.8 * (n - 1), 0) AS BIGINT) THEN o_totalprice END) AS hi FROM r, n)
SELECT o_orderkey, CASE WHEN o_totalprice < lo THEN 'susceptible' WHEN o_totalprice > hi THEN 'resistant'
 ELSE 'intermediate' END AS o_totalprice_level FROM orders, b""")
def discretize(s, d):
    return curate.discretize(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"],
        suffix="level").select("o_orderkey", "o_totalprice_level")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN NULL WHEN log2(l_quantity) = round(log2(l_quantity)) THEN l_quantity ELSE pow(2.0, least(greatest(ceil(log2(l_quantity) - 0.5), -8), 9)) END AS mic FROM lineitem""")
def smooth_log2(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.smooth_log2("l_quantity").alias("mic"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)(brass|copper)') THEN 'red' WHEN regexp_matches(p_type, '(?i)(steel|tin|nickel)') THEN 'grey' ELSE 'unknown' END AS metal FROM part""")
def recode_by_pattern(s, d):
    return table(s, d, "part").select("p_partkey",
        C.recode_by_pattern("p_type", [(["brass", "copper"], "red"), (["steel", "tin", "nickel"], "grey")]).alias("metal"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def partial_date_year(s, d):
    o = table(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 1,
        F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", C.partial_date_year(F.concat(F.lit("about "), text)).alias("year"))


@query("""SELECT p_partkey, CASE regexp_replace(trim(lower(p_type)), '[ -]+', '_', 'g') WHEN 'economy_brass' THEN 'brass' ELSE regexp_replace(trim(lower(p_type)), '[ -]+', '_', 'g') END AS name FROM part""")
def normalise_name(s, d):
    return table(s, d, "part").select("p_partkey", C.normalise_name(F.concat(F.lit("Drug combination: "), "p_type"),
        {"economy_brass": "brass"}).alias("name"))


@query("""SELECT column_name AS column, CAST(n_null AS BIGINT) AS n_null, n_null / total AS share FROM (SELECT count(*) AS total, count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic FROM (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))) UNPIVOT (n_null FOR column_name IN (doc_id, lang, quality, toxic))""")
def null_profile(s, d):
    return aggregate.null_profile(table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left"))


@query("""SELECT lang AS value, count(DISTINCT source) AS n, count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def count_table(s, d):
    return aggregate.count_table(table(s, d, "documents"), "source", "lang")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1""")
def freq_table(s, d):
    return aggregate.freq_table(table(s, d, "orders"), "o_orderpriority")


@query("""SELECT l_suppkey AS supplier, count(DISTINCT l_returnflag) AS n_flag, count(DISTINCT l_partkey) AS n_part FROM lineitem GROUP BY 1""")
def distinct_per_sample(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part"))
    return aggregate.distinct_per_sample(li, "supplier", ["flag", "part"])


def _confounding(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS x, '{y}' AS y, CAST(l.{y} AS VARCHAR) AS level, sum(abs(coalesce(n,
 0) / total - 1.0 / k)) / (1.0 / k * (k - 1) + 1 - 1.0 / k) AS score
FROM (SELECT {y}, count(*) AS total FROM t GROUP BY 1) l CROSS JOIN (SELECT DISTINCT {x} FROM t) g CROSS
 JOIN (SELECT count(DISTINCT {x}) AS k FROM t) c LEFT JOIN (SELECT {x}, {y}, count(*) AS n FROM t GROUP BY ALL) q ON q.{x} = g.{x}
 AND q.{y} = l.{y} GROUP BY l.{y}, k"""


@query(f"""WITH t AS (SELECT c_mktsegment AS segment, c_nationkey AS nation FROM customer), s AS ({_confounding('segment', 'nation')}
 UNION ALL {_confounding('nation', 'segment')}), a AS (SELECT avg(m) AS avg FROM (SELECT x, avg(score) AS m FROM s GROUP BY x))
SELECT x, y, level, round(score, 6) AS score, round(a.avg, 6) AS avg FROM s, a""")
def confounding_score(s, d):
    t = table(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return rounded(aggregate.confounding_score(t, ["segment", "nation"]), "score", "avg").select("x", "y", "level", "score", "avg")


@query("""SELECT c_nationkey, c_mktsegment, count(*) FILTER (c_acctbal > 5000) AS n_rich, count(*) FILTER (c_acctbal <= 0) AS n_poor FROM customer GROUP BY ALL HAVING count(*) FILTER (c_acctbal > 5000) > 3 AND count(*) FILTER (c_acctbal <= 0) > 1""")
def valid_cells(s, d):
    c = table(s, d, "customer").withColumn("level", F.when(F.col("c_acctbal") > 5000, "rich").when(F.col("c_acctbal") <= 0, "poor")
        .otherwise("mid"))
    return curate.valid_cells(c, ["c_nationkey", "c_mktsegment"], "level", {"rich": 3, "poor": 1})


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR regexp_matches(c_name, '00$') OR contains(c_name, '77') THEN 'test' ELSE 'train' END AS split FROM customer""")
def split_mask(s, d):
    spec = {"c_mktsegment": {"EXACT": "BUILDING"}, "c_acctbal": {"LT": 0}, "c_name": {"CONTAINS": "00$", "CONTAINS_ANY": ["77"]}}
    return curate.split_mask(table(s, d, "customer"), spec).select("c_custkey", "split")


@query("""SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice <= 1500 AND p_brand <> 'Brand#11'""")
def filter_ops(s, d):
    return curate.filter_ops(table(s, d, "part"),
        [("p_size", ">", 10), ("p_retailprice", "<=", 1500), ("p_brand", "!=", "Brand#11")]).select("p_partkey")


@query("""SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 25) AND p_partkey % 40 NOT IN (SELECT p_partkey % 40 FROM part WHERE p_size = 1 AND p_brand <= 'Brand#15')""")
def filter_features(s, d):
    p = table(s, d, "part").withColumn("line", F.col("p_partkey") % 40)
    white = p.groupBy("p_brand").agg(F.avg("p_size").alias("mean")).where("mean > 25").select("p_brand")
    black = p.where("p_size = 1 AND p_brand <= 'Brand#15'").select("line").distinct()
    return curate.filter_features(curate.filter_features(p, ["p_brand"], whitelist=white), ["line"], blacklist=black).select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 5""")
def min_rows_per(s, d):
    return curate.min_rows_per(table(s, d, "lineitem"), "l_orderkey", 5).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def keep_groups_with(s, d):
    return curate.keep_groups_with(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["R"]).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, concat_ws('_', p_brand, p_type) AS label FROM part""")
def unite_numbered(s, d):
    return curate.unite_numbered(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("label...1"),
        F.col("p_type").alias("label...2")), ["label"])


@query("""SELECT c_custkey, antibiotic, class, mic, CASE WHEN mic IS NULL OR mic <= 0 THEN NULL WHEN log2(mic) = round(log2(mic)) THEN mic ELSE pow(2.0, least(greatest(ceil(log2(mic) - 0.5), -8), 9)) END AS mic_smooth FROM (SELECT c_custkey, 'amikacin' AS antibiotic, CASE WHEN c_acctbal > 0 THEN 'resistant' END AS class, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS mic FROM customer UNION ALL SELECT c_custkey, 'gentamicin', 'susceptible', CAST(c_nationkey + 1 AS DOUBLE) FROM customer)""")
def ast_long(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("amikacin"),
        F.when(F.col("c_acctbal") > 0, "R").otherwise("not defined").alias("amikacin_class"),
            (F.col("c_nationkey") + 1).cast("double").alias("gentamicin"), F.lit("S").alias("gentamicin_class"))
    return curate.ast_long(c, ["amikacin", "gentamicin"], sample="c_custkey")


@query("""WITH c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), q AS (SELECT quantile_cont(k, 0.6) AS lo, quantile_cont(k, 0.9) AS hi FROM c) SELECT o_custkey, k AS n, CASE WHEN k >= hi THEN 'majority' WHEN k < lo THEN 'minority' ELSE 'intermediate' END AS representation FROM c, q""")
def representation(s, d):
    return windows.representation(table(s, d, "orders"), "o_custkey")


@query("""WITH b AS (SELECT o_orderkey AS uid, o_custkey AS k, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS start,
 CAST(epoch(o_orderdate) // 86400 AS BIGINT) + o_orderkey % 40 AS stop FROM orders), r AS (SELECT o_custkey AS k, CAST(epoch(o_orderdate) //
 86400 AS BIGINT) - 5 AS start, CAST(epoch(o_orderdate) // 86400 AS BIGINT) + 15 AS stop, o_orderkey AS note FROM orders),
m AS (SELECT b.uid, r.start AS start_right, r.stop AS stop_right, row_number() OVER (PARTITION BY b.uid ORDER BY r.start, r.stop) AS n
 FROM b JOIN r ON b.k = r.k AND ((r.start <= b.start AND r.stop >= b.stop) OR (r.start >= b.start AND r.stop <= b.stop)))
SELECT b.uid, start_right, stop_right FROM b LEFT JOIN m ON b.uid = m.uid AND m.n = 1""")
def interval_within(s, d):
    day = (F.unix_timestamp("o_orderdate") / 86400).cast("long")
    o = table(s, d, "orders")
    left = o.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("k"), day.alias("start"),
        (day + F.col("o_orderkey") % 40).alias("stop"))
    right = o.select(F.col("o_custkey").alias("k"), (day - 5).alias("start"), (day + 15).alias("stop"), F.col("o_orderkey").alias("note"))
    return joins.interval_within(left, right, ["k"], bin_size=30).select("uid", "start_right", "stop_right")


@query("""WITH f AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS len FROM events), g AS (SELECT event_id, user_id,
 CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + len AS stop FROM f), e AS (SELECT user_id, max(stop) +
 10 AS length FROM g GROUP BY 1)
SELECT event_id, coalesce(lead(start) OVER w - stop, length - stop) AS downstream_intergenic, coalesce(start - lag(stop) OVER w,
 start) AS upstream_intergenic FROM g JOIN e USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY start, stop, event_id)""")
def intergenic_gaps(s, d):
    start = F.unix_timestamp("ts")
    f = table(s, d, "events").select("event_id", "user_id", start.alias("start"), (start + F.floor("value")).alias("stop"))
    contigs = f.groupBy("user_id").agg((F.max("stop") + 10).alias("length"))
    return windows.add_intergenic(f, contigs, ["user_id"]).select("event_id", "downstream_intergenic", "upstream_intergenic")


@query("""SELECT o.o_orderkey, c.c_mktsegment, c.c_nationkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_sample_meta(s, d):
    c = table(s, d, "customer").withColumnRenamed("c_custkey", "sample")
    return joins.join_sample_meta(table(s, d, "orders").withColumnRenamed("o_custkey", "sample"), c, "sample",
        ["c_mktsegment", "c_nationkey"]).select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, p.p_brand, s.s_nationkey FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey""")
def with_metadata(s, d):
    kinds = {"sample": (table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "l_orderkey", "o_orderkey"),
        "sequence": (table(s, d, "part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey"),
            "external": (table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey")}
    return joins.with_metadata(table(s, d, "lineitem"), kinds).select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand",
        "s_nationkey")


@query("""SELECT o_orderkey AS sample, l_linenumber AS line, l_quantity AS mic FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus IS NOT NULL""")
def ast_runs(s, d):
    runs = table(s, d, "orders").select(F.col("o_orderkey").alias("BioSample"), F.col("o_orderstatus").alias("Run"))
    ast = table(s, d, "lineitem").select(F.col("l_orderkey").alias("#BioSample"), F.col("l_quantity").alias("MIC (mg/L)"),
        F.col("l_returnflag").alias("Testing standard"), F.col("l_linenumber").alias("line"))
    return joins.join_ast_runs(runs, ast, "R").select(F.col("BioSample").alias("sample"), "line", F.col("MIC").alias("mic"))


@query("""SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def pending_ids(s, d):
    wanted = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")),
        "; ").alias("ids"))
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size")
    return joins.pending_ids(wanted, "ids", p.where("p_size < 10"), p.where("p_size > 40"))


@query("""WITH l AS (SELECT o_custkey AS query, list_sort(list(DISTINCT o_orderpriority)) AS refs FROM orders GROUP BY 1) SELECT array_to_string(refs, ';') AS refs, count(*) AS n, min(query) AS first_query FROM l GROUP BY 1""")
def reference_groups(s, d):
    q = table(s, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("reference"))
    return joins.group_references(q).select(F.array_join("references", ";").alias("refs"), F.size("queries").cast("long").alias("n"),
        F.get("queries", F.lit(0)).alias("first_query"))


_TREE = """SELECT 0 AS tax_id, NULL AS parent, 'root' AS rank UNION ALL SELECT 1 + r_regionkey, 0, 'order' FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 'genus' FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'species' FROM customer"""


def _tree(s, d):
    r = table(s, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("tax_id"), F.lit(0).cast("long").alias("parent_tax_id"),
        F.lit("order").alias("rank"))
    n = table(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long"), (F.col("n_regionkey") + 1).cast("long"), F.lit("genus"))
    c = table(s, d, "customer").select((F.col("c_custkey") + 1000).cast("long"), (F.col("c_nationkey") + 100).cast("long"),
        F.lit("species"))
    root = r.limit(1).select(F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit("root"))
    return r.union(n).union(c).union(root)


@query(f"""WITH RECURSIVE t AS ({_TREE}), a AS (SELECT tax_id, tax_id AS ancestor, 0 AS depth FROM t UNION ALL SELECT a.tax_id, t.parent, depth + 1 FROM a JOIN t ON a.ancestor = t.tax_id WHERE t.parent IS NOT NULL) SELECT CAST(a.tax_id AS BIGINT) AS tax_id, CAST(ancestor AS BIGINT) AS ancestor, CAST(depth AS INTEGER) AS depth, t.rank FROM a JOIN t ON a.ancestor = t.tax_id""")
def ancestors(s, d):
    return joins.ancestors(_tree(s, d)).select("tax_id", "ancestor", "depth", "rank")


@query("""SELECT 1000 + c_custkey AS taxid, CAST(100 + c_nationkey AS BIGINT) AS genus, CAST(1 + n_regionkey AS BIGINT) AS "order" FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def taxid_ranks(s, d):
    ids = table(s, d, "customer").select((F.col("c_custkey") + 1000).alias("taxid"))
    return joins.taxid_to_ranks(ids, _tree(s, d), ranks=("genus", "order"))


@query("""SELECT 1000 + a.c_custkey AS a, 1000 + b.c_custkey AS b, CAST(CASE WHEN a.c_custkey = b.c_custkey THEN 0 WHEN a.c_nationkey = b.c_nationkey THEN 7 WHEN x.n_regionkey = y.n_regionkey THEN 16 END AS INTEGER) AS distance FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation x ON a.c_nationkey = x.n_nationkey JOIN nation y ON b.c_nationkey = y.n_nationkey""")
def taxon_distance(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") + 1000).alias("a"))
    pairs = c.join(c.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a").select("a", "b")
    return joins.taxon_distance(pairs, _tree(s, d)).select("a", "b", "distance")


@query("""SELECT l_suppkey AS sample FROM lineitem GROUP BY 1 HAVING avg(l_discount * 1000) >= 40 AND count(*) FILTER (l_returnflag = 'R') > 5 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity > 49) AND avg(l_quantity) > 20""")
def qc_rules(s, d):
    li = table(s, d, "lineitem")
    quast = aggregate.qc_quast(li.groupBy(F.col("l_suppkey").alias("sample")).agg(F.avg(F.col("l_discount") * 1000).alias("N50"),
        F.count_if(F.col("l_returnflag") == "R").alias("contigs")), [("N50", ">=", 40), ("contigs", ">", 5)])
    ani = aggregate.qc_fastani(li.select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("ANI")),
        {"any": (">", 49), "avg": (">", 20)})
    return sets.passing_all([quast, ani, table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sample"))])


@query("""WITH r AS (SELECT l_orderkey AS sample, l_returnflag AS taxid, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS p FROM lineitem GROUP BY l_orderkey, l_returnflag) SELECT a.sample FROM r a LEFT JOIN (SELECT sample, max(p) AS other FROM r WHERE taxid <> 'N' GROUP BY 1) b USING (sample) WHERE a.taxid = 'N' AND a.p >= 50 AND coalesce(other, 0) <= 30""")
def qc_kraken2(s, d):
    """Orders as samples, return flags as taxa: mostly the expected one, and no other of more than 30 %."""
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("taxid")).agg(
        F.count("*").alias("n"))
    total = n.groupBy("sample").agg(F.sum("n").alias("t"))
    reports = n.join(total, "sample").select("sample", "taxid", F.lit("S").alias("rank"),
        (F.lit(100.0) * F.col("n") / F.col("t")).alias("p_reads_covered"))
    expected = total.select("sample", F.lit("N").alias("taxid"))
    return aggregate.qc_kraken2(reports, expected, 50, 30)


@query("""SELECT doc_id AS id, 1::BIGINT AS n FROM documents WHERE 1 = 0 UNION ALL SELECT min(doc_id), count(*) FROM documents GROUP BY lang, source""")
def dedup(s, d):
    docs = table(s, d, "documents")
    n = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return sets.dedup(docs, ["lang", "source"], ["doc_id"]).select(F.col("doc_id").alias("id"), "lang", "source").join(n,
        (F.col("id").isNotNull()) & docs["lang"].eqNullSafe(n["lang"]) & docs["source"].eqNullSafe(n["source"])).select("id", "n")


@query("""SELECT doc_id AS id, lang, CAST(n_chars AS DOUBLE) AS size, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, 0.5, url FROM pages""")
def diagonal_union(s, d):
    a = table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("size"))
    return sets.union([a, table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit(0.5).alias("size"), "url")])


@query("""WITH g AS (SELECT DISTINCT l_partkey AS id, l_shipmode FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)) SELECT a.l_shipmode AS g1, b.l_shipmode AS g2, count(*) AS n FROM g a JOIN g b ON a.id = b.id AND a.l_shipmode < b.l_shipmode GROUP BY ALL""")
def overlaps(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("g"))
    return sets.overlaps(li, "id", "g")


@query("""SELECT doc_id, n AS text_n FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""")
def duplicate_report(s, d):
    return sets.duplicate_report(table(s, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "text_n")


@query("""SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer""")
def union_ids(s, d):
    return sets.union_ids([table(s, d, "orders"), table(s, d, "customer")], ["o_custkey", "c_custkey"])


@query("""SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS cluster FROM part""")
def cluster_ids(s, d):
    return windows.cluster_ids(table(s, d, "part").select("p_partkey", "p_type"), "p_type")


@query("""SELECT p_type, count(*) AS size, count(DISTINCT p_brand) AS n_p_brand, array_to_string(list_sort(list(DISTINCT p_brand)), '@') AS p_brand FROM part GROUP BY 1""")
def cluster_rollup(s, d):
    return aggregate.cluster_rollup(table(s, d, "part"), "p_type", ["p_brand"]).select("p_type", "size",
        F.col("n_p_brand").cast("long").alias("n_p_brand"), "p_brand")


@query("""SELECT o_orderkey, CAST(ceil(row_number() OVER (ORDER BY o_orderdate, o_orderkey) / 1000.0) AS BIGINT) AS batch FROM orders""")
def batch_number(s, d):
    return windows.batch_number(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def reference_genomes(s, d):
    return windows.reference_genomes(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 3, "o_custkey",
        "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT l_orderkey AS id, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS place FROM lineitem GROUP BY 1""")
def first_group(s, d):
    g = aggregate.first_group(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["R", "A", "N"])
    return g.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A",
        1).otherwise(2).alias("place"))


@query("""SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM customer GROUP BY c_nationkey, c_mktsegment""")
def share_within(s, d):
    n = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"))
    return aggregate.share_within(n, "n", ["nation"])


@query("""SELECT c_custkey, n_name AS new FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def recode_join(s, d):
    recode = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("new"))
    return joins.recode_join(table(s, d, "customer"), recode, ["c_nationkey"]).select("c_custkey", "new")


@query("""SELECT DISTINCT o_custkey AS sample, 'big' AS "group" FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_returnflag = 'R' AND l_partkey % 10 = 3""")
def priority_groups(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ast = li.select(F.col("o_custkey").alias("sample"), F.col("l_partkey").cast("string").alias("drug"),
        F.when(F.col("l_returnflag") == "R", "resistant").otherwise("susceptible").alias("class"))
    classes = li.select(F.col("l_partkey").cast("string").alias("drug"), F.concat(F.lit("class"), (F.col("l_partkey") % 10).cast("string"))
        .alias("drug_class")).distinct()
    taxa = table(s, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("taxon"))
    rules = classes.limit(1).select(F.lit("big").alias("group"), F.lit("BUILDING").alias("taxon"), F.lit("class3").alias("drug"))
    return aggregate.priority_groups(ast, taxa, classes, rules)


@query(f"""WITH r AS (SELECT c_custkey, c_mktsegment, unnest(range(0, 2))::INTEGER AS repeat FROM customer), f AS (SELECT repeat,
 c_mktsegment, CAST((row_number() OVER (PARTITION BY repeat, c_mktsegment ORDER BY {drawn(0, 'fold', 'repeat', 'c_custkey')},
 c_custkey) - 1) % 5 AS INTEGER) AS fold, c_custkey FROM r)
SELECT repeat, fold, c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM f GROUP BY ALL""")
def kfold(s, d):
    return sampling.kfold(table(s, d, "customer"), "c_custkey", 5, 2, stratify="c_mktsegment").groupBy("repeat", "fold",
        "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))


@query(f"""WITH a AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey
 ORDER BY {drawn(0, 'sample', 'c_custkey')}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer),
b AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), p AS (SELECT c_custkey, c_mktsegment,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY {drawn(0, 'place', 'c_custkey')}, c_custkey) - 1 AS i,
 count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
k AS (SELECT DISTINCT c_mktsegment, {drawn(0, 'replace', 'c_mktsegment', 'd')} % n AS i FROM (SELECT DISTINCT c_mktsegment, n,
 unnest(range(1, 101)) AS d FROM p))
SELECT c_custkey FROM a WHERE r <= floor(n * 0.2) UNION SELECT c_custkey FROM b WHERE n <= 50 UNION SELECT c_custkey FROM p
 JOIN k USING (c_mktsegment, i)""")
def subsample_union(s, d):
    rules = [{"by": ["c_mktsegment", "c_nationkey"], "fraction": 0.2}, {"by": ["c_nationkey"], "max_size": 50},
        {"by": ["c_mktsegment"], "n": 100}]
    return sampling.subsample_union(table(s, d, "customer"), rules, "c_custkey").select("c_custkey")


@query(f"""WITH c AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {drawn(0, 'outer', 'o_custkey')},
 o_custkey LIMIT 50)
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
 ORDER BY {drawn(0, 'sample', 'o_orderkey')}, o_orderkey) AS r FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c)) WHERE r <= 5""")
def sample_two_stage(s, d):
    return sampling.sample_two_stage(table(s, d, "orders"), "o_custkey", 50, 5, id="o_orderkey").select("o_custkey", "o_orderkey")


@query(f"""WITH g AS (SELECT t, row_number() OVER (ORDER BY {drawn(0, 'goal', 't')}, t) - 1 AS i FROM (SELECT DISTINCT c_mktsegment AS t
 FROM customer WHERE c_mktsegment IS NOT NULL)), v AS (SELECT c, {drawn(0, 'control', 'c')} AS h,
 row_number() OVER (ORDER BY {drawn(0, 'control', 'c')}, c) - 1 AS k FROM (SELECT DISTINCT c_nationkey AS c FROM customer
 WHERE c_nationkey IS NOT NULL)), n AS (SELECT count(*) AS n FROM g)
SELECT c_custkey, t AS control_target FROM customer LEFT JOIN (SELECT c, CASE WHEN k < n THEN k ELSE h % n END AS i FROM v,
 n) ON c_nationkey = c LEFT JOIN g USING (i)""")
def control_task(s, d):
    return sampling.control_task(table(s, d, "customer"), "c_mktsegment", "c_nationkey").select("c_custkey", "control_target")


@query(f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT label, row_number() OVER (ORDER BY {drawn(0, 'permute', 'vec_id')}, vec_id) AS i FROM embeddings) SELECT vec_id, label FROM a JOIN b USING (i)""")
def permuted_labels(s, d):
    return sampling.permute(table(s, d, "embeddings").select("vec_id", "label"), "vec_id", ["label"])
