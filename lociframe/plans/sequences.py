"""Queries of sequence operators, over document texts as sequences."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregate, sequences, store
from ..scratch import scratch_path
from .registry import drawn, drawn_unit, long_vector, registry, rounded, table

def letter_embedder(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """A stand-in for a model that SQL can follow: a token a letter, (place in the alphabet, place in the text, 1)."""
    out = []
    for t in texts:
        codes, at = np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32), return_inverse=True)
        x = np.ones((len(t), 3), np.float32)
        x[:, 0] = np.array([max(0, ord(chr(c).lower()) - 97) % 26 for c in codes.tolist()], np.float32)[at]
        x[:, 1] = np.arange(len(t))
        out.append((x, np.full(len(x), 1.0, np.float32)))
    return out


QUERIES, ORACLE_SQL, query = registry()

_DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_dna = lambda: F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz",
    "ACGTACGTACGTACGTACGTACGTAC")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS seqindex, CAST(greatest(i * 500 - 20, 0) AS INTEGER) AS start, CAST(least(i * 500 + 530, length(text)) AS INTEGER) AS stop, md5(substr(text, CAST(greatest(i * 500 - 20, 0) AS BIGINT) + 1, CAST(least(i * 500 + 530, length(text)) - greatest(i * 500 - 20, 0) AS BIGINT))) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) // 500 AS BIGINT))) AS i FROM documents)""")
def bin_split(s, d):
    b = sequences.bin_split(table(s, d, "documents").select("doc_id", "text"), "text", 500, 20, 30)
    return b.select("doc_id", "seqindex", "start", "stop", F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query("""SELECT doc_id AS id, CAST(i AS INTEGER) AS subseq_no, CASE WHEN length(text) > 0 THEN md5(substr(text, i * 700 + 1, 700)) END AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 700.0) AS BIGINT)))) AS i FROM documents)""")
def expand_max_len(s, d):
    return sequences.expand_max_len(table(s, d, "documents"), "text", "doc_id", 700).select("id", "subseq_no",
        F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), c AS (SELECT o_orderkey, n, unnest(range(0,
 n, 50000)) AS s FROM o WHERE n > 0)
SELECT o_orderkey, s + 7 AS chunk_start, least(s + 50000, n) + 7 AS chunk_stop, CAST(s // 50000 AS INTEGER) AS chunk, s = 0 AS is_5prime,
 s + 50000 >= n AS is_3prime FROM c""")
def split_features(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.lit(7).cast("long").alias("start"), (F.floor("o_totalprice") + 7).alias("stop"))
    return sequences.split_features(o, 50_000).select("o_orderkey", "chunk_start", "chunk_stop", "chunk", "is_5prime", "is_3prime")


@query(f"""WITH s AS (SELECT source, {_DNA} AS q FROM documents), k AS (SELECT source, substr(q, i, 6) AS kmer FROM (SELECT source, q,
 unnest(range(1, length(q) - 4)) AS i FROM s WHERE length(q) >= 6)), c AS (SELECT source, least(kmer, reverse(translate(kmer, 'ACGT',
 'TGCA'))) AS kmer FROM k)
SELECT source, kmer, least(count(*), 255) AS n FROM c GROUP BY ALL HAVING count(*) >= 2""")
def kmer_counts(s, d):
    return aggregate.kmer_counts(table(s, d, "documents").select("source", _dna().alias("q")), "source", "q", 6)


@query(f"""WITH s AS (SELECT source, {_DNA} AS q FROM documents), k AS (SELECT source, substr(q, i, 6) AS kmer FROM (SELECT source, q,
 unnest(range(1, length(q) - 4)) AS i FROM s WHERE length(q) >= 6)), c AS (SELECT source, least(kmer, reverse(translate(kmer, 'ACGT',
 'TGCA'))) AS kmer, count(*) AS n FROM k GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_distinct, count(*) FILTER (n >= 2) AS kept, max(n) AS max_count FROM c
 GROUP BY source""")
def kmer_stats(s, d):
    return aggregate.kmer_stats(table(s, d, "documents").select("source", _dna().alias("q")), "source", "q", 6)


@query("""WITH p AS (SELECT a.item_id AS a, b.item_id AS b, list_distinct(list_transform(range(1, length(a.text) - 3),
 lambda i: substr(a.text, i, 5))) AS x, list_distinct(list_transform(range(1, length(b.text) - 3), lambda i: substr(b.text, i, 5))) AS y
 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE length(a.text) >= 5 AND length(b.text) >= 5)
SELECT a, b, round((len(list_distinct(list_concat(x, y))) - len(list_intersect(x, y))) / len(list_distinct(list_concat(x, y))),
 6) AS distance FROM p""")
def kmer_distance(s, d):
    b = table(s, d, "benchmark").where("length(text) >= 5")
    p = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select((F.col("item_id") - 1).alias("a"),
        F.col("item_id").alias("b"), F.col("text").alias("y")), "a")
    return rounded(p.select("a", "b", C.kmer_distance("x", "y").alias("distance")), "distance")


@query(f"""WITH t AS (SELECT doc_id, {_DNA} AS q FROM documents)
SELECT doc_id, length(q) // 3 AS n, md5(translate(q, 'ACGT', 'TGCA')) AS complement,
 md5(coalesce(array_to_string(list_transform(regexp_extract_all(q, '.{{3}}'), lambda c: substr('{C.CODE_RESIDUES}',
 CAST(16 * strpos('{C.CODE_BASES}', substr(c, 1, 1)) + 4 * strpos('{C.CODE_BASES}', substr(c, 2, 1)) + strpos('{C.CODE_BASES}', substr(c, 3,
 1)) - 20 AS BIGINT), 1)), ''), '')) AS protein FROM t""")
def protein_lengths(s, d):
    q = table(s, d, "documents").select("doc_id", _dna().alias("q"))
    digest = lambda c: F.md5(c.cast("binary"))
    protein = C.translate_dna("q")
    return q.select("doc_id", F.length(protein).cast("long").alias("n"), digest(F.reverse(C.reverse_complement("q"))).alias("complement"),
        digest(protein).alias("protein"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS c FROM (SELECT doc_id, string_split(text, '') AS x FROM documents WHERE length(text) > 0)) SELECT doc_id, md5(string_agg(c, '' ORDER BY {drawn(0, 'permute', 'doc_id', 'i')}, i)) AS digest FROM l GROUP BY 1""")
def permute_letters(s, d):
    p = sequences.permute_seq(table(s, d, "documents").where("length(text) > 0").select("doc_id", "text"), "doc_id", "text")
    return p.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, i, string_split(substr(text, i + 1, 2000), '') AS c FROM (SELECT doc_id, text, unnest(range(0,
 length(text), 2000)) AS i FROM documents WHERE length(text) > 0)),
m AS (SELECT doc_id, CAST(CAST(list_avg(list_transform(c, lambda x: greatest(unicode(lower(x)) - 97,
 0) % 26)) AS FLOAT) AS DOUBLE) AS letter, (len(c) - 1) / 2 AS place FROM p), g AS (SELECT doc_id AS id, avg(letter) AS a, avg(place) AS b
 FROM m GROUP BY 1)
SELECT id, 0 AS pos, round(a, 4) AS value FROM g UNION ALL SELECT id, 1, round(b, 4) FROM g UNION ALL SELECT id, 2, 1.0::DOUBLE FROM g""")
def embed_store(s, d):
    docs = table(s, d, "documents").where("length(text) > 0")
    path = scratch_path(s, f"store-{uuid.uuid4().hex}")
    pooled = store.embed_long(docs, "text", "doc_id", path, letter_embedder, 2000)
    return long_vector(pooled, "id", places=4)


@query(f"""WITH s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark), l AS (SELECT item_id,
 generate_subscripts(x, 1) - 1 AS i, unnest(x) AS c FROM (SELECT item_id, string_split(seq, '') AS x FROM s WHERE length(seq) > 0))
SELECT item_id, seq, 'natural' AS variation, 'none' AS method FROM s UNION ALL SELECT s.item_id, coalesce(string_agg(c, ''
 ORDER BY {drawn(0, 'permute', 's.item_id', 'i')}, i), ''), 'perturbed', 'permute' FROM s LEFT JOIN l USING (item_id) GROUP BY s.item_id
UNION ALL SELECT s.item_id, coalesce(string_agg(CASE WHEN i IS NOT NULL THEN substr('ACDEFGHIKLMNPQRSTVWY',
 CAST(floor({drawn_unit(0, 'letter', 's.item_id', 'i')} * 20) AS BIGINT) + 1, 1) END, '' ORDER BY i), ''), 'random', 'random' FROM s LEFT
 JOIN l USING (item_id) GROUP BY s.item_id""")
def variants(s, d):
    q = table(s, d, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return store.variants(q, "item_id", "seq",
        [{"method": "permute"}, {"method": "random", "variation": "random", "alphabet": "ACDEFGHIKLMNPQRSTVWY"}])


@query("""SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(q, '.{3}')) AS codon FROM (SELECT """ + _DNA
    + """ AS q FROM documents)) GROUP BY 1""")
def codon_usage(s, d):
    return sequences.codon_usage(table(s, d, "documents").select(_dna().alias("q")), "q").select("codon", "n")
