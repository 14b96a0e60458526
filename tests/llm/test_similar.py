from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest

from lociframe.llm import similar as M

from .test_dedup import groups


def runs(text):
    w = (text or "").encode().lower().split()  # ASCII letters, as op1_simhash does
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def close(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(texts):
    sets = [runs(t) for t in texts]
    root = groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if close(sets[i], sets[j])])
    return {i for i, r in enumerate(root) if i == r}


def edited(rng, text, n):
    w = text.split()
    for k in rng.choice(len(w) // 6, n, replace=False) * 6 + 5:
        w[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = [f"Wörd{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    near = [edited(rng, b, n) for b in base for n in (1, 2, 3, 4, 6)]
    crowd = [edited(rng, base[0], int(n)) for n in rng.integers(1, 6, 120)]
    return [*base, *near, *crowd, base[1].upper(), base[1], None, "", " ", "one two", "One  two", "one two three four"]


@pytest.mark.parametrize("crowd", [4, 64])
def test_similar_against_brute_force(spark, texts, crowd):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = M.one_of_each(docs, crowd=crowd)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == kept(texts)
    assert M.one_of_each(docs.limit(0)).count() == 0


def test_the_stage_drops_near_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts[:120])), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == kept(texts[:120])


def test_repeated_and_null_ids(spark, texts):
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0])]
    got = M.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2])])


def test_many_repeated_rows(spark, texts):
    """Rows that are equal in id and text meet their near copies once."""
    rows = [(1, texts[0])] * 300 + [(2, texts[20])] * 300 + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in M.one_of_each(docs).collect()) == [1, 3]
    among = docs.select("doc_id", M.text_key(docs["text"]).alias("th")).where("doc_id > 1").select("doc_id",
        "th").withColumnRenamed("doc_id", "id").distinct()
    assert sorted(r["doc_id"] for r in M.one_of_each(docs, among=among).collect()) == [2, 3]


def template(rng, n, common, own):
    words = [f"t{i}" for i in range(common)]
    return [" ".join(words + [f"o{rng.integers(1 << 40)}" for _ in range(own)]) for _ in range(n)]


def test_texts_of_one_template_are_not_all_paired(spark):
    """Texts of 200 common and 40 own words have a similarity of 0.69: candidates grow with the texts, not with their pairs."""
    rng = np.random.default_rng(6)
    texts = template(rng, 1200, 200, 40)
    sets = M.run_sets(*block(texts), 5)
    rows = [(i, x.tobytes(), i) for i, x in enumerate(sets)]
    assert M.across_components(spark.createDataFrame(rows, "c long, runs binary, comp long").repartition(4)).count() < len(texts)
    near = texts[:300] + [edited(rng, t, 2) for t in texts[:5]]
    out = M.one_of_each(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == kept(near)


def block(texts):
    raw = [t.encode() for t in texts]
    return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def test_prefixes_lose_no_pair(spark):
    """All similar pairs of sets of many sizes, some a run over the limit or just under it."""
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64) for n in (1, 2, 4, 5, 9, 10, 40, 100, 237)]
    sets = []
    for b in base:
        for _ in range(12):
            cut = rng.choice(b, max(1, int(len(b) * rng.uniform(0.78, 1))), replace=False)
            more = rng.integers(0, 1 << 62, int(len(b) * rng.uniform(0, 0.15))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([cut, more])))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    rows = [(i, x.tobytes(), i) for i, x in enumerate(sets)]
    got = {(r["a"], r["b"]) for r in M.across_components(spark.createDataFrame(rows, "c long, runs binary, comp long")).collect()}
    assert len(want) > 100 and want <= got
