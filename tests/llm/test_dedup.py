from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lociframe.llm import embedding_dedup as E
from lociframe.llm import simhash as S
from lociframe.llm import suffix_dedup as D
from lociframe.llm.common import components


def groups(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(1100, edges)
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = [f"Wörd{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(12)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base]
    return [*base, *near, base[0], base[0].upper(), None, "", " \t\n", "one two", "one  two", "One Two Three", "x" * 100_000, *base[:3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "s") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component string")


def test_simhash_against_brute_force(spark, docs, texts):
    f = [fingerprint(t) for t in texts]
    want = groups(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (f"{f[i]:016x}", want[i]) for i in range(len(f))}
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert S.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.where("doc_id < 2").unionByName(docs.where("doc_id < 2"))
    assert S.near_duplicates(twice).count() == 4 and S.one_of_each(twice).count() == len({want[0], want[1]})


def test_crowds_are_linked_alike(spark):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 1 << 63, 3)
    fps = {int(c) for c in center} | {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in center for a, b in rng.integers(0, 63, (40, 2))} | {
        int(x) for x in rng.integers(0, 1 << 63, 50)}
    df = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    order = sorted(fps)
    want = groups(len(order), [(i, j) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= 2])

    def of(crowd: int) -> list[int]:
        found = {r["node"]: r["component"] for r in components(S.links(df, crowd=crowd)).collect()}
        return [found.get(x, x) for x in order]

    parts = lambda c: sorted(map(sorted, (np.flatnonzero(np.array(c) == v).tolist() for v in set(c))))
    assert parts(of(512)) == parts(of(1)) == parts(want)


def test_pivots_only_discard_far_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = np.r_[fps, fps[:20] ^ np.uint64(5)]
    a, b = S.close_pairs(fps, S.pivot_table(fps, rng.integers(0, 1 << 63, 16).astype(np.uint64)), 2)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i in range(80) for j in range(i + 1, 80)
        if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = base[:30] + rng.normal(size=(30, 16)) * 0.05
    close = base[0] + rng.normal(size=(25, 16)) * 0.08
    x = [*base, *near, *close, base[1], base[1] * 2.5]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, [float(v) for v in r], "l") for i, r in enumerate(x)] + [(1000 + i, r, "l") for i, r in enumerate(bad)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
        for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    want = groups(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)])
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(len(bad)))
    found, all_links = sum(got[i][0] for i in range(len(x))), int(hit.sum()) - len(x)
    assert 0.97 * all_links <= found <= all_links
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) > 0.95
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_calibration():
    for n in (100, 50_000, 10**8):
        lines, tables, count = E.calibrate(n, 0.95)
        assert lines >= 4 and 2 <= tables < 200 and E.reaches(count) >= E.KEEP > E.reaches(count + 1)
        assert (1 - E.same_cell(0.95) ** lines * E.reaches(count)) ** tables <= E.MISS


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, 2) for i, v in rows],
        "vec_id long, embedding array<double>, ball int, w int")


def results(df) -> dict:
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_vectors_of_other_lengths_cost_only_their_own_links(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=24)
    rows = [(0, [1.0]), (None, [2.0, 1.0])] + [(i, base + rng.normal(size=24) * 0.01) for i in range(1, 6)] + [(6, [1.0, 2.0]),
        (7, [1.0, 2.01]), (8, [3.0]), (9, [1e300] * 3), (10, [1e299] * 3), (11, [])]
    got = results(E.near_duplicates(vectors(spark, rows)))
    assert all(got[i] == (4, 1, i == 1) for i in range(1, 6))
    assert got[0] == (1, 0, True) and got[8] == (1, 0, False) and got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert got[9] == (1, 9, True) and got[10] == (1, 9, False) and got[11] == (0, 11, True) and got[None] == (0, None, False)


def test_recall_of_links_at_the_limit(spark, monkeypatch):
    """Links of the vectors whose id is divisible by 20, planted just over the limit, against all rows."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(1500, 32))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.95, 0.956, 1500)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    order = rng.permutation(len(x))
    x = x[order]
    for split in (E.SPLIT, 8):
        monkeypatch.setattr(E, "SPLIT", split)
        got = results(E.near_duplicates(vectors(spark, enumerate(x))))
        hit = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T >= 0.95
        queries = np.arange(0, len(x), 20)
        want = hit[queries].sum(1) - 1
        found = np.array([got[int(q)][0] for q in queries])
        assert want.sum() > 100 and (found <= want).all() and found.sum() >= 0.97 * want.sum()


def test_a_large_group_makes_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(8)
    center = rng.normal(size=32)
    x = np.concatenate([center + rng.normal(size=(300, 32)) * 0.1, rng.normal(size=(200, 32))])
    made = []
    whole = E.stage

    def seen(df, name="stage"):
        out = whole(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(E, "stage", seen)
    got = results(E.near_duplicates(vectors(spark, enumerate(x))))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    want = groups(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)])
    assert hit[:300, :300].mean() > 0.9 and [got[i][0] for i in range(300)] == (hit[:300].sum(1) - 1).tolist()
    assert [got[i][1] for i in range(len(x))] == want
    sizes = dict(made)
    assert sizes["pairs"] < 300 * 300 / 20 and sizes["links"] < 300 * 300 / 10


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        on = np.cumsum(cover[:-1]) > 0
        out.append((len(b), int(on.sum()), int((np.diff(np.r_[0, on.astype(int)]) == 1).sum()),
            hashlib.sha256(np.frombuffer(b, np.uint8)[~on].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [2, 4, 26])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(97, 97 + letters, 1500).astype(np.uint8)
    text[700:1000] = text[100:400]
    text[1200:1450] = 97
    order = D.suffix_order(text, 50)
    raw = text.tobytes()
    keys = [raw[i : i + 50] for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(5)
    make = lambda n: "".join(rng.choice(list("abcdé "), n))
    p, q = make(260), make(900)
    texts = [make(500) + p + make(300), p + make(100), make(50) + q + make(50), q, q, q[:450] + "X" + q[450:], None, "", "a" * 700,
        "ab" * 400, make(199), p[:199], p[:200], make(3000) + q[100:700] + make(10), q]
    rows = [(i, t, "t") for i, t in enumerate(texts)] + [(3, q, "t"), (None, p, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    want = sorted((str(r[0]), *w) for r, w in zip(rows, brute([r[1] for r in rows], 200), strict=True))
    for kw in ({}, {"crowd": 1}, {"sent_pieces": 0}):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
            for r in D.without_repeats(df, **kw).collect())
        assert got == want
    assert D.without_repeats(df.limit(0)).count() == 0


def test_a_common_passage_is_not_sorted_in_one_place():
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    make = lambda n: "".join(rng.choice(letters, n))
    passage = make(150)
    texts = [make(300) + passage + make(300) for _ in range(100)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    h, p, owner = [], [], []
    for i, data in enumerate(raw):
        found = D.pieces_of(data, np.array([0, len(data)]))
        h, p, owner = [*h, *found[4]], [*p, *found[5]], [*owner, *[i] * len(found[4])]
    assert Counter(h).most_common(1)[0][1] > 50  # one anchor has a piece of most texts
    key = D.piece_key(np.array(h), np.array(p))
    order = np.argsort(key)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "th": list(range(100)), "tb": list(range(100)), "text": texts})
    yes = np.ones(len(key), bool)
    rows = [r for out in D.extract_rows([batch], key[order], np.array(owner)[order], yes, yes) for r in out.to_pylist()]
    assert len(rows) == sum(len(t) - 199 for t in texts)  # every window is dealt
    assert Counter((r["h"], r["far"], r["bytes"]) for r in rows).most_common(1)[0][1] == 1


def test_long_periodic_texts_and_a_passage_in_many_contexts(spark):
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    make = lambda n: "".join(rng.choice(letters, n))
    passage = make(230)
    rows = [(i, make(40) + passage + make(40)) for i in range(300)] + [(1000, "xyz " * 100_000), (1001, make(400)), (1002, "q" * 300_000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"])
        for r in D.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (310, 230, 1) or got[i][1] > 230 for i in range(300))
    assert got[1000] == (400_000, 400_000, 1) and got[1001] == (400, 0, 0) and got[1002] == (300_000, 300_000, 1)


def test_windows_of_common_digests_leave_as_ranges(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    make = lambda n: "".join(rng.choice(letters, n))
    passage, other = make(230), make(260)
    rows = [(i, make(60) + passage + make(60)) for i in range(40)] + [(50 + i, make(60) + other + make(60)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    for most in (0, 40, D.SENT_DIGESTS):  # none, some and all of the common digests are sent
        assert sorted(tuple(r) for r in D.without_repeats(df, crowd=1, sent_digests=most).collect()) == want
    n = 40
    cols = {"h": [7] * n, "far": list(range(n)), "bytes": [bytes([i]) * D.DIGEST for i in range(n)], "th": [1] * n, "tb": [2] * n}
    batch = pa.RecordBatch.from_pydict(cols | {"at": list(range(100, 100 + n))}, schema=pa.schema([("h", pa.int64()), ("far", pa.int32()),
        ("bytes", pa.binary()), ("th", pa.int64()), ("tb", pa.int64()), ("at", pa.int64())]))
    keys = np.sort(D.window_keys(np.full(n, 7), np.arange(n), cols["bytes"])[[*range(10), *range(20, 35)]])
    assert [tuple(r.values()) for out in D.common_ranges([batch], keys) for r in out.to_pylist()] == [(1, 2, 100, 109), (1, 2, 120, 134)]
    assert [r["far"] for out in D.other_windows([batch], keys) for r in out.to_pylist()] == [*range(10, 20), *range(35, 40)]


def test_queries_of_copies_on_a_written_table(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    vectors(spark, [(i, [1.0, i % 3]) for i in range(9)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = S.op1_simhash(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert {r["doc_id"]: r["fingerprint"] for r in found.collect()} == {i: f"{fingerprint(t):016x}" for i, t in enumerate(texts)}
    found = E.op6_embedding_dedup(spark, str(tmp_path))
    assert found.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert results(found)[8] == (2, 2, False) and results(found)[0] == (2, 0, True)
    found = D.op10_suffix_dedup(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"),
        ("kept_sha256", "string")]
    want = {i: b for i, b in enumerate(brute(texts, 200))}
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == want
