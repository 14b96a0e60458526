from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.llm import collocations as C


def brute(rows: list[tuple], least: int, top: int = C.TOP, cover: int = C.COVER) -> list[tuple]:
    f: dict = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            for m in range(1, 5):
                f.setdefault("und" if lang is None else lang, Counter()).update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        n, best = sum(v for p, v in c.items() if len(p) == 1), []
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            around = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= cover * a for b in around):
                continue
            score, _, le, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), le, r, n))
        for i, (s, a, p, le, r, n) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, le, r, n, -s))
    return sorted(out)


def texts(seed: int, docs: int) -> list[tuple]:
    rnd = random.Random(seed)
    vocab = ["New", "york", "city", "hall", "é", "The", "of", "x1", "ßa", "a-b"]
    out = []
    for _ in range(docs):
        ws = []
        for _ in range(rnd.randrange(0, 60)):
            ws += rnd.choice([["new", "york", "City"], ["THE", "city", "hall", "of"], [rnd.choice(vocab)],
                [rnd.choice(vocab) + rnd.choice(".,;:!?\n\r\x0b\x0c")], ["\t", ""]])
        out.append((rnd.choice(["en", "de", None, "und", ""]), " ".join(ws)))
    return out


@pytest.mark.parametrize(("least", "split", "top"), [(2, 16, 2000), (3, 1, 5), (5, 2000, 2000)])
def test_same_as_counting_all(spark, least, split, top):
    rows = texts(least, 150) + [(None, None), ("en", ""), ("en", " \t "), ("en", "..,"),
        ("fr", "one")] + [("en", "new york city hall of the new york city")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    clash = docs.withColumns({c: F.lit("q") for c in ("word", "n", "words", "a", "grp", "c1")}).repartition(6)
    got = sorted(tuple(r) for r in C.collocations(clash, least, top, split=split).collect())
    assert got == brute(rows, least, top)


def test_split_prefixes_are_dealt_apart(spark):
    """With a small budget one pair's suffixes lie in many groups, and its node still has its whole count."""
    rows = [("en", f"hot pair w{i % 300} v{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    words, phrases = C.phrase_counts(docs, least=5, split=100)
    got = {tuple(r["words"]): r["a"] for r in phrases.collect()}
    assert got[("hot", "pair")] == 3000 and got[("hot", "pair", "w1")] == 10
    assert {r["word"]: r["n"] for r in words.collect()}["hot"] == 3000


def test_hashes_that_clash_are_told(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 1), ("de", "a", 1), ("en", "b", 1)], "lang string, word string, n long")
    seed, code = C._seed(words)
    import xxhash

    got = {r["word"]: r["c"] & ((1 << 64) - 1) for r in words.select("word", code.alias("c")).collect()}
    assert got == {w: xxhash.xxh64_intdigest(w.encode(), seed) for w in ("a", "b")}
    monkeypatch.setattr(C.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    with pytest.raises(RuntimeError):
        C._seed(words)


def test_none_and_long(spark):
    docs = spark.createDataFrame([("en", "a b " * 400_000)], "lang string, text string")
    assert C.collocations(docs.limit(0)).collect() == []
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in C.collocations(docs, cover=101).collect()}
    assert got["a b"] == (400_000, 400_000, 400_000, 1_000_000) and got["b a b a"][0] == 399_998


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    q = spark.createDataFrame([(8_000_000_000_000_000_000, 8_000_000_000_000_000_001, 9_000_000_000_000_000_000)], "a long, l long, r long")
    e = "(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    a, le, r = q.first()
    assert q.select(F.expr(e)).first()[0] == 2_000_000 * a // (le + r)
