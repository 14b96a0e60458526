from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lociframe.llm import merkle as M

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict, text: str | None) -> str:
    vals = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])


def climb(level: list[str]) -> tuple[str, list[list[str]]]:
    """The root, and each node's siblings level by level."""
    paths, owners = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        up, held = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            up.append(h(*run))
            held.append(sum(owners[at : at + 3], []))
        level, owners = up, held
    return level[0], paths


def folded(digest: str, path: list) -> str:
    for k, others in path:
        digest = h(*others[:k], digest, *others[k:])
    return digest


def brute(rows: list[dict]) -> list[tuple]:
    def changed(r):
        odd = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2 or r["text"] is None
        return r["text"] if odd else r["text"].replace("\n", "")

    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((ranked, *climb([leaf(r, r["text"]) for r in ranked])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (ranked, sub, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(ranked, paths, strict=True):
            whole = path + top
            now = folded(leaf(r, changed(r)), whole)
            out.append((r["doc_id"], leaf(r, r["text"]), sub, root, h(*[x for _, o in whole for x in o]), now, now == root))
    return sorted(out, key=repr)


def rows_of(sizes: dict) -> list[dict]:
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            text = [None, "", "one\ntwo", "plain é", "\n\n", "x" * 3000][i % 6]
            out.append({"doc_id": (i * 7) % 1000, "text": text, "lang": [None, "de"][i % 2], "source": s, "n_chars": None if i % 5 == 0
                else i})
            i += 1
    return out


def query(docs, levels):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return sorted((tuple(r) for r in M.manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")),
        levels).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, M.LEVELS])
def test_same_as_whole_trees(spark, levels):
    rows = rows_of({"a": 100, "B": 1, "": 27, None: 10, "ä": 3, "z": 4, "zz": 28, "y": 9, "x": 2})
    rows += [{"doc_id": None, "text": "no\nid", "lang": "de", "source": "a", "n_chars": 1}] * 2
    rows += [dict(rows[2]), dict(rows[2]), {**rows[3], "text": "another of its id"}]
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], FIELDS)
    clash = docs.withColumns({c: F.lit(5) for c in ("key", "pos", "n", "p", "i", "block", "witness", "root", "up", "digest")})
    got = query(clash.repartition(5), levels)
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


def test_one_leaf_and_none(spark):
    rows = rows_of({"only": 1})
    docs = spark.createDataFrame([tuple(rows[0][c] for c in ("doc_id", "text", "lang", "source", "n_chars"))], FIELDS)
    assert query(docs, 6) == brute(rows)
    assert query(docs.limit(0), 6) == []


def test_long_text_and_unaltered(spark):
    docs = spark.createDataFrame([(1, "ab\n" * 700_000, "en", "s", 3), (2, "x", "en", "s", 1)], FIELDS)
    got = {r["doc_id"]: r for r in M.manifest(docs).collect()}
    assert all(r["verified"] for r in got.values())
    assert got[1]["leaf"] == h("1:1", "1:s", "2:en", "1:3", "2100000:", "ab\n" * 700_000)


@pytest.mark.parametrize("n", range(1, 32))
def test_appends_give_the_same_witnesses(n):
    leaves = [h(str(i)) for i in range(n)]
    tree = M.Subtree(4)
    for x in leaves:
        tree.append(x)
    root, paths = climb(leaves)
    assert tree.root(True) == root
    assert tree.witness == [[x for _, o in p for x in o] for p in paths]
    assert all(M.fold(x, [(i, n)], "".join(w)) == root for i, (x, w) in enumerate(zip(leaves, tree.witness, strict=True)))
