from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from lociframe.llm.wordids import default_tokenizer

from .test_dedup import groups
from .test_models import base


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = {"en": [f"the{i}" for i in range(400)], "fr": [f"été{i}" for i in range(400)]}
    item = " ".join(rng.choice(words["en"], 40))
    rows = [(i, " ".join(rng.choice(words["en" if i % 2 else "fr"], 60)), "en" if i % 2 else "fr") for i in range(80)]
    rows += [(100, rows[3][1], "en"), (101, rows[5][1] + " " + item, "en"), (102, rows[7][1] + ' token = "0123456789abcdef0123"', "en"),
        (103, None, None), (104, "12 345", None)]
    rows += [(105, " ".join(rng.choice(words["en"], 60)) + ' token = "0123456789abcdef0123"', "en"),
        (106, rows[9][1][: len(rows[9][1]) // 2], "en")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, t, la in rows],
        "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", rows, item


def runs(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_against_brute_force(spark, folder):
    path, rows, item = folder
    kept = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    sets = [runs(t) for _, t in kept]
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    root = groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    kept = [r for k, r in enumerate(kept) if root[k] == k and item not in r[1]]
    assert not {100, 101, 102} & {i for i, _ in kept} and {105, 106} <= {i for i, _ in kept}
    lib = Tokenizer.from_file(default_tokenizer())
    want = {}
    for i, t in kept:
        for s, _, e in reversed(base(t)):
            t = t[:s] + "\0" * (e - s) + t[e:]
        want[i] = len(lib.encode(re.sub("\0+", "[SECRET]", t), add_special_tokens=False).ids) + 1
    got: dict = {}
    for r in corpus_pipeline.run(spark, path).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == want[r["doc_id"]]
    assert got == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and stage(spark, docs.limit(0), folder[0]).count() == 0
