from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import packing as P
from lociframe.llm import token_output as T
from lociframe.llm.wordids import default_tokenizer, encoder

ODD = ["a<|endoftext|>B  it's We'll,.. 'S x's,", "é́, «é», É… ﬁ İstanbul ΑΣ ΣΑΣ. a", "1,234.56 a1b2 x_y", "", " ",
    "<|STARTOFTEXT|> <|startoftext|>", "日本語 テスト。", "a\x1cb\x85c", "w" * 5000, "the cat " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(ODD)] + [(1, None, "x"), (None, "no id", "x"), (3, ODD[1], "x")],
        "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_tokenizer())
    return lambda t: lib.encode(t or "", add_special_tokens=False).ids


def test_words_are_what_the_library_gives(library):
    enc = encoder(default_tokenizer())
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(pa.array([*ODD, None]), 2).to_pylist()] == [library(t) + [2]
        for t in [*ODD, ""]]
    assert len(enc(pa.array([], pa.string()), 2)) == 0


def test_whole_texts_for_other_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = encoder(path)
    assert not enc.by_word
    lib = Tokenizer.from_file(path)
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc(pa.array(ODD[:4]), 5).to_pylist()]
    assert got == [lib.encode(t, add_special_tokens=False).ids + [5] for t in ODD[:4]]


def test_words_forgotten_by_a_full_cache(library, monkeypatch):
    from lociframe.llm import wordids

    monkeypatch.setattr(wordids, "CACHE_WORDS", 3)
    enc = wordids.WordIds(default_tokenizer())
    for some in (["a b c d e", "b f g"], ["h i a", "c j k l"], ["a b", "m n o"]):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(pa.array(some), 2).to_pylist()] == [library(t) + [2] for t in some]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=700), st.integers(9, 20))
def test_codes_round_trip(ids, limit):
    ids = np.array(ids + [7] * 300 + [8] * 90, np.int64)
    lengths = T.code_lengths(np.bincount(ids, minlength=300) ** 3, limit)
    assert lengths.max() <= limit and (0.5 ** lengths[lengths > 0]).sum() <= 1
    codes = T.canonical(lengths)
    payload, marks = T.pack_bits(ids, lengths, codes, 16)
    assert (T.unpack_bits(payload, marks, len(ids), T.decode_table(lengths, codes, limit), 16, limit) == ids).all()


def test_one_id_and_none():
    assert T.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and T.code_lengths(np.zeros(3)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(5), 2)


def test_written_ids_come_back(spark, docs, library, tmp_path):
    T.write_tokens(docs, f"file://{tmp_path}/t")
    got = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist())
        for r in T.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    want = sorted(((r["doc_id"], library(r["text"]) + [2]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted(map(str, (g[3] for g in got))) == sorted(map(str, (w[1] for w in want)))
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_digest_and_empty_table(spark, docs, library, tmp_path):
    T.write_tokens(docs.where("doc_id = 6"), f"file://{tmp_path}/a")
    r = T.read_tokens(spark, f"file://{tmp_path}/a", digest=True).first()
    assert r["ids_crc32"] == zlib.crc32(np.array(library(ODD[2]) + [2], "<u4").tobytes())
    T.write_tokens(docs.limit(0), f"file://{tmp_path}/b")
    assert T.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([16, 64]))
def test_groups_pack_without_loss(lengths, capacity):
    seqs = P.pack_group(lengths, capacity)
    held = [0] * len(lengths)
    spans: dict[int, list] = {}
    for s in seqs:
        total = sum(n for _, _, n in s)
        assert total == capacity or total & (total - 1) == 0 and total < capacity
        for d, b, n in s:
            held[d] += n
            spans.setdefault(d, []).append((b, n))
    assert held == lengths
    for d, x in spans.items():
        at = 0
        for b, n in sorted(x):
            assert b == at
            at += n
        assert at == lengths[d]


def test_first_fit_decreasing():
    assert P.first_fit_decreasing([5, 7, 5, 2, 4, 2, 5], 10) == [[1, 3], [0, 2], [6, 4], [5]]


def test_pieces_hold_all_ids(docs, library):
    got = P.pack(docs, capacity=64, group_docs=4).collect()
    ids: dict = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(library(r["text"]) + [1])
    for r in got:
        if r["doc_id"] in ids and len(ids[r["doc_id"]]) == 1:
            x = ids[r["doc_id"]][0]
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4")
                .tobytes())
    seqs: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert sum(seqs.values()) == sum(len(x) for v in ids.values() for x in v)
    assert P.pack(docs.limit(0)).count() == 0


def test_packing_does_not_depend_on_partitioning(spark, docs):
    more = docs.unionByName(docs.selectExpr("doc_id + 100 AS doc_id", "text", "ids"))
    first = P.pack(more.repartition(1), capacity=64, group_docs=4).collect()
    again = P.pack(more.repartition(7, "text"), capacity=64, group_docs=4).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_large_groups_are_packed_in_runs(spark):
    docs = spark.range(40).selectExpr("1L AS doc_id", "'same text' AS text")
    got = P.pack(docs, capacity=64, group_docs=2).collect()
    assert sum(r["length"] for r in got) == 40 * got[0]["doc_tokens"]
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places)


def test_queries_on_a_written_table(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate([*ODD, None])],
        "doc_id long, text string, ids string, start int, grp int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: library(t) for i, t in enumerate([*ODD, None])}
    at, got = 0, {r["doc_id"]: r for r in T.op2_token_output(spark, str(tmp_path)).collect()}
    for i, ids in want.items():
        whole = np.array(ids + [2], "<u4")
        assert tuple(got[i]) == (i, at, len(whole), zlib.crc32(whole.tobytes()))
        at += len(whole)
    packed = P.op9_packing(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for r in packed.collect():
        whole = np.array(want[r["doc_id"]] + [1], "<u4")
        assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
