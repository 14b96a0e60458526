"""Operator 5: benchmark decontamination.

Items and texts are lower-cased words of letters, digits and bytes beyond ASCII. A first pass over all
texts finds which ``GRAM``-word runs of the items occur at all; these are the seeds, however many texts hold
them, as the number cannot tell a common phrase from an item with many copies. A second pass joins
passages to items where a seed occurs. Where the words around are too few of the item's for the least score
they go; a Smith-Waterman alignment of the item against the others scores the pair: its share of the
score of an exact copy.

Items are sent to the tasks in slices of at most ``SLICE_WORDS`` words, one after the other, so that
what is sent does not grow with the benchmark. Null or empty items and texts match nothing; repeated
rows are scored again; items shorter than a run are looked for as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by_worker, only, text_blocks

GRAM = 3
SLICE_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SHARE = 0.5
LEAST_WORDS = 8
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


_PLACE = 32  # bits of a cell that tell where its alignment starts


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the window's start and end of it; negative words match nothing.

    A cell is its score above ``_PLACE`` bits of how far its alignment starts from the window's end, so that
    of equal scores the one that starts first is carried on.
    """
    m, one = len(window), 1 << _PLACE
    steps = np.arange(1, m + 1) * (GAP * one)
    fresh = np.arange(m - 1, -1, -1, dtype=np.int64)  # a new alignment may start after each place
    row = np.arange(m, -1, -1, dtype=np.int64)
    best, place, end = 0, m, 0
    for w in item:
        gain = np.where((window == w) & (window >= 0), MATCH, MISMATCH) * one
        here = np.maximum(np.maximum(row[:-1] + gain, row[1:] + GAP * one), fresh)
        here = np.maximum(np.maximum.accumulate(here - steps) + steps, fresh)  # runs of gaps from the left
        row = np.r_[m, here]
        k = int(here.argmax()) if m else 0
        if m and here[k] >> _PLACE > best:
            best, place, end = int(here[k] >> _PLACE), int(here[k] & (one - 1)), k + 1
    return best, m - place, end


class Items:
    """A slice of items: words as numbers, and their runs."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = {}
        for i, t in zip(ids, texts, strict=True):
            w = words_of((t or "").encode())
            if w:
                self.ids.append(i)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64))
        self.runs = [self.runs_of(w) for w in self.words]
        self.flat = np.concatenate([*self.words, np.zeros(0, np.int64)])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def runs_of(self, words: np.ndarray, n: int = GRAM) -> np.ndarray:
        """A number for each run of ``n`` words (for all of them where there are fewer); -1 where one is unknown."""
        n = min(n, max(1, len(words)))
        size, at = len(self.vocabulary) + 1, max(0, len(words) - n + 1)
        code, bad = np.full(at, n, np.int64), np.zeros(at, bool)
        for k in range(n):
            part = words[k : k + at]
            code = code * size + part
            bad |= part < 0
        code[bad] = -1
        return code

    def text_runs(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of a text of each length that items have."""
        for n in self.lengths:
            if len(words) >= n:
                yield n, self.runs_of(words, n)

    @property
    def lengths(self) -> list[int]:
        return sorted({min(GRAM, len(w)) for w in self.words})


def _numbers(items: Items, text: bytes) -> np.ndarray:
    get = items.vocabulary.get
    return np.array([get(w, -1) for w in words_of(text)], np.int64)


def _find(table: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``runs`` are in the sorted ``table``: positions in both."""
    at = np.minimum(np.searchsorted(table, runs), max(0, len(table) - 1))
    hit = np.flatnonzero(table[at] == runs) if len(table) else np.zeros(0, np.int64)
    return hit, at[hit]


_SENT: dict[str, tuple] = held_by_worker({})


def seen_rows(sent, key: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to the runs of the items that they hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SENT:
            _SENT.clear()
            items = Items(*sent.value)
            _SENT[key] = (items, np.unique(np.concatenate([*items.runs, np.zeros(0, np.int64)])))
        items, table = _SENT[key]
        seen = np.zeros(len(table), bool)
        for _, off, data in text_blocks(batches):
            raw = data.tobytes()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                words = _numbers(items, raw[a:b])
                for _, runs in items.text_runs(words):
                    seen[_find(table, runs)[1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(table[seen])], names=["run"])

    return run


def may_reach(item: np.ndarray, words: np.ndarray, spans: list[tuple[int, int]], score: float) -> list[tuple[int, int]]:
    """The spans around which words could give ``score``: a match takes a word of the item and one of the text, and gaps are at most what a full match has over ``score``."""
    least, wide = score / MATCH - 1e-6, len(item)
    inside = np.r_[0, np.cumsum(np.isin(words, item))]
    around = [(max(0, s - wide), min(len(words), e + wide)) for s, e in spans]
    return [x for x, (s, e) in zip(spans, around, strict=True) if inside[e] - inside[s] >= least and np.isin(item, words[s:e]).sum() >= least]


class Seeds:
    """The runs that texts hold, in order, and for each its items and its places in them, laid end to end."""

    def __init__(self, items: Items, seen: set[int]):
        runs = np.concatenate([*items.runs, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(items.runs)), [len(r) for r in items.runs])
        place = np.concatenate([*(np.arange(len(r)) for r in items.runs), np.zeros(0, np.int64)])
        keep = np.isin(runs, np.array(sorted(seen), np.int64))
        order = np.argsort(runs[keep], kind="stable")
        self.table, starts = np.unique(runs[keep][order], return_index=True)
        self.item, self.place = item[keep][order], place[keep][order].astype(np.int64)
        self.ends = np.append(starts, len(order))

    def met(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the text, item, place in it) of every seed that ``runs`` has."""
        hit, at = _find(self.table, runs)
        n = self.ends[at + 1] - self.ends[at]
        which = np.repeat(self.ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(hit, n), self.item[which], self.place[which]


def find_items(items: Items, seeds: Seeds, known: dict, text: bytes, share: float, least_words: int) -> list[tuple[int, float, int, int]]:
    """(item, share of its score, first word, word after the last) of the items that a text holds; ``known`` remembers alignments.

    A run that very many items share meets them all; those of whose words the text has too few for the least score, wherever they
    stand, are told apart at once, before any is looked at alone.
    """
    words = _numbers(items, text)
    found = [seeds.met(runs) for _, runs in items.text_runs(words)]
    if not found or not sum(len(f[0]) for f in found):
        return []
    at, item, place = (np.concatenate([f[i] for f in found]) for i in range(3))
    few = np.unique(item)
    present = np.zeros(len(items.vocabulary) + 1, bool)
    present[words] = True  # unknown words are the last
    present[-1] = False
    n = items.sizes[few]
    which = np.repeat(items.starts[few] - np.cumsum(n) + n, n) + np.arange(n.sum())
    held = np.add.reduceat(present[items.flat[which]], np.cumsum(n) - n)
    keep = np.isin(item, few[held >= n * np.maximum(share, np.minimum(1.0, least_words / n)) - 1e-6])
    spans: dict[int, set[tuple[int, int]]] = {}
    for p, k, q in zip(at[keep].tolist(), item[keep].tolist(), place[keep].tolist(), strict=True):
        slack = len(items.words[k]) // 4 + 4
        spans.setdefault(k, set()).add((max(0, p - q - slack), min(len(words), p - q + len(items.words[k]) + slack)))
    out = []
    for item, found in spans.items():
        n = len(items.words[item])
        least = max(share, min(1.0, least_words / n))
        merged: list[list[int]] = []
        for s, e in may_reach(items.words[item], words, sorted(found), MATCH * n * least):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        best = (0, 0, 0)  # score, end, start
        for s, e in merged:
            window = words[s:e]
            if (k := (item, window.tobytes())) not in known:
                if len(known) > 20_000:
                    known.clear()
                known[k] = smith_waterman(items.words[item], window)
            score, begin, end = known[k]
            best = max(best, (score, s + end, s + begin))
        part = best[0] / (MATCH * n)
        if part >= least:
            out.append((items.ids[item], part, best[2], best[1]))
    return out


def _prepared(sent, key: str) -> tuple[Items, Seeds]:
    """The slice's items and seeds, made once by each worker."""
    if key not in _SENT:
        _SENT.clear()
        ids, texts, seen = sent.value
        items = Items(ids, texts)
        _SENT[key] = (items, Seeds(items, seen))
    return _SENT[key]


def match_rows(sent, key: str, share: float, least_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to the items they hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = _prepared(sent, key)
        known: dict = {}
        for rows, off, data in text_blocks(batches):
            raw, ids = data.tobytes(), rows.column(0).to_pylist()
            out = [(ids[i], *m) for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
                for m in find_items(items, seeds, known, raw[a:b], share, least_words)]
            if out:
                kinds = (rows.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "from_word", "to_word"])

    return run


def clean_rows(sent, key: str, share: float, least_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows, whole, whose text holds no item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = _prepared(sent, key)
        known: dict = {}
        for rows, off, data in text_blocks(batches):
            raw = data.tobytes()
            keep = [not find_items(items, seeds, known, raw[a:b], share, least_words) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield rows.filter(pa.array(keep, pa.bool_()))

    return run


def _slices(benchmark: DataFrame, slice_words: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in slices of at most ``slice_words`` words (or one item)."""
    ids, texts, held = [], [], 0
    for r in only(benchmark, "item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"].encode()))
        if ids and held + n > slice_words:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids, texts, held = [*ids, int(r["item_id"])], [*texts, r["text"]], held + n
    if ids:
        yield ids, texts


def _seeded(docs: DataFrame, benchmark: DataFrame, slice_words: int) -> Iterator[tuple]:
    """For each slice of items: what is sent to the tasks, with the runs of its items that texts hold."""
    spark = docs.sparkSession
    for ids, texts in _slices(benchmark, slice_words):
        sent = spark.sparkContext.broadcast((ids, texts))
        runs = docs.select("text").mapInArrow(seen_rows(sent, uuid.uuid4().hex), "run long").distinct()
        seen = {r["run"] for r in runs.collect()}  # a row per run of the slice at most
        yield spark.sparkContext.broadcast((ids, texts, seen)), uuid.uuid4().hex


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = LEAST_SHARE, least_words: int = LEAST_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``doc_id, item_id, score, from_word, to_word`` for every row of ``doc_id, text`` and item whose alignment has at least ``share`` of an exact copy's score.

    Items of fewer than ``least_words / share`` words need a larger share, those of up to ``least_words`` all of it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, from_word long, to_word long"
    out = [only(docs, "doc_id", "text").mapInArrow(match_rows(*found, share, least_words), schema) for found in _seeded(docs, benchmark, slice_words)]
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = LEAST_SHARE, least_words: int = LEAST_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item."""
    out = docs
    for found in _seeded(docs, benchmark, slice_words):
        out = out.mapInArrow(clean_rows(*found, share, least_words), docs.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
