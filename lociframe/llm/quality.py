"""Operator 7: document quality by gradient-boosted trees over histograms of document statistics.

Statistics come from the whole text alone. The trees are fitted in numpy on the driver from at most
``TRAIN_ROWS`` labelled rows (those with the least hash of the id; only a share of the hashes that holds
about as many is collected), flattened into arrays, and
traversed for a batch of rows at a time in the tasks.

Null texts are empty (all statistics zero) and are scored; rows of ``labels`` with a null label or id
are not learned from; without two labels to learn from every score is their share of ones, or a half.
Repeated rows are scored again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, only, stage, text_blocks

TRAIN_ROWS = 20_000
TREES = 80
DEPTH = 4
RATE = 0.1
BINS = 64
LEAST_ROWS = 20
PENALTY = 1.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[44, 46]] = 6
_CLASS[[33, 63, 58, 59, 39, 34, 40, 41, 45]] = 7
_CLASS[[35, 36, 37, 38, 42, 64, 94, 126]] = 8
_CLASS[[60, 61, 62, 91, 93, 123, 125, 124, 92, 47, 95, 43, 96]] = 9
_CLASS[128:192] = 10
_CLASS[192:] = 11
_CLASSES = 12
NAMES = ["log_bytes", *[f"class_{i}" for i in range(_CLASSES)], "log_words", "word_bytes", "distinct_words", "top_word", "long_words", "distinct_pairs", "log_lines", "line_bytes", "distinct_lines", "short_lines", "entropy", "capital_words", "end_marks"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a block."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    share = counts / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    for k in range(_CLASSES):
        out[:, 1 + k] = share[:, k == _CLASS].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    raw = data.tobytes()
    for i in range(n):
        text = raw[off[i] : off[i + 1]]
        words = text.split()
        if not words:
            continue
        kinds: dict[bytes, int] = {}
        for w in words:
            kinds[w] = kinds.get(w, 0) + 1
        lines = [x for x in text.split(b"\n") if x]
        m = len(words)
        out[i, 13:] = (
            np.log1p(m), sum(map(len, words)) / m, len(kinds) / m, max(kinds.values()) / m, sum(len(w) > 12 for w in kinds) / len(kinds),
            len(set(zip(words, words[1:], strict=False))) / max(1, m - 1), np.log1p(len(lines)), len(text) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
            sum(len(x) < 30 for x in lines) / max(1, len(lines)), entropy[i], sum(65 <= w[0] <= 90 for w in words) / m, sum(x[-1] in b".!?" for x in lines) / max(1, len(lines)),
        )
    return out


def statistic_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, off, data in text_blocks(batches):
        x = statistics(data, off)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


@dataclass
class Trees:
    """Trees in flat arrays: a node sends a row left if ``x[feature] <= cut``; at a leaf, left and right are the node itself."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: float = 0.0
    depth: int = DEPTH

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for 0/1 labels by second-order gain over histograms of ``bins`` quantile bins."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(start=float(np.log(share / (1 - share))), depth=depth)
    if len(y) < 2 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    features, flat = x.shape[1], binned + np.arange(x.shape[1]) * bins
    margin = np.full(len(y), model.start)
    cols: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def add() -> int:
        for k, v in (("feature", 0), ("cut", 0.0), ("value", 0.0), ("left", len(cols["left"])), ("right", len(cols["right"]))):
            cols[k].append(v)
        return len(cols["left"]) - 1

    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(add())
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            later = []
            for node, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-9, -1, -1)
                if level < depth and len(rows) >= 2 * LEAST_ROWS:
                    at = flat[rows].reshape(-1)
                    hist = [np.bincount(at, w, features * bins).reshape(features, bins).cumsum(1) for w in (np.repeat(g[rows], features), np.repeat(h[rows], features), None)]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
                    gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = -1
                    for j, c in enumerate(cuts):
                        gain[j, len(c) :] = -1
                    k = int(gain.argmax())
                    best = max(best, (float(gain.reshape(-1)[k]), k // bins, k % bins))
                if best[1] < 0:
                    cols["value"][node] = rate * gs / (hs + PENALTY)
                    margin[rows] += cols["value"][node]
                    continue
                goes = binned[rows, best[1]] <= best[2]
                cols["feature"][node], cols["cut"][node] = best[1], float(cuts[best[1]][best[2]])
                cols["left"][node], cols["right"][node] = add(), add()
                later += [(cols["left"][node], rows[goes]), (cols["right"][node], rows[~goes])]
            open_nodes = later
    for k, v in cols.items():
        setattr(model, k, np.asarray(v))
    model.roots = np.asarray(roots)
    return model


def score_rows(model: Trees) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(x), pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 2, folds: int = 4, train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """``doc_id, held_out, score`` for ``doc_id, text``, learned from ``labels`` of the rows outside the held-out fold."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = stage(only(docs, "doc_id", "text").mapInArrow(statistic_rows, f"doc_id {kind}, x array<double>"), "statistics")
    known = only(labels, "doc_id", label).where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).alias("y"))
    taught = facts.where(crc_mod("doc_id", folds) != held_out).join(known, F.col("doc_id") == F.col("id"))
    ids = taught.select(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1).alias("h"), "y", "x")
    n = ids.count()
    if n > train_rows:  # a share of the hashes holds a tenth more rows than wanted; the least of them are taken
        ids = ids.where(F.col("h") < F.lit(int(min(1.0, (1.1 * train_rows + 100) / n) * (2**63 - 1))))
    sample = sorted(ids.collect(), key=lambda r: (r["h"], r["y"], r["x"]))[:train_rows]  # about 1.1 * train_rows at most
    model = fit(np.array([r["x"] for r in sample]).reshape(len(sample), len(NAMES)), np.array([r["y"] for r in sample], float))
    return facts.mapInArrow(score_rows(model), f"doc_id {kind}, score double").select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
