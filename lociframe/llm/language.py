"""Operator 3: language of a text by a bidirectional gated recurrent network over bytes.

The network reads whole lower-cased texts, forwards and backwards, in windows of ``CORE`` bytes with
``MARGIN`` more on both sides, whose states carry across words; it gives every byte position a probability
for each language. A text's probabilities pool those of all its letters geometrically. It is trained in
numpy by backpropagation through time on the driver, on at most about ``TRAIN_PIECES`` pieces of ``PIECE``
bytes a language, drawn by hash from all pieces of all texts that may be learned from.

A text that is null or has no letter is ``und`` with score 0. Rows with a null language are not learned
from; with no language to learn every text is ``und``. Repeated rows are scored again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, only, text_blocks

HIDDEN = 8
CORE = 480
MARGIN = 16
ROWS = 512
PIECE = 96
TRAIN_PIECES = 4_000
STEPS = 400
BATCH = 128
RATE = 0.02
NONE = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), an activation between -1 and 1 that costs a fraction of the hyperbolic tangent."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``_soft`` where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Network:
    """Weights by name: for each direction a table of byte inputs ``E`` (256 x 3H), recurrent ``U`` (H x 3H) and outputs ``V`` (H x K); a bias ``c``."""

    weights: dict[str, np.ndarray]
    languages: list[str]

    @staticmethod
    def new(languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        w = {"c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            w[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            w[f"V{d}"] = rng.normal(0, 0.3, (hidden, len(languages))).astype(np.float32)
        return Network(w, languages)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T x B x H) after each byte of ``x`` (T x B); ``keep`` gets what the way back needs."""
        table, u = self.weights[f"E{d}"], self.weights[f"U{d}"]
        n = u.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            e, a = table[x[t]], h @ u
            gates = 0.5 * _soft(e[:, : 2 * n] + a[:, : 2 * n]) + 0.5
            r, z = gates[:, :n], gates[:, n:]
            new = _soft(e[:, 2 * n :] + r * a[:, 2 * n :])
            if keep is not None:
                keep.append((h, r, z, a[:, 2 * n :], new))
            h = h + z * (new - h)
            out[t] = h
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """T x B x K log probabilities of the languages at every position of the pieces ``x`` (T x B bytes)."""
        logits = self.states(x, "f") @ self.weights["Vf"] + self.states(x[::-1], "b")[::-1] @ self.weights["Vb"] + self.weights["c"]
        logits -= logits.max(-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(-1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions of the pieces ``x`` with languages ``y``, by backpropagation through time."""
        w = self.weights
        keep: dict[str, list] = {"f": [], "b": []}
        hs = {"f": self.states(x, "f", keep["f"]), "b": self.states(x[::-1], "b", keep["b"])[::-1]}
        logits = hs["f"] @ w["Vf"] + hs["b"] @ w["Vb"] + w["c"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        out = {"c": p.sum((0, 1))}
        for d in "fb":
            out[f"V{d}"] = np.einsum("tbh,tbk->hk", hs[d], p)
            above = p @ w[f"V{d}"].T
            xs = x
            if d == "b":
                above, xs = above[::-1], x[::-1]
            u, n = w[f"U{d}"], w[f"U{d}"].shape[0]
            de, du, dh = np.zeros_like(w[f"E{d}"]), np.zeros_like(u), np.zeros((x.shape[1], n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, r, z, a, new = keep[d][t]
                dh = dh + above[t]
                dnew = dh * z * _slope(new)
                dr, dz = dnew * a * _slope(2 * r - 1) / 2, dh * (new - h) * _slope(2 * z - 1) / 2
                da = np.concatenate([dr, dz, dnew * r], 1)
                np.add.at(de, xs[t], np.concatenate([dr, dz, dnew], 1))
                du += h.T @ da
                dh = dh * (1 - z) + da @ u.T
            out[f"E{d}"], out[f"U{d}"] = de, du
        return out


def train(
    words: list[bytes], labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 3
) -> Network:
    """A network fitted by Adam to the languages of pieces of text; batches hold pieces of one length."""
    net = Network.new(languages, seed=seed)
    if not words or len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    sizes = np.array([len(w) for w in words])
    by = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    flat = {n: np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, n) for n, rows in by.items()}
    lengths = np.array(list(by))
    share = np.array([len(by[n]) * n for n in lengths], float)
    share /= share.sum()
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        n = int(rng.choice(lengths, p=share))
        rows = rng.integers(0, len(by[n]), batch)
        grads = net.gradients(flat[n][rows].T, labels[by[n][rows]])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _fast(net: Network) -> dict[str, np.ndarray]:
    """Weights turned so that a window is a column."""
    out = {"c": net.weights["c"].astype(np.float32)[:, None]}
    for d in "fb":
        for k in "EUV":
            out[k + d] = np.ascontiguousarray(net.weights[k + d].T.astype(np.float32))
    return out


def window_logits(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """T x K x B logits for the windows ``x`` (T x B bytes); the byte 0 is padding, which leaves no state."""
    steps, rows = x.shape
    n = w["Uf"].shape[1]
    out = np.empty((steps, len(w["c"]), rows), np.float32)
    out[:] = w["c"]
    a, e, size = (np.empty((3 * n, rows), np.float32) for _ in range(3))
    padded, places = (x == 0).any(1), x.astype(np.intp)
    for d in "fb":
        table, u, v = w[f"E{d}"], w[f"U{d}"], w[f"V{d}"]
        h = np.zeros((n, rows), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.matmul(u, h, out=a)
            np.take(table, places[t], axis=1, out=e, mode="clip")
            gates, new = a[: 2 * n], a[2 * n :]
            gates += e[: 2 * n]
            _soft_in_place(gates, size[: 2 * n])
            gates *= 0.5
            gates += 0.5
            new *= gates[:n]
            new += e[2 * n :]
            _soft_in_place(new, size[2 * n :])
            new -= h
            new *= gates[n:]
            h += new
            if padded[t]:
                h *= x[t] != 0
            out[t] += v @ h
    return out


def _soft_in_place(x: np.ndarray, size: np.ndarray) -> None:
    np.abs(x, out=size)
    size += 1
    x /= size


def pooled(net: Network, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text of a block, lower-cased bytes without zeros: the log probabilities summed over its letters, and their number."""
    n, k, size = len(off) - 1, len(net.languages), np.diff(off)
    out = np.zeros((n, k + 1))
    if not k or not len(data):
        return out
    many = -(-size // CORE)
    text = np.repeat(np.arange(n), many)
    core = off[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * CORE
    begin, end = np.maximum(off[:-1][text], core - MARGIN), np.minimum(off[1:][text], core + CORE + MARGIN)
    order = np.argsort(end - begin, kind="stable")
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    w = _fast(net)
    for i in range(0, len(order), ROWS):
        some = order[i : i + ROWS]
        steps = np.arange(int((end - begin)[some].max()))[:, None]
        at = begin[some] + steps
        inside = at < end[some]
        at = np.minimum(at, len(data) - 1)
        logits = window_logits(w, np.where(inside, data[at], 0))
        use = inside & letter[at] & (at >= core[some]) & (at < core[some] + CORE)
        top = logits.max(1)
        total = top + np.log(np.exp(logits - top[:, None]).sum(1))
        weight = use.astype(np.float32)
        sums = np.einsum("tkb,tb->bk", logits, weight) - (total * weight).sum(0)[:, None]
        for j in range(k):
            out[:, j] += np.bincount(text[some], sums[:, j], n)
        out[:, k] += np.bincount(text[some], use.sum(0), n)
    return out


def clean_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; zeros become blanks."""
    return np.frombuffer(data.tobytes().lower().replace(b"\0", b" "), np.uint8)


def predict_rows(net: Network, names: tuple[str, str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, off, data in text_blocks(batches):
            sums = pooled(net, clean_bytes(data), off)
            mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
            p = np.exp(mean - mean.max(1, keepdims=True)) if mean.shape[1] else np.zeros((len(mean), 1))
            p /= np.maximum(p.sum(1, keepdims=True), 1e-30)
            best = p.argmax(1)
            found, scores, raw = [], [], data.tobytes()
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                letter = sums[i, -1] > 0 and (any(65 <= c & 223 <= 90 for c in raw[a : min(b, a + 256)]) or any(c.isalpha() for c in raw[a:b].decode("utf-8", "replace")))
                found.append(net.languages[best[i]] if letter else NONE)
                scores.append(float(p[i, best[i]]) if letter else 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*rows.schema.names, *names])

    return run


def piece_rows(limits: dict[str, float]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (lang, h, text) to the pieces whose own hash, as a share of all hashes, is under the language's limit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, off, data in text_blocks(batches):
            clean = clean_bytes(data)
            many = -(-np.diff(off) // PIECE)
            text = np.repeat(np.arange(len(many)), many)
            k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            h = rows.column(1).to_numpy().view(np.uint64)[text] ^ (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
            langs = rows.column(0).to_pylist()
            limit = np.array([limits.get(x, 0.0) for x in langs])[text] if len(langs) else np.zeros(0)
            take = np.flatnonzero(h / 2.0**64 < limit)
            begin = off[:-1][text[take]] + k[take] * PIECE
            end = np.minimum(begin + PIECE, off[1:][text[take]])
            pieces = [clean[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in text[take]], pa.string()), pa.array(h[take].view(np.int64)), pa.array(pieces, pa.binary())], names=["lang", "h", "piece"])

    return run


def fit_languages(docs: DataFrame, held_out: int = 2, folds: int = 4, train_pieces: int = TRAIN_PIECES, seed: int = 3) -> Network:
    """A network trained on pieces of rows of ``doc_id, text, lang`` outside the held-out fold."""
    known = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", folds) != held_out))
    sizes = known.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / PIECE)).alias("n")).collect()  # a row a language
    limits = {r["lang"]: train_pieces / r["n"] for r in sizes if r["n"]}
    hashed = known.select("lang", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("h"), "text")
    sample = hashed.mapInArrow(piece_rows(limits), "lang string, h long, piece binary").collect()  # about train_pieces a language
    sample.sort(key=lambda r: (r["lang"], r["h"], r["piece"]))
    languages = sorted(limits)
    labels = np.asarray([languages.index(r["lang"]) for r in sample], np.int64)
    return train([bytes(r["piece"]) for r in sample], labels, languages, seed=seed)


def with_language(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with its predicted language and the score of it, in columns of these ``names``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict_rows(net, names), f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def accepted(docs: DataFrame, net: Network, least_score: float = 0.3) -> DataFrame:
    """``docs``, all columns, without the rows that have no language or one with a lower score."""
    names = ("__language", "__language_score")
    return with_language(docs, net, names).where((F.col(names[0]) != NONE) & (F.col(names[1]) >= least_score)).drop(*names)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_language(only(docs, "doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
