"""Operator 8: language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a Krichevsky-Trofimov estimate in the contexts
of the last 0 to ``DEPTH`` bytes, and every context mixes its own estimate with those of the longer
contexts below it, half and half before any data (Willems, Shtarkov and Tjalkens, 1995). A text is its
UTF-8 bytes after ``DEPTH`` zero bytes, closed by the byte 255, which UTF-8 never holds.

The corpus is counted once: a count for every distinct run of ``DEPTH + 1`` bytes and for every word.
Runs are dealt by their last two context bytes, so all deeper contexts of a run lie in one partition;
contexts of one and no byte are few and are summed on top. Each run thus gets one log probability.
Where there are at most ``TABLE_RUNS`` runs, tasks look them up in a table that is sent to them;
otherwise the runs of each text are joined to it. The base score's frequent words are sent likewise
(at most ``HEAD_WORDS``), and all others are joined.

Null texts are empty: one end token, one byte 255. Repeated rows are scored again and counted again in
training. An empty table gives no rows; without training rows every bit has probability a half.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, only, parts, stage, text_blocks

DEPTH = 4
SEED = 0
END_TOKEN = -1
TABLE_RUNS = 4_000_000
HEAD_WORDS = 1 << 20
HELD_WORDS = 1_500_000
_SMALL = 4096
_LG_HALF = np.r_[0.0, np.cumsum(np.log(np.arange(_SMALL) + 0.5))]
_LG_ONE = np.r_[0.0, np.cumsum(np.log(np.arange(1, _SMALL + 1)))]


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    """ln of gamma(n + shift) / gamma(shift) for whole n and a shift of a half or one."""
    z = np.maximum(n, _SMALL) + shift
    far = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) - (0.5 * np.log(np.pi) if shift == 0.5 else 0.0)
    near = (_LG_HALF if shift == 0.5 else _LG_ONE)[np.minimum(n, _SMALL).astype(np.int64)]
    return np.where(n <= _SMALL, near, far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0)


def runs_of(data: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For every byte of every text, and its closing 255, the run of it and the ``depth`` bytes before it as one number."""
    n, size = len(off) - 1, np.diff(off)
    start = off[:-1] + np.arange(n) * (depth + 1) + depth
    flat = np.zeros(len(data) + n * (depth + 1), np.uint64)
    flat[np.arange(len(data)) + np.repeat(start - off[:-1], size)] = data
    flat[start + size] = 255
    run = flat[: len(flat) - depth].copy()
    for k in range(1, depth + 1):
        run <<= np.uint64(8)
        run |= flat[k : len(flat) - depth + k]
    first = start - depth
    keep = np.ones(len(run), bool)
    for k in range(depth):  # runs that would end in the zeros before the next text
        at = first[1:] - 1 - k
        keep[at[at >= 0]] = False
    return run[keep]


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash; -1 is kept for the end token."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(word, SEED)
    h = h - (1 << 64) if h >> 63 else h
    return h if h != END_TOKEN else 0


def count_rows(depth: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (text, train) to counts ``kind, key, n``: runs of all texts (n from training ones), words of training ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words: dict[bytes, int] = {}
        ends = 0

        def rows(kind: int, k, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

        def flush() -> pa.RecordBatch:
            out = rows(1, [word_hash(w) for w in words], list(words.values()))
            words.clear()
            return out

        for batch, off, data in text_blocks(batches):
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found = runs_of(data, off, depth)
            taught = np.repeat(train, np.diff(off) + 1)
            known, n = np.unique(found[taught], return_counts=True)
            new = np.unique(found[~taught])
            keys, counts = _merge(np.concatenate([keys, known, new]), np.concatenate([counts, n, np.zeros(len(new), np.int64)]))
            raw = data.tobytes().lower()
            for i in np.flatnonzero(train).tolist():
                for w in raw[off[i] : off[i + 1]].split():
                    words[w] = words.get(w, 0) + 1
            ends += int(train.sum())
            if len(words) > HELD_WORDS:
                yield flush()
        yield rows(0, keys.astype(np.int64), counts)
        yield flush()
        if ends:
            yield rows(1, [END_TOKEN], [ends])

    return run


def _expand(runs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run and each of its eight bits: the context, the place in the byte's tree, the bit, the count."""
    sym = (runs & np.uint64(255)).astype(np.int64)
    ctx = (runs >> np.uint64(8)).astype(np.int64)
    k = np.arange(8)
    node = (1 << k) | (sym[:, None] >> (8 - k))
    bit = (sym[:, None] >> (7 - k)) & 1
    return np.repeat(ctx, 8), node.reshape(-1), bit.reshape(-1), np.repeat(n, 8)


def _levels(ctx: np.ndarray, node: np.ndarray, bit: np.ndarray, n: np.ndarray, depth: int, least: int) -> dict[int, dict]:
    """From ``depth`` down to ``least``: nodes, zeros, ones, ln of the own and of the weighted probability, and each bit's node."""
    out: dict[int, dict] = {}
    below: dict | None = None
    for d in range(depth, least - 1, -1):
        key = ((ctx & ((1 << 8 * d) - 1)) << 8) | node
        keys, at = np.unique(key, return_inverse=True)
        zeros = np.bincount(at, n * (bit == 0), len(keys))
        ones = np.bincount(at, n * (bit == 1), len(keys))
        own = log_kt(zeros, ones)
        mixed = own
        if below is not None:
            up = ((below["keys"] >> 8 & ((1 << 8 * d) - 1)) << 8) | (below["keys"] & 255)
            children = np.bincount(np.searchsorted(keys, up), below["mixed"], len(keys))
            mixed = np.logaddexp(own, children) - np.log(2)
        below = out[d] = {"keys": keys, "at": at, "zeros": zeros, "ones": ones, "own": own, "mixed": mixed}
    return out


def _arrays(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    runs, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        runs.append(b.column(0).to_numpy())
        n.append(b.column(1).to_numpy())
    return np.concatenate(runs).astype(np.uint64), np.concatenate(n)


def top_rows(depth: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of a partition to its nodes of two context bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _levels(*_expand(*_arrays(batches)), depth, 2)[2]
        yield pa.RecordBatch.from_arrays([pa.array(x["keys"]), *[pa.array(x[c], pa.float64()) for c in ("zeros", "ones", "mixed")]], names=["key", "zeros", "ones", "mixed"])

    return run


def score_runs(depth: int, top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of a partition to their log10 probabilities; ``top`` has keys, zeros, ones and own weights of the nodes of one and no context byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, n = _arrays(batches)
        ctx, node, bit, each = _expand(runs, n)
        levels = _levels(ctx, node, bit, each, depth, 2)
        p = None
        for d in range(depth, -1, -1):
            if d >= 2:
                x = levels[d]
                at, zeros, ones, weight = x["at"], x["zeros"], x["ones"], np.exp(x["own"] - np.log(2) - x["mixed"])
            else:
                keys, zeros, ones, weight = top[d]
                at = np.searchsorted(keys, ((ctx & ((1 << 8 * d) - 1)) << 8) | node)
            own = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            p = own if p is None else weight[at] * own + (1 - weight[at]) * p
        log = np.log10(p).reshape(-1, 8).sum(1) if len(runs) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(runs.astype(np.int64)), pa.array(log)], names=["run", "logp"])

    return run


def score_table(spark: SparkSession, runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``run, logp`` (log10) of every row of ``run, n``."""
    if depth < 2:
        raise ValueError("the depth must be 2 or more")
    dealt = runs.select("run", "n").repartition(parts(spark), F.shiftright("run", 8).bitwiseAND(F.lit(0xFFFF)))
    two = dealt.mapInArrow(top_rows(depth), "key long, zeros double, ones double, mixed double")
    drop = F.shiftright("key", 8).bitwiseAND(F.lit(0xFF)) * 256 + F.col("key").bitwiseAND(F.lit(0xFF))
    got = two.groupBy(drop.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("mixed")).orderBy("key").toArrow()  # 65,280 rows at most
    keys, zeros, ones = got["key"].to_numpy(), got["zeros"].to_numpy(), got["ones"].to_numpy()
    own = log_kt(zeros, ones)
    mixed = np.logaddexp(own, got["mixed"].to_numpy()) - np.log(2)
    root, at = np.unique(keys & 255, return_inverse=True)
    zeros0, ones0 = np.bincount(at, zeros, len(root)), np.bincount(at, ones, len(root))
    own0 = log_kt(zeros0, ones0)
    mixed0 = np.logaddexp(own0, np.bincount(at, mixed, len(root))) - np.log(2)
    top = {1: (keys, zeros, ones, np.exp(own - np.log(2) - mixed)), 0: (root, zeros0, ones0, np.exp(own0 - np.log(2) - mixed0))}
    return stage(dealt.mapInArrow(score_runs(depth, top), "run long, logp double"), "scores")


class Lookup:
    """Values by 64-bit key in an open-addressed table; a key that is absent has the value ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        self.bits = max(4, int(2 * max(1, len(keys))).bit_length() + 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, missing)
        full = np.zeros(1 << self.bits, bool)
        left, value = keys.astype(np.uint64), values
        at = self._home(left)
        while len(left):
            _, first = np.unique(at, return_index=True)
            fits = np.zeros(len(left), bool)
            fits[first] = True
            fits &= ~full[at]
            self.keys[at[fits]], self.values[at[fits]], full[at[fits]] = left[fits], value[fits], True
            left, value, at = left[~fits], value[~fits], (at[~fits] + 1) & ((1 << self.bits) - 1)
        self.full = full

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at = (at[wrong] + 1) & ((1 << self.bits) - 1) if len(at) != len(wrong) else (at + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.values[at]
            stay = (self.keys[at] != keys[wrong]) & self.full[at]
            wrong, at = wrong[stay], at[stay]
        return out


_TABLES: dict[str, tuple[Lookup | None, Lookup]] = {}


def text_rows(sent, key: str, depth: int, with_runs: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, train, text) to a row each: what the sent tables give, and what is left to join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:
            _TABLES.clear()
            runs, logs, heads, counts = sent.value
            _TABLES[key] = (Lookup(runs, logs, np.nan) if with_runs else None, Lookup(heads, counts, -1.0))
        by_run, by_word = _TABLES[key]
        row = TaskContext.get().partitionId() << 36
        for batch, off, data in text_blocks(batches):
            n, size = len(off) - 1, np.diff(off)
            found = runs_of(data, off, depth)
            ends = np.cumsum(size + 1)
            starts = ends - size - 1
            score = np.add.reduceat(by_run(found), starts) if with_runs else np.zeros(n)
            raw = data.tobytes().lower()
            ids: dict[bytes, int] = {}
            flat: list[int] = []
            tokens = np.zeros(n, np.int64)
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                words = raw[a:b].split()
                flat += [ids.setdefault(w, len(ids)) for w in words]
                tokens[i] = len(words)
            hashes = np.array([word_hash(w) for w in ids], np.int64)
            c = by_word(hashes.astype(np.uint64))
            at, doc = np.asarray(flat, np.int64), np.repeat(np.arange(n), tokens)
            each = c[at] if len(at) else np.zeros(0)
            known = np.bincount(doc, each >= 0, n).astype(np.int64)
            logs = np.bincount(doc, np.log10(np.maximum(each, 0) + 1), n).astype(float)
            tails = hashes[at[each < 0]] if len(at) else np.zeros(0, np.int64)
            cut = np.r_[0, np.cumsum(np.bincount(doc[each < 0], minlength=n))].astype(np.int32)
            cols = [np.arange(row, row + n), None, None, tokens + 1, known, logs, score]
            row += n
            arrays = [batch.column(0) if i == 1 else batch.column(1) if i == 2 else pa.array(x) for i, x in enumerate(cols)]
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(tails, pa.int64()))]
            if not with_runs:
                lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays + lists, names=["row", "doc_id", "train", "n_tokens", "known", "logs", "score", "tail", *(["runs"] if not with_runs else [])])

    return run


def score_texts(docs: DataFrame, held_out: int = 2, folds: int = 7, depth: int = DEPTH, table_runs: int = TABLE_RUNS, head_words: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``, learned from those outside the held-out fold."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs, "doc_id", "text").select("doc_id", (crc_mod("doc_id", folds) != held_out).alias("train"), "text")
    counted = rows.select("text", "train").mapInArrow(count_rows(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = stage(counted, "counts")
    table = score_table(spark, counted.where("kind = 0").select(F.col("key").alias("run"), "n"), depth)
    words = counted.where("kind = 1").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    by_count = words.where(F.col("key") != END_TOKEN).groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()  # as many rows as different counts: fewer than the root of twice the tokens
    least, held = None, 0
    for r in by_count:
        if (held := held + r["k"]) > head_words:
            break
        least = r["n"]
    heads = words.where((F.col("key") != END_TOKEN) & (F.col("n") >= least)) if least is not None else words.limit(0)
    heads = heads.toArrow()  # at most head_words
    with_runs = table.count() <= table_runs
    runs = (table if with_runs else table.limit(0)).toArrow()  # at most table_runs
    sent = spark.sparkContext.broadcast((runs["run"].to_numpy(), runs["logp"].to_numpy(), heads["key"].to_numpy(), heads["n"].to_numpy().astype(float)))
    del runs, heads
    schema = f"row long, doc_id {kind}, train boolean, n_tokens long, known long, logs double, score double, tail array<long>"
    scored = rows.mapInArrow(text_rows(sent, uuid.uuid4().hex, depth, with_runs), schema + ("" if with_runs else ", runs array<long>"))
    scored = stage(scored, "texts")
    rare = stage(words.where(F.col("n") < least) if least is not None else words.where(F.col("key") != END_TOKEN), "rare")
    more = scored.select("row", F.explode("tail").alias("key")).join(rare, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    if not with_runs:
        joined = scored.select("row", F.explode("runs").alias("run")).groupBy("row", "run").agg(F.count("*").alias("k")).join(table, "run").groupBy("row").agg(F.sum(F.col("k") * F.col("logp")).alias("by_run"))
        scored = scored.drop("score").join(joined.withColumnRenamed("by_run", "score"), "row")
    ends = words.where(F.col("key") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_known = F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0)))
    return scored.join(more, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", all_known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1.0)))).alias("base_score"), F.col("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
