"""Operator 10: removal of byte strings that occur more than once, by suffix sorting.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else. Suffixes of the whole
corpus are not sorted in one place. Every ``LENGTH``-byte window is dealt by its anchor, the ``GRAM``-byte
run in it with the least hash (the last of equals), so equal windows have equal anchors; consecutive
windows of one anchor are a piece. Pieces whose anchor occurs once hold no repeats. Equal pieces of
one anchor repeat as a whole; where an anchor has different pieces, one of each is suffix-sorted with
those of other anchors, a chunk at a time (so many as are not crowded): suffixes smaller than their successors are sorted directly,
the others are induced by scans over the buckets of first bytes, and adjacent common prefixes of
``LENGTH`` bytes mark repeats. Windows of an anchor with many different pieces are not sorted in one
place: they are dealt by their distance to the anchor and a digest of all their bytes, and counted. Digests
that very many windows have are few: they are sent to the windows, which leave as ranges; windows of other
digests meet theirs in a join.

Null texts are empty; texts shorter than ``LENGTH`` lose nothing; repeated rows are repeats of each
other; an empty table gives no rows. Ids need not be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, parts, stage, text_blocks

LENGTH = 200
GRAM = 40
CROWD = 64
DIGEST = 16
SENT_PIECES = 2_000_000
#: Windows of a digest that is sent, at least, and digests that are sent, at most.
COMMON = 16
SENT_DIGESTS = 250_000
CHUNK = 1 << 20
SCAN_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all pieces of the texts of a block: text, first and last window, anchor (places in the block), anchor hash, content hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    size = 1 << (n + 1).bit_length()
    if size not in _POWERS:
        if len(_POWERS) > 4:
            _POWERS.clear()
        _POWERS[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    up, down = _POWERS[size]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    grams = _mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    bits = np.uint64(max(24, (n + 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (mask - (low & mask)).astype(np.int64)
    sizes = np.diff(off)
    whole = np.flatnonzero(sizes >= length)
    inside = np.zeros(len(anchor) + 1, np.int64)
    inside[off[whole]] += 1
    np.add.at(inside, off[whole] + sizes[whole] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
    if not len(start):
        return none, none, none, none, none, none
    a = anchor[start]
    first = np.r_[True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]
    doc_first = np.zeros(n + 1, bool)
    doc_first[off[whole]] = True
    first |= doc_first[start]
    cut = np.flatnonzero(first)
    s0, s1, a = start[cut], start[np.r_[cut[1:], len(start)] - 1], a[cut]
    h = grams[a]
    p = _mix((prefix[s1 + length] - prefix[s0]) * down[s0] + (s1 - s0).astype(np.uint64))
    return np.searchsorted(off, s0, "right") - 1, s0, s1, a, h.view(np.int64), p.view(np.int64)


def _small_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return text_blocks(batches, limit=SCAN_BYTES)


def piece_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, th, tb, text) to pieces."""
    for rows, off, data in _small_blocks(batches):
        doc, s0, s1, _, h, p = pieces_of(data, off)
        ids, th, tb = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        own = [pa.array(x[doc], pa.int64()) for x in (ids, th, tb)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(h), pa.array(p), pa.array(s0 - off[doc]), pa.array(s1 - off[doc])], names=["doc_id", "th", "tb", "h", "p", "s0", "s1"])


def suffix_order(text: np.ndarray, limit: int) -> np.ndarray:
    """Places of ``text`` by the order of the suffixes there, told apart by their first ``limit`` bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    step = np.r_[np.sign(np.diff(text.astype(np.int16))), -1]  # the last suffix is larger than the empty one
    decided = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    padded = np.r_[text, np.zeros(limit, np.uint8)]
    direct = np.flatnonzero(small)
    keys = np.ndarray((n,), f"S{limit}", padded.tobytes(), strides=(1,))[direct]
    direct = direct[np.argsort(keys, kind="stable")]
    heads = text[direct]
    cuts = np.searchsorted(heads, np.arange(257))
    larger = ~small
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(some: np.ndarray, own: int) -> np.ndarray:
        before = some[some > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return before
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        edge = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
        again = before[:0]
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(heads)], strict=True):
            if heads[s] == own:
                again = before[s:e]
            else:
                induced[heads[s]].append(before[s:e])
        return again

    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        some = direct[cuts[c] : cuts[c + 1]]
        if len(some):
            out.append(some)
            induce(some, c)
    return np.concatenate(out)


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece which of its windows also start elsewhere in these pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff" + bytes(length), np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    used = int(sizes.sum()) + len(pieces)
    room = np.zeros(used + 1, np.int64)
    np.add.at(room, start, 1)
    np.add.at(room, start + np.maximum(sizes - length + 1, 0), -1)
    window = np.cumsum(room[:used]) > 0
    order = suffix_order(text[:used], length)
    order = order[window[order]]
    words = np.ndarray((used,), "<u8", text.tobytes(), strides=(1,))
    same = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        same = same[words[order[same] + k] == words[order[same + 1] + k]] if k < used else same
    hit = np.zeros(used, bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [hit[s : s + max(0, m - length + 1)] for s, m in zip(start.tolist(), sizes.tolist(), strict=True)]


def extract_rows(batches: Iterable[pa.RecordBatch], keys: np.ndarray, owners: np.ndarray, crowded: np.ndarray, single: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, th, tb, text) to the wanted pieces, ``far`` -1, or to the windows of crowded ones: distance to the anchor and digest.

    ``keys`` are sorted, ``owners`` are the documents to take each from.
    """
    for rows, off, data in _small_blocks(batches):
        doc, s0, s1, a, h, p = pieces_of(data, off)
        if not len(doc) or not len(keys):
            continue
        ids, th, tb = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        key = piece_key(h, p)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        take = np.flatnonzero((keys[at] == key) & (owners[at] == ids[doc]))
        take = take[np.unique(key[take], return_index=True)[1]]
        raw = data.tobytes()
        out: list[tuple] = []
        for i in take.tolist():
            b, e = int(s0[i]), int(s1[i])
            base = int(off[doc[i]])
            rest = (int(h[i]), int(p[i]), int(th[doc[i]]), int(tb[doc[i]]), bool(single[at[i]]))
            if not crowded[at[i]]:
                out.append((*rest, -1, b - base, raw[b : e + LENGTH]))
                continue
            out += [(*rest, int(a[i]) - w, w - base, hashlib.blake2b(raw[w : w + LENGTH], digest_size=DIGEST).digest()) for w in range(b, e + 1)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()))], names=["h", "p", "th", "tb", "single", "far", "at", "bytes"])


def window_keys(h: np.ndarray, far: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Anchor hash, distance and digest of windows as one string of bytes each."""
    out = np.empty((len(h), 12 + DIGEST), np.uint8)
    out[:, :8] = np.ascontiguousarray(h, np.int64).view(np.uint8).reshape(-1, 8)
    out[:, 8:12] = np.ascontiguousarray(far, np.int32).view(np.uint8).reshape(-1, 4)
    out[:, 12:] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
    return out.view(f"S{12 + DIGEST}").ravel()


def _among(batch: pa.RecordBatch, keys: np.ndarray) -> np.ndarray:
    """Which rows of (h, far, bytes, th, tb, at) have one of the sorted ``keys``."""
    if not len(keys) or not batch.num_rows:
        return np.zeros(batch.num_rows, bool)
    own = window_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist())
    return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own


def common_ranges(batches: Iterable[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows with one of ``keys`` as ranges of consecutive ones: (th, tb, b, e)."""
    for batch in batches:
        th, tb, at = (batch.column(i).to_numpy()[_among(batch, keys)] for i in (3, 4, 5))
        if len(at):
            first = np.flatnonzero(np.r_[True, (th[1:] != th[:-1]) | (tb[1:] != tb[:-1]) | (at[1:] != at[:-1] + 1)])
            last = np.r_[first[1:], len(at)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (th[first], tb[first], at[first], at[last])], names=["th", "tb", "b", "e"])


def other_windows(batches: Iterable[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows with none of ``keys``."""
    for batch in batches:
        yield batch.filter(pa.array(~_among(batch, keys)))


PIECES = "h long, p long, th long, tb long, single boolean, far int, at long, bytes binary"


def piece_key(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (_mix(h.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ p.view(np.uint64)).view(np.int64)


def sorted_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (h, p) to the window ranges of single pieces that repeat: (th, tb, b, e)."""
    held: list[tuple] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        hits = repeated_windows([r[7] for r in held])
        out: list[list[int]] = [[], [], [], []]
        for r, hit in zip(held, hits, strict=True):
            if r[4] and hit.any():
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                n = len(edge) // 2
                for col, v in zip(out, ([r[2]] * n, [r[3]] * n, (edge[::2] + r[6]).tolist(), (edge[1::2] - 1 + r[6]).tolist()), strict=True):
                    col += v
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["th", "tb", "b", "e"])

    last: tuple | None = None
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if last is not None and r[0] != last[0] and size >= CHUNK:
                yield from close()
                held, size = [], 0
            if last is None or (r[0], r[1], r[6]) != last:  # a repeated row has brought it already
                held.append(r)
                size += len(r[7])
            last = (r[0], r[1], r[6])
    if held:
        yield from close()


def remove_rows(with_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text, spans) to what is left of each text; ``spans`` are first and last repeated windows, in turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, off, data in text_blocks(batches):
            raw = data.tobytes()
            out: list[list] = [[] for _ in range(4)]
            for a, b, spans in zip(off[:-1].tolist(), off[1:].tolist(), rows.column(2).to_pylist(), strict=True):
                text, runs = raw[a:b], []
                for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e + LENGTH)
                    else:
                        runs.append([s, e + LENGTH])
                at, kept = 0, []
                for s, e in runs:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                for c, v in zip(out, (len(text), len(text) - len(left), len(runs), left if with_text else hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary() if with_text else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_text else "kept_sha256"])

    return run


def common_keys(shared: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """The keys of ``h, far, bytes, n`` with the largest ``n``, sorted, ``most`` at most, and the ``n`` from which on they are taken."""
    held = {r["e"]: r["k"] for r in shared.where(F.col("n") >= COMMON).groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("k")).collect()}  # 60 rows at most
    floor, total = 1 << 62, 0
    for e in sorted(held, reverse=True):
        total += held[e]
        if total > most:
            break
        floor = 1 << e
    got = shared.where(F.col("n") >= floor).select("h", "far", "bytes").toArrow()  # at most ``most``
    return np.sort(window_keys(got["h"].to_numpy(), got["far"].to_numpy(), got["bytes"].to_pylist())), floor


def repeats(docs: DataFrame, sent_pieces: int = SENT_PIECES, crowd: int = CROWD, sent_digests: int = SENT_DIGESTS) -> DataFrame:
    """``th, tb, spans`` of every text of ``doc_id, th, tb, text`` with repeats: ``spans`` has the first and last window of each range of repeated ones."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "th", "tb", "text")
    pieces = stage(docs.mapInArrow(piece_rows, "doc_id long, th long, tb long, h long, p long, s0 long, s1 long"), "pieces")
    again = stage(pieces.groupBy("h").agg(F.count("*").alias("k"), (F.min("p") != F.max("p")).alias("mixed")).where("k > 1").select("h", "mixed"), "again")
    met = stage(pieces.join(again, "h"), "met")
    kinds = met.where("mixed").groupBy("h", "p").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
    kinds = stage(kinds, "kinds")
    groups = stage(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd).withColumn("crowded", F.lit(True)).select("h", "crowded"), "groups")
    wanted = stage(kinds.join(groups, "h", "left").select("h", "p", "owner", (F.col("n") == 1).alias("single"), F.coalesce("crowded", F.lit(False)).alias("crowded")), "wanted")
    if wanted.count() <= sent_pieces:
        got = wanted.toArrow()  # at most sent_pieces
        h, p, owner, crowded, single = (got[c].to_numpy() for c in ("h", "p", "owner", "crowded", "single"))
        key = piece_key(h, p)
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], owner[order], crowded[order], single[order]))
        del got, h, p, owner, crowded, single

        def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from extract_rows(batches, *sent.value)

        found = docs.mapInArrow(extract, PIECES)
    else:
        lists = stage(wanted.groupBy("owner").agg(*[F.collect_list(c).alias(c) for c in ("h", "p", "crowded", "single")]), "lists")

        def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    h, p = (np.array(row.column(c)[0].as_py(), np.int64) for c in (4, 5))
                    key = piece_key(h, p)
                    order = np.argsort(key)
                    yield from extract_rows([row], key[order], np.full(len(key), row.column(0)[0].as_py()), *(np.array(row.column(c)[0].as_py(), bool)[order] for c in (6, 7)))

        found = docs.join(lists, F.col("doc_id") == F.col("owner")).select("doc_id", "th", "tb", "text", "h", "p", "crowded", "single").mapInArrow(extract, PIECES)
    found = stage(found, "found")
    ranges = found.where("far < 0").repartition(4 * parts(spark), "h").sortWithinPartitions("h", "p", "at").mapInArrow(sorted_rows, "th long, tb long, b long, e long")
    windows = found.where("far >= 0").select("h", "far", "bytes", "p", "th", "tb", "single", "at")
    shared = stage(windows.groupBy("h", "far", "bytes").agg((F.min("p") != F.max("p")).alias("shared"), F.count("*").alias("n")).where("shared").drop("shared"), "shared")
    keys, floor = common_keys(shared, sent_digests)
    known = spark.sparkContext.broadcast(keys)
    own = windows.where("single").select("h", "far", "bytes", "th", "tb", "at")
    ranges = ranges.unionByName(own.mapInArrow(lambda batches: common_ranges(batches, known.value), "th long, tb long, b long, e long"))
    rest = own.mapInArrow(lambda batches: other_windows(batches, known.value), "h long, far int, bytes binary, th long, tb long, at long")
    ranges = ranges.unionByName(rest.join(shared.where(F.col("n") < floor), ["h", "far", "bytes"], "left_semi").select("th", "tb", F.col("at").alias("b"), F.col("at").alias("e")))
    twice = stage(kinds.where("n > 1").select("h", "p"), "twice")
    whole = met.where("not mixed").select("th", "tb", "s0", "s1").unionByName(met.where("mixed").join(twice, ["h", "p"]).select("th", "tb", "s0", "s1"))
    every = whole.select("th", "tb", F.col("s0").alias("b"), F.col("s1").alias("e")).unionByName(ranges).distinct()
    return every.groupBy("th", "tb").agg(F.flatten(F.collect_list(F.array("b", "e"))).alias("spans"))


def without_repeats(docs: DataFrame, with_text: bool = False, sent_pieces: int = SENT_PIECES, crowd: int = CROWD, sent_digests: int = SENT_DIGESTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and ``kept`` (the bytes left) or ``kept_sha256`` of every row of ``doc_id, text``."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("th"), F.xxhash64(F.octet_length(text), F.md5(text.cast("binary"))).alias("tb"), text.alias("text"))
    spans = stage(repeats(rows, sent_pieces, crowd, sent_digests), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = spans.withColumnsRenamed({"th": "key", "tb": "key2"})
    joined = rows.join(keyed, (F.col("th") == F.col("key")) & (F.col("tb") == F.col("key2")), "left").select("id", "text", "spans")
    return joined.mapInArrow(remove_rows(with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {'kept binary' if with_text else 'kept_sha256 string'}")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
