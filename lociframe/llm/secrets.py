"""Operator 4: secret scans.

Three patterns give the base spans. The method adds what they miss: a long string without blanks that
stands near a sensitive word (before or after it), or follows a reported one after blanks or line ends, is
measured by zstandard, primed with a dictionary of identifiers and with the text around it, other copies of
the string cut out; its marginal compressed bytes over those of an empty frame tell how much of it is new.
Strings of at least ``NOVEL_BYTES`` new bytes and ``NOVEL_SHARE`` of their length are reported as ``novel``.
Base spans are measured alike, and every span comes with its new bytes. The dictionary has the words of all
texts that save the most bytes (count times length), ``DICTIONARY_BYTES`` in all, beside a few that all code
has; words that mix letters and digits as secrets do are no part of it. Spans are in code points,
the end exclusive.

Null texts are empty and have no spans; repeated rows are scanned again; whole texts are scanned; an empty
table gives no rows and adds nothing to the dictionary.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, stage, text_blocks

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
NOT_BLANK = re.compile(r"\S")
STRING = re.compile(r"[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_.=-]{10,})[A-Za-z0-9+/_=-]")
SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)?|secret|token|api[_-]?key|[_-]key\b|\bkey\b|auth|bearer|credential|private|signature|\bpwd\b", re.I | re.A)
SENSITIVE_BYTES = (b"pass", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"private", b"signature", b"pwd")
ASSIGN_BYTES = (b"password", b"passwd", b"secret", b"token", b"api")
CONTEXT = 64
AROUND = 1024
PIECE = 48
NOVEL_BYTES = 12
NOVEL_SHARE = 0.75
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 configuration application authentication authorization "
    "environment connection parameters description information credentials certificate certificates permission repository "
    "transaction controller implementation initialization javascript typescript namespace interface exception attribute "
    "public static final private protected return function default import export class package version response request "
    "password secret token api_key apikey access_key private_key client_id client_secret username localhost example.com "
    "https://www.example.com/index.html /usr/local/lib/python site-packages node_modules src/main/java/com/org/test/resources "
    "your-token-here changeme placeholder xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 ------------------------ ========================"
).encode()
DICTIONARY_BYTES = 16_384
LEAST_WORD, LONGEST_WORD = 4, 64
HELD_WORDS = 400_000
_WORD = bytes(c if chr(c).isalnum() and c < 128 or c in b"_-." or c >= 128 else 32 for c in range(256))


def word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text) to counts of identifiers: runs of letters, digits and ``_-.``."""
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"])
        held.clear()
        return out

    for _, off, data in text_blocks(batches):
        raw = data.tobytes().translate(_WORD)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            held.update(raw[a:b].split())
        for w in [w for w in held if not LEAST_WORD <= len(w) <= LONGEST_WORD]:
            del held[w]
        if len(held) > HELD_WORDS:
            yield flush()
    yield flush()


def identifiers(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The words of all texts that save the most bytes, the best last (zstandard reaches the end of a dictionary most cheaply)."""
    counts = only(docs, "text").mapInArrow(word_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stage(counts.withColumn("saved", F.col("n") * F.octet_length("word")), "words")
    most = size // (LEAST_WORD + 1)  # words that the dictionary can hold
    sizes = counts.groupBy(F.floor(F.log2("saved")).alias("power")).agg(F.count("*").alias("k")).orderBy(F.desc("power")).collect(
        )  # 64 rows at most
    least, held = 0, 0
    for r in sizes:  # only words that may be among the best are sorted
        held, least = held + r["k"], r["power"]
        if held >= most:
            break
    best = counts.where(F.floor(F.log2("saved")) >= least).orderBy(F.desc("saved"), "word").limit(most).collect()
    out, left = [], size
    for r in best:
        word = bytes(r["word"])
        if len(word) + 1 <= left and not (len(word) >= NOVEL_BYTES
            and mixed(word.decode("utf-8", "replace"))):  # it could be a secret itself
            out.append(word)
            left -= len(word) + 1
    return IDENTIFIERS + b" " + b" ".join(out[::-1])


def novelty(candidate: bytes, around: bytes, known: bytes = IDENTIFIERS) -> int:
    """Marginal compressed bytes of ``candidate`` where the identifiers ``known`` and the text around it are given."""
    primer = known + b" " + around
    data = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
    primed = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False)
    return len(primed.compress(candidate)) - len(primed.compress(b""))


def text_around(text: str, start: int, end: int) -> str:
    """The text on both sides of a candidate without other copies of it, or of what it has after an equals sign."""
    s = text[start:end]
    reach = AROUND + len(s)  # so that copies cut by the edge are seen whole
    before, after = text[max(0, start - reach) : start], text[end : end + reach]
    for part in sorted({s, *(x for x in s.split("=") if len(x) >= NOVEL_BYTES)}, key=lambda x: (-len(x), x)):
        before, after = (x.replace(part, "\0" * len(part)) for x in (before, after))
    return (before[-AROUND:] + after[:AROUND]).replace("\0", "")


Span = tuple[int, int, int, int]  # start, kind, end, new bytes


def measured(text: str, start: int, end: int, known: bytes) -> int:
    """New bytes of a span. Of a long one each piece is measured after what stands before it in the span, as zstandard codes the letters of
    long inputs by their frequency, which would make a secret of few different letters look less new the longer it is."""
    around = text_around(text, start, end).encode()
    if end - start <= PIECE + PIECE // 2:
        return novelty(text[start:end].encode(), around, known)
    total = 0
    for at in range(start, end - PIECE // 2, PIECE):
        stop = at + PIECE if end - at - PIECE >= PIECE // 2 else end
        total += novelty(text[at:stop].encode(), around + text[max(start, at - AROUND) : at].encode(), known)
    return total


def base_spans(text: str, low: bytes, raw: bytes, known: bytes = IDENTIFIERS) -> list[Span]:
    """The three patterns' matches; ``low`` and ``raw`` are the text's bytes and tell what can be skipped. Of an assignment its value is measured."""
    found = []
    if any(x in low for x in ASSIGN_BYTES):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted((s, k, e, measured(text, v, e, known)) for s, k, e, v in found)


def near_sensitive(text: str, start: int, end: int) -> bool:
    return bool(SENSITIVE.search(text, max(0, start - CONTEXT), start) or SENSITIVE.search(text, end, end + CONTEXT))


def mixed(s: str) -> bool:
    """Letters with digits, or capitals inside of a word."""
    return any(c.isalpha() for c in s) and (any(c.isdigit() for c in s)
        or any(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)))


def novel_spans(text: str, low: bytes, base: list[Span], known: bytes = IDENTIFIERS) -> list[Span]:
    """Incompressible strings near a sensitive word, clear of ``base`` (sorted, each end the largest so far)."""
    if not any(x in low for x in SENSITIVE_BYTES):
        return []
    out, at, told = [], 0, -1  # told: the end of the last span that is surely of a secret
    word_at, word = -1, -1  # the first place after ``told`` that is not blank, looked for once
    for m in STRING.finditer(text):
        s = m.group()
        if not mixed(s):
            continue
        while at < len(base) and base[at][2] <= m.start():
            told = base[at][2] if base[at][1] < 2 else told
            at += 1
        if told >= 0 and word_at != told:
            found = NOT_BLANK.search(text, told)
            word_at, word = told, found.start() if found else len(text)
        carried = 0 <= told <= m.start() <= word  # only blanks or line ends part it from the secret before it
        if (at < len(base) and base[at][0] < m.end()) or not (carried or near_sensitive(text, m.start(), m.end())):
            continue
        new = measured(text, m.start(), m.end(), known)
        if new >= NOVEL_BYTES and new >= NOVEL_SHARE * len(s):
            out.append((m.start(), 3, m.end(), new))
            told = m.end()
    return out


def find(raw: bytes, known: bytes = IDENTIFIERS) -> list[Span]:
    """All spans of a text given as UTF-8, by start, then kind."""
    low, text = raw.lower(), raw.decode("utf-8", "replace")
    base = base_spans(text, low, raw, known)
    longest, reach = [], 0
    for s in base:
        reach = max(reach, s[2])
        longest.append((s[0], s[1], reach, s[3]))
    return sorted(base + novel_spans(text, low, longest, known))


def scan_rows(known: bytes) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text) to (doc_id, spans)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, off, data in text_blocks(batches):
            raw = data.tobytes()
            spans = [find(raw[a:b], known) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            lists = [[{"kind": KINDS[k], "start": s, "end": e, "new_bytes": n} for s, k, e, n in x] for x in spans]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lists, SPANS)], names=["doc_id", "spans"])

    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("new_bytes", pa.int64())]))
SPANS_SQL = "array<struct<kind:string,start:long,end:long,new_bytes:long>>"


def scan(docs: DataFrame, known: bytes | None = None) -> DataFrame:
    """``doc_id`` and its ``spans``, an array of ``kind, start, end, new_bytes``, for each row of ``doc_id, text``.

    ``known`` is the dictionary of identifiers, by default that of ``docs``.
    """
    known = identifiers(docs) if known is None else known
    return only(docs, "doc_id", "text").mapInArrow(scan_rows(known),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS_SQL}")


def redact_rows(mark: str, known: bytes) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            chars = batch.schema.get_field_index("n_chars")
            counted = chars >= 0 and pa.types.is_integer(batch.schema.field(chars).type)  # other columns of that name are not counts
            for rows, off, data in text_blocks([batch]):
                raw, out, sizes = data.tobytes(), rows.column(at).to_pylist(), rows.column(chars).to_pylist() if counted else []
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    if spans := find(raw[a:b], known):
                        text, done, kept = out[i], 0, []
                        for s, _, e, _ in spans:
                            if s >= done:
                                kept += [text[done:s], mark]
                            done = max(done, e)
                        out[i] = "".join([*kept, text[done:]])
                        if sizes:
                            sizes[i] = len(out[i])
                cols = list(rows.columns)
                cols[at] = pa.array(out, rows.schema.field(at).type)
                if sizes:
                    cols[chars] = pa.array(sizes, rows.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(cols, names=rows.schema.names)

    return run


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (``n_chars`` follows where there is such a column of whole numbers)."""
    return docs.mapInArrow(redact_rows(mark, identifiers(docs)), docs.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    new = F.array_join(F.transform("spans", lambda x: x["new_bytes"].cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"), count("novel"), new.alias("new_bytes"))
