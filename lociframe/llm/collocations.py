"""Operator 13: phrases of two to four words that occur together more than their parts would, by language.

Counting is by vertical partitioning of a suffix tree that is four words deep. The text is read three times: for the
words' counts; for those of adjacent pairs (by 40 bits of hash, so never too low); and to collect suffixes. A suffix is
cut at the end of its piece and after the last pair that may be frequent, and equal ones of a block are one row. Rows
are dealt by prefix: by their first word; if that has more suffixes than the budget of a group, by their first two; if
those have more, by all four. Each group builds the subtrees of its prefixes from its sorted suffixes, on its own, and
reads a phrase's count from the total below its node; nodes above a split prefix add up over the groups. Only frequent
phrases (at most three for every 30 words of text) are joined further.

Words are told by 64 bits of hash in the passes over the text. That no two of the corpus's words share a hash is checked
and another seed taken if they do, so counts are exact. Heavy prefixes are at most 32 a shuffle partition; the table of
frequent pairs sent to the workers has a bit for each hash and 16 MB at most (fuller at larger sizes: more suffixes are
then collected, none is lost).

A null text is empty, a null language is ``und``; empty texts and tables give no rows; repeated rows count again; other
columns are ignored. Equal scores are ranked by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, parts, stage, text_blocks

DEPTH = 4
LEAST = 30
COVER = 80
TOP = 2000
BLOCK_BYTES = 4 << 20
TABLE_BITS = 1 << 27
SPLIT = 16

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR_BITS = np.uint64((1 << 40) - 1)


class Block:
    """The words of some whole texts: their indices in ``words``, and which of them stand in one piece with the next."""

    def __init__(self, rows: pa.RecordBatch, offs: np.ndarray, raw: np.ndarray, seed: int):
        kind = _KIND[raw]
        inside = kind == 0
        left, right = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        left[1:], right[:-1] = inside[:-1], inside[1:]
        cuts = offs[1:-1]
        left[cuts[cuts < len(raw)]] = False
        right[cuts[cuts > 0] - 1] = False
        starts = np.nonzero(inside & ~left)[0]
        ends = np.nonzero(inside & ~right)[0] + 1
        size = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=size[1:])
        body = _LOWER[raw[inside]]
        every = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(body)]).dictionary_encode()
        self.words, self.index = every.dictionary, every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.searchsorted(offs, starts, "right") - 1
        piece = np.cumsum(kind == _BREAK)[starts] + doc if len(starts) else doc
        self.joined = np.append(piece[1:] == piece[:-1], False) if len(starts) else np.zeros(0, bool)
        langs = rows.column(rows.schema.get_field_index("lang")).fill_null("und").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        hashes = lambda a, s: np.array([xxhash.xxh64_intdigest(w, s) for w in a.cast(pa.binary()).to_pylist()], np.uint64)
        self.codes, self.lang_codes = hashes(self.words, seed), hashes(self.langs, seed)

    def pair_hash(self, lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return _mix(self.lang_codes[lang], self.codes[one], self.codes[two])


def _mix(*values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values[0]), np.uint64)
    for v in values:
        out = (out ^ v) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _counted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row of each distinct combination of ``keys``, and how many rows have it."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        sorted_key = k[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    starts = np.nonzero(new)[0]
    return order[starts], np.diff(np.append(starts, n))


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offs, raw in text_blocks(batches, limit=BLOCK_BYTES):
        b = Block(rows, offs, raw, 0)
        at, n = _counted(b.lang * len(b.words) + b.index)
        yield pa.RecordBatch.from_arrays([b.langs.take(pa.array(b.lang[at])), b.words.take(pa.array(b.index[at])), pa.array(n)],
            names=["lang", "word", "n"])


def _pair_counts(seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs, raw in text_blocks(batches, limit=BLOCK_BYTES):
            b = Block(rows, offs, raw, seed)
            i = np.nonzero(b.joined)[0]
            at, n = _counted((b.lang[i] * len(b.words) + b.index[i]) * len(b.words) + b.index[i + 1])
            i = i[at]
            h = b.pair_hash(b.lang[i], b.index[i], b.index[i + 1]) & _PAIR_BITS
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["pair", "n"])

    return run


def _suffixes(seed: int, table: np.ndarray, heavy_words: np.ndarray, heavy_pairs: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]],
    Iterator[pa.RecordBatch]]:
    """(grp, whole, lang, c1..c4, n): suffixes with counts, dealt by ``grp``; nodes of at least ``whole`` words are in one group."""
    mask = np.uint64(len(table) * 64 - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs, raw in text_blocks(batches, limit=BLOCK_BYTES):
            b = Block(rows, offs, raw, seed)
            total, width = len(b.index), len(b.words) + 1
            pair = np.zeros(total, np.uint64)
            i = np.nonzero(b.joined)[0]
            pair[i] = b.pair_hash(b.lang[i], b.index[i], b.index[i + 1]) & _PAIR_BITS
            bit = pair & mask
            going = b.joined & ((table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1)
            two = np.nonzero(going)[0]
            words = [b.index[two] + 1, b.index[two + 1] + 1]
            alive = np.ones(len(two), bool)
            padded = np.append(going, [False] * DEPTH)
            longer = np.append(b.index, [0] * DEPTH)
            for d in range(2, DEPTH):
                alive = alive & padded[two + d - 1]
                words.append(np.where(alive, longer[two + d] + 1, 0))
            at, n = _counted((b.lang[two] * width + words[0]) * width + words[1], words[2] * width + words[3])
            two, words = two[at], [w[at] for w in words]
            codes = np.append(np.zeros(1, np.uint64), b.codes)
            c = [codes[w] for w in words]
            lang = b.lang_codes[b.lang[two]]
            first, second = _mix(lang, c[0]), pair[two]
            split = np.isin(first, heavy_words)
            again = split & np.isin(second, heavy_pairs)
            grp = np.where(again, _mix(second, c[2], c[3]), np.where(split, _mix(second), first))
            whole = np.where(again, DEPTH, np.where(split, 2, 1)).astype(np.int32)
            names = ["grp", "whole", "lang", "c1", "c2", "c3", "c4", "n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grp.view(np.int64)), pa.array(whole), b.langs.take(pa.array(b.lang[two])),
                    *[pa.array(x.view(np.int64)) for x in c], pa.array(n)], names=names
            )

    return run


def _subtrees(least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted suffixes to nodes of two to four words with totals; those of whole prefixes only if frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("lang", "whole", "c1", "c2", "c3", "c4", "n")}
            lang = col["lang"].dictionary_encode()
            keys = [lang.indices.to_numpy(zero_copy_only=False), *[col[f"c{d}"].to_numpy() for d in range(1, DEPTH + 1)]]
            n, whole = col["n"].to_numpy(), col["whole"].to_numpy()
            new = np.zeros(rows, bool)
            new[0] = True
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
            for depth in range(2, DEPTH + 1):
                new[1:] |= keys[depth][1:] != keys[depth][:-1]
                starts = np.nonzero(new)[0]
                totals = np.add.reduceat(n, starts)
                keep = (totals >= least) | (whole[starts] > depth)
                keep[[0, -1]] = True  # may go on in the batch before or after
                keep &= keys[depth][starts] != 0
                at = starts[keep]
                if len(at):
                    cs = [keys[d][at] if d <= depth else np.zeros(len(at), np.int64) for d in range(1, DEPTH + 1)]
                    yield pa.RecordBatch.from_arrays([col["lang"].take(pa.array(at)), *[pa.array(x) for x in cs], pa.array(totals[keep])],
                        names=["lang", "c1", "c2", "c3", "c4", "n"])

    return run


def _seed(words: DataFrame) -> tuple[int, Column]:
    """A seed with which no two of the words have one hash and none has 0, and the hash as a column."""
    spark = words.sparkSession
    one = words.select("word").distinct()
    for attempt in range(16):
        code = F.xxhash64(F.lit(attempt), F.col("word"))
        twice = one.groupBy(code.alias("c")).agg(F.count("*").alias("k")).where("k > 1 or c = 0")
        if twice.isEmpty():
            return spark.range(1).select(F.xxhash64(F.lit(attempt))).first()[0] & ((1 << 64) - 1), code
    raise RuntimeError("words share their hashes with each of 16 seeds")


def _bit_table(pairs: DataFrame) -> np.ndarray:
    """A bit for each pair's hash, in 64-bit words: 16 bits or more a pair, up to ``TABLE_BITS`` in all."""
    bits = min(TABLE_BITS, max(1 << 13, 1 << (16 * pairs.count()).bit_length()))
    at = F.col("pair").bitwiseAND(bits - 1)
    found = pairs.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((pair & {bits - 1}) & 63 as int))"))
        .alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def phrase_counts(docs: DataFrame, least: int = LEAST, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """All words ``lang, word, n``, and the phrases of two to four words that occur ``least`` times, ``lang, words, a``; both written tables."""
    spark = docs.sparkSession
    rows = only(docs, "lang", "text").withColumns({"lang": F.col("lang").cast("string"), "text": F.col("text").cast("string")})
    words = stage(rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "words")
    seed, code = _seed(words)
    pairs = stage(rows.mapInArrow(_pair_counts(seed), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least), "pairs")
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(least, total // (split * parts(spark)))
    hot = words.where(F.col("n") > budget).select("lang", "word").collect()  # at most split a shuffle partition, as are the pairs
    u64 = lambda w: xxhash.xxh64_intdigest(w.encode(), seed)
    heavy_words = np.unique(_mix(*(np.array([u64(r[c]) for r in hot], np.uint64) for c in ("lang", "word"))))
    heavy_pairs = np.array(sorted(r["pair"] for r in pairs.where(F.col("n") > budget).select("pair").collect()), np.uint64)
    dealt = rows.mapInArrow(_suffixes(seed, _bit_table(pairs), heavy_words, heavy_pairs),
        "grp long, whole int, lang string, c1 long, c2 long, c3 long, c4 long, n long")
    codes = ["c1", "c2", "c3", "c4"]
    groups = dealt.repartition(parts(spark), "grp").sortWithinPartitions("lang", *codes)
    nodes = groups.mapInArrow(_subtrees(least), "lang string, c1 long, c2 long, c3 long, c4 long, n long")
    frequent = stage(nodes.groupBy("lang", *codes).agg(F.sum("n").alias("a")).where(F.col("a") >= least), "nodes")
    names = words.where(F.col("n") >= least).select(code.alias("code"), "word").distinct()
    each = frequent.select("*", F.posexplode(F.array(*codes)).alias("at", "code")).where("code <> 0").join(names, "code")
    spelt = each.groupBy("lang", *codes, "a").agg(F.array_sort(F.collect_list(F.struct("at", "word")))["word"]
        .alias("words"))  # four words at most
    return words, stage(spelt.select("lang", "words", "a"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, split: int = SPLIT) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut with the lowest score, which is 1000000 times
    the share of the parts' mean count that the phrase has. Phrases that lie in a longer one with ``cover`` % of their count are dropped.
    """
    words, phrases = phrase_counts(docs, least, split)
    text = lambda start, n: F.concat_ws(" ", F.slice("words", start, n))
    size = F.size("words")
    counts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    counts = counts.unionByName(phrases.select("lang", F.concat_ws(" ", "words").alias("part"), F.col("a").alias("f")))
    cuts = phrases.select("*", F.concat_ws(" ", "words").alias("phrase"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("head"),
        text(F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: text(s, m))))
    longer = phrases.where(size > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang",
        "phrase").agg(F.max("a").alias("over"))
    own = scored.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (whole("over") * 100 < whole("a") * cover))
    ranked = own.withColumn("rank",
        F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
        "cut.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
 FROM lists, range(1, {DEPTH + 1}) sizes(m) WHERE len(ws) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
cands AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:m], ' ') AS rest FROM cands, range(1,
 {DEPTH}) ks(k) WHERE k < m),
scored AS (SELECT c.*, h.f AS l, r.f AS r, (2000000::HUGEINT * a // (h.f + r.f))::BIGINT AS score FROM cuts c
 JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, max(a) AS over, array_to_string(ws[s:s + k - 1], ' ') AS phrase FROM cands, range(2, {DEPTH}) ks(k), range(1,
 {DEPTH}) ss(s) WHERE k < m AND s + k - 1 <= m GROUP BY ALL),
own AS (SELECT b.* FROM best b LEFT JOIN inner_ i USING (lang, phrase) WHERE i.over IS NULL OR 100 * i.over::HUGEINT < {COVER} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM own
 JOIN totals USING (lang) QUALIFY rank <= {TOP}"""
