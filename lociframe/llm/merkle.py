"""Operator 12: a Merkle manifest of a dataset: a tree of three-way hashes a source, and one over the sources.

Leaves are hashed where the rows are read and dealt by ranges of (source, id), so a source of any size is many tasks;
a leaf's place in its source follows from the counts of the ranges before. Blocks of 3**6 consecutive leaves start at
multiples of that number, so that their roots are nodes of the whole tree. A block grows by appends: a new node takes
its left siblings as the start of its witness, every node already in its run takes the new one, and a full run closes
into its parent, which is appended one level up. Block roots are appended the same way, round by round, until each
source has one root, and the roots of the sources once more. A leaf's witness is its own block's, then its block
root's, and so on; blocks, not leaves, are joined.

A hash is the lowercase hexadecimal SHA-256 of its inputs laid end to end, digests as that text. A leaf has, for each of
``doc_id, source, lang, n_chars, text``, ``-`` if null, else the number of UTF-8 bytes, ``:`` and the value. In a source
leaves ascend by id, null first, then by leaf; equal rows are leaves of their own. A lone node is no run: it stays itself.
An empty table gives no rows; other columns are ignored; texts and trees of any size are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, parts, stage

ARITY = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]),
        256)


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Subtree:
    """A tree of ``levels`` levels that grows by appends; ``witness[i]`` is what leaf ``i`` has of its siblings so far."""

    def __init__(self, levels: int = LEVELS, arity: int = ARITY):
        self.arity, self.runs, self.witness = arity, [[] for _ in range(levels + 1)], []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._add(0, digest, len(self.witness) - 1, len(self.witness))

    def _add(self, level: int, digest: str, first: int, end: int) -> None:
        run = self.runs[level]
        left = [d for d, _, _ in run]
        for i in range(first, end):
            self.witness[i] += left
        for _, a, b in run:
            for i in range(a, b):
                self.witness[i].append(digest)
        run.append((digest, first, end))
        if len(run) == self.arity and level + 1 < len(self.runs):
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._add(level + 1, hashed("".join(d for d, _, _ in run)), run[0][1], run[-1][2])

    def root(self, whole: bool) -> str:
        """Open runs closed: up to the last level, or if this is the ``whole`` tree only while there is more than one node."""
        for level in range(len(self.runs) - 1):
            run = self.runs[level]
            if whole and len(run) == 1 and not any(self.runs[level + 1 :]):
                return run[0][0]
            if run:
                self._close(level)
        return self.runs[-1][0][0]


def fold(digest: str, places: Iterable[tuple[int, int]], witness: str) -> str:
    """The root that a leaf and its siblings give; ``places`` are the leaf's place among how many, tree by tree."""
    width, at = len(digest), 0
    for pos, n in places:
        while n > 1:
            own = pos % ARITY
            others = (min(ARITY, n - pos + own) - 1) * width
            cut = at + own * width
            digest = hashed(witness[at:cut] + digest + witness[cut : at + others])
            at += others
            pos, n = pos // ARITY, -(-n // ARITY)
    return digest


def _run_numbers(key: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by ``key`` with ``i``, their number among those of one key in this partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(key))
            n = len(col)
            if not n:
                continue
            codes = col.dictionary_encode()
            idx = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.nonzero(np.diff(idx))[0] + 1])
            number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            first_end = starts[1] if len(starts) > 1 else n
            if col[0].as_py() == last:
                number[:first_end] += seen
            last, seen = col[n - 1].as_py(), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int64))], names=[*batch.schema.names, "i"])

    return run


def placed(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``pos``, the place of a row among those of its ``key`` in ``order``, and ``n``, how many these are; keys are not null."""
    cols = [F.col(key), *[F.col(o).asc_nulls_first() for o in order]]
    ranges = df.repartitionByRange(parts(df.sparkSession), *cols).sortWithinPartitions(*cols).withColumn("p", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields) + ", i long"
    rows = stage(ranges.mapInArrow(_run_numbers(key), schema), "placed")
    sizes = rows.groupBy(key, "p").agg(F.count("*").alias("k"))  # a row a partition and key
    w = Window.partitionBy(key)
    before = F.sum("k").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "p", F.coalesce(before, F.lit(0)).alias("before"), F.sum("k").over(w).alias("n"))
    return rows.join(sizes, [key, "p"]).withColumn("pos", F.col("before") + F.col("i")).drop("p", "i", "before")


def _grow(levels: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes sorted by (key, block, pos) with ``witness`` within their block and the block's ``root``."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        tree = Subtree(levels)
        for d in rows.column(rows.schema.get_field_index("digest")).to_pylist():
            tree.append(d)
        n = rows.column(rows.schema.get_field_index("n"))[0].as_py()
        root = tree.root(n <= ARITY**levels)
        witness = pa.array([bytes.fromhex("".join(w)) for w in tree.witness], pa.binary())
        return pa.RecordBatch.from_arrays([*rows.columns, witness, pa.array([root] * len(rows))],
            names=[*rows.schema.names, "witness", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "block")), strict=True))
            at = 0
            for i, k in enumerate(keys):
                if k != last:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        yield close(held)
                    held, at, last = [], i, k
            if len(keys) > at:
                held.append(batch.slice(at))
        if held:
            yield close(held)

    return run


def tree_rounds(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of block trees over ``key, pos, n, digest`` and other columns, each round's nodes with ``block, witness, root``."""
    size, rounds, now = ARITY**levels, [], nodes
    while True:
        cut = now.withColumn("block", F.floor(F.col("pos") / size)).repartition(parts(now.sparkSession), "key",
            "block").sortWithinPartitions("key", "block", "pos")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", witness binary, root string"
        done = stage(cut.mapInArrow(_grow(levels), schema), "blocks")
        rounds.append(done)
        top = done.agg(F.max("n")).first()[0] or 0
        if top <= size:
            return rounds
        now = done.where(F.col("pos") % size == 0).select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"),
            F.col("root").alias("digest"))


def full_witnesses(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's nodes with whole witnesses: ``above`` has ``key``, its tree's ``subroot`` and what follows from there as ``up``."""
    up = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds[1:]):
        joined = nodes.join(up, ["key", "block"]).withColumn("up", F.concat("witness", "up"))
        up = joined.select("key", F.col("pos").alias("block"), *[c for c in above.columns if c != "key"])
    return rounds[0].join(up, ["key", "block"]).withColumn("up", F.concat("witness", "up"))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "digest", "subroot", "top", "tampered", "pos", "n", "s_pos", "s_n", "up"]
    for batch in batches:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
        proofs, folded = [], []
        for leaf, changed, pos, n, s_pos, s_n, up in zip(
            *(cols[c].to_pylist() for c in ("digest", "tampered", "pos", "n", "s_pos", "s_n", "up")), strict=True):
            text = up.hex()
            proofs.append(hashed(text))
            folded.append(fold(leaf if changed is None else changed, ((pos, n), (s_pos, s_n)), text))
        roots = cols["top"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [cols["doc_id"], cols["digest"], cols["subroot"], cols["top"], pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                pa.array([a == b for a, b in zip(folded, roots, strict=True)], pa.bool_())],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def manifest(docs: DataFrame, altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A row a document: its leaf, the roots above it, its proof's digest, and whether leaf and proof give the root.

    ``altered`` is the text to check in place of ``text``, null texts stay null: with it, ``verified`` tells which rows have changed since.
    """
    rows = only(docs, *FIELDS)
    now = F.col("text") if altered is None else F.when(F.col("text").isNotNull(), altered)
    same = F.col("text").eqNullSafe(now)
    others = [F.col(c) for c in FIELDS[:-1]]
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
            F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(*others, F.col("text")).alias("digest"), F.when(~same, leaf_hash(*others, now)).alias("tampered"),
    )
    rounds = tree_rounds(placed(leaves, "key", ["doc_id", "digest"]), levels)
    subroots = rounds[-1].where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest"))
    over = tree_rounds(placed(subroots, "key", ["name"]), levels)
    top = over[-1].where("pos = 0").select("key", F.col("root").alias("top"), F.lit(b"").alias("up"))
    above = full_witnesses(over, top).select(F.col("name").alias("key"), F.col("digest").alias("subroot"), "top",
        F.col("pos").alias("s_pos"), F.col("n").alias("s_n"), "up")
    whole = full_witnesses(rounds, above)
    return whole.mapInArrow(_verify,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, against texts whose line ends are deleted where 2 divides the crc32 of the id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


_RUN = "string_agg(d, '' ORDER BY i)"
_LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in FIELDS)

#: Bitwise CRC-32 of the id's digits; then levels of runs of three from the leaves up, and proofs folded along them.
OP12_SQL = f"""WITH RECURSIVE crcs AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, range(0,
 8 * length(CAST(doc_id AS VARCHAR)))), lambda c, k:
  CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, ascii(CAST(doc_id AS VARCHAR)[(k // 8 + 1)::INTEGER])::BIGINT) ELSE c END) % 2 = 1
  THEN xor((CASE WHEN k % 8 = 0 THEN xor(c, ascii(CAST(doc_id AS VARCHAR)[(k // 8 + 1)::INTEGER])::BIGINT) ELSE c END) // 2, 3988292384)
  ELSE (CASE WHEN k % 8 = 0 THEN xor(c, ascii(CAST(doc_id AS VARCHAR)[(k // 8 + 1)::INTEGER])::BIGINT) ELSE c END) // 2 END) AS c
 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
rows0 AS (SELECT d.*, coalesce('=' || d.source, '') AS key, CASE WHEN c % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS altered
 FROM documents d LEFT JOIN crcs USING (doc_id)),
hashes AS (SELECT key, doc_id, sha256({_LEAF}) AS leaf, sha256({_LEAF.replace("text", "altered")}) AS now FROM rows0),
leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n
 FROM hashes),
low AS (SELECT key, 0 AS level, i, n, leaf AS d FROM leaves UNION ALL
 SELECT key, level + 1, i // 3, (any_value(n) + 2) // 3, sha256({_RUN}) FROM low WHERE n > 1 GROUP BY key, level, i // 3),
subs AS (SELECT key, d, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, i, n, d FROM subs UNION ALL SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256({_RUN}) FROM high
 WHERE n > 1 GROUP BY level, i // 3),
every AS (SELECT '=' || key AS key, level, i, d FROM low UNION ALL SELECT '', level, i, d FROM high),
walk AS (SELECT row_number() OVER () AS id, doc_id, leaf, now, key, 0 AS level, i, n, false AS upper, now AS d, '' AS proof FROM leaves
 UNION ALL
 SELECT w.id, w.doc_id, w.leaf, w.now, w.key, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.i // 3 ELSE s.i END,
 CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE s.n END, w.upper OR w.n = 1,
  CASE WHEN w.n = 1 THEN w.d ELSE sha256(concat(CASE WHEN w.i % 3 = 0 THEN w.d ELSE a.d END, CASE WHEN w.i % 3 = 1 THEN w.d ELSE b.d END,
 CASE WHEN w.i % 3 = 2 THEN w.d ELSE c.d END)) END,
  CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || concat(CASE WHEN w.i % 3 <> 0 THEN a.d END, CASE WHEN w.i % 3 <> 1 THEN b.d END, CASE
 WHEN w.i % 3 <> 2 THEN c.d END) END
 FROM walk w JOIN subs s USING (key)
 LEFT JOIN every a ON a.key = CASE WHEN w.upper THEN '' ELSE '=' || w.key END AND a.level = w.level AND a.i = w.i // 3 * 3
 LEFT JOIN every b ON b.key = CASE WHEN w.upper THEN '' ELSE '=' || w.key END AND b.level = w.level AND b.i = w.i // 3 * 3 + 1
 LEFT JOIN every c ON c.key = CASE WHEN w.upper THEN '' ELSE '=' || w.key END AND c.level = w.level AND c.i = w.i // 3 * 3 + 2
 WHERE w.n > 1 OR NOT w.upper)
SELECT w.doc_id, w.leaf, s.d AS subroot, r.d AS root, sha256(w.proof) AS proof_sha256, w.d AS folded_root, w.d = r.d AS verified FROM walk w
 JOIN subs s USING (key), (SELECT d FROM high WHERE n = 1) r WHERE w.upper AND w.n = 1"""
