"""Joins (JN) and taxonomy."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import draw
from ..scratch import materialise
from .sets import dedup
from .windows import row_index

#: Taxonomic ranks from the highest to the lowest.
RANKS = (
    "acellular root", "cellular root", "domain", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass", "class",
        "subclass", "infraclass",
    "cohort", "subcohort", "superorder", "order", "suborder", "infraorder", "parvorder", "superfamily", "family", "subfamily", "tribe",
        "subtribe", "genus", "subgenus",
    "section", "subsection", "series", "species group", "species subgroup", "species", "subspecies", "varietas", "subvariety", "forma",
        "forma specialis", "strain",
    "isolate", "biotype", "genotype", "morph", "pathogroup", "serogroup", "serotype",
)


def rank_level(rank):
    """Levels above the lowest rank; null for ranks without a place."""
    table = F.create_map(*[F.lit(v) for i, r in enumerate(RANKS) for v in (r, len(RANKS) - i)])
    return table[rank]


def _first_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return dedup(df, key)


def join_sample_meta(df: DataFrame, meta: DataFrame, id_col: str = "sample", cols: Sequence[str] | None = None) -> DataFrame:
    """JN1: left join with one metadata row a sample."""
    meta = meta.select(id_col, *cols) if cols else meta
    return df.join(_first_rows(meta, [id_col]), id_col, "left")


def with_metadata(df: DataFrame, kinds: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """JN2: successive left joins, each table by its own keys, one row a key."""
    for meta, left, right in kinds.values():
        meta = _first_rows(meta, [right])
        meta = meta.select(F.col(right).alias("_key"), *[c for c in meta.columns if c != right and c not in df.columns])
        df = df.join(meta, F.col(left) == F.col("_key"), "left").drop("_key")
    return df


def _first_containers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of a key and bin by ascending start, right ones first, to each left one's first container.

    A right interval can be the first only if it ends after all before it, so only those are kept, by rising ends.
    """
    stops, rows, key = [], [], None
    for batch in batches:
        found: list[tuple] = []
        for k, uid, stop, place in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
            for c in ("_key", "_uid", "_e", "_place")), strict=True):
            if k != key:
                stops, rows, key = [], [], k
            if place is not None:
                if not stops or stop > stops[-1]:
                    stops.append(stop)
                    rows.append(place)
            elif (i := bisect_left(stops, stop)) < len(stops):
                found.append((uid, rows[i]))
        yield _met(found)


def _first_contained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of a key and bin by descending start, right ones first, to each left one's first contained.

    A right interval hides those after it that end no sooner; the others' ends fall from the first on.
    """
    stops, rows, key = [], [], None
    for batch in batches:
        found: list[tuple] = []
        for k, uid, stop, place in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
            for c in ("_key", "_uid", "_e", "_place")), strict=True):
            if k != key:
                stops, rows, key = [], [], k
            if place is not None:
                while stops and stops[-1] >= stop:
                    stops.pop()
                    rows.pop()
                stops.append(stop)
                rows.append(place)
            elif i := bisect_right(stops, stop):
                found.append((uid, rows[i - 1]))
        yield _met(found)


def _met(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
        names=["_uid", "_place"])


def interval_within(left: DataFrame, right: DataFrame, on: Sequence[str], start: str = "start", stop: str = "stop", uid: str = "uid",
    bin_size: int = 10_000) -> DataFrame:
    """JN3: left rows with the first right row (by start, stop, then its hash) of equal keys that contains or is contained in them; the others with nulls.

    Intervals are dealt to bins of ``bin_size``, so that a contig with many features is many keys. In a bin a sweep over the starts
    finds each left row's first container and a sweep back its first contained row: a match a row and bin leaves them, however deep
    features nest. A container covers the left row's first bin; a contained row starts in one of its bins. Rows whose key, start or stop
    is null meet none.
    """
    rest = [c for c in right.columns if c not in on and c not in (start, stop)]
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col(start).alias("_start"), F.col(stop).alias("_stop"),
        F.xxhash64(*rest).alias("_hash") if rest else F.lit(0).cast("long").alias("_hash"), *rest)
    r = materialise(row_index(named, ["_start", "_stop", "_hash"], "_place",
        start=0))  # the place in the order in which the first is chosen
    l = materialise(row_index(left.select(uid, *on, start, stop), [uid], "_uid", start=0))
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.greatest(s, e) / bin_size)))
    first = lambda s: F.floor(F.col(s) / bin_size)
    known = lambda df, cols: df.na.drop(subset=cols)
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def sweep(lrows: DataFrame, rrows: DataFrame, run: Callable, down: bool) -> DataFrame:
        none, bin_ = F.lit(None).cast("long"), F.col("_bin").alias("bin")
        lone = lrows.select(F.struct(*on, bin_).alias("_k"), "_uid", F.col(start).alias("_s"), F.col(stop).alias("_e"),
            none.alias("_place"))
        rone = rrows.select(F.struct(*[F.col(f"_r_{c}").alias(c) for c in on], bin_).alias("_k"), none.alias("_uid"),
            F.col("_start").alias("_s"), F.col("_stop").alias("_e"), "_place")
        order = [F.desc("_s"), F.desc_nulls_last("_place")] if down else [F.asc("_s"), F.asc_nulls_last("_place")]
        both = lone.union(rone).repartition(parts, "_k").sortWithinPartitions("_k", *order)
        return both.select(F.to_json("_k").alias("_key"), "_uid", "_e", "_place").mapInArrow(run, "_uid long, _place long")

    lefts, rights = known(l, [*on, start, stop]), known(r, [*[f"_r_{c}" for c in on], "_start", "_stop"])
    around = sweep(lefts.withColumn("_bin", first(start)), rights.withColumn("_bin", bins("_start", "_stop")), _first_containers, False)
    inside = sweep(lefts.withColumn("_bin", bins(start, stop)), rights.withColumn("_bin", first("_start")), _first_contained, True)
    one = around.unionByName(inside).groupBy("_uid").agg(F.min("_place").alias("_place"))
    met = one.join(r.select("_place", "_start", "_stop", *rest), "_place").join(l.select("_uid", F.col(uid).alias("_id")), "_uid")
    met = met.select("_id", F.col("_start").alias(f"{start}_right"), F.col("_stop").alias(f"{stop}_right"), *rest)
    return left.join(met, F.col(uid) == F.col("_id"), "left").drop("_id")


def store_lookup(df: DataFrame, key: str, store: DataFrame, level: str = "seq", strict: bool = True) -> DataFrame:
    """JN4: rows with their stored vectors, one row a key; ``strict`` raises on missing keys and names some.

    The store is reduced to the wanted keys, by files where it is laid out by a hash of the key, before one row a key is chosen.
    """
    from .store import asked_for

    cols = [c for c in store.columns if c != "key" and (c == "seq" if level == "seq" else c.startswith("token"))]
    one = dedup(asked_for(store, df, key).select("key", *cols), ["key"])
    if strict:
        one = materialise(one)
        missing = df.select(F.col(key).alias("k")).distinct().join(one.select(F.col("key").alias("k")), "k", "left_anti").take(5)
        if missing:
            raise KeyError(f"keys that are not in the store: {[r['k'] for r in missing]}")
    return df.join(one.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key")).drop("_key")


def join_ast_runs(runs: DataFrame, ast: DataFrame, standard: str = "CLSI", id: str = "BioSample", ast_id: str = "#BioSample",
    mic: str = "MIC (mg/L)", standard_col: str = "Testing standard", synonyms: Mapping[str, str] | None = None,
        drug: str = "Antibiotic") -> DataFrame:
    """JN5: test rows of runs with an accession, of one standard and with a value."""
    a = ast.where(F.col(mic).isNotNull() & (F.col(standard_col) == standard)).withColumnsRenamed({ast_id: "_id", mic: "MIC"})
    for old, new in (synonyms or {}).items():
        a = a.withColumn(drug, F.when(F.col(drug) == old, new).otherwise(F.col(drug)))
    return runs.where(F.col(id).isNotNull() & F.col("Run").isNotNull()).join(a, F.col(id) == F.col("_id")).drop("_id")


def recode_join(df: DataFrame, recode: DataFrame, on: Sequence[str]) -> DataFrame:
    """JN6: the ``new`` value of each row; targets must be unique a key."""
    if recode.groupBy(*on).count().where("count > 1").take(1):
        raise ValueError("the recode table has a key twice")
    return df.join(recode.select(*on, "new"), list(on))


#: Left rows whose ids stand together in one list of a common item's holders; items of more holders are common.
HOLDERS = 1 << 16
#: Holders in one packed list, and holders of one right row's items that meet in a worker at most.
PIECE = 1 << 10
MET = 1 << 22


def _packed(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of 7 bits, the least first, the last one below 128; and where each number ends."""
    size = 1 + sum((flat >= 1 << 7 * j).astype(np.int64) for j in range(1, 9))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(size.max(initial=0))):
        some = size > j
        out[(ends - size)[some] + j] = (flat[some] >> 7 * j & 127) | np.where(size[some] > j + 1, 128, 0)
    return out, ends


def _unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.nonzero(data < 128)[0]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for j in range(int(size.max(initial=0))):
        some = size > j
        out[some] |= (data[starts[some] + j].astype(np.int64) & 127) << 7 * j
    return out


def _starts(values: pa.Array) -> np.ndarray:
    """Where runs of equal values (not null) start."""
    if len(values) < 2:
        return np.arange(len(values))
    return np.concatenate([[0], np.nonzero(pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False))[0] + 1])


def _pack_holders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item, place`` sorted to ``item, n, places``: lists of up to ``PIECE`` places as their differences."""
    for batch in batches:
        if not len(batch):
            continue
        first, at = _starts(batch.column(0)), np.arange(len(batch))
        cut = np.nonzero((at - first[np.searchsorted(first, at, "right") - 1]) % PIECE == 0)[0]
        flat = np.diff(batch.column(1).to_numpy(), prepend=0)
        flat[cut] = batch.column(1).to_numpy()[cut]
        data, ends = _packed(flat)
        n = np.diff(np.append(cut, len(batch)))
        offsets = np.concatenate([[0], ends[cut + n - 1]]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cut)), pa.array(n.astype(np.int32)), lists],
            names=["item", "n", "places"])


def _common(min_overlap: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``right_id, size, n, places`` sorted by right row to ``right_id, size, place, common`` of the left rows that have enough of its items."""

    def count(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        n, lists = rows.column(2).to_numpy().astype(np.int64), rows.column(3).cast(pa.binary())
        edges = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        places = _unpacked(np.frombuffer(lists.buffers()[2], np.uint8)[edges[0] : edges[-1]])
        begins = np.cumsum(n) - n
        total = np.cumsum(places)
        places = total - np.repeat(total[begins] - places[begins], n)  # a list starts with its first place
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        span = int(places.max()) + 1
        keys = np.sort(np.repeat(group, n) * span + places, kind="stable")
        at = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
        common, which = np.diff(np.append(at, len(keys))), first[keys[at] // span]
        size = rows.column(1).to_numpy()[which]
        keep = common / size >= min_overlap
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(which[keep])), pa.array(size[keep]), pa.array(keys[at][keep] % span),
            pa.array(common[keep])], names=["right_id", "size", "place", "common"])

    def whole(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Few right rows at a time, as far as their lists are long."""
        sums = np.cumsum(rows.column(2).to_numpy().astype(np.int64))
        upto = sums[np.append(first[1:], len(rows)) - 1]
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MET // 4, "right")))
            end = first[j] if j < len(first) else len(rows)
            yield count(rows.slice(first[i], end - first[i]), first[i:j] - first[i])
            i = j

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last right row's, which may go on
        for batch in batches:
            if not len(batch):
                continue
            first = _starts(batch.column(0))
            if held and len(first) == 1 and batch.column(0)[0] == held[0].column(0)[0]:
                held.append(batch)
                continue
            rows = pa.concat_batches([*held, batch]) if held else batch
            first = _starts(rows.column(0))
            if len(first) > 1:
                yield from whole(rows.slice(0, first[-1]), first[:-1])
            held = [rows.slice(first[-1])]
        if held:
            yield count(pa.concat_batches(held), np.array([0]))

    return run


def overlap_join(left: DataFrame, right: DataFrame, a: str, b: str, min_overlap: float) -> DataFrame:
    """JN7: pairs whose share of the right row's items that the left row has is at least ``min_overlap``.

    ``left`` and ``right`` have ``left_id`` and ``right_id`` and arrays; null items are never shared. Left rows are numbered, and an item's
    holders are packed lists of the differences of their numbers: each item of a right row brings its lists, and what meets at the right row
    is counted there, so no array is moved by pair. Right rows with an item that far more left rows than usual have, or with very many
    items, go by their rarest items (``_by_rare_items``).
    """
    spark = left.sparkSession
    l = row_index(left.select("left_id", F.array_compact(F.array_distinct(a)).alias("a")), ["left_id"], "place", start=0)
    r = materialise(right.where("right_id is not null").select("right_id", F.array_compact(F.array_distinct(b)).alias("b"),
        F.size(F.array_distinct(b)).alias("size")))
    kinds = {c: l.schema["a"].dataType.elementType.simpleString() if c == "item" else r.schema[c].dataType.simpleString() for c in ("item",
        "right_id")}
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = l.select(F.explode("a").alias("item"), "place").repartitionByRange(parts, "item", "place").sortWithinPartitions("item", "place")
    holders = materialise(held.mapInArrow(_pack_holders, f"item {kinds['item']}, n int, places binary"))
    count = holders.groupBy("item").agg(F.sum("n").alias("n"))
    every = count.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"),
        F.lit(0)).alias("most")).first()
    usual = min(HOLDERS, max(64, 8 * every["n"] // max(1, every["items"])))
    many = MET // max(1, min(usual, every["most"]))
    largest = r.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    plain, rest = r, None
    if every["most"] > usual or largest > many:
        common = count.where(F.col("n") > usual).select("item")
        other = r.select("right_id", F.explode("b").alias("item")).join(common, "item", "left_semi").select("right_id").unionByName(
            r.where(F.col("size") > many).select("right_id")).distinct()
        other = materialise(other)
        plain, rest = r.join(other, "right_id", "left_anti"), materialise(r.join(other, "right_id", "left_semi"))
    met = plain.select("right_id", "size", F.explode("b").alias("item")).join(holders, "item").select("right_id", "size", "n", "places")
    found = met.repartition("right_id").sortWithinPartitions("right_id").mapInArrow(_common(min_overlap),
        f"right_id {kinds['right_id']}, size int, place long, common long")
    out = found.join(l.select("place", "left_id"), "place").select("left_id", "right_id", "common",
        (F.col("common") / F.col("size")).alias("overlap"))
    return out if rest is None else out.unionByName(_by_rare_items(l.select("left_id", "a"), rest, min_overlap))


def _by_rare_items(l: DataFrame, r: DataFrame, min_overlap: float) -> DataFrame:
    """JN7 of written tables with common items.

    A pair that overlaps so much shares two of the right row's rarest items (one where one is enough), so many that the others hold all
    but two of those needed: only these meet the ids of the left rows that have them, as lists a block of left rows, and leave the pairs
    that met twice. These few take the right row's items, which are not many more than the left row's, to the left row. An item that all
    rows have makes no pairs by itself.
    """
    need = F.greatest(F.ceil(F.col("size") * min_overlap - 1e-9), F.lit(1)).cast("int")
    blocks = max(1, -(-l.count() // HOLDERS))
    held = l.select("left_id", F.explode("a").alias("item"))
    count = held.groupBy("item").agg(F.count("*").alias("n"))
    holders = held.groupBy("item", F.pmod(F.xxhash64("left_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("left_id").alias("ids"))
    ranked = r.where("size > 0").select("right_id", need.alias("need"), F.explode("b").alias("item")).join(count,
        "item")  # items that no left row has cannot be shared
    order = F.array_sort(F.collect_list(F.struct("n", "item")))
    prefix = ranked.groupBy("right_id", "need").agg(order.alias("o")).where(F.size("o") >= F.col("need"))
    twice = F.least("need", F.lit(2))
    seeds = prefix.select("right_id", twice.alias("times"), F.explode(F.slice("o", F.lit(1), F.size("o") - F.col("need") + twice))
        .alias("s")).select("right_id", "times", F.col("s.item").alias("item"))
    met = seeds.join(holders, "item").groupBy("right_id", "block", "times").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    again = F.when(F.col("times") == 1, F.array_distinct("ids")).otherwise(
        F.array_distinct(F.filter("ids", lambda v, i: v == F.get("ids", i + 1))))
    pairs = met.select("right_id", again.alias("ids")).where(F.size("ids") > 0).join(r, "right_id").select("right_id", "b", "size",
        F.explode("ids").alias("left_id"))
    both = pairs.join(l, "left_id").select("left_id", "right_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), "size")
    return both.where(F.col("common") / F.col("size") >= min_overlap).select("left_id", "right_id", "common",
        (F.col("common") / F.col("size")).alias("overlap"))


def align_pairs(natural: DataFrame, perturbed: DataFrame, random: DataFrame, id: str = "id", x: str = "x", pairable: bool = True,
    seed: int = 0) -> DataFrame:
    """JN8: ``id, natural, perturbed, random`` vectors; without ``pairable`` the random partner is drawn by hash order."""
    from .windows import row_index

    both = natural.select(id, F.col(x).alias("natural")).join(perturbed.select(id, F.col(x).alias("perturbed")), id)
    if pairable:
        return both.join(random.select(id, F.col(x).alias("random")), id)
    n = random.count()
    partners = row_index(random.withColumn("_h", draw(seed, "partner", id)), ["_h", id], "_i", start=0).select("_i",
        F.col(x).alias("random"))
    mine = row_index(both, [id], "_i", start=0).withColumn("_i", F.pmod("_i", F.lit(max(1, n))))
    return mine.join(partners, "_i").drop("_i")


def remap_accessions(df: DataFrame, mapping: DataFrame, left: str, right: str, new: str = "sample", how: str = "inner") -> DataFrame:
    """JN9: accessions replaced by those of the mapping, one row each."""
    m = mapping.select(F.col(right).alias("_right"), F.col(new).alias("_new")).distinct()
    return df.join(m, F.col(left) == F.col("_right"), how).drop("_right", left).withColumnRenamed("_new", left).distinct()


def pending_ids(df: DataFrame, col: str, seen: DataFrame, failed: DataFrame, sep: str = ";") -> DataFrame:
    """JN10: wanted ids that are neither seen nor failed."""
    from ..functions.columns import split_labels

    wanted = df.select(F.explode(split_labels(col, sep)).alias("id")).distinct()
    done = seen.select("id").unionByName(failed.select("id"))
    return wanted.join(done, "id", "left_anti")


def group_references(queries: DataFrame, refs: DataFrame | None = None, via: str = "taxid") -> DataFrame:
    """JN11: ``queries, references`` lists: by taxon (``query, via`` and ``via, reference``), or of ``query, reference`` rows by equal reference lists."""
    if refs is not None:
        q = queries.groupBy(via).agg(F.array_sort(F.collect_set("query")).alias("queries"))
        r = refs.groupBy(via).agg(F.array_sort(F.collect_set("reference")).alias("references"))
        return q.join(r, via).select(via, "queries", "references")
    lists = queries.groupBy("query").agg(F.array_sort(F.collect_set("reference")).alias("references"))
    return lists.groupBy("references").agg(F.array_sort(F.collect_list("query")).alias("queries"))


def ancestors(tax: DataFrame, max_rounds: int = 32) -> DataFrame:
    """``tax_id, ancestor, depth, rank`` of every node and each of its ancestors, itself included (depth 0).

    Paths are doubled round by round: a node's known ancestor is joined to that ancestor's own. A cycle of
    parents, which no number of rounds ends, is an error once a path is longer than there are nodes.
    """
    nodes = tax.select("tax_id", "parent_tax_id", "rank")
    step = nodes.where("tax_id <> parent_tax_id and parent_tax_id is not null").select("tax_id", F.col("parent_tax_id").alias("ancestor"),
        F.lit(1).alias("depth"))
    known, jump, reach, n = step, step, 1, nodes.count()
    for _ in range(max_rounds):
        nxt = jump.withColumnsRenamed({"tax_id": "_t", "ancestor": "_a", "depth": "_d"})
        more = known.join(nxt, F.col("ancestor") == F.col("_t")).select("tax_id", F.col("_a").alias("ancestor"),
            (F.col("depth") + F.col("_d")).alias("depth"))
        jumps = jump.join(nxt, F.col("ancestor") == F.col("_t")).select("tax_id", F.col("_a").alias("ancestor"),
            (F.col("depth") + F.col("_d")).alias("depth"))
        jump = materialise(jumps)
        known = materialise(known.unionByName(more))
        reach *= 2
        if not jump.take(1):
            break
        if reach > n:
            raise ValueError("the tree's parents run in a circle")
    own = nodes.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("depth"))
    ranks = nodes.select(F.col("tax_id").alias("_n"), "rank")
    return known.unionByName(own).join(ranks, F.col("ancestor") == F.col("_n"), "left").drop("_n")


def taxid_to_ranks(df: DataFrame, tax: DataFrame, taxid: str = "taxid", ranks: Sequence[str] = ("species", "genus", "family", "order"),
    names: DataFrame | None = None) -> DataFrame:
    """JN12: the ancestor (its id, or name of ``tax_id, name``) of each row at each rank."""
    a = ancestors(tax).where(F.col("rank").isin(list(ranks)))
    value = F.col("ancestor")
    if names is not None:
        a = a.join(names.select(F.col("tax_id").alias("_t"), "name"), F.col("ancestor") == F.col("_t"), "left")
        value = F.col("name")
    wide = a.groupBy("tax_id").pivot("rank", list(ranks)).agg(F.min_by(value, "depth"))
    return df.join(wide, F.col(taxid) == F.col("tax_id"), "left").drop("tax_id")


def taxon_distance(pairs: DataFrame, tax: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """SC14: levels from species up to the rank of the lowest common ancestor that has one; 0 at or below species, null without any."""
    up = ancestors(tax).withColumn("level", rank_level(F.col("rank"))).where("level is not null").select("tax_id", "ancestor", "level",
        "depth")
    ids = pairs.select(a, b).distinct()
    met = ids.join(up.select(F.col("tax_id").alias(a), "ancestor", "level", "depth"),
        a).join(up.select(F.col("tax_id").alias(b), "ancestor"), [b, "ancestor"])
    species = len(RANKS) - RANKS.index("species")
    low = met.groupBy(a, b).agg(F.min_by("level", "depth").alias("level")).withColumn("distance",
        F.greatest(F.col("level") - species, F.lit(0))).drop("level")
    return pairs.join(low, [a, b], "left")


def cluster_metadata(meta: DataFrame, clusters: DataFrame, member: str = "member", rep: str = "rep") -> DataFrame:
    """JN13: members with their metadata, empty text as null, and whether they are the representative."""
    text = {f.name: F.nullif(F.col(f.name), F.lit("")) for f in meta.schema.fields if f.dataType.simpleString() == "string"
        and f.name != "accession"}
    m = meta.withColumns(text)
    return clusters.join(m, F.col(member) == F.col("accession"), "left").drop("accession").withColumn("is_rep", F.col(member) == F.col(rep))


def drug_classes(drugs: DataFrame, compounds: DataFrame, custom: DataFrame, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """JN14: the class of each ``drug``, from ``compounds`` else ``custom`` (``drug, drug_class``), and the class of interest whose pattern it matches."""
    c1 = dedup(compounds.select(F.col("drug").alias("_d1"), F.col("drug_class").alias("_c1")), ["_d1"], ["_c1"])
    c2 = dedup(custom.select(F.col("drug").alias("_d2"), F.col("drug_class").alias("_c2")), ["_d2"], ["_c2"])
    out = drugs.join(c1, F.col("drug") == F.col("_d1"), "left").join(c2, F.col("drug") == F.col("_d2"), "left").withColumn("drug_class",
        F.coalesce("_c1", "_c2")).drop("_d1", "_d2", "_c1", "_c2")
    if patterns:
        label = reduce(lambda w, kv: w.when(F.col("drug_class").rlike("(?i)" + kv[1]), kv[0]), patterns.items(),
            F.when(F.col("drug_class").isNull(), F.lit(None).cast("string")))
        out = out.withColumn("interest", label)
    return out
