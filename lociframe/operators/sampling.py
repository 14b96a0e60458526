"""Samples, pairs and splits (SM): all draws are hashes of seeds and ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import draw, pick, unit
from .curate import split_predicate
from .windows import _changes, group_index, row_index, running_sums


#: Up to so many rows a group, each task's own best are few enough to be put in order together.
FEW = 1000
#: Draws are cut at 12 of their 60 bits for the histogram that finds where a selection ends.
BUCKET_BITS = 12


def least_rows(df: DataFrame, h: Column, id: str, n: int | Column, by: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` rows of the table, or of each group, with the least draws ``h`` (ties by ``id``); ``n`` may depend on ``by`` and on ``_size``, the group's rows.

    A histogram of the draws' leading bits tells in which bucket each group's selection ends. Rows of lower buckets are taken
    where they are read, and only the last bucket's, one in 4,096 of a group, are put in order. A selection of up to ``FEW`` is put in
    order at once, as no task passes on more than that of a group.
    """
    by = list(by or [])
    if isinstance(n, int) and n <= FEW:
        if not by:
            return df.orderBy(h, id).limit(n)
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(h, id))).where(F.col("_r") <= n).drop("_r")
    keyed = df.withColumn("_draw", h).withColumn("_slot", F.shiftright("_draw", 60 - BUCKET_BITS))
    cells = keyed.groupBy(*by, "_slot").agg(F.count("*").alias("_k"))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    sums = running_sums(cells, by, ["_slot"], ["_k"]).withColumnsRenamed(names)
    sizes = cells.groupBy(*by).agg(F.sum("_k").alias("_size")).withColumn("_n",
        (F.lit(n) if isinstance(n, int) else n).cast("long")).withColumnsRenamed({c: f"{m}_" for c, m in names.items()})
    on = [F.col(m).eqNullSafe(F.col(f"{m}_")) for m in names.values()]
    cut = sums.join(sizes, on) if by else sums.join(F.broadcast(sizes))  # one row
    last = cut.where((F.col("_run__k") >= F.col("_n")) & (F.col("_run__k") - F.col("_k") < F.col("_n")))
    last = last.select(*names.values(), F.col("_slot").alias("_last"), (F.col("_n") - F.col("_run__k") + F.col("_k")).alias("_need"))
    whole = sizes.where(F.col("_n") > F.col("_size")).select(*[F.col(f"{m}_").alias(m) for m in names.values()],
        F.lit(1 << BUCKET_BITS).cast("long").alias("_last"), F.lit(0).cast("long").alias("_need"))
    ends = last.unionByName(whole)
    near = keyed.join(ends, [F.col(c).eqNullSafe(F.col(m)) for c, m in names.items()]) if by else keyed.join(F.broadcast(ends))  # one row
    near = near.where(F.col("_slot") <= F.col("_last"))
    taken = near.where(F.col("_slot") < F.col("_last")).select(*df.columns)
    edge = near.where(F.col("_slot") == F.col("_last")).withColumn("_r",
        F.row_number().over(Window.partitionBy(*names.values(), "_last").orderBy("_draw", id)))
    return taken.unionByName(edge.where(F.col("_r") <= F.col("_need")).select(*df.columns))


def sample_n(df: DataFrame, id: str, n: int | None = None, fraction: float | None = None, by: Sequence[str] | None = None,
    seed: int = 0) -> DataFrame:
    """SM1: ``n`` rows or a share of them, of the table or of each group."""
    h = draw(seed, "sample", id)
    if n is not None:
        return least_rows(df, h, id, n, by)
    if not by:
        return least_rows(df, h, id, round(fraction * df.count()))
    return least_rows(df, h, id, F.floor(F.col("_size") * fraction), by)


def subsample_union(df: DataFrame, rules: Sequence[Mapping], id: str, seed: int = 0) -> DataFrame:
    """SM2: rows whose id any rule takes: a ``fraction`` of each group, groups of at most ``max_size`` rows, or ``n`` draws with replacement from each group."""
    ids = []
    for k, rule in enumerate(rules):
        by = list(rule["by"])
        known = df.where(F.coalesce(*[F.lit(None).cast("string")] + [F.when(F.col(b).isNull(), F.lit("x")) for b in by])
            .isNull()) if rule.get("skip_null") else df
        if "fraction" in rule:
            taken = sample_n(known, id, fraction=rule["fraction"], by=by, seed=seed + k)
        elif "max_size" in rule:
            sizes = known.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") <= rule["max_size"])
            taken = known.join(sizes, by)
        else:
            # a row is drawn if any of n hash picks of its group's positions is its own
            place = group_index(known.select(id, *by, draw(seed, "place", id).alias("_h")), by, ["_h", id], "_i", start=0).drop("_h")
            sizes = place.groupBy(*by).agg(F.count("*").alias("_size"))
            picks = sizes.select(*by, F.explode(F.sequence(F.lit(1), F.lit(rule["n"]))).alias("_d"), "_size").select(*by,
                pick(F.col("_size"), seed, "replace", *by, "_d").alias("_i")).distinct()
            taken = place.join(picks, [*by, "_i"])
        ids.append(taken.select(id))
    kept = ids[0]
    for more in ids[1:]:
        kept = kept.unionByName(more)
    return df.join(kept.distinct(), id, "left_semi")


def sample_two_stage(df: DataFrame, sample: str, n: int, n_inner: int, seed: int = 0, id: str = "uid") -> DataFrame:
    """SM3: ``n`` samples, then ``n_inner`` rows of each."""
    chosen = least_rows(df.select(sample).distinct(), draw(seed, "outer", sample), sample, n)
    return sample_n(df.join(chosen, sample, "left_semi"), id, n_inner, by=[sample], seed=seed)


def bootstrap(df: DataFrame, sample: str, rounds: int, n: int, seed: int = 0, id: str = "uid") -> DataFrame:
    """SM4: ``round`` and the ``n`` rows of each sample drawn in it, all rounds in one job."""
    rows = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return least_rows(rows, draw(seed, "round", "round", id), id, n, ["round", sample])


def random_pairs(df: DataFrame, id: str, n: int, seed: int = 0, every: bool = False) -> DataFrame:
    """SM5: ``n`` distinct pairs ``a, b`` of different rows, a before b (null last); ``every`` draws from all pairs, however many there are."""
    spark = df.sparkSession
    index = row_index(df.select(id).distinct(), [F.col(id).asc_nulls_last()], "_i", start=0)
    total = index.count()
    if total < 2:
        return index.select(F.col(id).alias("a"), F.col(id).alias("b")).limit(0)
    most = total * (total - 1) // 2
    want = min(n, most)
    if every or most <= 4 * n:  # nearly all pairs: listed once and drawn from
        over = index.select(F.col("_i").alias("_x")).where(F.col("_x") > 0).select("_x",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_x") - 1)).alias("_y")).select(F.col("_y").alias("_l"),
                F.col("_x").alias("_h"))
    else:
        x, y = pick(F.lit(total), seed, "first", "id"), pick(F.lit(total), seed, "second", "id")
        over = spark.range(3 * n + 64).select(x.alias("_x"), y.alias("_y")).where("_x <> _y").select(F.least("_x", "_y").alias("_l"),
            F.greatest("_x", "_y").alias("_h")).distinct()
    keyed = over.withColumn("_pair", F.struct("_l", "_h"))
    chosen = least_rows(keyed, draw(seed, "pair", "_l", "_h"), "_pair", want).select("_l", "_h")
    a, b = (index.select(F.col("_i").alias(k), F.col(id).alias(v)) for k, v in (("_l", "a"), ("_h", "b")))
    return chosen.join(a, "_l").join(b, "_h").select("a", "b")


def related_pairs(df: DataFrame, id: str, by: str, n_per: int, seed: int = 0) -> DataFrame:
    """SM6: up to ``n_per`` pairs within each group of enough rows, and as many with partners of other groups: ``a, b, related``."""
    w = Window.partitionBy(by).orderBy(draw(seed, "pairs", id), id)
    ranked = df.where(F.col(by).isNotNull()).select(F.col(id).alias("_id"), F.col(by).alias("_g"),
        F.row_number().over(w).alias("_n")).where(F.col("_n") <= 2 * n_per)
    whole = ranked.groupBy("_g").agg(F.max("_n").alias("_top")).where(F.col("_top") >= 2 * n_per).select("_g")
    ranked = ranked.join(whole, "_g", "left_semi")
    odd = ranked.where(F.col("_n") % 2 == 1).select("_g", F.col("_id").alias("a"), ((F.col("_n") + 1) / 2).cast("int").alias("_k"))
    even = ranked.where(F.col("_n") % 2 == 0).select(F.col("_g").alias("_g2"), F.col("_id").alias("b"),
        (F.col("_n") / 2).cast("int").alias("_k2"))
    inside = odd.join(even, (F.col("_g") == F.col("_g2")) & (F.col("_k") == F.col("_k2"))).select("a", "b", F.lit(True).alias("related"))
    groups = row_index(ranked.select("_g").distinct(), ["_g"], "_i", start=0)
    n = groups.count()
    if n < 2:
        return inside
    nxt = groups.select(F.col("_g").alias("_g"), F.pmod(F.col("_i") + 1 + pick(F.lit(n - 1), seed, "other", "_g"), F.lit(n))
        .alias("_j")).join(groups.select(F.col("_g").alias("_other"), F.col("_i").alias("_j")), "_j").select("_g", "_other")
    across = odd.join(nxt, "_g").join(even, (F.col("_other") == F.col("_g2")) & (F.col("_k") == F.col("_k2"))).select("a", "b",
        F.lit(False).alias("related"))
    return inside.unionByName(across)


def balance(df: DataFrame, label: str, seed: int = 0, id: str = "id") -> DataFrame:
    """SM7: as many rows of each class as the smallest has."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return sample_n(df, id, int(least), by=[label], seed=seed)


def train_test(df: DataFrame, id: str, share: float, seed: int = 0, validation: float = 0.0, name: str = "split") -> DataFrame:
    """SM8: ``test`` for a share of ids, ``validation`` for a share of the rest where asked for, else ``train``."""
    u, v = unit(seed, "split", id), unit(seed, "validation", id)
    return df.withColumn(name, F.when(u < share, "test").when(v < validation, "validation").otherwise("train"))


def named_splits(df: DataFrame, specs: Mapping[str, Mapping], name: str = "test_set") -> DataFrame:
    """SM8: each row once for each named mask, with its ``split`` there."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.when(split_predicate(s), "test").otherwise("train").alias("split")) for k,
        s in specs.items()]))
    return df.select("*", rows.alias("_r")).select(*df.columns, "_r.*")


def kfold(df: DataFrame, id: str, k: int, repeats: int = 1, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """SM9: ``repeat`` and ``fold`` of each row; folds differ by one row at most, within labels where stratified."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", draw(seed, "fold", "repeat", id))
    if stratify:
        return group_index(rows, ["repeat", stratify], ["_h", id], "_n", start=0).withColumn("fold", (F.col("_n") % k).cast("int")).drop(
            "_h", "_n")
    return row_index(rows, ["repeat", "_h", id], "_n", start=0).withColumn("fold", (F.col("_n") % k).cast("int")).drop("_h", "_n")


def holdout_plan(df: DataFrame, id: str, spec: Mapping[str, Mapping], bootstrap: int = 1, share: float = 1.0, seed: int = 0) -> DataFrame:
    """SM10: named masks with ``iter`` rounds, each of a drawn share of the training rows; the others are left out."""
    rows = named_splits(df, spec).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(bootstrap - 1))))
    return rows.where((F.col("split") == "test") | (unit(seed, "holdout", "test_set", "iter", id) < share))


def control_task(df: DataFrame, target: str, control: str, seed: int = 0, name: str = "control_target") -> DataFrame:
    """SM11: each value of ``control`` mapped to a drawn value of ``target``; every target is used where there are enough values."""
    goals = row_index(df.where(F.col(target).isNotNull()).select(F.col(target).alias("_t")).distinct().withColumn("_h",
        draw(seed, "goal", "_t")), ["_h", "_t"], "_i", start=0).select("_t", "_i")
    n = max(1, goals.count())
    values = row_index(df.where(F.col(control).isNotNull()).select(F.col(control).alias("_c")).distinct().withColumn("_h",
        draw(seed, "control", "_c")), ["_h", "_c"], "_k", start=0)
    linked = values.withColumn("_i", F.when(F.col("_k") < n, F.col("_k")).otherwise(F.pmod("_h", F.lit(n)))).join(goals, "_i").select("_c",
        F.col("_t").alias(name))
    return df.join(linked, F.col(control) == F.col("_c"), "left").drop("_c")


def permute(df: DataFrame, id: str, cols: Sequence[str], within: str | None = None, seed: int = 0) -> DataFrame:
    """SM12: columns shuffled together over the table, or each on its own (all of one type) within groups."""
    if within is None:
        left = row_index(df, [id], "_i")
        right = row_index(df.select(id, *cols).withColumn("_h", draw(seed, "permute", id)), ["_h", id], "_i").select("_i",
            *[F.col(c).alias(f"_{c}") for c in cols])
        return left.join(right, "_i").select(*[F.col(f"_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    kinds = {df.schema[c].dataType.simpleString() for c in cols}
    if len(kinds) > 1:
        raise ValueError("columns shuffled within groups must be of one type")
    place = {c: i for i, c in enumerate(cols)}
    out = _within(df, id, within, F.array(*[F.col(c) for c in cols]), lambda i: F.get(F.array(*[F.lit(c) for c in cols]), i), len(cols), seed)
    return out.select(*[F.get("_m", F.lit(place[c])).alias(c) if c in place else F.col(c) for c in df.columns])


def permute_places(df: DataFrame, id: str, x: str, width: int, within: str, seed: int = 0) -> DataFrame:
    """SM12: the first ``width`` places of an array shuffled as ``permute`` shuffles columns ``_x0``, ``_x1``, ... within groups; no column a place is made."""
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(x, i))
    out = _within(df, id, within, values, lambda i: F.concat(F.lit("_x"), i.cast("string")), width, seed)
    return out.select(*[F.col("_m").alias(c) if c == x else F.col(c) for c in df.columns])


def _within(df: DataFrame, id: str, within: str, values: Column, name: Callable[[Column], Column], width: int, seed: int) -> DataFrame:
    """``df`` with ``_m``, the array ``values`` with each place shuffled on its own within groups."""
    long = df.select(id, F.col(within).alias("_w"), F.posexplode(values).alias("_c", "_v")).withColumn("_h",
        draw(seed, "within", name(F.col("_c")), id))
    drawn = group_index(long, ["_w", "_c"], ["_h", id], "_j", start=0).select("_w", F.floor(F.col("_j") / BLOCK_ROWS).alias("_b"), "_j", "_c", "_v")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {c: drawn.schema[c].dataType.simpleString() for c in ("_w", "_v")}
    made = drawn.repartition(parts, "_w", "_b").sortWithinPartitions("_w", "_b").mapInArrow(_wide(width),
        f"_w {kinds['_w']}, _j long, _m array<{kinds['_v']}>")
    return group_index(df, [within], [id], "_i", start=0).join(made, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_i") == F.col("_j")))


#: Numbered rows whose values are put side by side at a time.
BLOCK_ROWS = 1024


def _wide(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``_w, _b, _j, _c, _v`` sorted by (_w, _b), a value each, to ``_w, _j, _m``: the ``width`` values of each ``_j`` in the order of ``_c``."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        j, c = (rows[n].to_numpy() for n in ("_j", "_c"))
        order = np.lexsort((c, j))
        n = len(order) // width
        first = pa.array(order[::width])
        m = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), rows["_v"].chunk(0).take(pa.array(order)))
        return pa.RecordBatch.from_arrays([rows["_w"].chunk(0).take(first), rows["_j"].chunk(0).take(first), m], names=["_w", "_j", "_m"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            edges = np.append(np.flatnonzero(_changes(batch, ["_w", "_b"])), len(batch)).tolist()
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                some = batch.slice(s, e - s)
                key = (some.column(0)[0].as_py(), some.column(1)[0].as_py())
                if held and key != now:
                    yield close(held)
                    held = []
                now = key
                held.append(some)
        if held:
            yield close(held)

    return run
