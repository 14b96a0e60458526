"""Windows, ranks, top-k (WN) and the shared global row order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _changes(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """Where a row's ``cols`` differ from the row before; true for the first row."""
    new = np.zeros(len(batch), bool)
    new[0] = True
    for c in cols:
        codes = batch.column(batch.schema.get_field_index(c)).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _run_totals(by: Sequence[str], sums: Sequence[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of a partition with running sums within their group, ``_seq``, and ``_head``: whether the group is the partition's first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, seq, head = None, [0] * len(sums), 0, True
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch.select(by).slice(0, 1).to_pylist()[0] if by else {}
            new = _changes(batch, by)
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], n)
            goes_on = last is not None and str(keys) == str(last)
            head = head and (last is None or goes_on)
            first_end = int(ends[0])
            in_head = np.zeros(n, bool)
            in_head[:first_end] = head
            out = []
            for i, c in enumerate(sums):
                v = batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False)
                run_sum = np.cumsum(v)
                before = run_sum[starts] - v[starts]
                run_sum = run_sum - np.repeat(before, ends - starts)
                if goes_on:
                    run_sum[:first_end] += carry[i]
                carry[i] = run_sum[-1]
                out.append(pa.array(run_sum))
            head = head and len(starts) == 1
            last = batch.select(by).slice(n - 1, 1).to_pylist()[0] if by else {}
            flags = [pa.array(np.arange(seq, seq + n)), pa.array(in_head)]
            seq += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, *flags],
                names=[*batch.schema.names, *[f"_run_{c}" for c in sums], "_seq", "_head"])

    return run


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str]) -> DataFrame:
    """``df`` with ``_run_<c>``, the sum of column ``c`` (long or double, null as 0) over the rows of its ``by`` group up to it in ``order``.

    Rows are dealt by ranges of (group, order), so a group of any size is many tasks. Each partition sums on its own in the
    stage that sorts it; only its first group can have begun before, and what it brings along (a row a partition) is added where the
    table is read.
    """
    cols = [*_columns(by), *_columns(order)]
    sorted_rows = df.repartitionByRange(_parts(df), *cols).sortWithinPartitions(*cols).withColumn("_p", F.spark_partition_id())
    kinds = {c: df.schema[c].dataType.simpleString() for c in sums}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields]
        + [f"`_run_{c}` {kinds[c]}" for c in sums] + ["_seq long", "_head boolean"])
    rows = materialise(sorted_rows.mapInArrow(_run_totals(list(by), list(sums)), schema))
    runs = F.struct(F.lit(0).alias("_"), *[F.col(f"_run_{c}") for c in sums])
    key = F.struct(F.lit(0).alias("_"), *_columns(by))
    edges = rows.groupBy("_p").agg(F.min_by(key, "_seq").alias("first"), F.max_by(key, "_seq").alias("last"),
        F.max_by(runs, "_seq").alias("runs"), F.min("_head").alias("one")).collect()  # a row a partition
    open_key, brought, carries = None, [0] * len(sums), {}
    for r in sorted(edges, key=lambda r: r["_p"]):
        same = open_key is not None and str(r["first"]) == str(open_key)
        carries[r["_p"]] = brought if same else [0] * len(sums)
        brought = [v + (w if r["one"] else 0) for v, w in zip(list(r["runs"])[1:], carries[r["_p"]], strict=True)]
        open_key = r["last"]
    out = rows
    for i, c in enumerate(sums):
        some = [(p, v[i]) for p, v in carries.items() if v[i]]
        if some:
            table = F.create_map(*[F.lit(x) for pair in some for x in pair])
            out = out.withColumn(f"_run_{c}",
                F.when(F.col("_head"), F.col(f"_run_{c}") + F.coalesce(F.try_element_at(table, F.col("_p")), F.lit(0)))
                    .otherwise(F.col(f"_run_{c}")).cast(kinds[c]))
    return out.drop("_p", "_seq", "_head")


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "n", start: int = 1) -> DataFrame:
    """Global 1, 2, 3, ... in ``order``: range partitions number their sorted rows as they write them, and each one's first number comes from the counts of those before."""
    cols = _columns(order)
    place = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the row in the lower 33
    keyed = materialise(df.repartitionByRange(_parts(df), *cols).sortWithinPartitions(*cols).withColumn("__place", place))
    part = F.shiftright("__place", 33)
    counts = keyed.groupBy(part.alias("_p")).agg(F.count("*").alias("k")).collect()  # one row a partition
    before, at = [], start - 1
    for r in sorted(counts):
        before.append((r["_p"], at))
        at += r["k"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offset = F.create_map(*[F.lit(v) for pair in before for v in pair])
    return keyed.withColumn(name, (offset[part] + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("__place")


def group_index(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "n", start: int = 1) -> DataFrame:
    """Number of each row within its group in ``order``; a group of any size is spread over range partitions, not sorted in one task."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), by, order, ["_one"]).withColumn(name,
        F.col("_run__one") + start - 1).drop("_one", "_run__one")


def value_ranks(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """``value, n, below`` (after ``by``): each distinct value of the table or group, its count and the number of rows below it; only distinct values are ordered."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return running_sums(counts, by, ["value"], ["n"]).select(*by, "value", "n", (F.col("_run_n") - F.col("n")).alias("below"))


def avg_rank(df: DataFrame, col: str, by: Sequence[str] | None = None, name: str = "rank") -> DataFrame:
    """WN4: rank of ``col``, ties averaged, over all rows or within groups of any size."""
    by = list(by or [])
    ranks = value_ranks(df, col, by).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("value").alias("_v"),
        (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(col) == F.col("_v")]
    return df.join(ranks, on).drop("_v", *[f"_{b}" for b in by])


def add_intergenic(features: DataFrame, contigs: DataFrame, by: Sequence[str] = ("sample", "seqid"), start: str = "start",
    stop: str = "stop") -> DataFrame:
    """WN1: bases to the next and from the previous feature of a contig; at its ends to the contig's ends (``contigs`` has ``by`` and ``length``)."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    df = features.join(contigs.select(*by, F.col("length").alias("_length")), list(by), "left")
    return df.select(*features.columns, F.coalesce(F.lead(start).over(w) - F.col(stop), F.col("_length") - F.col(stop))
        .alias("downstream_intergenic"), F.coalesce(F.col(start) - F.lag(stop).over(w), F.col(start)).alias("upstream_intergenic"))


def with_group_size(df: DataFrame, by: Sequence[str], name: str = "group_size") -> DataFrame:
    """WN2."""
    sizes = df.groupBy(*by).agg(F.count("*").alias(name))
    return df.join(sizes, list(by))


def cluster_ids(df: DataFrame, rep: str, name: str = "cluster") -> DataFrame:
    """WN3: 0, 1, 2, ... in the order of representatives."""
    ids = row_index(df.select(F.col(rep).alias("_rep")).distinct(), ["_rep"], name, start=0)
    return df.join(ids, F.col(rep) == F.col("_rep")).drop("_rep")


def topk_labels(df: DataFrame, by: str, metric: str, k: int, label: str = "label") -> DataFrame:
    """WN5: the ``k`` best rows of each group by ``metric``, ties by label, with their ``rank``; kept map-side first."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(metric), F.asc(label))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reference_genomes(df: DataFrame, per_taxid: int = 3, taxid: str = "taxid", score: str = "score", acc: str = "accession") -> DataFrame:
    """WN6: the best-scoring genomes of each taxon, scores null last, ties by accession."""
    return topk_labels(df, taxid, score, per_taxid, acc)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """WN7."""
    return df.orderBy(*order).limit(n)


def batch_number(df: DataFrame, order: Sequence[str], size: int = 1000, name: str = "batch") -> DataFrame:
    """WN8: 1 for the first ``size`` rows, 2 for the next."""
    return row_index(df, order, "_i").withColumn(name, F.ceil(F.col("_i") / size)).drop("_i")


def representation(df: DataFrame, col: str, lo: float = 0.6, hi: float = 0.9) -> DataFrame:
    """WN9: ``majority`` for values whose count is at least the ``hi`` quantile of counts, ``minority`` below the ``lo`` one."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.percentile("n", F.array(F.lit(lo), F.lit(hi))).alias("q"))
    return counts.join(F.broadcast(bounds)).select(col, "n",
        F.when(F.col("n") >= F.col("q")[1], "majority").when(F.col("n") < F.col("q")[0], "minority").otherwise("intermediate")
            .alias("representation"))  # bounds is one row
