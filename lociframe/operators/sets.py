"""Set operations (SET)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _ORDER and type(b) in _ORDER:
        return a if _ORDER.index(type(a)) >= _ORDER.index(type(b)) else b
    return T.StringType()


def union(dfs: Sequence[DataFrame], diagonal: bool = True) -> DataFrame:
    """SET1, SET2: all rows; ``diagonal`` takes all columns and widens types."""
    if not diagonal:
        return reduce(DataFrame.unionByName, dfs)
    kinds: dict[str, T.DataType] = {}
    for df in dfs:
        for f in df.schema.fields:
            kinds[f.name] = _wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    cast = [df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns]) for df in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def dedup(df: DataFrame, key: Sequence[str] | str, order: Sequence | None = None) -> DataFrame:
    """SET3: the first row of each key by ``order``, else by a hash of the row; the limit is applied before the shuffle too."""
    key = [key] if isinstance(key, str) else list(key)
    order = list(order) if order else [F.xxhash64(*df.columns)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def passing_all(dfs: Sequence[DataFrame], id: str = "sample") -> DataFrame:
    """SET4: ids in all tables."""
    return reduce(DataFrame.intersect, [df.select(id) for df in dfs])


def overlaps(df: DataFrame, id: str, group: str) -> DataFrame:
    """SET5: ``g1, g2, n`` ids that two groups share, g1 < g2; an id's groups are few, so its pairs are made from its own list."""
    lists = df.where(F.col(group).isNotNull()).groupBy(id).agg(F.array_sort(F.collect_set(group)).alias("g"))
    pairs = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b > a), lambda b: F.struct(a.alias("g1"), b.alias("g2")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.g1", "p.g2").agg(F.count("*").alias("n"))


def union_ids(dfs: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """SET6: distinct ids of several columns."""
    return reduce(DataFrame.union, [df.select(F.col(c).alias("id")) for df, c in zip(dfs, cols, strict=True)]).where("id is not null").distinct()


def duplicate_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET7: rows that share a value of any of ``cols``, with how often it occurs (``<col>_n``)."""
    for c in cols:
        sizes = df.groupBy(F.col(c).alias("_k")).agg(F.count("*").alias(f"{c}_n"))
        df = df.join(sizes, F.col(c).eqNullSafe(F.col("_k"))).drop("_k")
    return df.where(reduce(lambda a, b: a | b, [F.col(f"{c}_n") > 1 for c in cols]))
