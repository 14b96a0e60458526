"""Projections, recodes, filters (PRJ, FLT)."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.seeded import unit

_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def class_columns(df: DataFrame, suffix: str = "_class") -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def apply_source_spec(df: DataFrame, spec: Mapping, dataset: str) -> DataFrame:
    """PRJ1: ``sample`` column, renames, drops and class suffix of a source, and its name as ``dataset``."""
    df = df.withColumnRenamed(spec.get("sample", "sample"), "sample")
    df = df.drop(*spec.get("drop", ())).withColumnsRenamed(dict(spec.get("rename", {})))
    if suffix := spec.get("class_suffix"):
        df = df.withColumnsRenamed({c: c[: -len(suffix)] + "_class" for c in df.columns if c.endswith(suffix)})
    return df.withColumn("dataset", F.lit(dataset))


def recode_phenotype(df: DataFrame, suffix: str = "_class") -> DataFrame:
    """PRJ2."""
    return df.withColumns({c: C.phenotype_word(c) for c in class_columns(df, suffix)})


def discretize(df: DataFrame, cols: Sequence[str], susceptible: float = 0.3, resistant: float = 0.8, suffix: str = "",
    interpolation: str = "nearest") -> DataFrame:
    """PRJ3: below and above two quantiles of the whole column, strictly; null stays null.

    ``nearest`` takes the value of rank round(q (n - 1)), half to even, ``linear`` interpolates. Ranks are
    found over range partitions, so no task sees the whole column.
    """
    bounds = quantiles(df, cols, (susceptible, resistant), interpolation)
    out = {}
    for c in cols:
        lo, hi = bounds[c]
        x = F.col(c)
        out[f"{c}_{suffix}" if suffix else c] = F.when(x.isNull(), F.lit(None).cast("string")).when(x < lo, "susceptible").when(x > hi,
            "resistant").otherwise("intermediate")
    return df.withColumns(out)


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], interpolation: str = "nearest") -> dict[str, list[float | None]]:
    """Exact quantiles of each column; the driver gets as many numbers as are asked for."""
    if interpolation == "linear":
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(c) for c in cols]).first()
        return {c: list(row[c] or [None] * len(qs)) for c in cols}
    n = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    exprs = [F.percentile(c, F.array(*[F.lit(min(1.0, round(q * (n[c] - 1)) / (n[c] - 1)) if n[c] > 1 else 0.0) for q in qs])).alias(c)
        for c in cols]
    row = df.agg(*exprs).first()
    return {c: list(row[c] or [None] * len(qs)) for c in cols}


def binarize_phenotype(df: DataFrame, suffix: str = "_class") -> DataFrame:
    """PRJ5: each class column as 0/1, and ``any_resistant``, ``any_susceptible``."""
    cols = class_columns(df, suffix)
    any_of = lambda v: F.exists(F.array(*[F.col(c) for c in cols]), lambda x: F.coalesce(x == v, F.lit(False)))
    return df.select("*", any_of("resistant").alias("any_resistant"), any_of("susceptible").alias("any_susceptible")).withColumns(
        {c: F.coalesce((F.col(c) == "resistant").cast("int"), F.lit(0)) for c in cols})


def class_codes(df: DataFrame, suffix: str = "_class") -> DataFrame:
    """PRJ6: codes R, I, S under ``<drug>_resistant``."""
    cols = class_columns(df, suffix)
    return df.select(*[c for c in df.columns if c not in cols], *[C.class_code(c).alias(c[: -len(suffix)] + "_resistant") for c in cols])


def unite_numbered(df: DataFrame, prefixes: Sequence[str], sep: str = "_") -> DataFrame:
    """PRJ11: ``name...1, name...2`` joined into ``name``, nulls skipped."""
    for p in prefixes:
        parts = [c for c in df.columns if c == p or c.startswith(p + "...")]
        if parts:
            df = df.withColumn("_united", F.nullif(F.concat_ws(sep, *[F.col(f"`{c}`") for c in parts]), F.lit(""))).drop(
                *[F.col(f"`{c}`") for c in parts]).withColumnRenamed("_united", p)
    return df


def drop_null_columns(df: DataFrame) -> DataFrame:
    """PRJ12: columns without a value go; one aggregate."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if row[c]])


def in_gene(df: DataFrame, pattern: str = "gene") -> DataFrame:
    """PRJ13."""
    cols = [F.col(c).cast("string") for c in df.columns if pattern in c.lower()]
    return df.withColumn("in_gene", F.coalesce(*cols).isNotNull() if cols else F.lit(False))


def ast_long(df: DataFrame, drugs: Sequence[str], suffix: str = "_class", sample: str = "sample") -> DataFrame:
    """PRJ14: ``sample, antibiotic, class, mic, mic_smooth`` of a wide table."""
    rows = F.explode(F.array(
        *[F.struct(F.lit(d).alias("antibiotic"), F.col(d + suffix).alias("class") if d + suffix in df.columns
            else F.lit(None).cast("string").alias("class"), F.col(d).cast("double").alias("mic") if d in df.columns
                else F.lit(None).cast("double").alias("mic")) for d in drugs]))
    long = df.select(sample, rows.alias("r")).select(sample, "r.*")
    return long.withColumn("class", C.phenotype_word("class")).withColumn("mic_smooth", C.smooth_log2("mic"))


def _predicate(col: str, op: str, value) -> Column:
    return _OPS[op](F.col(col), F.lit(value))


def filter_ops(df: DataFrame, conditions: Sequence[tuple], all: bool = True) -> DataFrame:
    """FLT1: rows where all, or any, of ``(column, operator, value)`` hold."""
    return df.where(reduce(operator.and_ if all else operator.or_, [_predicate(*c) for c in conditions])) if conditions else df


def split_predicate(spec: Mapping[str, Mapping]) -> Column:
    """FLT2: any of ``column: {rule: value}`` with EXACT, NOT, LT, GT, CONTAINS (pattern), CONTAINS_ANY (literals); null is false."""
    found = []
    for col, rules in spec.items():
        x = F.col(col)
        for rule, v in rules.items():
            values = list(v) if isinstance(v, (list, tuple, set)) else [v]
            found.append({
                "EXACT": lambda x=x, v=values: x.isin(v), "NOT": lambda x=x, v=values: ~x.isin(v), "LT": lambda x=x, v=values: x < v[0],
                    "GT": lambda x=x, v=values: x > v[0],
                "CONTAINS": lambda x=x, v=values: x.rlike(v[0]), "CONTAINS_ANY": lambda x=x,
                    v=values: reduce(operator.or_, [x.contains(s) for s in v]),
            }[rule]())
    return F.coalesce(reduce(operator.or_, found), F.lit(False)) if found else F.lit(False)


def split_mask(df: DataFrame, spec: Mapping[str, Mapping], name: str = "split") -> DataFrame:
    """FLT2: ``test`` or ``train`` by the predicate."""
    return df.withColumn(name, F.when(split_predicate(spec), "test").otherwise("train"))


def split_rows(df: DataFrame, spec: Column | str | float | Mapping | DataFrame | Callable[[DataFrame], Column], id: str, seed: int = 0,
    name: str = "split") -> DataFrame:
    """UD5: ``test`` or ``train`` by a condition, the name of a boolean column, a share of the ids, FLT2's rules, a table or list of ids, or a function that gives a condition.

    A null condition is ``train``.
    """
    if callable(spec) and not isinstance(spec, Column):
        spec = spec(df)
    if isinstance(spec, (list, tuple, set)):
        if not spec:
            return df.withColumn(name, F.lit("train"))
        spec = df.sparkSession.createDataFrame([(v,) for v in spec], df.select(id).schema)
    if isinstance(spec, DataFrame):
        ids = spec.select(F.col(spec.columns[0]).alias("_id")).distinct().withColumn("_test", F.lit(True))
        return df.join(ids, F.col(id) == F.col("_id"), "left").withColumn(name, F.when(F.col("_test"), "test").otherwise("train")).drop(
            "_id", "_test")
    if isinstance(spec, float):
        spec = unit(seed, "split", id) < spec
    elif isinstance(spec, Mapping):
        spec = split_predicate(spec)
    elif isinstance(spec, str):
        spec = F.col(spec)
    return df.withColumn(name, F.when(spec, "test").otherwise("train"))


def filter_features(df: DataFrame, cols: Sequence[str], whitelist: DataFrame | Sequence | Mapping | None = None,
    blacklist: DataFrame | Sequence | Mapping | None = None) -> DataFrame:
    """FLT3: rows whose value in any of ``cols`` is listed stay; those with any blacklisted value go."""

    def listed(names) -> Column | None:
        if isinstance(names, Mapping):
            return reduce(operator.or_, [F.coalesce(F.col(c).isin(list(v)), F.lit(False)) for c, v in names.items()])
        return reduce(operator.or_, [F.coalesce(F.col(c).isin(list(names)), F.lit(False)) for c in cols])

    for names, how in ((whitelist, "white"), (blacklist, "black")):
        if names is None:
            continue
        if isinstance(names, DataFrame):
            ids = names.select(F.col(names.columns[0]).alias("_f")).distinct()
            hit = F.lit(False)
            for i, c in enumerate(cols):  # an equality join a column, the flags merged
                df = df.join(ids.select(F.col("_f").alias(f"_f{i}")), F.col(c) == F.col(f"_f{i}"), "left")
                hit = hit | F.col(f"_f{i}").isNotNull()
            df = df.where(hit if how == "white" else ~hit).drop(*[f"_f{i}" for i in range(len(cols))])
        else:
            df = df.where(listed(names) if how == "white" else ~listed(names))
    return df


def _with_size(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group sizes by a partial aggregate joined back; a hot group is split by the join, not gathered."""
    sizes = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count("*").alias("_size"))
    on = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return df.join(sizes, on).drop(*[f"_by_{c}" for c in by])


def min_rows_per(df: DataFrame, by: str | Sequence[str], n: int) -> DataFrame:
    """FLT4."""
    return _with_size(df, [by] if isinstance(by, str) else list(by)).where(F.col("_size") >= n).drop("_size")


def min_group_size(df: DataFrame, by: str | Sequence[str], n: int = 50) -> DataFrame:
    """FLT11."""
    return min_rows_per(df, by, n)


def keep_known_keys(df: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """FLT5: of a laid-out store only the buckets of the table's keys are read, and of these the key."""
    from .store import asked_for

    have = asked_for(store, df, key).select(F.col("key").alias("_key"))
    return df.join(have, F.col(key) == F.col("_key"), "left_semi")


def long_components(df: DataFrame, x: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(x).alias("pos", "value"))


def component_variance(df: DataFrame, x: str) -> DataFrame:
    """Population variance of each component: ``pos, variance``; components are summed where they are read."""
    return long_components(df, x).groupBy("pos").agg(F.var_pop("value").alias("variance"))


def variance_fit(df: DataFrame, x: str, q: float = 0.3) -> list[int]:
    """FLT6: components whose variance is at least the ``q`` quantile (linear) of all; a number each comes to the driver."""
    rows = sorted((r["variance"], r["pos"]) for r in component_variance(df, x).collect())
    if not rows:
        return []
    values = [v for v, _ in rows]
    at = q * (len(values) - 1)
    lo = int(at)
    bound = values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo)
    return sorted(p for v, p in rows if v >= bound)


def variance_transform(df: DataFrame, x: str, indices: Sequence[int]) -> DataFrame:
    """FLT6: only these components."""
    return df.withColumn(x, F.array(*[F.get(x, F.lit(i)) for i in indices]))


def drop_constant_features(long_df: DataFrame, feature: str = "feature", value: str = "value", sample: str = "sample") -> DataFrame:
    """FLT7: features of a long table, absent values zero, that are the same in all samples go."""
    n = long_df.select(F.count_distinct(sample)).first()[0]
    varying = long_df.groupBy(feature).agg(F.count_distinct(sample).alias("k"), F.min(value).alias("lo"), F.max(value).alias("hi")).where(
        (F.col("lo") != F.col("hi")) | ((F.col("k") < n) & ((F.col("lo") != 0) | (F.col("hi") != 0))))
    return long_df.join(varying.select(F.col(feature).alias("_f")), F.col(feature) == F.col("_f"), "left_semi")


def valid_cells(df: DataFrame, by: Sequence[str], label: str, mins: Mapping[str, int]) -> DataFrame:
    """FLT8: groups in which each label occurs more often than its minimum, with the counts."""
    counts = {v: F.count_if(F.col(label) == v).alias(f"n_{v}") for v in mins}
    return df.groupBy(*by).agg(*counts.values()).where(reduce(operator.and_, [F.col(f"n_{v}") > m for v, m in mins.items()]))


def keep_groups_with(df: DataFrame, id: str, col: str, accepted: Sequence[str]) -> DataFrame:
    """FLT9: all rows of ids with at least one accepted value."""
    good = df.where(F.col(col).isin(list(accepted))).select(F.col(id).alias("_id")).distinct()
    return df.join(good, F.col(id) == F.col("_id"), "left_semi")


def split_candidates(df: DataFrame, acc: str, status: str, ok: str = "OK") -> tuple[DataFrame, DataFrame]:
    """FLT10: rows with an accession whose check is fine, and the others."""
    good = F.col(acc).isNotNull() & F.coalesce(F.col(status) == ok, F.lit(False))
    return df.where(good), df.where(~good)
