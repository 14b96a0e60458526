"""How the plan modules list their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, SQL, a decorator that adds a query under its function's name)."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            queries[fn.__name__] = fn
            if text:
                sql[fn.__name__] = text
            return fn

        return add

    return queries, sql, query


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in cols})


def long_vector(df: DataFrame, *keep: str, x: str = "x", places: int = 6) -> DataFrame:
    """A row a component, so that vectors compare as numbers."""
    return rounded(df.select(*keep, F.posexplode(x).alias("pos", "value")), "value", places=places)


def drawn(seed: int, purpose: str, *exprs: str) -> str:
    """SQL of ``functions.seeded.draw``."""
    ids = "".join(f", coalesce(CAST({e} AS VARCHAR), '~')" for e in exprs)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}|{purpose}'{ids})), 1, 15))::BIGINT"


def drawn_unit(seed: int, purpose: str, *exprs: str) -> str:
    """SQL of ``functions.seeded.unit``."""
    return f"(({drawn(seed, purpose, *exprs)} % {1 << 52}) / {1 << 52}::DOUBLE)"


def _tail(density: str, start: str, width: float, steps: int) -> str:
    """SQL of the integral of a density of ``x`` from ``start`` over ``width``, by Simpson's rule."""
    h = width / steps
    x = f"({start} + i * {h})"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT {h} / 3 * sum(({weight}) * {density.replace('@', x)}) FROM range(0, {steps + 1}) steps(i))"


def normal_tail(z: str) -> str:
    """Two-sided p-value of a standard normal value."""
    return f"least(1, 2 * {_tail('exp(-@ * @ / 2) / sqrt(2 * pi())', f'abs({z})', 40.0, 10_000)})"


def student_tail(t: str, df: str) -> str:
    """Two-sided p-value of Student's t."""
    log = f"lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - ln(pi() * {df}) / 2 - ({df} + 1) / 2.0 * ln(1 + @ * @ / {df})"
    return f"(2 * {_tail(f'exp({log})', f'abs({t})', 60.0, 10_000)})"


def chi2_tail(v: str, df: str, steps: int = 2_000) -> str:
    log = f"({df} / 2.0 - 1) * ln(@) - @ / 2 - {df} / 2.0 * ln(2) - lgamma({df} / 2.0)"
    return _tail(f"exp({log})", v, 200.0, steps)


def pairs_sql(seed: int, n: int) -> str:
    """SQL of ``sampling.related_pairs`` of embeddings by label, as a list of common tables that ends with ``p``."""
    return f"""WITH r AS (SELECT vec_id AS id, label AS g, row_number() OVER (PARTITION BY label ORDER BY {drawn(seed, 'pairs', 'vec_id')},
 vec_id) AS n FROM embeddings WHERE label IS NOT NULL),
w AS (SELECT * FROM r WHERE n <= {2 * n} AND g IN (SELECT g FROM r GROUP BY g HAVING count(*) >= {2 * n})), i AS (SELECT g,
 row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT g FROM w)),
o AS (SELECT a.g, b.g AS other FROM i a JOIN i b ON b.i = (a.i + 1 + {drawn(seed, 'other', 'a.g')} % (a.k - 1)) % a.k),
p AS (SELECT x.id AS a, y.id AS b, true AS related FROM w x JOIN w y ON x.g = y.g AND y.n = x.n + 1 WHERE x.n % 2 = 1 UNION ALL SELECT x.id,
 y.id, false FROM w x JOIN o ON x.g = o.g JOIN w y ON y.g = o.other AND y.n = x.n + 1 WHERE x.n % 2 = 1)"""


def random_pairs_sql(rows: str, id: str, n: int, seed: int, name: str = "p") -> str:
    """SQL of ``sampling.random_pairs`` where there are many more pairs than wanted: common tables that end with ``name``."""
    return f"""{name}_i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT {id} AS id
 FROM {rows})),
{name}_x AS (SELECT id, {drawn(seed, 'first', 'id')} % k AS x, {drawn(seed, 'second', 'id')} % k AS y FROM range(0, {3 * n + 64}) t(id),
 (SELECT max(k) AS k FROM {name}_i)),
{name}_o AS (SELECT DISTINCT least(x, y) AS l, greatest(x, y) AS h FROM {name}_x WHERE x <> y), {name}_c AS (SELECT * FROM {name}_o
 ORDER BY {drawn(seed, 'pair', 'l', 'h')}, l, h LIMIT {n}),
{name} AS (SELECT a.id AS a, b.id AS b FROM {name}_c c JOIN {name}_i a ON a.i = c.l JOIN {name}_i b ON b.i = c.h)"""
