"""A metric index over vectors: cells around sampled centres, each cell in chunks by the distance to its centre.

Vectors are dealt to the nearest of about two centres for every square root of their number, but a centre for ``CELL_ROWS``
of them at most, as far as the centres fit ``CENTRE_BYTES``. A cell's vectors are sorted by their distance to the centre over range partitions and cut into chunks,
so that a cell of any size is many rows and each chunk is a ring. A query visits only cells, and in them only rings,
that the triangle inequality allows within its bound. Equal vectors are one entry: copies are told apart by their ids
at the end, so that a vector that many rows have is compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import unit
from ..scratch import few_rows, materialise

CENTRE_BYTES = 64 << 20
CHUNK_VALUES = 1 << 16
CHUNK_ROWS = 1024
#: Cells have about so many rows at least.
CELL_ROWS = 32
#: Rows of whole chunks that reach a worker at a time, and bytes of such rows that a file's part holds.
WORK_ROWS = 16
WORK_BYTES = 16 << 20
#: Full chunks of queries that a worker holds at most, rows of the smallest groups, and labels whose counts are held for each query.
GROUP_CHUNKS = 32
GROUP_ROWS = 4096
HELD_LABELS = 16
#: Queries that meet a chunk of entries at a time, and pairs whose distances are taken at a time.
QUERY_ROWS = 1024
PAIRS = 1 << 15

Batches = Iterable[pa.RecordBatch]


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of the rows of ``x`` and ``y``; a vector of zeros has no cosine (NaN)."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    if metric == "euclidean":
        mid = y.mean(axis=0) if len(y) else 0.0  # vectors far from zero lose nothing to cancellation
        x, y = x - mid, y - mid
        near = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
        return np.sqrt(np.maximum(near, 0))
    if metric == "manhattan":
        out = np.empty((len(x), len(y)))
        for i, r in enumerate(x):
            out[i] = np.abs(y - r).sum(1)
        return out
    raise ValueError(f"no such metric: {metric}")


def matrix(values: pa.Array) -> np.ndarray:
    """A list array of lists, all of one length, as rows."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    wid = len(flat) // max(1, len(values))
    if (np.diff(values.offsets.to_numpy()) != wid).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(-1, wid)


def reach(d: np.ndarray | float, metric: str):
    """A distance as one that has the triangle inequality: a cosine distance as that of unit vectors."""
    return np.sqrt(np.maximum(2 * np.asarray(d), 0)) if metric == "cosine" else np.asarray(d)


def _space(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _to_centres(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    return distances(_space(x, metric), centres, "manhattan" if metric == "manhattan" else "euclidean")


def _slack(x: np.ndarray) -> np.ndarray:
    """What rounding may add to distances of about ``x``."""
    return 1e-7 * (1 + x)


@dataclass(frozen=True)
class Index:
    """``entries`` are distinct vectors, ``members`` the rows' ids by entry; ``chunks`` hold the entries of a cell's ring as arrays."""

    metric: str
    id_type: str
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    entries: DataFrame
    members: DataFrame
    chunks: DataFrame


def _assign(centres: np.ndarray, metric: str) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Entries with their nearest centre and the distance to it; vectors that no distance can be told of are left out."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                some = batch.slice(at, CHUNK_ROWS)
                x = matrix(some.column(some.schema.get_field_index("x")))
                if not centres.shape[1]:  # an index of no vectors
                    continue
                if x.shape[1] != centres.shape[1]:
                    raise ValueError("vectors differ in length")
                d = _to_centres(x, centres, metric)
                d[np.isnan(d)] = np.inf
                cell = d.argmin(axis=1)
                near = d[np.arange(len(d)), cell]
                out = pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(near)],
                    names=[*some.schema.names, "cell", "gap"])
                yield out.filter(pa.array(np.isfinite(near)))

    return run


def _chunk_rows(width: int) -> int:
    return max(32, min(CHUNK_ROWS, CHUNK_VALUES // max(1, width)))


def _cut(width: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Rows sorted by (cell, gap) as a row a chunk: ``cell, part, seq, entries, xs, gaps``."""
    most = _chunk_rows(width)

    def pack(cell: int, part: int, seq: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        wrap = lambda c: pa.array([rows[c].to_pylist()], pa.list_(rows.schema.field(c).type)) if len(
            rows) == 0 else pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows[c].chunk(0))
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
            wrap("entry"), wrap("x"), wrap("gap")], names=["cell", "part", "seq", "entries", "xs", "gaps"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, size, now, part, seq = [], 0, None, 0, 0
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            part = batch.column(batch.schema.get_field_index("part"))[0].as_py() if len(batch) else part
            at = 0
            while at < len(batch):
                if cells[at] != now:
                    if size:
                        yield pack(int(now), part, seq, held)
                    held, size, now, seq = [], 0, cells[at], 0
                end = min(at + most - size, int(np.searchsorted(cells, now, "right")))
                held.append(batch.slice(at, end - at))
                size, at = size + end - at, end
                if size == most:
                    yield pack(int(now), part, seq, held)
                    held, size, seq = [], 0, seq + 1
        if size:
            yield pack(int(now), part, seq, held)

    return run


def _chunks(entries: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    parts = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = entries.schema["entry"].dataType.simpleString()
    placed = materialise(entries.mapInArrow(_assign(centres, metric), f"entry {kind}, x array<double>, cell int, gap double"))
    rings = placed.repartitionByRange(parts, "cell", "gap", "entry").sortWithinPartitions("cell", "gap", "entry").withColumn("part",
        F.spark_partition_id())
    made = rings.mapInArrow(_cut(centres.shape[1]),
        f"cell int, part int, seq int, entries array<{kind}>, xs array<array<double>>, gaps array<double>")
    return materialise(made, WORK_BYTES)


def distinct_vectors(df: DataFrame, id: str, x: str) -> tuple[DataFrame, DataFrame]:
    """(``entry, x``, ``entry, id``): distinct vectors, named by their least id, and all rows' ids; null vectors are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(x).cast("array<double>").alias("x"))
    keyed = materialise(rows.withColumn("h", F.xxhash64("x")))
    least = keyed.groupBy("h", "x").agg(F.min("id").alias("entry"))
    entries = materialise(least)
    members = keyed.join(entries.withColumnsRenamed({"h": "_h", "x": "_x"}),
        (F.col("h") == F.col("_h")) & (F.col("x") == F.col("_x"))).select("entry", "id")
    return entries.select("entry", "x"), materialise(members)


def build(df: DataFrame, id: str, x: str, metric: str) -> Index:
    entries, members = distinct_vectors(df, id, x)
    kind = df.schema[id].dataType.simpleString()
    n, first = entries.count(), entries.first()
    width = len(first["x"]) if first else 0
    most = max(1, CENTRE_BYTES // (8 * max(1, width)))
    want = max(1, min(int(2 * np.sqrt(n)), n // CELL_ROWS, most))
    drawn = entries.where(unit(0, "centre", "entry") < want / max(1, n)).limit(min(most, 2 * want)).select("x").toArrow().combine_chunks(
        )  # CENTRE_BYTES or less
    centres = matrix(drawn["x"].combine_chunks()) if len(drawn) else np.array([first["x"]] if first else np.zeros((0, width)))
    centres = _space(centres, metric)
    centres = centres[np.isfinite(centres).all(axis=1)]
    if not len(centres):
        centres = np.eye(1, width)
    chunks = _chunks(entries, centres, metric)
    m = len(centres)
    low, high, sizes = np.full(m, np.inf), np.full(m, -np.inf), np.zeros(m, np.int64)
    stats = chunks.groupBy("cell").agg(F.min(F.array_min("gaps")).alias("lo"), F.max(F.array_max("gaps")).alias("hi"),
        F.sum(F.size("entries")).alias("n"))
    for r in stats.collect():  # a row a centre
        low[r["cell"]], high[r["cell"]], sizes[r["cell"]] = r["lo"], r["hi"], r["n"]
    return Index(metric, kind, centres, low, high, sizes, entries, members, chunks)


def placed_chunks(entries: DataFrame, index: Index) -> DataFrame:
    """Entries of another table in chunks by the cells of ``index``."""
    return _chunks(entries, index.centres, index.metric)


def _bounds_by_sizes(d: np.ndarray, high: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each row has ``k`` entries, from the cells' sizes and radii; infinite where there are too few."""
    m = min(len(high), k)
    far = d + high
    cells = np.argpartition(far, m - 1, axis=1)[:, :m]
    some = np.take_along_axis(far, cells, 1)
    order = np.argsort(some, axis=1)
    enough = np.cumsum(sizes[np.take_along_axis(cells, order, 1)], axis=1) >= k
    out = np.take_along_axis(some, order, 1)[np.arange(len(d)), enough.argmax(axis=1)]
    return np.where(enough.any(axis=1), out, np.inf)


def _bounded(index: Index, k: int | None, radius: float | None, emit: Callable) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Chunks of queries (with ``near``, entries of their own cell) to what ``emit`` makes of (row, bounds, cells, which query must visit which of them)."""
    metric, held = index.metric, np.nonzero(index.sizes)[0]
    cs, lo, hi, ns = index.centres[held], index.low[held], index.high[held], index.sizes[held]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                xs, near = (row.column(row.schema.get_field_index(c))[0].values for c in ("xs", "near"))
                x = matrix(xs)
                d = _to_centres(x, cs, metric)
                if k is None:
                    bound = np.full(len(x), float(reach(radius, metric)))
                else:
                    bound = _bounds_by_sizes(d, hi, ns, k)
                    if near is not None and len(near) >= k:
                        own = reach(distances(x, matrix(near), metric), metric)
                        bound = np.minimum(bound, np.partition(own, k - 1, axis=1)[:, k - 1])
                slack = _slack(np.where(np.isfinite(bound), bound, 0))[:, None] + _slack(d)
                yield from emit(row, bound, held, np.maximum(d - hi, lo - d) <= bound[:, None] + slack)

    return run


def _with_heads(index: Index, chunks: DataFrame) -> DataFrame:
    """Chunks with ``near``: the first entries of their cell."""
    heads = index.chunks.where("seq = 0")
    one = heads.groupBy("cell").agg(F.min("part").alias("part"))
    heads = heads.join(one, ["cell", "part"], "left_semi").select("cell", F.col("xs").alias("near"))
    return chunks.select("cell", "part", "seq", "entries", "xs").join(heads, "cell", "left")


def _list(a: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def visits(index: Index, queries: Index | None = None, k: int | None = None, radius: float | None = None) -> DataFrame:
    """``cell, queries``: which entries must be looked up in which cells, for ``k`` nearest entries or those within ``radius``."""

    def emit(row: pa.RecordBatch, bound: np.ndarray, cells: np.ndarray, go: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = row.column(row.schema.get_field_index("entries"))[0].values
        for c in np.nonzero(go.any(axis=0))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([cells[c]], pa.int32()), _list(ids.take(pa.array(np.nonzero(go[:, c])[0])))],
                names=["cell", "queries"])

    both = _with_heads(index, (queries or index).chunks)
    return both.mapInArrow(_bounded(index, k, radius, emit), f"cell int, queries array<{(queries or index).id_type}>")


def _groups(index: Index, chunks: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows a group, each cell's first group, its number of groups): cells that lie near each other share a group, a large one has several."""
    n = np.zeros(len(index.centres), np.int64)
    for r in chunks.groupBy("cell").agg(F.sum(F.size("entries")).alias("n")).collect():  # a row a centre
        n[r["cell"]] = r["n"]
    size = int(min(GROUP_CHUNKS * _chunk_rows(index.centres.shape[1]), max(GROUP_ROWS, -(-n.sum() // 8))))
    first, pieces = np.zeros(len(n), np.int64), np.maximum(1, -(-n // size))
    c = index.centres - index.centres.mean(axis=0)
    line = c @ c[(c**2).sum(axis=1).argmax()]
    at, filled = 0, 0
    for cell in np.argsort(line, kind="stable"):
        if filled and filled + n[cell] > size:
            at, filled = at + 1, 0
        first[cell] = at
        if n[cell] > size:
            at += pieces[cell]
        else:
            filled += n[cell]
    return size, first, pieces


def _meet(index: Index, queries: Index | None, k: int | None, radius: float | None, more: DataFrame | None = None) -> DataFrame:
    """Tiles, sorted: a group of query chunks with their bounds, then the entry chunks of a slice of the cells that the group visits.

    A chunk of entries travels once to each group that must see it, not once to each chunk of queries, and a worker holds one group.
    """
    asked, spark = (queries or index).chunks, index.chunks.sparkSession
    size, first, pieces = _groups(index, asked)

    def emit(row: pa.RecordBatch, bound: np.ndarray, cells: np.ndarray, go: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, part, seq, ids, xs = (row.column(row.schema.get_field_index(c)) for c in ("cell", "part", "seq", "entries", "xs"))
        c = cell[0].as_py()
        grp = int(first[c] + (part[0].as_py() * 31 + seq[0].as_py()) % pieces[c])
        seen = cells[go.any(axis=0)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), cell, part, seq, ids, xs, _list(pa.array(bound)),
            _list(pa.array(seen))], names=["grp", "cell", "part", "seq", "queries", "xs", "gaps", "seen"])

    kind = (queries or index).id_type
    with few_rows(spark, WORK_ROWS):
        bounded = materialise(_with_heads(index, asked).mapInArrow(_bounded(index, k, radius, emit),
            f"grp long, cell int, part int, seq int, queries array<{kind}>, xs array<array<double>>, gaps array<double>, seen array<int>"),
            WORK_BYTES)
    need = materialise(bounded.select("grp", F.explode("seen").alias("cell")).distinct())
    counts = index.chunks.groupBy("cell").agg(F.sum(F.size("entries")).alias("n"))
    slices = materialise(need.join(counts, "cell").groupBy("grp").agg(F.ceil(F.sum("n") / size).cast("int").alias("slices")))
    entries = (index.chunks if more is None else index.chunks.join(more, ["cell", "part", "seq"])).join(need, "cell").join(slices, "grp")
    entries = entries.withColumn("slice", F.pmod(F.xxhash64("cell", "part", "seq"), F.col("slices")).cast("int")).withColumn("queries",
        F.lit(None).cast(f"array<{kind}>"))
    held = bounded.drop("seen").join(slices, "grp").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    extra = [] if more is None else ["weights"]
    held = held.withColumns({c: F.lit(None).cast(entries.schema[c].dataType) for c in ["entries", *extra]})
    names = ["grp", "slice", "cell", "part", "seq", "queries", "entries", "xs", "gaps", *extra]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = held.select(*names).unionByName(entries.select(*names)).withColumn("entry_side", F.col("queries").isNull())
    return both.repartition(parts, "grp", "slice").sortWithinPartitions("grp", "slice", "entry_side", "cell", "part", "seq")


def _compared(met: DataFrame, run: Callable, schema: str, then: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """What ``run`` makes of the tiles of ``_meet``, by ``then``, as a written table: a row is a chunk, so few are handed over at a time."""
    with few_rows(met.sparkSession, WORK_ROWS):
        return materialise(then(met.mapInArrow(run, schema)))


@dataclass
class _Asked:
    """A chunk of queries that a tile holds; ``bounds`` are of ``reach``, ``state`` is what has been found for it in the tile."""

    key: tuple
    ids: pa.Array
    x: np.ndarray
    bounds: np.ndarray
    state: np.ndarray | dict | None = None


def _kernel(index: Index, pick: Callable | int, own: bool, weighted: bool = False,
    end: Callable[[_Asked], Iterator[pa.RecordBatch]] | None = None) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Sorted tiles to what ``pick`` makes of (chunk of queries, its rows in reach, entry ids, distances, weights), then ``end`` of each chunk of queries.

    For a number in place of ``pick``, to so many nearest entries (``_nearest``). Rings beyond a query's bound, which ``pick`` may lower,
    are not compared. Where entries ask for themselves (``own``) their distance is 0.
    """
    if isinstance(pick, int):
        return _nearest(index, pick, own)
    centres, metric = index.centres, index.metric

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            for q in held if end else ():
                yield from end(q)
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                col = lambda c: batch.column(batch.schema.get_field_index(c))[i]  # noqa: B023,E731
                tile, key = (col("grp").as_py(), col("slice").as_py()), (col("cell").as_py(), col("part").as_py(), col("seq").as_py())
                if tile != now:
                    yield from close()
                    now = tile
                x, gaps = matrix(col("xs").values), col("gaps").values.to_numpy()
                if not col("entry_side").as_py():
                    ids = col("queries").values
                    held.append(_Asked(key, ids.take(pa.array(np.arange(len(ids)))), x.copy(), gaps.copy()))  # a view would keep the whole batch
                    continue
                rids, extra = col("entries").values, col("weights").values if weighted else None
                for q in held:
                    g, b = _to_centres(q.x, centres[key[0] : key[0] + 1], metric)[:, 0], q.bounds
                    live = np.nonzero(np.maximum(g - gaps.max(), gaps.min() - g) <= b + _slack(np.where(np.isfinite(b), b, 0)) + _slack(g))[0]
                    if len(live):
                        d = distances(q.x[live], x, metric)
                        if own and q.key == key:
                            d[np.arange(len(live)), live] = 0.0
                        yield from pick(q, live, rids, d, extra)
        yield from close()

    return run


def _single(x: np.ndarray, mid: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Rows less ``mid`` with a one at their end in single precision, and their lengths."""
    u = x - mid
    return np.hstack([u, np.ones((len(u), 1))]).astype(np.float32), np.sqrt((u**2).sum(1))


def close_pairs(x: np.ndarray, y: np.ndarray, most: np.ndarray, k: int, metric: str,
    ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance), by row, of the pairs within ``most`` of their row; some beyond a row's ``k`` nearest may be left out.

    Products in single precision, with a margin for their rounding, leave few pairs, whose distances are taken in double precision.
    ``ready`` are a middle and ``_single`` of ``x`` by it, which serve where it lies so near ``y`` that the margin is small.
    """
    if metric == "cosine":
        x, y = _space(x, metric), _space(y, metric)
    if metric == "manhattan" or not max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e15:
        d = distances(x, y, metric)
        row, col = np.nonzero((d <= most[:, None]) & np.isfinite(d))
        return row, col, d[row, col]
    share = (x.shape[1] + 8) * 2.0**-22
    if metric == "cosine":
        (u, long), v, low = _single(x, 0.0), np.hstack([y, np.zeros((len(y), 1))]), 1 - most
        top = 1.0
    else:
        mid, u, long = ready or (y.mean(axis=0), None, None)
        top = np.sqrt(((y - mid) ** 2).sum(1).max())
        if u is None or np.median(share * (long * top + top**2)) > np.median(most**2) / 128:
            mid = y.mean(axis=0)
            (u, long), top = _single(x, mid), np.sqrt(((y - mid) ** 2).sum(1).max())
        v = y - mid
        v = np.hstack([v, -(v**2).sum(1)[:, None] / 2])  # x.y - y.y / 2 grows as distance falls
        low = (long**2 - most**2) / 2
    margin = share * (long * top + top**2)
    s = u @ v.astype(np.float32).T
    keep = s >= (low - margin).astype(np.float32)[:, None]
    at = np.flatnonzero(keep)  # few: faster than counts of all rows
    crowded = np.nonzero(np.bincount(at // len(y), minlength=len(x)) > k)[0]
    if len(crowded):
        kth = np.partition(s[crowded], len(y) - k, axis=1)[:, len(y) - k].astype(float)
        tied = 1e-11 * (1 if metric == "cosine" else np.sqrt(np.maximum(long[crowded] ** 2 - 2 * kth, 0)) + 1e-11)  # ties are to 12 places
        keep[crowded] &= s[crowded] >= (kth - 2 * margin[crowded] - tied).astype(np.float32)[:, None]
        at = np.flatnonzero(keep)
    row, col = np.divmod(at, len(y))
    d = np.empty(len(row))
    for at in range(0, len(row), PAIRS):
        p, q = x[row[at : at + PAIRS]], y[col[at : at + PAIRS]]
        d[at : at + PAIRS] = 1 - np.einsum("ij,ij->i", p, q) if metric == "cosine" else np.sqrt(np.einsum("ij,ij->i", p - q, p - q))
    near = d <= most[row]
    return row[near], col[near], d[near]


def _within_rows(row: np.ndarray) -> np.ndarray:
    """Each place's number within its run of equal, sorted rows."""
    return np.arange(len(row)) - np.searchsorted(row, row)


class _Held:
    """All queries of a tile: their ids, vectors, bounds (of ``reach``) and the ``k`` nearest entries so far; ``places`` are the chunks' first rows.

    ``least`` are the distances of the nearest entries and ``which`` their numbers in ``entries``, the chunks that have given one.
    """

    def __init__(self, asked: list[tuple], k: int, metric: str):
        self.ids = pa.concat_arrays([ids for _, ids, _, _ in asked])
        self.x = np.concatenate([x for _, _, x, _ in asked])
        self.bounds = np.concatenate([b for _, _, _, b in asked])
        self.least, self.which = np.full((len(self.x), k), np.inf), np.zeros((len(self.x), k), np.int64)
        self.entries: list[pa.Array] = []
        self.seen = 0
        sizes = [len(x) for _, _, x, _ in asked]
        self.places = {key: at for (key, *_), at in zip(asked, np.cumsum(sizes) - sizes, strict=True)}
        self.metric, self.plain = metric, metric == "euclidean" and np.abs(self.x).max(initial=0) < 1e15
        if self.plain:
            self.mid = self.x.mean(axis=0)
            self.single, self.long = _single(self.x, self.mid)

    def gaps(self, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the distances to a centre are at least and at most."""
        c = centre - self.mid if self.plain else centre
        if not self.plain or not np.abs(c).max(initial=0) < 1e15:
            g = _to_centres(self.x, centre[None], self.metric)[:, 0]
            return g, g
        near = self.long**2 + c @ c - 2 * (self.x @ c - self.mid @ c)
        wide = self.long + np.sqrt(c @ c) + np.abs(self.mid).max(initial=0)
        rounding = (len(c) + 8) * 2.0**-50 * wide * (wide + np.sqrt(len(c)) * np.abs(self.mid).max(initial=0))
        return np.sqrt(np.maximum(near - rounding, 0)), np.sqrt(np.maximum(near + rounding, 0))

    def found(self) -> Iterator[pa.RecordBatch]:
        """The nearest entries of all queries, few queries at a time."""
        every = pa.concat_arrays(self.entries) if self.entries else None
        for at in range(0, len(self.x) if self.entries else 0, QUERY_ROWS):
            row, col = np.nonzero(np.isfinite(self.least[at : at + QUERY_ROWS]))
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(at + row)), every.take(pa.array(self.which[at + row, col])),
                pa.array(self.least[at + row, col])], names=["query", "entry", "distance"])

    def ready(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        return (self.mid, self.single[some], self.long[some]) if self.plain else None


def _nearest(index: Index, k: int, own: bool) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Sorted tiles to ``query, entry, distance``: of each chunk of entries the nearest ones of all queries that its ring is in reach of, ``QUERY_ROWS`` at a time.

    A query's ``k``-th distance so far is its bound. What leaves a tile are its ``k`` nearest entries of each query at its end, and before
    it those that tie with the ``k``-th (to 12 places), of which ids tell the nearest.
    """
    centres, metric = index.centres, index.metric

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, asked, held = None, [], None
        for batch in batches:
            for i in range(len(batch)):
                col = lambda c: batch.column(batch.schema.get_field_index(c))[i]  # noqa: B023,E731
                tile, key = (col("grp").as_py(), col("slice").as_py()), (col("cell").as_py(), col("part").as_py(), col("seq").as_py())
                if tile != now:
                    if held is not None:
                        yield from held.found()
                    now, asked, held = tile, [], None
                y, gaps = matrix(col("xs").values), col("gaps").values.to_numpy()
                if not col("entry_side").as_py():
                    ids = col("queries").values
                    asked.append((key, ids.take(pa.array(np.arange(len(ids)))), y.copy(), gaps.copy()))  # a view would keep the whole batch
                    continue
                if held is None:
                    if not asked:
                        continue
                    held, asked = _Held(asked, k, metric), []
                yield from meet(held, key, y, gaps, col("entries").values)
        if held is not None:
            yield from held.found()

    def meet(held: _Held, key: tuple, y: np.ndarray, gaps: np.ndarray, rids: pa.Array) -> Iterator[pa.RecordBatch]:
        order, kept, first, (g, far), b = None, False, 0, held.gaps(centres[key[0]]), held.bounds
        live = np.nonzero(np.maximum(g - gaps.max(), gaps.min() - far) <= b + _slack(np.where(np.isfinite(b), b, 0)) + _slack(far))[0]
        for at in range(0, len(live), QUERY_ROWS):
            some = live[at : at + QUERY_ROWS]
            b = held.bounds[some] + _slack(np.where(np.isfinite(held.bounds[some]), held.bounds[some], 0))
            most = np.minimum(b**2 / 2 if metric == "cosine" else b, held.least[some].max(axis=1) + 1e-11)
            row, col, d = close_pairs(held.x[some], y, most, k, metric, held.ready(some))
            if own and key in held.places:
                d[some[row] - held.places[key] == col] = 0.0
            if not len(row):
                continue
            if _within_rows(row).max() >= k:
                if order is None:
                    order = np.argsort(np.argsort(np.array(rids.to_pylist())))
                by = np.lexsort((order[col], np.round(d, 12), row))
                by = by[_within_rows(row[by]) < k]
                row, col, d = row[by], col[by], d[by]
            if not kept:
                held.entries.append(rids.take(pa.array(np.arange(len(rids)))))
                first, kept = held.seen, True
                held.seen += len(rids)
            hit = np.unique(row)
            at_hit, place = some[hit], (np.searchsorted(hit, row), k + _within_rows(row))
            d_all = np.concatenate([held.least[at_hit], np.full((len(hit), k), np.inf)], axis=1)
            e_all = np.concatenate([held.which[at_hit], np.zeros((len(hit), k), np.int64)], axis=1)
            d_all[place], e_all[place] = d, first + col
            by = np.argpartition(d_all, k - 1, axis=1)
            d_all, e_all = np.take_along_axis(d_all, by, 1), np.take_along_axis(e_all, by, 1)
            held.least[at_hit], held.which[at_hit] = d_all[:, :k], e_all[:, :k]
            edge = d_all[:, :k].max(axis=1)
            held.bounds[at_hit] = np.minimum(held.bounds[at_hit], reach(edge + 1e-11, metric))
            r, c = np.nonzero((d_all[:, k:] <= edge[:, None] + 1e-11) & np.isfinite(d_all[:, k:]))
            if len(r):
                every = pa.concat_arrays(held.entries)
                held.entries = [every]
                yield pa.RecordBatch.from_arrays([held.ids.take(pa.array(at_hit[r])), every.take(pa.array(e_all[r, k + c])),
                    pa.array(d_all[r, k + c])], names=["query", "entry", "distance"])

    return run


def nearest_entries(index: Index, k: int, queries: Index | None = None) -> DataFrame:
    """``query, entry, distance``: the ``k`` nearest entries of each query entry, its own vector (distance 0) counted; ties (to 12 places) by entry."""
    order = Window.partitionBy("query").orderBy(F.round("distance", 12), "entry")
    met = _meet(index, queries, k, None)
    return _compared(met, _kernel(index, k, queries is None), f"query {(queries or index).id_type}, entry {index.id_type}, distance double",
        lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))


def entries_within(index: Index, radius: float, queries: Index | None = None) -> DataFrame:
    """``query, entry, distance``: all entries within ``radius`` of each query entry, its own vector too."""

    def near(q: _Asked, live: np.ndarray, rids: pa.Array, d: np.ndarray, _: None) -> Iterator[pa.RecordBatch]:
        row, col = np.nonzero(d <= radius)
        yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(live[row])), rids.take(pa.array(col)), pa.array(d[row, col])],
            names=["query", "entry", "distance"])

    met = _meet(index, queries, None, radius)
    return _compared(met, _kernel(index, near, queries is None), f"query {(queries or index).id_type}, entry {index.id_type}, distance double")


def counts_within(index: Index, radii: Sequence[float], labels: DataFrame | None = None, queries: Index | None = None) -> DataFrame:
    """``query, radius, label, n``: how many rows of each label (``id, label``; none: null) lie within each radius of a query entry; counted in the tiles, no pair leaves them."""
    if labels is None:
        each = index.members.select("entry", F.lit(None).cast("string").alias("label"))
    else:
        each = index.members.join(labels.select("id", "label"), "id").select("entry", "label")
    each = each.groupBy("entry", "label").agg(F.count("*").alias("n"))
    kind = each.schema["label"].dataType.simpleString()
    places = index.chunks.select("cell", "part", "seq", F.posexplode("entries").alias("at", "entry"))
    weights = places.join(each, "entry").groupBy("cell", "part",
        "seq").agg(F.collect_list(F.struct("at", "label", "n")).alias("weights"))  # a chunk's labels

    def rows(q: _Asked, at: np.ndarray, radius: float, names: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        row, col = np.nonzero(n)
        return pa.RecordBatch.from_arrays([q.ids.take(pa.array(at[row])), pa.array(np.full(len(row), float(radius))),
            names.take(pa.array(col)), pa.array(n[row, col].astype(np.int64))], names=["query", "radius", "label", "n"])

    def count(q: _Asked, live: np.ndarray, rids: pa.Array, d: np.ndarray, extra: pa.StructArray) -> Iterator[pa.RecordBatch]:
        names = extra.field("label").dictionary_encode("encode")
        table = np.zeros((len(rids), max(1, len(names.dictionary))))
        np.add.at(table, (extra.field("at").to_numpy(), names.indices.to_numpy(zero_copy_only=False)), extra.field("n").to_numpy())
        if q.state is None:
            q.state = {"labels": {}, "kind": names.dictionary.type, "n": np.zeros((len(radii), len(q.x), HELD_LABELS))}
        known = q.state["labels"]
        for v in names.dictionary.to_pylist():
            if v not in known and len(known) < HELD_LABELS:
                known[v] = len(known)
        place = np.array([known.get(v, -1) for v in names.dictionary.to_pylist()], np.int64)
        for j, r in enumerate(radii):
            n = (d <= r) @ table
            q.state["n"][j][np.ix_(live, place[place >= 0])] += n[:, place >= 0]
            if (place < 0).any():  # labels beyond those that are held leave at once
                n[:, place >= 0] = 0
                yield rows(q, live, r, names.dictionary, n)

    def end(q: _Asked) -> Iterator[pa.RecordBatch]:
        if q.state is not None:
            names = pa.array(list(q.state["labels"]), q.state["kind"])
            for j, r in enumerate(radii):
                yield rows(q, np.arange(len(q.x)), r, names, q.state["n"][j])

    met = _meet(index, queries, None, max(radii), weights)
    return _compared(met, _kernel(index, count, queries is None, True, end), f"query {(queries or index).id_type}, radius double, label {kind}, n long",
        lambda found: found.groupBy("query", "radius", "label").agg(F.sum("n").alias("n")))


def first_members(members: DataFrame, k: int) -> DataFrame:
    """The ``k`` least ids of each entry; kept where rows are read, so an entry of very many rows is not shuffled."""
    w = Window.partitionBy("entry").orderBy("id")
    return members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
