from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import neighbors as N
from lociframe.operators import vector_index as V

SCHEMA = "id string, x array<double>, label string"


def _dist(a, b, metric):
    if metric == "cosine":
        return 1 - a @ b / np.sqrt((a @ a) * (b @ b))
    return np.abs(a - b).sum() if metric == "manhattan" else np.sqrt(((a - b) ** 2).sum())


def _clustered(n: int, width: int, groups: int, seed: int, far: float = 0.0) -> list[tuple]:
    rnd = np.random.default_rng(seed)
    mids = rnd.normal(size=(groups, width)) * 10 + far
    return [(f"v{i:05d}", (mids[i % groups] + rnd.normal(size=width) * 0.3).round(3).tolist(), f"l{i % groups % 3}") for i in range(n)]


def _brute(queries, refs, k, metric):
    out = {}
    for q, x, _ in queries:
        near = sorted((round(_dist(np.array(x), np.array(y), metric), 9), r) for r, y, _ in refs if r != q and np.isfinite(y).all() and np.any(y))
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_nearest_are_those_of_all_pairs(spark, metric):
    rows = _clustered(230, 6, 9, 1)
    rows += [(f"copy{i:02d}", rows[0][1], "l0") for i in range(40)] + [(f"same{i}", [1.0] * 6, "l1") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in sorted(N.knn(df, df, "id", "x", 4, metric).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["distance"], r["neighbor"]))
    want = _brute(rows, rows, 4, metric)
    assert set(got) == set(want)
    for q, near in want.items():
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in near], atol=2e-7)
        if near[0][0] == 0:  # ties of copies go by id
            zeros = [n for d, n in near if d == 0]
            assert [n for _, n in got[q]][: len(zeros)] == zeros


def test_other_tables_and_odd_vectors(spark):
    refs = _clustered(120, 4, 5, 2) + [("zero", [0.0] * 4, "l0"), ("nan", [float("nan")] * 4, "l0"), ("null", None, "l0")]
    asked = [("v00003", [9.0, 9.0, 9.0, 9.0], "l0"), ("q", refs[7][1], "l1"), ("none", None, "l1")]
    q, r = spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    got = {(x["id"], x["rank"]): (x["neighbor"], x["distance"]) for x in N.knn(q, r, "id", "x", 3, "cosine").collect()}
    want = _brute([a for a in asked if a[1]], [x for x in refs if x[1] is not None], 3, "cosine")
    assert {k: v[0] for k, v in got.items()} == {(i, n + 1): near[n][1] for i, near in want.items() for n in range(3)}
    assert N.knn(q, r.limit(0), "id", "x", 3).count() == 0 and N.knn(q.limit(0), r, "id", "x", 3).count() == 0
    few = spark.createDataFrame([("a", [1.0], "l"), ("b", [2.0], "l")], SCHEMA)
    assert N.knn(few, few, "id", "x", 5).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        N.knn(few, few.union(spark.createDataFrame([("c", [1.0, 2.0], "l")], SCHEMA)), "id", "x", 1).collect()


def test_far_from_zero(spark):
    rows = _clustered(80, 3, 4, 3, far=1e7)
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows, rows, 2, "euclidean")
    for r in N.knn(df, df, "id", "x", 2).collect():
        assert abs(r["distance"] - want[r["id"]][r["rank"] - 1][0]) < 1e-4


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_few_cells_are_visited(spark, metric):
    """On clustered vectors a query compares itself with under a tenth of all."""
    df = spark.createDataFrame(_clustered(6000, 16, 60, 4), SCHEMA)
    index = V.build(df, "id", "x", metric)
    sizes = index.chunks.groupBy("cell").agg(F.sum(F.size("entries")).alias("n"))
    for found in (V.visits(index, k=6), V.visits(index, radius=1.5 if metric == "euclidean" else 0.01)):
        met = found.join(sizes, "cell").agg(F.sum(F.size("queries") * F.col("n"))).first()[0]
        assert met < 0.1 * 6000**2
    plan = N.knn(df, df, "id", "x", 5, metric)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_copies_are_compared_once(spark):
    """Two thirds of the rows are one vector: it is one entry, and no more rows than k a query leave the comparison."""
    rows = _clustered(1000, 4, 10, 5) + [(f"w{i:05d}", [3.0, 3.0, 3.0, 3.0], "l0") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = V.build(df, "id", "x", "euclidean")
    assert index.entries.count() <= 1001
    most = V.nearest_entries(index, 4).groupBy("query").count().agg(F.max("count")).first()[0]
    assert most <= 4 * index.chunks.count()
    got = N.knn(df, df, "id", "x", 3).where("id = 'w00007'").orderBy("rank").collect()
    assert [(r["neighbor"], r["distance"]) for r in got] == [("w00000", 0.0), ("w00001", 0.0), ("w00002", 0.0)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_radius_pairs_and_counts(spark, metric):
    rows = _clustered(150, 5, 6, 6) + [(f"copy{i}", [1.0, 2.0, 3.0, 4.0, 5.0], f"l{i % 2}") for i in range(12)]
    radii = {"euclidean": [0.0, 0.9, 4.0], "cosine": [0.0, 0.01, 0.3], "manhattan": [0.0, 2.0, 8.0]}[metric]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, counts = {}, {}
    for q, x, _ in rows:
        for r, y, lab in rows:
            d = 0.0 if x == y else _dist(np.array(x), np.array(y), metric)
            for radius in radii:
                if q != r and d <= radius:
                    counts[q, radius, lab] = counts.get((q, radius, lab), 0) + 1
                    if radius == radii[1]:
                        pairs[q, r] = d
    got = {(r["id"], r["neighbor"]): r["distance"] for r in N.radius_neighbors(df, df, "id", "x", radii[1], metric).collect()}
    assert set(got) == set(pairs) and all(abs(got[p] - pairs[p]) < 1e-6 for p in got)
    found = {(r["id"], r["radius"], r["label"]): r["n"] for r in N.radius_counts(df, df, "id", "x", radii, metric, "label").collect()}
    assert found == counts
    some = df.where("id like 'copy%' or id like '%3'")
    part = {(r["id"], r["radius"], r["label"]): r["n"] for r in N.radius_counts(some, df, "id", "x", radii, metric, "label").collect()}
    ids = {r["id"] for r in some.collect()}
    assert part == {k: v for k, v in counts.items() if k[0] in ids}


def test_few_chunks_reach_a_worker_at_a_time(spark, monkeypatch):
    """A row of work holds two chunks of vectors, so rows by thousands would not fit a worker."""
    kernel = N.V._kernel

    def strict(*args, **more):
        run = kernel(*args, **more)

        def checked(batches):
            def few():
                for batch in batches:
                    assert len(batch) <= 16
                    yield batch

            yield from run(few())

        return checked

    monkeypatch.setattr(N.V, "_kernel", strict)
    monkeypatch.setattr(N.V, "CHUNK_ROWS", 32)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(r["id"], r["neighbor"]) for r in N.knn(df, df, "id", "x", 1).collect()} == set(enumerate(d.argmin(1).tolist()))
    assert {r["id"]: r["n"] for r in N.radius_counts(df, df, "id", "x", [0.5]).collect()} == {i: int(n) for i, n in enumerate((d <= 0.5).sum(1)) if n}
    assert N.radius_neighbors(df, df, "id", "x", 0.3).count() == int((d <= 0.3).sum())


def test_a_vector_travels_a_few_times(spark, monkeypatch, tmp_path):
    """Vectors without structure visit all cells; they travel once to each group that must see them, not once to each cell and chunk."""
    kernel = N.V._kernel

    def counted(*args, **more):
        run = kernel(*args, **more)

        def told(batches):
            def each():
                for batch in batches:
                    n = sum(len(v.values) for name in batch.schema.names if name in ("xs", "qxs") for v in batch.column(name))
                    with (tmp_path / "seen").open("a") as f:
                        f.write(f"{n}\n")
                    yield batch

            yield from run(each())

        return told

    monkeypatch.setattr(N.V, "_kernel", counted)
    monkeypatch.setattr(N.V, "CHUNK_ROWS", 64)
    monkeypatch.setattr(N.V, "CELL_ROWS", 64)
    x = np.random.default_rng(6).standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(r["id"], r["neighbor"]) for r in N.knn(df, df, "id", "x", 1).collect()} == set(enumerate(d.argmin(1).tolist()))
    assert sum(map(int, (tmp_path / "seen").read_text().split())) < 10 * len(x)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_close_pairs_hold_all_nearest(metric):
    """Single precision leaves out no neighbour: equal and nearly equal vectors, far from zero, tiny and huge."""
    rng = np.random.default_rng(6)
    for scale, far, width in ((1, 0, 64), (1e-3, 5, 8), (1e-12, 0, 8), (1, 1000, 3), (1e9, 0, 16), (1e16, 0, 4)):
        x, y = (rng.standard_normal((n, width)) * scale + far for n in (90, 70))
        y[:20], y[20:40] = x[:20], x[:20] * (1 + 1e-9)
        d = V.distances(x, y, metric) if metric != "euclidean" else np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
        for most in (np.full(90, np.inf), np.quantile(d, 0.1, axis=1) * (1 + 1e-9) + 1e-11):
            row, col, got = V.close_pairs(x, y, most, 7, metric)
            found = set(zip(row.tolist(), col.tolist(), strict=True))
            assert np.allclose(got, d[row, col], rtol=1e-6, atol=1e-12 + 1e-7 * scale)
            for i in range(90):
                near = np.nonzero(d[i] <= most[i] - 1e-11 * (np.isfinite(most[i])))[0]
                assert {(i, j) for j in near[np.lexsort((near, np.round(d[i, near], 12)))][:7].tolist()} <= found


def test_bounds_of_distances_to_centres_hold():
    """Distances to a centre are told with their rounding, and queries that are made ready once give the same pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for scale, far, width in ((1, 0, 64), (1e-3, 1000, 8), (1e6, 1e9, 3), (1e-9, 0, 5), (1e14, 0, 4), (1e16, 0, 4)):
        x = rng.standard_normal((200, width)) * scale + far
        c = x[3] + rng.standard_normal(width) * scale * 1e-6
        held = V._Held([((0, 0, 0), pa.array(range(200)), x, np.zeros(200))], 3, "euclidean")
        least, most = held.gaps(c)
        d = np.sqrt(((x - c) ** 2).sum(1))
        assert (least <= d * (1 + 1e-7)).all() and (d <= most * (1 + 1e-7)).all()
        y = rng.standard_normal((70, width)) * scale + far
        far_off = np.sort(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), axis=1)[:, 4]
        some = np.arange(50, 150)
        with_ready = V.close_pairs(x[some], y, far_off[some], 3, "euclidean", held.ready(some))
        without = V.close_pairs(x[some], y, far_off[some], 3, "euclidean")
        for i in range(100):
            nearest = [np.sort(d[row == i])[:3] for row, _, d in (with_ready, without)]
            assert np.array_equal(*nearest) and len(nearest[0]) == 3


def test_nearest_of_equal_distances(spark):
    """All distances are equal, so ids tell which are nearest; queries of several chunks meet each chunk together."""
    df = spark.createDataFrame([(i, [float(j == i) for j in range(80)]) for i in range(80)], "id long, x array<double>")
    for metric in ("euclidean", "cosine"):
        got: dict = {}
        for r in N.knn(df, df, "id", "x", 3, metric).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
        assert got == {i: [(n + 1, j) for n, j in enumerate([j for j in range(80) if j != i][:3])] for i in range(80)}


def test_few_distances_are_taken_in_double_precision(monkeypatch):
    """Of a chunk's pairs only those that may be nearest are compared again."""
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((512, 64)), rng.standard_normal((512, 64))
    met = []
    einsum = np.einsum
    monkeypatch.setattr(V.np, "einsum", lambda how, p, q: met.append(len(p)) or einsum(how, p, q))
    row, _, _ = V.close_pairs(x, y, np.full(512, np.inf), 11, "euclidean")
    assert 512 * 11 <= len(row) <= sum(met) < 512 * 13
