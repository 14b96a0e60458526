"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lociframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return float(f"{float(v):.8g}") if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_overlaps_are_of_all_orders(spark, duck):
    few = {r[0] for r in duck.sql("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) < 3").fetchall()}
    assert few and few <= {r["right_id"] for r in catalog.QUERIES["overlap_join"](spark, DATA).collect()}


def _values(spark, name: str, key: str) -> dict:
    out: dict = {}
    for r in catalog.QUERIES[name](spark, DATA).collect():
        out.setdefault(r[key], []).append(r["value"])
    return out


def test_models_learn_what_vectors_tell(spark):
    """Queries that SQL cannot follow, held to what their labels allow."""
    level = _values(spark, "regression_cv", "metric")
    assert min(level["pearson"]) > 0.9 and max(level["nrmse"]) < 0.2
    kinds = _values(spark, "perceptron_cv", "metric")
    assert min(kinds["acc"]) > 0.7 and min(kinds["auroc"]) > 0.7
    report = _values(spark, "perturbation_report", "measure")
    assert set(report) == {"mcc_perturbed", "mcc_random", "transfer", "random_neighbors", "wilcoxon_p"}
    assert report["mcc_random"][0] > 0.3 and report["wilcoxon_p"][0] < 1e-6 and 0 <= report["random_neighbors"][0] <= 1


def test_ablation_changes_scores(spark):
    got = catalog.QUERIES["latent_ablation"](spark, DATA).collect()
    assert {r["ablated"] for r in got} == {"0", "5"} and all(abs(r["after"] - r["before"] - r["delta"]) < 1e-9 for r in got)
    assert any(r["delta"] != 0 for r in got)


def test_names_are_registered():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
