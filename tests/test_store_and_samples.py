from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lociframe.operators import curate, joins, sampling, store
from lociframe.sources import writers

SCHEMA = "key string, seq array<float>, token array<array<float>>, token_idx array<long>, token_pr array<float>"


def _fill(spark, path: str, n: int) -> None:
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.col("id").cast("float")).alias("seq"),
        F.lit(None).cast("array<array<float>>").alias("token"), F.lit(None).cast("array<long>").alias("token_idx"),
            F.lit(None).cast("array<float>").alias("token_pr"))
    writers.store_append(path, rows)


def _files(df) -> set:
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_few_keys_read_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    _fill(spark, path, 2000)
    held = store.open_store(spark, path)
    assert store.layout(held) == store.BUCKETS
    keys = spark.createDataFrame([(f"k{i}", i) for i in range(0, 50, 5)] + [("k5", 99), (None, 7)], "k string, i long")
    few = store.asked_for(held, keys, "k")
    assert few.count() == 10 and len(_files(store.with_buckets_of(held, keys, "k"))) <= 10 < 0.5 * len(_files(held))
    scan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket_64" in scan.replace("isnotnull(bucket_64), ", "") and "bucket_64" in scan
    found = {(r["i"], r["k"]): list(r["seq"]) for r in joins.store_lookup(keys.where("k is not null"), "k", held).collect()}
    assert found == {(i, f"k{i}"): [float(i)] for i in range(0, 50, 5)} | {(99, "k5"): [5.0]}
    with pytest.raises(KeyError, match="absent"):
        joins.store_lookup(spark.createDataFrame([("absent",)], "k string"), "k", held)
    assert {r["k"] for r in curate.keep_known_keys(spark.createDataFrame([("absent",), ("k7",)], "k string"), "k", held).collect()} == {
        "k7"}


def test_layouts_stay(spark, tmp_path):
    """A flat folder stays flat and is read whole; other numbers of buckets stay too; a rewritten store has one row a key."""
    flat = f"file://{tmp_path}/flat"
    spark.createDataFrame([("k1", [1.0], None, None, None)], SCHEMA).write.parquet(flat)
    _fill(spark, flat, 3)
    assert store.layout(store.open_store(spark, flat)) is None and store.open_store(spark, flat).count() == 4
    few = f"file://{tmp_path}/few"
    one = spark.createDataFrame([("k1", [1.0], None, None, None)], SCHEMA)
    store.write_rows(one, few, buckets=3)
    _fill(spark, few, 100)
    assert store.layout(store.open_store(spark, few)) == 3 and store.open_store(spark, few).count() == 101
    writers.store_rewrite(spark, few, f"file://{tmp_path}/new", 10)
    new = store.open_store(spark, f"file://{tmp_path}/new")
    assert new.count() == new.select("key").distinct().count() == 100
    assert store.open_store(spark, f"file://{tmp_path}/none").count() == 0
    assert store.asked_for(store.open_store(spark, f"file://{tmp_path}/none"), one, "key").count() == 0


def _draw(seed: int, i: int) -> int:
    return int(hashlib.md5(f"{seed}|sample|{i}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("n", [0, 7, 1500, 4999, 5000, 9000])
def test_selection_is_that_of_sorting(spark, n):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("g"))
    want = sorted(range(5000), key=lambda i: (_draw(4, i), i))
    got = {r["id"] for r in sampling.sample_n(df, "id", n, seed=4).collect()}
    assert got == set(want[:n])
    group = lambda i: "a" if i % 3 == 0 else None if i % 50 == 1 else "b"
    taken = {r["id"] for r in sampling.sample_n(df, "id", n, by=["g"], seed=4).collect()}
    assert taken == {i for g in ("a", "b", None) for i in [j for j in want if group(j) == g][:n]}


def test_shares_and_balance(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") < 3000, "rare").otherwise("hot").alias("g"))
    part = {r["g"]: r["count"] for r in sampling.sample_n(df, "id", fraction=0.25, by=["g"]).groupBy("g").count().collect()}
    assert part == {"rare": 750, "hot": 1500}
    assert sampling.sample_n(df, "id", fraction=0.5).count() == 4500
    even = {r["g"]: r["count"] for r in sampling.balance(df, "g").groupBy("g").count().collect()}
    assert even == {"rare": 3000, "hot": 3000}
    same = spark.range(6000).select(F.lit(1).alias("id"), F.col("id").alias("v"))  # equal draws: ties do not add or lose rows
    assert sampling.sample_n(same, "id", 2500).count() == 2500


def test_last_bucket_alone_is_sorted(spark):
    """What reaches the ordering is the bucket in which the selection ends."""
    df = spark.range(200_000).withColumn("g", F.lit("hot"))
    some = sampling.sample_n(df, "id", 100_000, by=["g"])
    assert some.count() == 100_000
    cells = df.select(F.shiftright(sampling.draw(0, "sample", "id"), 60 - sampling.BUCKET_BITS).alias("b")).groupBy("b").count()
    assert cells.agg(F.max("count")).first()[0] < 200
