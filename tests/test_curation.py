from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import columns as C
from lociframe.operators import aggregate, curate, joins, sampling, sets, windows

from .conftest import rows


def test_smooth_log2(spark):
    df = spark.createDataFrame([(x,) for x in (3.82e-03, 7.8125e-03, 3.225e-02, 512.0, 2.1, None, 0.0, 1e9)], "x double")
    assert [r["y"] for r in df.select(C.smooth_log2("x").alias("y")).collect()] == [3.90625e-03, 7.8125e-03, 3.125e-2, 512.0, 2.0, None,
        None, 512.0]


def test_dedup(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aaabbccddfe")], "i int, k string")
    got = sets.dedup(df, "k", ["i"]).collect()
    assert len(got) == 6 and {r["k"]: r["i"] for r in got}["b"] == 3


def test_dates_names_and_groups(spark):
    df = spark.createDataFrame([("2015",), ("June 2015-06",), ("2015-06-07",), (None,), ("unknown",)], "d string")
    assert [r[0] for r in df.select(C.partial_date_year("d")).collect()] == [2015, 2015, 2015, None, None]
    p = spark.createDataFrame([("GenomeTrakr x NARMS", "t", "me"), (None, "a Vet-LIRN b", "me"), ("p", "GenomeTrakr", "me"),
        ("p", "t", "me")], "p string, t string, c string")
    assert [tuple(r) for r in p.select(C.project_group("p", "t"), C.tested_by("p", "t", "c")).collect()] == [("NARMS", "NARMS"),
        ("Vet-LIRN", "me"), ("GenomeTrakr", "me"), (None, "me")]


def test_discretize_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    got = {r["x"]: r["x_c"] for r in curate.discretize(df, ["x"], suffix="c").collect()}
    assert got[2.0] == "susceptible" and got[3.0] == "intermediate" and got[8.0] == "intermediate" and got[9.0] == "resistant" and got[
        None] is None


def test_split_and_features(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), (None, None)], "k string, v int")
    assert [r["split"] for r in curate.split_mask(df, {"v": {"GT": 3}}).collect()] == ["train", "test", "train"]
    assert [r["k"] for r in curate.filter_features(df, ["k"], blacklist=["a"]).collect()] == ["b", None]
    assert [r["k"] for r in curate.filter_features(df, ["k"], whitelist={"k": ["a"]}).collect()] == ["a"]
    assert curate.drop_null_columns(df.withColumn("n", F.lit(None).cast("int"))).columns == ["k", "v"]


def test_source_spec_and_classes(spark):
    df = spark.createDataFrame([("s1", "R", "x", 1)], "BioSample string, amk_pheno string, junk string, old int")
    out = curate.apply_source_spec(df, {"sample": "BioSample", "drop": ["junk"], "rename": {"old": "new"}, "class_suffix": "_pheno"}, "d1")
    assert rows(curate.recode_phenotype(out)) == [{"sample": "s1", "amk_class": "resistant", "new": 1, "dataset": "d1"}]


def test_variance(spark):
    df = spark.createDataFrame([([1.0, 0.0, 5.0],), ([1.0, 1.0, 9.0],)], "x array<double>")
    keep = curate.variance_fit(df, "x", 0.5)
    assert keep == [1, 2] and curate.variance_transform(df, "x", keep).first()["x"] == [0.0, 5.0]


def test_interval_within(spark):
    left = spark.createDataFrame([("a", "c", 10, 20), ("b", "c", 100, 900), ("d", "c", 15, 30), ("e", "z", 1, 2)],
        "uid string, seqid string, start int, stop int")
    right = spark.createDataFrame([("c", 5, 25, "one"), ("c", 200, 300, "two"), ("c", 150, 160, "three"), ("c", 0, 5000, "wide")],
        "seqid string, start int, stop int, note string")
    got = {r["uid"]: r["note"] for r in joins.interval_within(left, right, ["seqid"], bin_size=64).collect()}
    assert got == {"a": "wide", "b": "wide", "d": "wide", "e": None}
    none = joins.interval_within(left.where("uid = 'e'"), right, ["seqid"]).collect()
    assert len(none) == 1 and none[0]["note"] is None


def test_intergenic(spark):
    f = spark.createDataFrame([("s", "c", 10, 20), ("s", "c", 30, 40)], "sample string, seqid string, start int, stop int")
    c = spark.createDataFrame([("s", "c", 100)], "sample string, seqid string, length int")
    got = sorted((r["start"], r["upstream_intergenic"], r["downstream_intergenic"]) for r in windows.add_intergenic(f, c).collect())
    assert got == [(10, 10, 10), (30, 10, 60)]


def test_joins(spark):
    df = spark.createDataFrame([("a;b; c",)], "ids string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r["id"] for r in joins.pending_ids(df, "ids", ids("a"), ids("c")).collect()] == ["b"]
    drugs = spark.createDataFrame([("amikacin",), ("odd",)], "drug string")
    table = lambda *x: spark.createDataFrame(x, "drug string, drug_class string")
    got = {r["drug"]: (r["drug_class"], r["interest"]) for r in joins.drug_classes(drugs, table(("amikacin", "Aminoglycosides")),
        table(("odd", "Beta-lactams")), {"amino": "aminoglyc"}).collect()}
    assert got == {"amikacin": ("Aminoglycosides", "amino"), "odd": ("Beta-lactams", None)}
    with pytest.raises(ValueError):
        joins.recode_join(drugs, spark.createDataFrame([("odd", "x"), ("odd", "y")], "drug string, new string"), ["drug"])
    store = spark.createDataFrame([("amikacin", [1.0])], "key string, seq array<float>")
    with pytest.raises(KeyError):
        joins.store_lookup(drugs, "drug", store)
    assert joins.store_lookup(drugs, "drug", store, strict=False).count() == 1


def test_taxon_distance(spark):
    t = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "genus"), (3, 2, "species"), (4, 2, "species"), (5, 3, "strain"),
        (6, 6, "no rank")], "tax_id long, parent_tax_id long, rank string")
    pairs = spark.createDataFrame([(3, 4), (5, 3), (3, 6), (5, 5)], "a long, b long")
    got = {(r["a"], r["b"]): r["distance"] for r in joins.taxon_distance(pairs, t).collect()}
    assert got == {(3, 4): 7, (5, 3): 0, (3, 6): None, (5, 5): 0}


def test_quality_filters(spark):
    k = spark.createDataFrame([("a", 50.0, "S", 1), ("a", 0.05, "S", 2), ("b", 10.0, "S", 1), ("c", 90.0, "S", 9)],
        "sample string, p_reads_covered double, rank string, taxid long")
    e = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "sample string, taxid long")
    assert [r["sample"] for r in aggregate.qc_kraken2(k, e, 20, 0.1).collect()] == ["a"]
    ani = spark.createDataFrame([("a", 99.0), ("a", 97.0), ("b", 97.7)], "sample string, ANI double")
    assert [r["sample"] for r in aggregate.qc_fastani(ani, {"any": (">", 98), "avg": (">", 97.6)}).collect()] == ["a"]
    q = spark.createDataFrame([("a", 50, 6_000_000), ("b", 200, 6_000_000)], "sample string, contigs int, length int")
    assert [r["sample"] for r in aggregate.qc_quast(q, [("contigs", "<", 100), ("length", ">", 5_000_000)]).collect()] == ["a"]


def test_related_pairs(spark):
    df = spark.createDataFrame([(f"{g}{i}", g) for g, n in (("A", 50), ("B", 50), ("C", 50), ("D", 50), ("E", 10)) for i in range(n)],
        "id string, g string")
    got = sampling.related_pairs(df, "id", "g", 20).collect()
    assert all((r["a"][0] == r["b"][0]) == r["related"] and r["a"] != r["b"] for r in got)
    assert {r["a"][0] for r in got} == set("ABCD") and sum(r["related"] for r in got) == 80 == sum(not r["related"] for r in got)


def test_samples_and_folds(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, g int")
    assert sampling.sample_n(df, "id", 5).count() == 5 and sampling.sample_n(df, "id", 2, by=["g"]).count() == 6 and sampling.sample_n(df,
        "id", fraction=0.2, by=["g"]).count() == 6
    folds = sampling.kfold(df, "id", 4, 2).groupBy("repeat", "fold").count().collect()
    assert len(folds) == 8 and {r["count"] for r in folds} <= {7, 8}
    pairs = sampling.random_pairs(df, "id", 40).collect()
    assert len({(r["a"], r["b"]) for r in pairs}) == 40 and all(r["a"] < r["b"] for r in pairs)
    moved = sampling.permute(df, "id", ["g"])
    assert sorted(r["g"] for r in moved.collect()) == sorted(r["g"] for r in df.collect())
    inside = sampling.permute(df.withColumn("x", F.col("id") * 10), "id", ["x"], within="g").collect()
    assert all(r["x"] // 10 % 3 == r["g"] for r in inside)
    control = sampling.control_task(df.withColumn("c", F.col("id") % 10), "g", "c").select("c", "control_target").distinct().collect()
    assert len(control) == 10 and {r["control_target"] for r in control} == {0, 1, 2}


def test_confounding_and_fisher(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "y")] * 5, "p string, q string")
    assert {round(r["score"], 9) for r in aggregate.confounding_score(df, ["p", "q"]).collect()} == {1.0}
    b = spark.createDataFrame([("m", 1.0, 0.05), ("m", 3.0, 0.2)], "metric string, value double, p double")
    got = aggregate.bootstrap_rollup(b, ["metric"]).first()
    assert got["combined_p"] == pytest.approx(aggregate.fisher_combined([0.05, 0.2]))


def test_split_specs(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, "x" if i < 3 else None) for i in range(8)], "id long, even boolean, tag string")
    test = lambda spec: sorted(r["id"] for r in curate.split_rows(df, spec, "id").where("split = 'test'").collect())
    assert test("even") == test(F.col("even")) == test(lambda t: t["even"]) == [0, 2, 4, 6]
    assert test([1, 5, 99]) == test(spark.createDataFrame([(5,), (1,), (None,)], "k long")) == [1, 5] and test([]) == []
    assert test(F.col("tag") == "x") == [0, 1, 2]  # a null condition is train
    assert 0 < len(test(0.5)) < 8 and test(0.0) == [] and test(1.0) == list(range(8))
    assert test({"tag": {"EXACT": ["x"]}}) == [0, 1, 2]


def test_lists_over_several_columns(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", None), (3, None, "a"), (4, "d", "d")], "id long, p string, q string")
    names = spark.createDataFrame([("a",), ("d",), ("a",), (None,)], "f string")
    keep = curate.filter_features(df, ["p", "q"], whitelist=names)
    assert keep.columns == df.columns and sorted(r["id"] for r in keep.collect()) == [1, 3, 4]
    assert [r["id"] for r in curate.filter_features(df, ["p", "q"], blacklist=names).collect()] == [2]


def test_overlaps_by_rare_items(spark):
    rng = np.random.default_rng(0)
    draw = lambda n: [["all", *map(str, rng.choice(20, rng.integers(0, 8), replace=False))] for _ in range(n)]
    left, right = draw(40), draw(40) + [[], ["none"]]
    a = spark.createDataFrame(list(enumerate(left)), "left_id long, a array<string>")
    b = spark.createDataFrame(list(enumerate(right)), "right_id long, b array<string>")
    for least in (0.3, 0.5, 0.75, 1.0):
        got = {(r["left_id"], r["right_id"]): r["common"] for r in joins.overlap_join(a, b, "a", "b", least).collect()}
        want = {(i, j): len(set(x) & set(y)) for i, x in enumerate(left) for j, y in enumerate(right) if y and len(set(x) & set(y))
            / len(set(y)) >= least}
        assert got == want


def test_overlaps_of_common_and_rare_items(spark, monkeypatch):
    """Rows with an item of many holders go another way than the others; both give all pairs."""
    monkeypatch.setattr(joins, "HOLDERS", 8)
    rng = np.random.default_rng(2)
    left = [{int(v) for v in rng.choice(60, rng.integers(1, 9), replace=False)} | ({99} if i % 2 else set()) for i in range(50)]
    right = [{int(v) for v in rng.choice(60, rng.integers(1, 6), replace=False)} | ({99} if i % 3 == 0 else set()) for i in range(70)]
    a = spark.createDataFrame([(f"l{i}", [*v, None]) for i, v in enumerate(left)], "left_id string, a array<int>")
    b = spark.createDataFrame([(i, [*v]) for i, v in enumerate(right)], "right_id long, b array<int>")
    for least in (0.2, 0.6):
        got = {(r["left_id"], r["right_id"]): (r["common"], r["overlap"]) for r in joins.overlap_join(a, b, "a", "b", least).collect()}
        assert got == {(f"l{i}", j): (len(x & y), len(x & y) / len(y)) for i, x in enumerate(left) for j, y in enumerate(right)
            if x & y and len(x & y) / len(y) >= least}


def test_holders_are_packed_and_counted(monkeypatch):
    """Lists cut anywhere, right rows over several batches, and few met at a time."""
    import pyarrow as pa

    monkeypatch.setattr(joins, "PIECE", 3)
    monkeypatch.setattr(joins, "MET", 40)
    rng = np.random.default_rng(3)
    have = {i: sorted(int(v) for v in rng.choice([0, 1, 127, 128, 300, 16383, 16384, 70_000, 1 << 33], 5, replace=False)) for i in range(30)}
    pairs = pa.RecordBatch.from_arrays([pa.array([i for i, v in have.items() for _ in v]), pa.array([p for v in have.values() for p in v])],
        names=["item", "place"])
    lists = [r for at in range(0, len(pairs), 17) for b in joins._pack_holders([pairs.slice(at, 17)]) for r in b.to_pylist()]
    wants = {c: sorted(int(v) for v in rng.choice(30, rng.integers(1, 8), replace=False)) for c in range(40)}
    met = [(c, len(v), r["n"], r["places"]) for c, v in wants.items() for i in v for r in lists if r["item"] == i]
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*met, strict=True), (pa.int64(), pa.int32(), pa.int32(),
        pa.binary()), strict=True)], names=["right_id", "size", "n", "places"])
    for step in (1, 7, 1000):
        out = [r for b in joins._common(0.5)([table.slice(at, step) for at in range(0, len(table), step)]) for r in b.to_pylist()]
        every = {(c, p): sum(p in have[i] for i in v) for c, v in wants.items() for p in {p for i in v for p in have[i]}}
        assert len(out) == len({(r["right_id"], r["place"]) for r in out})
        assert {(r["right_id"], r["place"]): r["common"] for r in out} == {k: n for k, n in every.items() if n / len(wants[k[0]]) >= 0.5}


def test_holders_travel_packed(spark):
    """A right row's lists of holders meet it as two or three bytes a holder, and no array follows a pair."""
    rng = np.random.default_rng(4)
    left, right = [rng.choice(400, 20, replace=False) for _ in range(20_000)], [rng.choice(400, 4, replace=False) for _ in range(400)]
    a = spark.createDataFrame([(i * 1000, v.tolist()) for i, v in enumerate(left)], "left_id long, a array<long>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(right)], "right_id long, b array<long>")
    assert _shuffled(spark, lambda: joins.overlap_join(a, b, "a", "b", 0.6).collect()) < 8_000_000


def _shuffled(spark, run) -> int:
    """Bytes that the stages of ``run()`` write to shuffles, with joins that are not by broadcast."""
    store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    found = stages()
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()) if found.apply(i).stageId() not in seen)


def test_overlaps_do_not_move_long_lists_by_pair(spark):
    rng = np.random.default_rng(1)
    pick = lambda n, k: [[int(v) for v in rng.choice(4000, k, replace=False)] for _ in range(n)]
    a = spark.createDataFrame(list(enumerate(pick(40, 1000))), "left_id long, a array<long>")
    b = spark.createDataFrame(list(enumerate(pick(500, 5))), "right_id long, b array<long>")
    assert _shuffled(spark, lambda: joins.overlap_join(a, b, "a", "b", 0.6).collect()) < 2_000_000


def test_shuffles_within_groups_keep_values(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 20 else None, float(i), float(-i)) for i in range(24)],
        "id long, g long, x double, y double")
    out = sampling.permute(df, "id", ["x", "y"], within="g")
    got, want = rows(out), rows(df)
    assert out.columns == df.columns and len(got) == 24
    for g in (0, 1, 2, None):
        for c in "xy":
            assert sorted(r[c] for r in got if r["g"] == g) == sorted(r[c] for r in want if r["g"] == g)
    assert any(r["x"] != float(r["id"]) for r in got) and any(r["x"] != -r["y"] for r in got)


def test_groups_are_numbered(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(40)], "id long, g long")
    got = rows(windows.group_index(df, ["g"], ["id"], "n"))
    for g in (0, 1, 2, None):
        mine = sorted(r["id"] for r in got if r["g"] == g)
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])] == list(range(1, len(mine) + 1))


def test_circles_of_parents(spark):
    tax = spark.createDataFrame([(1, 1, "root"), (2, 3, "a"), (3, 2, "b")], "tax_id long, parent_tax_id long, rank string")
    with pytest.raises(ValueError):
        joins.ancestors(tax)


def test_places_are_shuffled_as_columns_are_without_a_column_a_place(spark):
    x = lambda i: [float(i), None if i == 3 else float(-i), float(i * i)]
    df = spark.createDataFrame([(i, i % 3 if i < 20 else None, None if i == 7 else x(i)) for i in range(24)], "id long, g long, x array<double>")
    flat = df.select("id", "g", *[F.get("x", F.lit(i)).alias(f"_x{i}") for i in range(3)])
    want = sampling.permute(flat, "id", ["_x0", "_x1", "_x2"], within="g", seed=5).select("id", "g", F.array("_x0", "_x1", "_x2").alias("x"))
    got = sampling.permute_places(df, "id", "x", 3, "g", 5)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
