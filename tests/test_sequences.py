from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lociframe.functions import columns as C
from lociframe.operators import aggregate, pooling, sequences, store
from lociframe.plans.sequences import letter_embedder
from lociframe.sources import readers, writers

from .conftest import rows

WORDS = ["forest", "harbor", "linen", "a", "velvet"]


def test_translate(spark):
    df = spark.createDataFrame([("ATGAAATAG",), ("ATGRAA",), ("AT",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(C.translate_dna("s")).collect()] == ["MK*", "MK", "", "", None]
    assert [r[0] for r in df.select(C.translate_dna("s", "ignore")).collect()] == ["MK*", None, "", "", None]
    with pytest.raises(PySparkException):
        df.select(C.translate_dna("s", "error")).collect()


def test_bins_and_pieces(spark):
    df = spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, "AB"), (3, "")], "id int, s string")
    got = [(r["id"], r["start"], r["stop"], r["sequence"]) for r in sequences.bin_split(df, "s", 4, 1, 1).collect()]
    assert got == [(1, 0, 5, "ABCDE"), (1, 3, 9, "DEFGHI")]
    assert [r["sequence"] for r in sequences.bin_split(df, "s", 4, keep_tail=True).collect()] == ["ABCD", "EFGH", "IJ", "AB"]
    pieces = sorted((r["id"], r["subseq_no"], r["piece"]) for r in sequences.expand_max_len(df.where("id < 3"), "s", "id", 4).collect())
    assert pieces == [(1, 0, "ABCD"), (1, 1, "EFGH"), (1, 2, "IJ"), (2, 0, "AB")]
    assert [r["piece"] for r in sequences.expand_max_len(df.where("id = 3"), "s", "id", 4).collect()] == [None]


def test_cut_features(spark):
    f = spark.createDataFrame([("s", "c", 10, 20, 10, 10)],
        "sample string, seqid string, start int, stop int, upstream_intergenic int, downstream_intergenic int")
    c = spark.createDataFrame([("s", "c", "A" * 10 + "G" * 10 + "T" * 10)], "sample string, seqid string, sequence string")
    chunks = sequences.split_features(f, 5)
    assert sorted((r["chunk_start"], r["chunk_stop"], r["is_5prime"], r["is_3prime"]) for r in chunks.collect()) == [(10, 15, True, False),
        (15, 20, False, True)]
    got = sorted(r["sequence"] for r in sequences.cut_features(c, chunks, utr=(3, 0.5), up=1, down=1).collect())
    assert got == ["A" * 3 + "G" * 6, "G" * 6 + "T" * 5]


def test_kmers(spark):
    df = spark.createDataFrame([("a", "AAAATTTT"), ("b", "ACG")], "sample string, s string")
    got = {(r["sample"], r["kmer"]): r["n"] for r in aggregate.kmer_counts(df, "sample", "s", 4).collect()}
    assert got == {("a", "AAAA"): 2, ("a", "AAAT"): 2}
    assert df.select(C.kmer_distance("s", "s", 3)).first()[0] == 0.0


def test_random_variants(spark):
    df = spark.createDataFrame([(1, "ACDEFGHIKL"), (2, "")], "id int, s string")
    for out in (sequences.permute_seq(df, "id", "s"), sequences.random_seq(df, "id", "s", "AC"),
        sequences.random_seq(df, "id", "s", dist="observed")):
        assert [len(r["s"]) for r in out.orderBy("id").collect()] == [10, 0]
    assert sorted(sequences.permute_seq(df, "id", "s").orderBy("id").first()["s"]) == sorted("ACDEFGHIKL")
    scores = {"A": {"A": 9, "C": 3, "D": 2, "E": -1}}
    got = sequences.substitute(df, "id", "s", scores, 2, 1.0).orderBy("id").first()["s"]
    assert got[0] in "CD" and got[1:] == "CDEFGHIKL"
    coding = spark.createDataFrame([(1, "AAAAAGAAGG")], "id int, s string")
    assert sequences.best_codon(coding, "s", sequences.codon_usage(coding, "s")).first()["s"] == "AAGAAGAAGG"


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(w,) for w in WORDS * 2], "word string")
    store.embed_missing(df, "word", path, letter_embedder, level="both", save_proba=True)
    assert store.open_store(spark, path).count() == len(WORDS)
    store.embed_missing(df, "word", path, letter_embedder)
    assert store.open_store(spark, path).count() == len(WORDS)
    got = {r["word"]: r["x"] for r in store.to_dataset(df.distinct(), "word", store.open_store(spark, path)).collect()}
    assert got["linen"] == pytest.approx([(11 + 8 + 13 + 4 + 13) / 5, 2.0, 1.0])
    tokens = store.to_dataset(df.distinct(), "word", store.open_store(spark, path), "token")
    assert tokens.count() == sum(map(len, WORDS))
    assert store.token_view(store.open_store(spark, path), one_per_key=True).count() == len(WORDS)
    assert sequences.sample_tokens(store.open_store(spark, path), 2).select(F.max(F.size("token"))).first()[0] == 2
    other = f"file://{tmp_path}/other"
    store.embed_missing(spark.createDataFrame([("new",), ("linen",)], "word string"), "word", other, letter_embedder)
    writers.store_combine(spark, [path, other], f"file://{tmp_path}/both")
    assert store.open_store(spark, f"file://{tmp_path}/both").count() == len(WORDS) + 1
    long = store.embed_long(df.distinct(), "word", "word", f"file://{tmp_path}/long", letter_embedder, 3)
    assert long.count() == len(WORDS)


def test_stream_into_store(spark, tmp_path):
    from lociframe.streaming.incremental import embed_stream

    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(w,) for w in WORDS], "word string").write.parquet(src)
    for _ in range(2):
        embed_stream(spark.readStream.schema("word string").parquet(src), "word", f"file://{tmp_path}/s", letter_embedder,
            f"file://{tmp_path}/ck").awaitTermination()
    assert store.open_store(spark, f"file://{tmp_path}/s").count() == len(WORDS)


def test_pooling(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], "R", 0), ("a", [3.0, 4.0], "S", 1), ("b", [5.0, 6.0], "S", 0)],
        "g string, x array<double>, c string, i int")
    by = lambda d: {r["g"]: r["x"] for r in d.collect()}
    assert by(pooling.pool(df, "g", "x", "mean")) == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
    assert by(pooling.pool(df, "g", "x", "sum"))["a"] == [4.0, 6.0] and by(pooling.pool(df, "g", "x", "max"))["a"] == [3.0, 4.0]
    assert by(pooling.pool(df, "g", "x", "concat", order="i")) == {"a": [1.0, 2.0, 3.0, 4.0], "b": [5.0, 6.0, 0.0, 0.0]}
    assert by(pooling.pool(df, "g", "x", "seq_subset", label="c", priority=["R"])) == {"a": [1.0, 2.0], "b": [5.0, 6.0]}
    far = by(pooling.pool(df, "g", "x", "similarity", metric="euclidean_distance", agg="max"))
    assert far["a"] == pytest.approx([8**0.5 * 4, 8**0.5 * 6]) and far["b"] == [0.0, 0.0]
    dot = by(pooling.pool(df, "g", "x", "similarity", metric="dot_product", agg="sum"))
    assert dot["a"] == pytest.approx([11 * 4, 11 * 6])


def test_readers(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "s1.fasta").write_text(">c1 first one\nACGT\nAC\n>c2\nGG\n")
    got = sorted((r["sample"], r["seqid"], r["description"], r["sequence"]) for r in readers.read_fasta_dir(spark, f"file://{tmp_path}/f")
        .collect())
    assert got == [("s1", "c1", "c1 first one", "ACGTAC"), ("s1", "c2", "c2", "GG")]
    remap = spark.createDataFrame([("s1", "new")], "id string, sample string")
    assert {r["sample"] for r in readers.read_fasta_dir(spark, f"file://{tmp_path}/f", remap).collect()} == {"new"}
    (tmp_path / "p.fasta").write_text(">sp|P1|X\nMK\n>sp|P2|Y\nMV\n>sp|P1|X\nMK\n")
    assert sorted((r["id"], r["sequence"]) for r in readers.read_fasta(spark, f"file://{tmp_path}/p.fasta").collect()) == [("P1", "MK"),
        ("P2", "MV")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "s1_bakta.tsv").write_text(
        "# a\n# b\n# c\n# d\n# e\n#Sequence Id\tType\tStart\tStop\tStrand\tLocus Tag\tGene\tProduct\nc1\tcds\t1\t9\t+\tL1\tgyrA\tgyrase\n")
    assert rows(readers.read_bakta(spark, f"file://{tmp_path}/b")) == [{"sample": "s1", "seqid": "c1", "type": "cds", "start": 1, "stop": 9,
        "strand": "+", "locus_tag": "L1", "gene": "gyrA", "product": "gyrase"}]
    (tmp_path / "x.kraken2.report.txt").write_text(" 99.5\t100\t5\tS\t562\t  Escherichia coli\n")
    k = rows(readers.read_kraken2(spark, f"file://{tmp_path}/x.kraken2.report.txt"))[0]
    assert (k["sample"], k["taxid"], k["name"]) == ("x", 562, "Escherichia coli")
    (tmp_path / "ani.txt").write_text("/d/s1.fna\t/r/ref.fna\t98.5\t10\t11\n")
    assert rows(readers.read_fastani(spark, f"file://{tmp_path}/ani.txt"))[0]["sample"] == "s1"
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\t\t|\t8\t|\t0\t|\t1\t|\t0\t|\t0\t|\t0\t|\t0\t|\t0\t|\t\t|\n")
    n = rows(readers.read_taxdump(spark, f"file://{tmp_path}/nodes.dmp"))[0]
    assert (n["tax_id"], n["parent_tax_id"], n["rank"], n["division_id"]) == (1, 1, "no rank", 8)
    text = spark.createDataFrame([('1: Thing\nAccession: A1\n/host="cow"\n/host="pig"\n/place="x"',), ("noise",)], "value string")
    assert rows(readers.parse_native_records(text)) == [{"acc": "A1", "attrs": {"host": ["cow", "pig"], "place": ["x"]}}]
    p = spark.createDataFrame([("1. A title\nOrganism: E. coli\nProject Accession: PRJ1",)], "value string")
    assert rows(readers.parse_project_records(p)) == [{"acc": "PRJ1", "title": "A title", "organism": "E. coli"}]
    (tmp_path / "asm.tsv").write_text("# preamble\naccession\tlevel\t\nGCA1\tContig\t\n")
    assert rows(readers.read_assembly_details(spark, f"file://{tmp_path}/asm.tsv")) == [{"accession": "GCA1", "level": "Contig"}]
    (tmp_path / "h.tsv").write_text(
        "input_file_name\tinput_sequence_id\tinput_gene_start\tinput_gene_stop\tgene_symbol\tresistance_mechanism\tpredicted_phenotype\tantimicrobial_agent\tdrug_class\tanalysis_software_name\ns1.txt.rgi\ts1_c1_seq2\t5\t9\tgyrA\tm\tp\ta\td\trgi\n")
    h = rows(readers.read_hamronization(spark, f"file://{tmp_path}/h.tsv"))[0]
    assert (h["sample"], h["seqid"], h["start"], h["hamr_gene_symbol"]) == ("s1", "c1", 5, "gyrA")
    (tmp_path / "amp.tsv").write_text("")
    assert readers.read_ampcombi(spark, f"file://{tmp_path}/amp.tsv").count() == 0
    (tmp_path / "q.tsv").write_text("Assembly\t# contigs\tN50\ns1.scaffolds\t5\t100\n")
    assert rows(readers.read_quast(spark, f"file://{tmp_path}/q.tsv"))[0]["sample"] == "s1"
    meta = writers.write_fasta(spark.createDataFrame([("u1", "ACG", "g", None, None), ("u2", "AC", None, None, None)],
        "uid string, sequence string, gene string, product string, type string"), f"file://{tmp_path}/out")
    assert [(r["uid"], r["accession"]) for r in meta.collect()] == [("u1", "MM1")]
    writers.write_table(remap, f"file://{tmp_path}/t", "tsv")
    assert rows(readers.read_tabular(spark, f"file://{tmp_path}/t", "id string, sample string"))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_runs_and_pieces_of_any_letters(spark, k):
    texts = ["a😀b😀😀cd", "ab", "", "ab\ncd\r ef", None, "😀" * 5, "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", C.kmers("t", k).alias("runs")).collect():
        t = texts[r["i"]] or ""
        assert r["runs"] == [t[j : j + k] for j in range(len(t) - k + 1)]
    want = [(i, n, p) for i, t in enumerate(texts) for n, p in (enumerate(t[j : j + k] for j in range(0, len(t), k)) if t else [(0, None)])]
    assert sorted(map(tuple, sequences.expand_max_len(df, "t", "i", k).collect()), key=repr) == sorted(want, key=repr)


def test_variants_take_whole_texts(spark, tmp_path):
    from lociframe.plans import catalog

    spark.createDataFrame([(1, "acdef " * 400)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert [len(r["seq"]) for r in catalog.QUERIES["variants"](spark, f"file://{tmp_path}").collect()] == [2000] * 3


def test_permuted_letters_are_drawn_by_one_digest_each(spark):
    """The order is that of ``draw``; the digests are not made by a lambda over an array of letters, which took minutes for 10,000 texts."""
    import hashlib

    texts = [(1, "abcdefghij" * 20), (2, "aé€😀z\n\x00"), (3, ""), (4, None), (None, "xyz")]
    df = spark.createDataFrame(texts, "id long, seq string")
    got = sequences.permute_seq(df, "id", "seq", 3)
    at = lambda i, k: int(hashlib.md5(f"3|permute|{'~' if i is None else i}|{k}".encode()).hexdigest()[:15], 16)
    want = {i: None if t is None else "".join(c for _, _, c in sorted((at(i, k), k, c) for k, c in enumerate(t))) for i, t in texts}
    assert {r["id"]: r["seq"] for r in got.collect()} == want
    assert "lambda" not in got._jdf.queryExecution().toString()


def test_the_letter_embedder_works_on_whole_texts():
    """The same numbers as letter by letter, in a fraction of the time."""
    import time

    slow = lambda t: np.array([[max(0, ord(c.lower()) - 97) % 26, i, 1] for i, c in enumerate(t)], np.float32).reshape(-1, 3)
    texts = ["", "aZ", "Grüße, ЖÄ \U0001f600\n", "the quick brown fox " * 20_000]
    for t, (got, p) in zip(texts, letter_embedder(texts), strict=True):
        want = slow(t)
        assert got.dtype == np.float32 and np.array_equal(got, want) and len(p) == len(want)
        assert not len(t) or np.array_equal(got.mean(axis=0), want.mean(axis=0))
    a = time.process_time()
    slow(texts[-1])
    b = time.process_time()
    letter_embedder(texts[-1:])
    assert time.process_time() - b < (b - a) / 2
