"""Sequence operators (SC1-SC5, SC18, SC19, SC21-SC25)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import codon_table, codons, normalise_name
from ..functions.seeded import draw, unit


def _starts(n: Column, size: int, keep_tail: bool) -> Column:
    """0, size, 2 size, ... while a window fits, or while anything is left."""
    last = n - 1 if keep_tail else n - size
    return F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"), F.lit(size))).otherwise(F.array().cast("array<int>"))


def bin_split(df: DataFrame, seq: str, max_len: int, up: int = 0, down: int = 0, keep_tail: bool = False) -> DataFrame:
    """SC1: consecutive windows of ``max_len``, full ones only unless ``keep_tail``, each widened and clipped: ``seqindex, start, stop, sequence``."""
    n = F.length(seq)
    rows = df.select("*", F.posexplode(_starts(n, max_len, keep_tail)).alias("seqindex", "_s"))
    rows = rows.withColumn("start", F.greatest(F.col("_s") - up, F.lit(0))).withColumn("stop", F.least(F.col("_s") + max_len + down, n))
    return rows.withColumn("_piece", F.substring(seq, F.col("start") + 1, F.col("stop") - F.col("start"))).drop("_s",
        seq).withColumnRenamed("_piece", "sequence")


def split_features(df: DataFrame, max_len: int | None, start: str = "start", stop: str = "stop") -> DataFrame:
    """SC2: each interval as chunks of at most ``max_len`` (one without a limit), with ``is_5prime`` and ``is_3prime``; no chunk is empty."""
    if max_len is None:
        return df.select("*", F.col(start).alias("chunk_start"), F.col(stop).alias("chunk_stop"), F.lit(0).alias("chunk"),
            F.lit(True).alias("is_5prime"), F.lit(True).alias("is_3prime"))
    n = F.col(stop) - F.col(start)
    rows = df.select("*", F.posexplode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(max_len).cast("long"))))
        .alias("chunk", "_s"))
    lo = F.col(start) + F.col("_s")
    hi = F.least(lo + max_len, F.col(stop))
    return rows.select(*df.columns, lo.alias("chunk_start"), hi.alias("chunk_stop"), "chunk", (F.col("_s") == 0).alias("is_5prime"),
        (hi == F.col(stop)).alias("is_3prime"))


def cut_features(contigs: DataFrame, features: DataFrame, utr: tuple[int | float, int | float] | None = None, up: int = 0, down: int = 0,
    by: Sequence[str] = ("sample", "seqid"), seq: str = "sequence") -> DataFrame:
    """SC3: the text of each chunk. Untranslated ends are added only at a feature's own ends, as bases or, for fractions, as a share of the gap; other context only where none was added. The contig's text is dropped in the join's projection."""
    f = features
    zero = F.lit(0)
    up_n = down_n = zero
    if utr is not None:
        amount = lambda v, gap: F.floor(F.coalesce(F.col(gap), zero) * v) if isinstance(v, float) else F.lit(v)
        up_n = F.when(F.col("is_5prime"), F.greatest(zero, amount(utr[0], "upstream_intergenic"))).otherwise(zero)
        down_n = F.when(F.col("is_3prime"), F.greatest(zero, amount(utr[1], "downstream_intergenic"))).otherwise(zero)
        up_n = up_n + F.when(F.col("is_5prime"), zero).otherwise(F.lit(up))
        down_n = down_n + F.when(F.col("is_3prime"), zero).otherwise(F.lit(down))
    else:
        up_n, down_n = F.lit(up), F.lit(down)
    joined = f.join(contigs.select(*by, F.col(seq).alias("_seq")), list(by))
    lo = F.greatest(F.col("chunk_start") - up_n, zero)
    hi = F.least(F.col("chunk_stop") + down_n, F.length("_seq"))
    return joined.select(*f.columns, lo.alias("cut_start"), hi.alias("cut_stop"),
        F.substring("_seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("sequence"))


def expand_max_len(df: DataFrame, seq: str, id: str, max_len: int) -> DataFrame:
    """SC4: ``id, subseq_no, piece``, the short tail included; empty text keeps one null piece."""
    pieces = F.regexp_extract_all(seq, F.lit("(?s)(.{1,%d})" % max_len), F.lit(1))  # one pass over the text, which no piece's row carries
    return df.select(F.col(id).alias("id"), F.posexplode_outer(pieces).alias("subseq_no", "piece")).withColumn("subseq_no",
        F.coalesce("subseq_no", F.lit(0)))


def pool_pieces(df: DataFrame, store: DataFrame, seq: str, id: str, max_len: int, agg: str = "mean") -> DataFrame:
    """SC5: stored vectors of a text's pieces pooled to ``id, x``."""
    from .joins import store_lookup
    from .pooling import pool

    pieces = expand_max_len(df, seq, id, max_len).where("piece is not null")
    return pool(store_lookup(pieces, "piece", store, "seq"), ["id"], "seq", agg)


def piece_tokens(df: DataFrame, store: DataFrame, seq: str, id: str, max_len: int) -> DataFrame:
    """SC5: ``id, token, token_idx`` of a text's pieces, token positions shifted by those of the pieces before."""
    from .joins import store_lookup

    found = store_lookup(expand_max_len(df, seq, id, max_len).where("piece is not null"), "piece", store, "token")
    return found.withColumn("token_idx", F.transform("token_idx", lambda i: i + F.col("subseq_no") * max_len)).select("id", "subseq_no",
        "token", "token_idx")


def sample_tokens(df: DataFrame, amount: int | float, seed: int = 0, key: str = "key") -> DataFrame:
    """SC18: so many, or such a share, of a row's tokens, drawn by the key; ``token_idx`` tells which."""
    n = F.size("token")
    count = F.lit(amount) if isinstance(amount, int) else F.ceil(n * amount)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(draw(seed, "token", F.col(key), i).alias("h"),
        i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(order, F.lit(1), F.least(count, n).cast("int")), lambda s: s["i"]))
    picked = df.withColumn("_i", F.when(n > 0, chosen).otherwise(F.array().cast("array<int>")))
    return picked.withColumn("token", F.transform("_i", lambda i: F.get("token", i))).withColumn("token_idx",
        F.transform("_i", lambda i: i.cast("long"))).drop("_i")


def one_token(df: DataFrame, seed: int = 0, key: str = "key") -> DataFrame:
    """SC19: the same single token of a key each time."""
    at = F.pmod(draw(seed, "one", key), F.size("token")).cast("int")
    return df.withColumn("_at", at).withColumn("x", F.get("token", F.col("_at"))).withColumn("index", F.col("_at")).drop("_at", "token")


def _letters(seq: str) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def permute_seq(df: DataFrame, id: str, seq: str, seed: int = 0) -> DataFrame:
    """SC21: the letters in the order of ``draw`` of id and place, ties by place; a digest a letter is the work, which Python's hashlib does faster than a lambda over an array."""
    head = f"{seed}|permute|"

    @F.pandas_udf("string")
    def permuted(ids: pd.Series, texts: pd.Series) -> pd.Series:
        places: list[bytes] = []

        def one(name: str, text: str | None) -> str | None:
            if text is None:
                return None
            places.extend(b"%d" % i for i in range(len(places), len(text)))
            start = f"{head}{name}|".encode()
            drawn = b"".join([md5(start + i).digest()[:8] for i in places[: len(text)]])
            order = np.argsort(np.frombuffer(drawn, ">u8") >> 4, kind="stable")  # the first 60 bits
            return np.frombuffer(text.encode("utf-32-le"), "<u4")[order].tobytes().decode("utf-32-le")

        return pd.Series([one(n, t) for n, t in zip(ids, texts, strict=True)], dtype=object)

    return df.withColumn(seq, permuted(F.coalesce(F.col(id).cast("string"), F.lit("~")), F.col(seq)))


def letter_shares(df: DataFrame, seq: str) -> DataFrame:
    """``letter, n`` over all texts."""
    return df.select(F.explode(_letters(seq)).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))


def random_seq(df: DataFrame, id: str, seq: str, alphabet: str | None = None, dist: str = "uniform", seed: int = 0) -> DataFrame:
    """SC22: new text of the same length, uniform over ``alphabet`` or by the letters' observed shares."""
    if dist == "uniform":
        letters = F.array(*[F.lit(c) for c in alphabet or ""])
        pick = lambda _, i: F.get(letters, F.floor(unit(seed, "letter", F.col(id), i) * len(alphabet or "")).cast("int"))
    else:
        counts = sorted((r["letter"], r["n"]) for r in letter_shares(df, seq).collect())  # a row a letter
        total, at, bounds = sum(n for _, n in counts), 0, []
        for c, n in counts:
            at += n
            bounds.append(F.struct(F.lit(at / total).alias("to"), F.lit(c).alias("c")))
        table = F.array(*bounds)
        pick = lambda _, i: F.get(F.filter(table, lambda b: b["to"] > unit(seed, "letter", F.col(id), i)), F.lit(0))["c"]
    return df.withColumn(seq, F.array_join(F.transform(_letters(seq), pick), ""))


def substitute(df: DataFrame, id: str, seq: str, scores: Mapping[str, Mapping[str, float]], k: int = 3, rate: float = 0.1, seed: int = 0,
    groups: Mapping[str, str] | None = None) -> DataFrame:
    """SC23: a share of positions replaced by one of the ``k`` residues of the highest score, or one of the same group; unknown letters stay."""
    if groups is not None:
        choices = {a: [b for b in sorted(groups) if b != a and groups[b] == groups[a]] for a in groups}
    else:
        choices = {a: [b for b, _ in sorted(((b, s) for b, s in row.items() if b != a), key=lambda p: (-p[1], p[0]))[:k]] for a,
            row in scores.items()}
    choices = {a: c for a, c in choices.items() if c}
    if not choices:
        return df
    table = F.create_map(*[v for a, c in sorted(choices.items()) for v in (F.lit(a), F.array(*[F.lit(b) for b in c]))])

    def new(c: Column, i: Column) -> Column:
        some = table[c]
        at = F.floor(unit(seed, "which", F.col(id), i) * F.size(some)).cast("int")
        return F.when((unit(seed, "where", F.col(id), i) < rate) & some.isNotNull(), F.get(some, at)).otherwise(c)

    return df.withColumn(seq, F.array_join(F.transform(_letters(seq), new), ""))


def codon_usage(df: DataFrame, seq: str) -> DataFrame:
    """``codon, residue, n`` of full codons in frame."""
    table = F.create_map(*[F.lit(v) for kv in codon_table().items() for v in kv])
    return df.select(F.explode(codons(F.upper(seq))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n")).select("codon",
        table[F.col("codon")].alias("residue"), "n").where("residue is not null")


def best_codon(df: DataFrame, seq: str, usage: DataFrame) -> DataFrame:
    """SC24: the same protein by each residue's most frequent codon of ``usage`` (ties by codon); unknown codons stay."""
    w = Window.partitionBy("residue").orderBy(F.desc("n"), "codon")
    best = {r["residue"]: r["codon"] for r in usage.withColumn("_k", F.row_number().over(w)).where("_k = 1").collect()}  # at most 21 rows
    change = {c: best[a] for c, a in codon_table().items() if a in best}
    if not change:
        return df
    table = F.create_map(*[F.lit(v) for kv in change.items() for v in kv])
    n = F.floor(F.length(seq) / 3).cast("int")
    body = F.array_join(F.transform(codons(F.upper(seq)), lambda c: F.coalesce(table[c], c)), "")
    return df.withColumn(seq, F.concat(body, F.substring(seq, n * 3 + 1, F.lit(2))))


def clean_drug_names(df: DataFrame, synonyms: Mapping[str, str] | None = None, col: str = "antibiotic") -> DataFrame:
    """SC25."""
    return df.withColumn(col, normalise_name(F.regexp_replace(col, r"\s*\(.*\)\s*", ""), synonyms))
