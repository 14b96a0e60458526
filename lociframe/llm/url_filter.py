"""Operator 11: which URLs to keep: rules by host and path, and for the rest a logistic regression on hashed letter runs.

Host, path and rule are column expressions; the score comes from one pass over Arrow batches that hold only them, so a
host of any number of pages is dealt like any other and nothing is shuffled. The model is fitted in the driver on a
table of at most ``MOST_LABELLED`` labelled URLs (of a larger one, those with the least hashes), and has ``BUCKETS``
weights at any size of the input.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path follows up to
``?``, ``#`` or the end. A null URL, or one without ``://``, has an empty host and path and is judged as such by the model.
A rule fits its host and all subdomains if the path starts with its own; of several the longest counts (host and path
together; then the longer host; then a block). Repeated rows are judged again; an empty table gives no rows; a URL may be
of any length and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers_of, only

BUCKETS = 1 << 16
RUNS = (3, 4, 5)
MOST_LABELLED = 20_000
THRESHOLD = 0.35
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

# Subjects of sites to keep and of sites to leave out, and syllables of invented names, from which the labelled table is built.
KEPT = (
    "news library museum university recipes weather garden science history council school hospital travel music books photos maps football chess "
    "maths docs wiki forum blog theatre orchestra cinema poetry language grammar dictionary physics chemistry biology geology astronomy painting "
    "sculpture kitchen bakery farmers market railway station airport harbour mountain river forest ocean island village bridge castle temple "
    "parliament court justice insurance bank post energy water climate birds horses flowers knitting woodwork bicycle running swimming tennis "
    "software compiler database network research journal archive letters family children health nursing medicine dental radio television"
).split()
LEFT_OUT = (
    "casino slots poker betting bets free-bets jackpot roulette lottery-win bingo-bonus win-prize sports-bets pills cheap-pills-shop diet-pills "
    "pharma-discount viagra cialis cheap-meds adult adult-video xxx-tube porn sex-cams hot-escorts nude-pics ads ad-server adsense-click track "
    "tracker click-track banner-ads pop-ads pixel-track spam spam-links link-farm seo-farm content-farm backlinks replica-watch cheap-replica "
    "payday-loan fast-cash easy-money free-gift free-iphone free-download crypto-double coin-doubler warez cracked-apps keygen torrents-free "
    "login-verify account-confirm phish casino-bonus win-big mega-win slot-machine online-pills x-rated adult-dating cheap-followers"
).split()
SYLLABLES = "ba co di fen gor han il ket lor men non or per qua res sol th ti un ver wes yan ent ion ing ed er ly nd ou re sh st at ch".split()


def labelled_rows() -> list[tuple[str, int]]:
    """``url, blocked`` by rule: each subject in three forms, and invented names, which are kept."""
    names = [a + b + c for i, a in enumerate(SYLLABLES) for b in (SYLLABLES[(i * 7 + 3) % len(SYLLABLES)],)
        for c in ("", SYLLABLES[(i * 5 + 11) % len(SYLLABLES)], SYLLABLES[(i * 11 + 2) % len(SYLLABLES)])]
    tops, tongues = ("com", "org", "net"), ("en", "de", "fr", "es")
    out = []
    for blocked, subjects in ((0, KEPT + names), (1, LEFT_OUT)):
        for i, s in enumerate(subjects):
            top, tongue = tops[i % 3], tongues[i % 4]
            out += [(f"https://www.{s}.example.{top}/{tongue}/{i * 37 % 991}.html", blocked),
                (f"http://{s}.example.{tops[(i + 1) % 3]}/", blocked)]
            out += [(f"https://{('m', 'blog')[i % 2]}.{s}.example.{tops[(i + 2) % 3]}/{tongues[(i + 1) % 4]}/{i * 53 % 997}/", blocked),
                (f"https://pages.example.{top}/{s}/{i}", blocked)]
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The position in ``rules`` of the one that counts, or null; for lists that fit an expression."""
    order = sorted(range(len(rules)), key=lambda i: (-len(str(rules[i])), -len(rules[i].host), rules[i].action != "block", i))
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), i) for i in order
        for r in (rules[i],)]
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def letter_runs(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of all runs of letters; a host stands between two marks; weights of a field have a square sum of 1 if no run repeats."""
    rows, buckets, weights = [], [], []
    for field, arr in enumerate((hosts, paths)):
        offs, raw = buffers_of(arr)
        size = np.diff(offs) + 2
        at = np.zeros(len(arr) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        text = np.full(at[-1], 2, np.uint64)
        inside = np.ones(at[-1], bool)
        inside[at[:-1]] = inside[at[1:] - 1] = False
        text[inside] = raw
        owner = np.repeat(np.arange(len(arr)), size)
        left = at[1:][owner] - np.arange(at[-1])
        total = np.maximum(1, sum(np.maximum(0, size - n + 1) for n in RUNS))
        share = 1 / np.sqrt(total)
        for n in RUNS:
            first = np.nonzero(left >= n)[0]
            h = np.full(len(first), field * 31 + n, np.uint64)
            for k in range(n):
                h = (h ^ text[first + k]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            rows.append(owner[first])
            buckets.append((h >> np.uint64(48)).astype(np.int64) % BUCKETS)
            weights.append(share[owner[first]])
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(weights)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def __call__(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, bucket, value = letter_runs(hosts, paths)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weights[bucket] * value, len(hosts)))))


def fit_urls(labelled: DataFrame, steps: int = 400, rate: float = 4.0, ridge: float = 2e-4, most: int = MOST_LABELLED) -> UrlModel:
    """Logistic regression of ``url, blocked`` (1 or 0; null labels are left out) by gradient descent with momentum, in numpy; no labels at all give one half everywhere."""
    url = F.col("url")
    some = labelled.where(F.col("blocked").isNotNull()).orderBy(F.xxhash64("url"), "url",
        "blocked").limit(most)  # a bound on what the driver gets
    got = some.select(host_of(url).alias("h"), path_of(url).alias("p"), F.col("blocked").cast("double").alias("y")).toArrow(
        ).combine_chunks()
    weights, bias = np.zeros(BUCKETS), 0.0
    y = got["y"].to_numpy()
    if not len(y):
        return UrlModel(weights, bias)
    h, p = (got[c].combine_chunks() for c in ("h", "p"))
    row, bucket, value = letter_runs(h, p)
    drift, bias_drift = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = bias + np.bincount(row, weights[bucket] * value, len(y))
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        drift = 0.9 * drift + np.bincount(bucket, error[row] * value, BUCKETS) + ridge * weights
        bias_drift = 0.9 * bias_drift + error.sum()
        weights, bias = weights - rate * drift, bias - rate * bias_drift
    return UrlModel(weights, bias)


def _scores(model: UrlModel) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                h, p = (some.column(some.schema.get_field_index(c)) for c in ("host", "path"))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(model(h, p))], names=[*some.schema.names, "score"])

    return run


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's action, else ``block`` from ``threshold`` on."""
    url = F.col("url").cast("string")
    parts = only(pages, "page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(_scores(model), f"page_id {kind}, host string, path string, score double")
    at = rule_of(F.col("host"), F.col("path"), rules)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), at) if values else F.lit(None).cast("string")
    verdict = F.coalesce(pick([r.action for r in rules]), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", pick([str(r) for r in rules]).alias("rule"), verdict.alias("verdict"), "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_rows(), "url string, blocked int")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit_urls(labelled))
