"""Column builders: labels, names, dates, vectors, sequences and distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x


# -- values and labels -------------------------------------------------------------------------------


def smooth_log2(mic: Column | str, lo: int = -8, hi: int = 9) -> Column:
    """PRJ4: whole powers of two stay, other values go to the nearest power on the log scale within [lo, hi]."""
    x = _c(mic).cast("double")
    log = F.log2(x)
    # halfway between two powers goes to the lower one; rint alone would round half to even
    near = F.ceil(log - 0.5)
    return F.when(x.isNull() | (x <= 0), F.lit(None)).when(log == F.rint(log),
        x).otherwise(F.pow(F.lit(2.0), F.least(F.greatest(near, F.lit(lo)), F.lit(hi)).cast("double")))


def recode_by_pattern(col: Column | str, rules: Sequence[tuple[Sequence[str], str]] | Mapping[str, Sequence[str]],
    default: str = "unknown") -> Column:
    """PRJ7: label of the first rule one of whose patterns is found, whatever the case; null stays null."""
    x = _c(col)
    pairs = [(p, label) for label, p in rules.items()] if isinstance(rules, Mapping) else list(rules)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for patterns, label in pairs:
        out = out.when(x.rlike("(?i)(" + "|".join(patterns) + ")"), label)
    return out.otherwise(default)


def partial_date_year(col: Column | str) -> Column:
    """PRJ9: the year of ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``, letters and blanks dropped; null where it is no date."""
    x = F.regexp_replace(_c(col), "[A-Za-z ]+", "")
    dashes = F.length(x) - F.length(F.regexp_replace(x, "-", ""))
    parsed = F.when(dashes == 1, F.try_to_timestamp(x, F.lit("yyyy-MM"))).when(dashes == 2,
        F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))).when(dashes == 0, F.try_to_timestamp(x, F.lit("yyyy")))
    return F.year(parsed)


def normalise_name(col: Column | str, synonyms: Mapping[str, str] | None = None) -> Column:
    """PRJ10: lower case, ``drug combination: `` off, blanks and dashes to underscores, then synonyms."""
    x = F.regexp_replace(F.trim(F.lower(F.regexp_replace(_c(col), "(?i)^drug combination: ", ""))), "[ -]+", "_")
    if not synonyms:
        return x
    table = F.create_map(*[F.lit(v) for kv in synonyms.items() for v in kv])
    return F.coalesce(table[x], x)


def class_code(col: Column | str) -> Column:
    """PRJ6: resistant, intermediate, susceptible to R, I, S; others null."""
    x = _c(col)
    return F.when(x == "resistant", "R").when(x == "intermediate", "I").when(x == "susceptible", "S")


def phenotype_word(col: Column | str) -> Column:
    """PRJ2: I, S, R to words; ``not defined`` to null; others as they are."""
    x = _c(col)
    return F.when(x == "R", "resistant").when(x == "S", "susceptible").when(x == "I", "intermediate").when(x == "not defined",
        F.lit(None)).otherwise(x)


def project_group(project: Column | str, title: Column | str) -> Column:
    """PRJ8: umbrella project from names."""
    p, t = _c(project), _c(title)
    return F.when(p.rlike("GenomeTrakr.*NARMS") | t.rlike("NARMS"), "NARMS").when(t.rlike("Vet-LIRN"),
        "Vet-LIRN").when(t.rlike("GenomeTrakr"), "GenomeTrakr")


def tested_by(project: Column | str, title: Column | str, collected_by: Column | str) -> Column:
    """PRJ8: who tested: the central programme, else whoever collected."""
    return F.when(F.coalesce(_c(project).rlike("GenomeTrakr.*NARMS"), F.lit(False)) | F.coalesce(_c(title).rlike("NARMS"), F.lit(False)),
        "NARMS").otherwise(_c(collected_by))


def fill_label(col: Column | str, label: str = "unknown") -> Column:
    """SC17."""
    return F.coalesce(_c(col), F.lit(label))


#: Factors of the reference-genome score.
ANI_STATUS_FACTORS = {"species_match": 1.2, "synonym_match": 1.2, "derived_species_match": 1.5, "subspecies_match": 2.0,
    "below_threshold_mismatch": 1.0}
LEVEL_FACTORS = {"Chromosome": 1.2, "Complete Genome": 1.3, "Scaffold": 1.1, "Contig": 1.0}


def genome_score(status: Column | str, category: Column | str, level: Column | str, ani: Column | str) -> Column:
    """SC20: product of the factors of ANI status, category and assembly level, and the ANI; unknown values give null."""
    by = lambda x, table: reduce(lambda out, kv: out.when(x == kv[0], kv[1]), list(table.items())[1:],
        F.when(x == next(iter(table)), next(iter(table.values()))))
    category_factor = F.when(_c(category).isNull(), 1.0).when(_c(category) == "reference genome", 1.5)
    return by(_c(status), ANI_STATUS_FACTORS) * category_factor * by(_c(level), LEVEL_FACTORS) * _c(ani)


def make_uid(sample: Column | str = "sample", seqid: Column | str = "seqid", start: Column | str = "start",
    stop: Column | str = "stop") -> Column:
    """SC7: ``sample_seqid:start-stop``."""
    return F.concat(_c(sample), F.lit("_"), _c(seqid), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(stop).cast("string"))


def strip_sequence_suffix(col: Column | str) -> Column:
    """SC8: directory and sequence-file suffix off a path."""
    return F.regexp_replace(F.regexp_extract(_c(col), r"([^/]*)$", 1), r"\.(fasta|fna|fa)(\.gz)?$", "")


def split_labels(col: Column | str, sep: str = ";") -> Column:
    """SC9: trimmed, non-empty labels of delimited text; null gives none."""
    parts = F.transform(F.split(F.coalesce(_c(col), F.lit("")), F.lit("\\Q" + sep + "\\E")), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def overlap_size(a: Column | str, b: Column | str) -> Column:
    """SC10: number of common items of two arrays, nulls left out."""
    return F.size(F.array_intersect(F.array_compact(_c(a)), F.array_compact(_c(b))))


# -- vectors -----------------------------------------------------------------------------------------


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return _sum(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b.cast("double")))


def vec_distance(x: Column | str, y: Column | str, metric: str = "cosine") -> Column:
    """SC11: cosine, euclidean or manhattan distance of two arrays of one length."""
    x, y = _c(x), _c(y)
    if metric == "cosine":
        return F.lit(1.0) - dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))))
    if metric == "manhattan":
        return _sum(F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    raise ValueError(f"no such metric: {metric}")


def clean_vector(x: Column | str) -> Column:
    """SC17: null and NaN components to zero."""
    return F.transform(_c(x), lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))


def label_jaccard(a: Column | str, b: Column | str) -> Column:
    """SC12: share of labels that only one set has; null where both are empty."""
    a, b = _c(a), _c(b)
    one = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return one / F.nullif(one + F.size(F.array_intersect(a, b)), F.lit(0))


def gap_distance(start_a: Column | str, stop_a: Column | str, start_b: Column | str, stop_b: Column | str, same: Column | None = None,
    far: Column | None = None) -> Column:
    """SC15: bases between two intervals, 0 where they overlap, ``far`` on different contigs."""
    gap = F.greatest(_c(start_b) - _c(stop_a), _c(start_a) - _c(stop_b), F.lit(0))
    return gap if same is None else F.when(same, gap).otherwise(F.lit(None) if far is None else far)


def abs_diff(a: Column | str, b: Column | str) -> Column:
    """SC16."""
    return F.abs(_c(a) - _c(b))


# -- sequences ---------------------------------------------------------------------------------------


def kmers(seq: Column | str, k: int) -> Column:
    """All runs of ``k`` letters, in order and in one pass over the text; none for shorter text."""
    s = _c(seq)
    # the look-ahead steps by half a letter over those beyond the basic plane, which the first class leaves out
    pattern = r"(?s)(?=([^\x{DC00}-\x{DFFF}].{%d}))" % (k - 1)
    return F.when(F.length(s) >= k, F.regexp_extract_all(s, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def kmer_distance(a: Column | str, b: Column | str, k: int = 5) -> Column:
    """SC13: share of distinct runs of ``k`` letters that only one text has; null where neither has any."""
    x, y = F.array_distinct(kmers(a, k)), F.array_distinct(kmers(b, k))
    both = F.size(F.array_intersect(x, y))
    union = F.size(F.array_union(x, y))
    return (union - both) / F.nullif(union, F.lit(0))


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_c(seq)), "ACGTacgt", "TGCAtgca")


#: The standard genetic code, bases in the order TCAG, the first base slowest.
CODE_BASES = "TCAG"
CODE_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: The first base, in alphabetical order, of each ambiguity code.
AMBIGUOUS, FIRST_BASE = "RYSWKMBDHVN", "ACCAGACAAAA"


def codon_table() -> dict[str, str]:
    return {a + b + c: CODE_RESIDUES[16 * i + 4 * j + k] for i, a in enumerate(CODE_BASES) for j, b in enumerate(CODE_BASES) for k,
        c in enumerate(CODE_BASES)}


def codons(seq: Column | str) -> Column:
    """The full codons in frame, in one pass over the text."""
    return F.regexp_extract_all(_c(seq), F.lit("(.{3})"), F.lit(1))


def is_degenerate(seq: Column | str) -> Column:
    return F.upper(_c(seq)).rlike("[^ACGTU]")


def translate_dna(seq: Column | str, degenerate: str = "first") -> Column:
    """SC6: protein of the full codons; ambiguous letters give null (``ignore``), their first base (``first``) or an error (``error``)."""
    s = F.translate(F.upper(_c(seq)), "U", "T")
    plain = F.translate(s, AMBIGUOUS, FIRST_BASE)
    table = F.create_map(*[F.lit(v) for kv in codon_table().items() for v in kv])
    of = lambda x: F.array_join(F.transform(codons(x), lambda c: F.coalesce(table[c], F.lit("X"))), "")
    if degenerate == "first":
        return F.when(s.isNotNull(), of(plain))
    if degenerate == "ignore":
        return F.when(s.isNotNull() & ~is_degenerate(s), of(s))
    if degenerate == "error":
        return F.when(s.isNull(), F.lit(None)).when(is_degenerate(s),
            F.raise_error(F.concat(F.lit("ambiguous letters in "), s)).cast("string")).otherwise(of(s))
    raise ValueError(f"no such policy: {degenerate}")
