"""Scalar sequence functions as Column expressions (JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements; any other character becomes N.
IUPAC, COMPLEMENT = "ACGTRYKMBDHVSWN", "TGCAYRMKVHDBSWN"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(seq) -> Column:
    """Upper case, with everything that isn't an IUPAC code as N."""
    return F.regexp_replace(F.upper(_c(seq)), f"[^{IUPAC}]", "N")


def comp(seq) -> Column:
    """Complement of each base; ambiguity codes become N."""
    return F.translate(F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N"), "ACGT", "TGCA")


def revcomp(seq) -> Column:
    """Reverse complement of a clean sequence, IUPAC codes kept."""
    return F.reverse(F.translate(_c(seq), IUPAC, COMPLEMENT))


def div_floor(x, d) -> Column:
    return F.floor(_c(x) / _c(d)).cast("long")


def gc_fraction(seq) -> Column:
    s = _c(seq)
    return F.try_divide(F.length(F.regexp_replace(s, "[^GCgc]", "")).cast("double"), F.length(s).cast("double"))


def is_acgt(seq) -> Column:
    return F.rlike(_c(seq), F.lit("^[ACGTacgt]*$"))


def first_invalid(seq) -> Column:
    """1-based position of the first character that isn't ACGT, 0 if there is none."""
    return F.regexp_instr(_c(seq), F.lit("[^ACGTacgt]")).cast("long")


def valid_spans(seq) -> Column:
    """Maximal ACGT-only runs as array<struct<start, end>>, from run lengths by a running sum."""
    s = _c(seq)
    runs = F.regexp_extract_all(s, F.lit("([ACGTacgt]+|[^ACGTacgt]+)"), 1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc, x):
        end = acc["at"] + F.length(x)
        mine = F.array(F.struct(acc["at"].alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(F.rlike(x, F.lit("^[ACGTacgt]")), F.concat(acc["out"], mine)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(runs, zero, step, lambda acc: acc["out"])


def first_token(header) -> Column:
    return F.split(_c(header), r"\s+").getItem(0)


def canonical_id(header) -> Column:
    """First token without a trailing -dupN or -dupN.N."""
    return F.regexp_replace(first_token(header), r"-dup[0-9]+(\.[0-9]+)?$", "")


def label_prefix(label) -> Column:
    """What comes before the last underscore."""
    return F.regexp_replace(_c(label), "_[^_]*$", "")


def detail_map(detail) -> Column:
    """map<string,string> of `k=v,k=v` text."""
    return F.str_to_map(_c(detail), F.lit(","), F.lit("="))


def wrap(seq, width: int) -> Column:
    """Lines of `width` characters; 0 leaves the sequence on one line."""
    s = _c(seq)
    return s if width <= 0 else F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")


def milli(x) -> Column:
    """A fraction rounded to thousandths, as X.XXX."""
    m = F.floor(_c(x) * 1000 + 0.5).cast("long")
    return F.concat(F.floor(m / 1000).cast("long").cast("string"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"))


def banded_edits(a, b, band: int) -> Column:
    """Levenshtein distance up to `band`, else band + 1."""
    d = F.levenshtein(_c(a), _c(b), band)
    return F.when(d < 0, F.lit(band + 1)).otherwise(d).cast("long")


def hamming_matches(a, b) -> Column:
    """Equal positions of two strings over the shorter length."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    n = F.least(F.length(_c(a)), F.length(_c(b)))
    return F.size(F.filter(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q), lambda e: e)).cast("long")


def ir_class(spacer, immediate: int = 2000, wide: int = 100_000) -> Column:
    s = _c(spacer)
    return F.when(s <= 0, "overlap").when(s <= immediate, "immediate").when(s >= wide, "wide").otherwise("spaced")


def ir_class_fasta(spacer) -> Column:
    """The FASTA header's classes, which have their own bounds; null spacer: unknown."""
    s = _c(spacer)
    return F.when(s.isNull(), "unknown").when(s <= 0, "immediate").when(s <= 10_000, "spaced").otherwise("wide")
