"""Sequence functions as Column expressions; all run in the JVM.

The alphabet is $ACGNT. Text is mapped byte by byte: a, c, g, n and t become upper case, and every other byte becomes N,
so that a character of two bytes gives two N.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "$ACGNT"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(seq) -> Column:
    s = F.translate(_col(seq), "acgnt", "ACGNT")
    for low, high, n in (("10000", "10FFFF", 4), ("800", "FFFF", 3), ("80", "7FF", 2)):
        s = F.regexp_replace(s, rf"[\x{{{low}}}-\x{{{high}}}]", "N" * n)
    return F.regexp_replace(s, "[^$ACGNT]", "N")


def encode(seq) -> Column:
    """Codes 0 to 5 in the order of the alphabet."""
    letters = F.array(*[F.lit(x) for x in ALPHABET])
    found = F.filter(F.split(normalise(seq), ""), lambda c: c != "")
    return F.transform(found, lambda c: F.array_position(letters, c).cast("int") - 1)


def decode(codes) -> Column:
    letters = F.array(*[F.lit(x) for x in ALPHABET])
    return F.array_join(F.transform(_col(codes), lambda i: F.element_at(letters, i.cast("int") + 1)), "")


def reverse_complement(seq) -> Column:
    """N and $ are their own complements."""
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def bounded_median(values, least) -> Column:
    """The lower median of the values that are not under `least`; 0 if there is none."""
    kept = F.array_sort(F.filter(_col(values), lambda v: v >= least))
    return F.when(F.size(kept) == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(kept, F.floor((F.size(kept) - 1) / 2).cast("int") + 1).cast("bigint"))


def edit_distance(a, b) -> Column:
    return F.levenshtein(_col(a), _col(b))


def prefix_edit_distance(a, b) -> Column:
    """struct(score, match_length): the least distance of a to a prefix of b, and the longest such prefix."""
    a, b = _col(a), _col(b)
    each = F.transform(F.sequence(F.lit(0), F.length(b)), lambda y: F.struct(F.levenshtein(a, F.substring(b, F.lit(1), y)).alias("score"), (-y).alias("short")))
    best = F.array_min(each)
    return F.struct(best["score"].alias("score"), (-best["short"]).alias("match_length"))
