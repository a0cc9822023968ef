"""Base and quality codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluorspark.model import MAX_PHRED, MAX_QUALITY, MIN_PHRED


def base_code(char: Column) -> Column:
    """0..3 for ACGT in either case, 4 for all else."""
    at = F.instr(F.lit("ACGT"), F.translate(char, "acgt", "ACGT"))
    return F.when((F.length(char) == 1) & (at > 0), at - 1).otherwise(4).cast("tinyint")


def base_char(code: Column) -> Column:
    """The letter of a code; N for what is none."""
    return F.when(code.between(0, 3), F.substring(F.lit("ACGT"), code.cast("int") + 1, F.lit(1))).otherwise("N")


def parse(text: Column) -> Column:
    """The text with ACGT upper-cased and N for every other character."""
    return F.regexp_replace(F.translate(text, "acgt", "ACGT"), "[^ACGT]", "N")


def codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(parse(text), ""), lambda c: c != ""), base_code)


def chars(codes_: Column) -> Column:
    return F.array_join(F.transform(codes_, base_char), "")


def complement(text: Column) -> Column:
    return F.translate(parse(text), "ACGT", "TGCA")


def reverse_complement(text: Column) -> Column:
    return F.reverse(complement(text))


def has_ambiguous(text: Column) -> Column:
    return parse(text).contains("N")


def quality_from_prob(p: Column) -> Column:
    """-10 log10(1 - p); infinite at 1, NaN beyond, finite and negative below 0."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(p > 1, nan).when(p == 1, inf).otherwise(-10 * F.log1p(-p) / F.log(F.lit(10.0)))


def quality_int(q: Column) -> Column:
    """0..93, rounded half up; NaN counts as the least and infinity as the most."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(float(MAX_QUALITY)), q))
    return F.when(F.isnan(q), 0).otherwise(F.floor(bounded + 0.5)).cast("int")


def phred_char(q: Column) -> Column:
    return F.char(quality_int(q) + MIN_PHRED)


def clamp_phred(char: Column) -> Column:
    """A byte as a printable quality character; bytes from 128 on count as the least."""
    code = F.ascii(char)
    return F.char(F.when(code >= 128, MIN_PHRED).otherwise(F.greatest(F.lit(MIN_PHRED), F.least(F.lit(MAX_PHRED), code))))


def quality_of_char(char: Column) -> Column:
    return F.ascii(clamp_phred(char)) - MIN_PHRED


def display_char(char: Column) -> Column:
    return F.when(F.ascii(char).between(MIN_PHRED, MAX_PHRED), char).otherwise("!")
