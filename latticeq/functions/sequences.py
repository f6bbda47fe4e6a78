"""String functions over biological sequences, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeq.functions.alphabet import CODONS


def letters(s: Column) -> Column:
    """The letters of a string as an array."""
    return F.when(F.length(s) > 0, F.filter(F.split(s, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def reverse_complement(s: Column) -> Column:
    """Complement of A, C, G, T in either case, reversed; other letters stay as they are."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def translate_codons(s: Column, codons: dict[str, str] = CODONS) -> Column:
    """Amino acids of the codons in frame 0, up to the first unknown codon; an incomplete last one is left out.

    A codon's number is its place in a list of all of them, its acid the letter of that number: strings only, and each
    text is cut into codons once.
    """
    listed, acids = "".join(f"{c}," for c in codons), "?" + "".join(codons.values())
    number = lambda c: F.floor((F.instr(F.lit(listed), c) + 3) / 4).cast("int")
    return F.substring_index(F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.{3})")), lambda c: F.substr(F.lit(acids), number(c) + 1, F.lit(1))), ""), "?", 1)


def trim_stop(s: Column, skip: int = 1) -> Column:
    """What stands before the first ``*``, without the first ``skip`` letters."""
    return F.substr(F.substring_index(s, "*", 1), F.lit(skip + 1))


def after_primer(s: Column, primer: str, compat: bool = False) -> Column:
    """What follows the first occurrence of a primer; null if it is absent (compat: cut at its length less one)."""
    at = F.locate(primer, s)
    found = F.substr(s, at + len(primer))
    return F.when(at > 0, found).otherwise(F.substr(s, F.lit(len(primer))) if compat else F.lit(None))


def strip_tags(s: Column) -> Column:
    """Text without ``<...>`` tags that hold no further ``<``."""
    return F.regexp_replace(s, "<[^<]+?>", "")


def hamming(a: Column, b: Column) -> Column:
    """Number of places that differ; an error if lengths differ."""
    different = F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return F.when(F.length(a) == F.length(b), different).otherwise(F.raise_error(F.lit("sequences of different length")).cast("long"))


def identity_percent(a: Column, b: Column) -> Column:
    """Share of equal places, in percent; null for empty sequences."""
    return F.try_divide(F.lit(100.0) * (F.length(a) - hamming(a, b)), F.length(a))


def stirling(n: Column) -> Column:
    """Stirling's approximation of log n! that also serves for small n: n log n - n + log(2 pi n) / 2; 0 for 0."""
    x = n.cast("double")
    return F.when(x > 0, 0.5 * F.log(2 * math.pi * x) + x * F.log(x / math.e)).otherwise(0.0)


def complexity(s: Column) -> Column:
    """Log multinomial of the letters per place: (log n! - sum of log c!) / n, factorials by Stirling; null if empty."""
    counts = F.transform(F.array_distinct(letters(s)), lambda c: F.length(s) - F.length(F.replace(s, c, F.lit(""))))
    rest = F.aggregate(counts, F.lit(0.0), lambda t, c: t + stirling(c))
    return F.try_divide(stirling(F.length(s)) - rest, F.length(s))


def slug(*parts: Column) -> Column:
    """Parts joined by ``_``, as keys of contacts and ranks are."""
    return F.concat_ws("_", *(p.cast("string") for p in parts))


def radial_basis(d: Column, low: float = 0.0, high: float = 20.0, n: int = 16) -> Column:
    """Gaussian responses of a distance at n evenly spaced centres."""
    sigma = (high - low) / n
    centres = F.array(*(F.lit(low + i * (high - low) / (n - 1)) for i in range(n)))
    return F.transform(centres, lambda c: F.exp(-F.pow((d - c) / sigma, F.lit(2.0))))


def temperatures(start: Column, end: Column, n: Column) -> Column:
    """A linear schedule of n temperatures from start to end."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (end - start) * i / F.greatest(n - 1, F.lit(1)))
