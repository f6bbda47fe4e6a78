"""Amino acids, codons and other fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: three-letter codes in the order of their numbers 0..19 (unknown: 20, letter X)
RESIDUES = "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split()
LETTERS = "ACDEFGHIKLMNPQRSTVWY"

# fixed values: modified residues and what they count as
MODIFIED = {
    "MSE": "MET", "FME": "MET", "SEP": "SER", "SAC": "SER", "OAS": "SER", "TPO": "THR", "IYT": "THR", "PTR": "TYR", "TYS": "TYR",
    "CSO": "CYS", "SEC": "CYS", "CSS": "CYS", "CAS": "CYS", "CAF": "CYS", "OCS": "CYS", "CSD": "CYS", "CME": "CYS", "YCM": "CYS", "SAH": "CYS",
    "HYP": "PRO", "M3L": "LYS", "LLP": "LYS", "KPI": "LYS", "KPX": "LYS", "MLY": "LYS", "KCX": "LYS", "PCA": "GLN", "DGL": "GLU", "BHD": "ASP", "IAS": "ASP",
    "ABA": "ALA", "0A9": "PHE", "KYN": "TRP",
}

# the standard genetic code, by codon in the order TCAG
CODONS = {a + b + c: x for (a, b, c), x in zip(((a, b, c) for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG")}


def table(mapping: dict) -> Column:
    """A literal map, for look-ups by ``element_at``."""
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def look_up(mapping: dict, key: Column) -> Column:
    """The value of a key, null if it has none."""
    return F.try_element_at(table(mapping), key)


def normal_residue(name: Column) -> Column:
    """A modified residue's ordinary name; other names stay."""
    return F.coalesce(look_up(MODIFIED, name), name)


def residue_number(name: Column) -> Column:
    """0..19 by three-letter code, 20 for unknown ones."""
    return F.coalesce(look_up({r: i for i, r in enumerate(RESIDUES)}, normal_residue(name)), F.lit(20))


def residue_letter(name: Column) -> Column:
    """One-letter code by three-letter code, X for unknown ones."""
    return F.coalesce(look_up(dict(zip(RESIDUES, LETTERS)), normal_residue(name)), F.lit("X"))


def letter_number(letter: Column) -> Column:
    """0..19 by one-letter code, 20 for any other."""
    return F.coalesce(look_up({c: i for i, c in enumerate(LETTERS)}, letter), F.lit(20))


def number_letter(number: Column) -> Column:
    """One-letter code by number, X for any other."""
    return F.coalesce(look_up(dict(enumerate(LETTERS)), number), F.lit("X"))
