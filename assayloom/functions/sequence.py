"""Column functions for nucleotide and protein text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes, their base sets and complements.
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "U", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT",
}
COMPLEMENT_FROM = "ACGTURYSWKMBDHVNXacgturyswkmbdhvnx"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBNXtgcaayrswmkvhdbnx"

# Genetic codes (numbered as in the public NCBI list), amino acids for codons in TCAG order.
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
# Start (M) and stop (*) marks of the same codons.
CODON_MARKS = {
    1: "---M------**--*----M---------------M----------------------------",
    2: "----------**--------------------MMMM----------**---M------------",
    3: "----------**----------------------MM---------------M------------",
    4: "--MM------**-------M------------MMMM---------------M------------",
    5: "---M------**--------------------MMMM---------------M------------",
    6: "--------------*--------------------M----------------------------",
    11: "---M------**--*----M------------MMMM---------------M------------",
}
CODON_BASES = "TCAG"
ALL_CODONS = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]


def complement(seq: Column) -> Column:
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def count_symbol(seq: Column, symbol: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))).cast("bigint")


def count_any(seq: Column, symbols: str) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, symbols, ""))).cast("bigint")


def gc_percent(seq: Column) -> Column:
    upper = F.upper(seq)
    known = count_any(upper, "ACGTU")
    return F.when(known > 0, F.round(count_any(upper, "GC") / known * 100, 6))


def starts(length: Column, width: int | Column, step: int = 1) -> Column:
    """1-based window starts that leave room for ``width`` symbols."""
    last = length - width + 1
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def windows(seq: Column, width: int, step: int = 1) -> Column:
    """Array of ``(start, word)`` windows; ``start`` is 1-based."""
    return F.transform(
        starts(F.length(seq), width, step),
        lambda i: F.struct(i.cast("bigint").alias("start"), seq.substr(i, F.lit(width)).alias("word")),
    )


def matching_symbols(symbol: str) -> str:
    """Sequence symbols that share a base with a pattern symbol."""
    bases = {"T" if b == "U" else b for b in IUPAC_BASES[symbol]}
    return "".join(s for s, own in IUPAC_BASES.items() if bases & {"T" if b == "U" else b for b in own})


def iupac_regex(pattern: str) -> str:
    """Regular expression of an IUPAC pattern; ambiguous sequence symbols match what they may stand for."""
    return "".join(f"[{matching_symbols(s)}]" if s in IUPAC_BASES else re.escape(s) for s in pattern.upper())


def reverse_complement_text(pattern: str) -> str:
    return pattern.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]


def codon_index(codon: Column) -> Column:
    """1-based place of an upper-case DNA codon in TCAG order, NULL when it holds another symbol."""
    place = F.lit(0)
    for i in (1, 2, 3):
        place = place * 4 + (F.instr(F.lit(CODON_BASES), F.substring(codon, i, 1)) - 1)
    return F.when(codon.rlike("^[TCAG]{3}$"), place + 1)


def as_dna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "U", "T")


def amino_acid(codon: Column, code: int = 1) -> Column:
    """Amino acid of one codon, ``X`` when it holds an unknown base."""
    return F.coalesce(F.lit(GENETIC_CODES[code]).substr(codon_index(as_dna(codon)), F.lit(1)), F.lit("X"))


def start_codons(code: int = 1) -> list[str]:
    return [c for c, mark in zip(ALL_CODONS, CODON_MARKS[code]) if mark == "M"]


def stop_codons(code: int = 1) -> list[str]:
    return [c for c, aa in zip(ALL_CODONS, GENETIC_CODES[code]) if aa == "*"]


def codons(seq: Column, offset: int | Column = 0) -> Column:
    """Array of the whole codons from ``offset`` (0-based) on."""
    first = F.lit(offset) if isinstance(offset, int) else offset
    whole = F.floor((F.length(seq) - first) / 3).cast("int")
    return F.when(
        whole > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: seq.substr(first + i * 3 + 1, F.lit(3))),
    ).otherwise(F.array().cast("array<string>"))


def translate_dna(seq: Column, offset: int | Column = 0, code: int = 1) -> Column:
    return F.array_join(F.transform(codons(seq, offset), lambda c: amino_acid(c, code)), "")


def hamming(a: Column, b: Column) -> Column:
    """Mismatches between two texts of the same length."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v
    )
