"""Sequence and statistics expressions; all stay in Spark's JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def kmer_index(kmer: Column) -> Column:
    """Number of a k-mer, first base most significant, from 1; null if it holds anything but A, C, G, T."""
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long") + 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmer_number(kmer: Column) -> Column:
    """Number of a k-mer from 0; 0 too if it holds anything but A, C, G, T."""
    return F.coalesce(kmer_index(kmer) - 1, F.lit(0).cast("long"))


def reversed_record(seq: Column, quality: Column) -> tuple[Column, Column]:
    """A read as the other strand has it: bases and their qualities."""
    return reverse_complement(seq), F.reverse(quality)


def two_bit(seq: Column, other: str = "A") -> Column:
    """A base outside A, C, G, T counts as A, as two bits can hold no other."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", other)


def phred(quality: Column) -> Column:
    """Probability that a base with this quality is right."""
    return 1 - F.pow(F.lit(10.0), -quality / 10)


def gc_bin(gc: Column) -> Column:
    """Bin of the number of G and C in fifty bases: their share over 0.05 in floating point, cut, so 15 of 50 are in the sixth."""
    share = gc / F.lit(50.0)
    return F.round((share - share % F.lit(0.05)) / F.lit(0.05)).cast("int") + 1


def complexity(paths: Column) -> Column:
    """ceil(log2(number of paths))."""
    return F.ceil(F.log2(paths)).cast("long")


def shannon(shares: Column) -> Column:
    """Entropy in bits of an array of shares; an empty share adds nothing."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def significant(x: Column, digits: int) -> Column:
    """Round to a number of significant digits, half away from zero."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


#: Kinds of a node's two boundaries (fixed values).
EDGE_KINDS = ["SL", "SR", "LS", "RS", "LR", "LL", "RR"]
_TXSTART, _TXSTOP = ["SL", "LS"], ["SR", "RS"]
_EXONSTART, _EXONSTOP, _HARD = ["LR", "RR", "SR", "LS", "SL"], ["LR", "LL", "SR", "LS", "RS"], ["LR", "LS", "SR"]


def is_tx_start(edge: Column) -> Column:
    return edge.isin(_TXSTART)


def is_tx_stop(edge: Column) -> Column:
    return edge.isin(_TXSTOP)


def is_exon_start(edge: Column) -> Column:
    return edge.isin(_EXONSTART)


def is_exon_stop(edge: Column) -> Column:
    return edge.isin(_EXONSTOP)


def is_hard(edge: Column) -> Column:
    return edge.isin(_HARD)


def inverted(edge: Column) -> Column:
    """The boundary as the other strand sees it."""
    return F.create_map(*[F.lit(x) for p in {"SL": "RS", "RS": "SL", "SR": "LS", "LS": "SR", "LL": "RR", "RR": "LL", "LR": "LR"}.items() for x in p])[edge]


#: Motif of a node by its left and right boundary (fixed values); every other pair is NA.
MOTIFS = {
    "TS": (["SL", "LS"], ["SL"]),
    "TE": (["RS"], ["RS", "SR"]),
    "AF": (["LS"], ["LL", "LR", "LS"]),
    "AL": (["RR", "LR", "SR"], ["SR"]),
    "RI": (["LL"], ["RR"]),
    "CE": (["RR", "LR", "SR"], ["LL", "LR", "LS"]),
    "AD": (["LL"], ["LL", "LR", "LS"]),
    "AA": (["RR", "LR", "SR"], ["RR"]),
}


def motif(left: Column, right: Column) -> Column:
    whens = [(left.isin(a) & right.isin(b), name) for name, (a, b) in MOTIFS.items()]
    return reduce(lambda e, w: e.when(*w), whens[1:], F.when(*whens[0])).otherwise("NA")


def is_spanning(first: Column, last: Column, node: Column) -> Column:
    return (first < node) & (node < last)


def is_connecting(first: Column, last: Column, node: Column) -> Column:
    return (first == node) | (last == node)
