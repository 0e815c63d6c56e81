"""Strings of bases: complements, canonical form, packing, extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rcomplement(s: Column) -> Column:
    """Reverse complement; other characters stay."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The lesser of a string and its reverse complement."""
    return F.least(s, rcomplement(s))


def next_kmer(kmer: Column, forward: Column) -> Column:
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer) - 1), forward)


def last_kmer(kmer: Column, backward: Column) -> Column:
    return F.concat(backward, F.substring(kmer, F.lit(1), F.length(kmer) - 1))


def pack_kmer(s: Column) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), four bases a byte, padded with A: binary."""
    quads = F.ceil(F.length(s) / 4).cast("int")
    digits = F.translate(F.rpad(s, quads * 4, "A"), "ACGT", "0123")
    value = lambda k: F.substring(digits, (k * 4 + 1).cast("int"), F.lit(4))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), quads - 1), lambda k: F.lpad(F.conv(value(k), 4, 16), 2, "0")), ""))


def unpack_kmer(b: Column, length: Column) -> Column:
    hexes = F.hex(b)
    quad = lambda k: F.lpad(F.conv(F.substring(hexes, (k * 2 + 1).cast("int"), F.lit(2)), 16, 4), 4, "0")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.length(b) - 1), quad), "")
    return F.substring(F.translate(digits, "0123", "ACGT"), F.lit(1), length)


def bounded(s: Column, n: int) -> Column:
    """A string of at most n bytes; a longer one raises."""
    return F.when(F.octet_length(s) <= n, s).when(s.isNotNull(), F.raise_error(F.lit(f"longer than {n} bytes")).cast("string"))
