"""Hashes that decide where a key is placed. Any of them will do; results never show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_32 = 0xFFFFFFFF


def xxhash64(key: Column) -> Column:
    return F.xxhash64(key)


def murmur3(key: Column) -> Column:
    return F.hash(key).cast("long")


def djb2(key: Column) -> Column:
    """h = 33 h + c over the bytes of the key as text, from 5381, in 32 bits."""
    raw = F.encode(key.cast("string"), "utf-8")
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(raw), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(_32)))


def times107(key: Column) -> Column:
    """A whole number times 107, in 32 bits."""
    return (key.cast("long").bitwiseAND(F.lit(_32)) * 107).bitwiseAND(F.lit(_32))


def mix32(key: Column) -> Column:
    """The finishing steps of a 32-bit mixing hash of a whole number: xor-shift, multiply, twice."""
    h = key.cast("long").bitwiseAND(F.lit(_32))

    def times(x: Column, by: int) -> Column:  # a product of 64 bits, of which 32 stay
        low, high = by & 0xFFFF, by >> 16
        return (x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_32))

    h = times(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = times(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


HASHES = {"xxhash64": xxhash64, "murmur3": murmur3, "djb2": djb2, "times107": times107, "mix32": mix32}
