"""Membership: a blocked Bloom filter as a table of words, and its exact twins."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bytes of a filter's rows (bucket and word) up to which they are broadcast.
BROADCAST = 64 << 20


def sizing(n: int, p: float = 0.01, ranks: int = 1) -> tuple[int, int]:
    """(buckets, hash functions) for n elements at a false-positive rate of p."""
    bits = -log2(p) / log(2)
    buckets = floor(n / (64 / bits / -log(p)) + 0.5)
    return max(1, ceil(buckets / ranks)) * ranks, max(1, floor(-log2(p) + 0.5))


@dataclass(frozen=True)
class BlockedBloom:
    """(bucket, word): every value sets ``hashes`` bits of the one 64-bit word of its bucket."""

    words: DataFrame
    buckets: int
    hashes: int

    @staticmethod
    def _bucket(value: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(buckets))

    @staticmethod
    def _mask(value: Column, hashes: int) -> Column:
        mask = F.lit(0).cast("long")
        for k in range(hashes):
            bit = F.pmod(F.xxhash64(value, F.lit(k + 1)), F.lit(64)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return mask

    @classmethod
    def build(cls, values: DataFrame, column: str, n: int, p: float = 0.01, ranks: int = 1) -> BlockedBloom:
        buckets, hashes = sizing(n, p, ranks)
        v = F.col(column)
        words = values.where(v.isNotNull()).groupBy(cls._bucket(v, buckets).alias("bucket")).agg(F.bit_or(cls._mask(v, hashes)).alias("word"))
        return cls(words, buckets, hashes)

    def test(self, probes: DataFrame, column: str, into: str = "maybe") -> DataFrame:
        """Probes with whether the value may have been inserted: false is certain. Words of at
        most ``BROADCAST`` bytes go to the probes, which then stay where they are."""
        v = F.col(column)
        marked = probes.withColumns({"bloom__bucket": self._bucket(v, self.buckets), "bloom__mask": self._mask(v, self.hashes)})
        words = self.words.select(F.col("bucket").alias("bloom__of"), F.col("word").alias("bloom__word"))
        joined = marked.join(F.broadcast(words) if self.buckets * 16 <= BROADCAST else words, F.col("bloom__bucket") == F.col("bloom__of"), "left")
        hit = F.coalesce(F.col("bloom__word").bitwiseAND(F.col("bloom__mask")) == F.col("bloom__mask"), F.lit(False))
        return joined.select(*probes.columns, hit.alias(into))

    def insert_seen(self, values: DataFrame, column: str, into: str = "maybe") -> tuple[DataFrame, BlockedBloom]:
        """Values with whether they may have been there before this batch, and the filter that
        holds them too."""
        return self.test(values, column, into), self.insert(values, column)

    def insert(self, values: DataFrame, column: str) -> BlockedBloom:
        v = F.col(column)
        more = values.where(v.isNotNull()).select(self._bucket(v, self.buckets).alias("bucket"), self._mask(v, self.hashes).alias("word"))
        return BlockedBloom(self.words.unionByName(more).groupBy("bucket").agg(F.bit_or("word").alias("word")), self.buckets, self.hashes)


def bloom_semijoin(probes: DataFrame, on: str, build: DataFrame, column: str, n: int, p: float = 0.01) -> DataFrame:
    """Rows of ``probes`` whose key is in ``build``. A filter that can be broadcast drops most of
    the others before the exact join, whose result it cannot change; a larger one would move the
    probes that it should spare, so then the exact join is all there is."""
    keys = build.select(F.col(column).alias("bloom__key")).distinct()
    if sizing(n, p)[0] * 16 <= BROADCAST:
        probes = BlockedBloom.build(build, column, n, p).test(probes, on).where("maybe").drop("maybe")
    return probes.join(keys, F.col(on) == F.col("bloom__key"), "left_semi")


def seen_before(df: DataFrame, value: str, order: list[str], into: str = "seen") -> DataFrame:
    """The exact twin of inserting in order: was the value there already? The first of a value
    is its minimum of ``order`` (which must be unique), an aggregate, so no value is one task."""
    first = df.groupBy(F.col(value).alias("seen__value")).agg(F.min(F.struct(*order)).alias("seen__first"))
    joined = df.join(first, F.col(value).eqNullSafe(F.col("seen__value")), "left")
    return joined.select(*df.columns, (F.struct(*order) > F.col("seen__first")).alias(into))


def seen_count(df: DataFrame, value: str, order: list[str], into: str = "nth") -> DataFrame:
    """Number of earlier rows with the value, as a window (few rows a value)."""
    w = Window.partitionBy(value).orderBy(*order)
    return df.withColumn(into, (F.row_number().over(w) - 1).cast("long"))
