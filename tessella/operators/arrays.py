"""One-dimensional arrays as (idx, value): point and range reads and writes, block ownership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlockedArray:
    """``rows(idx long, value)`` of a length dealt in blocks of ceil(length / ranks)."""

    rows: DataFrame
    length: int
    ranks: int = 1

    @property
    def local_size(self) -> int:
        return max(1, -(-self.length // self.ranks))

    def placed(self) -> DataFrame:
        """Rows with the owner (``node``) and the place there (``slot``)."""
        return self.rows.withColumns({"node": F.expr(f"idx div {self.local_size}"), "slot": F.col("idx") % self.local_size})

    def _checked(self, first: int, end: int) -> None:
        if not 0 <= first <= end <= self.length:
            raise IndexError(f"[{first}, {end}) is not inside [0, {self.length})")

    def get(self, first: int, n: int = 1) -> DataFrame:
        self._checked(first, first + n)
        return self.rows.where((F.col("idx") >= first) & (F.col("idx") < first + n))

    def put(self, new: DataFrame, order: list[str] | None = None) -> BlockedArray:
        """Overwrite the cells in ``new(idx, value)``; an index outside raises when it is read. Of
        several writes of a cell the last in ``order`` stays, without one the greatest value."""
        new = new.groupBy("idx").agg(F.max_by("value", F.struct(*(order or []), "value")).alias("value"))
        bad = F.when((F.col("idx") < 0) | (F.col("idx") >= self.length), F.raise_error(F.concat(F.lit("index out of range: "), F.col("idx").cast("string"))).cast("long")).otherwise(F.col("idx"))
        fresh = new.select(bad.alias("idx"), F.col("value").alias("array__new"), F.lit(True).alias("array__hit"))
        both = self.rows.join(fresh, "idx", "full_outer")
        value = F.when(F.col("array__hit"), F.col("array__new")).otherwise(F.col("value"))
        return BlockedArray(both.select("idx", value.alias("value")), self.length, self.ranks)

    def free(self, first: int, n: int = 1) -> BlockedArray:
        """Drop the values of cells: they read as NULL."""
        self._checked(first, first + n)
        gone = (F.col("idx") >= first) & (F.col("idx") < first + n)
        return BlockedArray(self.rows.withColumn("value", F.when(~gone, F.col("value"))), self.length, self.ranks)

    def subspan(self, first: int, n: int) -> BlockedArray:
        """A view of n cells, numbered from 0."""
        cut = self.get(first, n).withColumn("idx", F.col("idx") - first)
        return BlockedArray(cut, n, self.ranks)

    def first(self, n: int) -> BlockedArray:
        return self.subspan(0, n)

    def last(self, n: int) -> BlockedArray:
        return self.subspan(self.length - n, n)

    def map(self, fn) -> BlockedArray:
        """``fn`` from Column to Column, on every value."""
        return BlockedArray(self.rows.withColumn("value", fn(F.col("value"))), self.length, self.ranks)

    def fill(self, value: Column) -> BlockedArray:
        every = self.rows.sparkSession.range(self.length).select(F.col("id").alias("idx"), value.alias("value"))
        return BlockedArray(every, self.length, self.ranks)
