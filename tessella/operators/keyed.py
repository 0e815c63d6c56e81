"""Keyed tables: upsert, read-modify-write, lookup, absence, find-or-insert, scans.

A table is a DataFrame with unique keys. What many writers do between two barriers is one
aggregate over their rows, in which an order column decides who wins; missing is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import placement

#: Folds that need no order: name to aggregate.
MONOIDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "or": F.bit_or, "and": F.bit_and, "xor": F.bit_xor, "land": F.bool_and, "count": F.count}


@dataclass(frozen=True)
class KeyedTable:
    """``rows`` with unique ``key`` columns and ``value`` columns."""

    rows: DataFrame
    key: tuple[str, ...]
    value: tuple[str, ...]

    @classmethod
    def empty(cls, like: DataFrame, key: list[str], value: list[str]) -> KeyedTable:
        return cls(like.select(*key, *value).limit(0), tuple(key), tuple(value))

    @classmethod
    def load(cls, writes: DataFrame, key: list[str], value: list[str], order: list[str], keep: str = "last") -> KeyedTable:
        """Bulk load: of the writes of a key the last (or first) in ``order`` stays. One hash
        exchange with map-side combine. ``order`` should be unique in a key; a tie takes the
        greatest (least) value, so the result is the same on every run."""
        pick = F.max if keep == "last" else F.min
        at = pick(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*value).alias("v"))).getField("v")
        won = writes.groupBy(*key).agg(at.alias("won"))
        return cls(won.select(*key, *[F.col("won")[c].alias(c) for c in value]), tuple(key), tuple(value))

    def insert_or_assign(self, writes: DataFrame, order: list[str]) -> KeyedTable:
        """Upsert: a write replaces what is there; among writes the last in ``order`` wins."""
        new = KeyedTable.load(writes, list(self.key), list(self.value), order).rows
        both = self.rows.withColumn("keyed__new", F.lit(0)).unionByName(new.withColumn("keyed__new", F.lit(1)))
        return KeyedTable.load(both, list(self.key), list(self.value), ["keyed__new"])

    def insert_first(self, writes: DataFrame, order: list[str]) -> KeyedTable:
        """Insert only: an entry that exists stays; among writes the first wins."""
        new = KeyedTable.load(writes, list(self.key), list(self.value), order, keep="first").rows
        return KeyedTable(self.rows.unionByName(new.join(self.rows, list(self.key), "left_anti")), self.key, self.value)

    def modify(self, writes: DataFrame, column: str, monoid: str) -> KeyedTable:
        """Read-modify-write of one value by a monoid; a missing key begins at its identity."""
        both = self.rows.select(*self.key, column).unionByName(writes.select(*self.key, column))
        return KeyedTable(both.groupBy(*self.key).agg((F.sum if monoid == "count" else MONOIDS[monoid])(column).alias(column)), self.key, (column,))

    def modify_with(self, writes: DataFrame, column: str, order: str, init: Column, step: Callable[[Column, Column], Column]) -> KeyedTable:
        """Read-modify-write by any function, applied in ``order`` from ``init`` for new keys.
        The writes of a key meet in one row; a monoid is better where there is one."""
        folded = writes.groupBy(*self.key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))).alias("w"))
        old = self.rows.select(*self.key, F.col(column).alias("keyed__old"))
        joined = folded.join(old, list(self.key), "full_outer")
        start = F.coalesce("keyed__old", init)
        value = F.when(F.col("w").isNull(), F.col("keyed__old")).otherwise(F.aggregate(F.transform("w", lambda x: x["v"]), start, step))
        return KeyedTable(joined.select(*self.key, value.alias(column)), self.key, (column,))

    def find(self, probes: DataFrame, on: dict[str, str] | None = None, found: str = "found") -> DataFrame:
        """Probes with the values of their keys and whether there was an entry. ``on`` names the
        probe's column for each key column."""
        on = on or {k: k for k in self.key}
        mine = self.rows.select(*[F.col(k).alias(f"keyed__{k}") for k in self.key], *self.value, F.lit(True).alias("keyed__hit"))
        match = [probes[on[k]] == mine[f"keyed__{k}"] for k in self.key]
        return probes.join(mine, match, "left").select(*probes.columns, *self.value, F.coalesce("keyed__hit", F.lit(False)).alias(found))

    def absent(self, probes: DataFrame, on: dict[str, str] | None = None) -> DataFrame:
        """Probes without an entry."""
        return self._member(probes, on, "left_anti")

    def present(self, probes: DataFrame, on: dict[str, str] | None = None) -> DataFrame:
        """Probes with an entry."""
        return self._member(probes, on, "left_semi")

    def _member(self, probes: DataFrame, on: dict[str, str] | None, how: str) -> DataFrame:
        on = on or {k: k for k in self.key}
        mine = self.rows.select(*[F.col(k).alias(f"keyed__{k}") for k in self.key])
        return probes.join(mine, [probes[on[k]] == mine[f"keyed__{k}"] for k in self.key], how)

    def find_or_insert(self, probes: DataFrame, defaults: dict[str, Column], order: list[str]) -> tuple[DataFrame, KeyedTable]:
        """Each probe with the value there, or else the one that the first probe of the key in
        ``order`` gave and inserted (``inserted`` is true for that probe alone), and the table that
        holds both."""
        asked = probes.select("*", *[d.alias(f"keyed__{c}") for c, d in defaults.items()])
        first = asked.groupBy(*[F.col(k).alias(f"keyed__of_{k}") for k in self.key]).agg(F.min(F.struct(*order, *[f"keyed__{c}" for c in defaults])).alias("keyed__first"))
        mine = self.rows.select(*[F.col(k).alias(f"keyed__of_{k}") for k in self.key], F.struct(*defaults).alias("keyed__old"))
        held = first.join(mine, [f"keyed__of_{k}" for k in self.key], "left")
        joined = probes.join(held, [F.col(k).eqNullSafe(F.col(f"keyed__of_{k}")) for k in self.key], "left")
        new = F.col("keyed__old").isNull()
        values = [F.when(new, F.col("keyed__first")[f"keyed__{c}"]).otherwise(F.col("keyed__old")[c]).alias(c) for c in defaults]
        own = reduce(and_, (F.col(c).eqNullSafe(F.col("keyed__first")[c]) for c in order), new)
        seen = joined.select(*probes.columns, *values, own.alias("inserted"))
        fresh = held.where("keyed__old is null").select(*[F.col(f"keyed__of_{k}").alias(k) for k in self.key], *[F.col("keyed__first")[f"keyed__{c}"].alias(c) for c in defaults])
        return seen, KeyedTable(self.rows.select(*self.key, *defaults).unionByName(fresh), self.key, tuple(defaults))

    def placed(self, ranks: int, hashed: Callable[[Column], Column] = placement.xxhash64) -> DataFrame:
        """Entries with the rank that owns them, by a hash of their key."""
        key = F.col(self.key[0]) if len(self.key) == 1 else F.concat_ws("|", *self.key)
        return self.rows.withColumn("rank", F.pmod(hashed(key), F.lit(ranks)).cast("int"))

    def scan(self) -> DataFrame:
        """All entries."""
        return self.rows

    def local_scan(self) -> DataFrame:
        """All entries with the partition that holds them."""
        return self.rows.withColumn("partition", F.spark_partition_id())
