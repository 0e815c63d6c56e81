"""FIFO queues as (host, seq, value): tickets in order of ``seq`` decide capacity and order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ticket


@dataclass(frozen=True)
class RecordQueue:
    """``rows`` hold host, an order column and values; ``head`` is the first ticket not popped.
    Tickets are computed in cells of the order column, so one busy host is many tasks."""

    rows: DataFrame
    host: str
    seq: str
    capacity: int | None = None

    def _tickets(self) -> DataFrame:
        return ticket(self.rows, [self.seq], [self.host], "ticket")

    def push(self, more: DataFrame) -> tuple[RecordQueue, DataFrame]:
        """(queue, pushes with ``accepted``): pushes come after what is there and are taken while
        the host has room."""
        if self.capacity is None:
            return replace(self, rows=self.rows.unionByName(more)), more.withColumn("accepted", F.lit(True))
        size = self.rows.groupBy(F.col(self.host).alias("queue__host")).agg(F.count(F.lit(1)).alias("queue__size"))
        placed = ticket(more, [self.seq], [self.host], "queue__at").join(size, F.col(self.host).eqNullSafe(F.col("queue__host")), "left")
        told = placed.select(*more.columns, (F.col("queue__at") + F.coalesce("queue__size", F.lit(0)) < self.capacity).alias("accepted"))
        return replace(self, rows=self.rows.unionByName(told.where("accepted").drop("accepted"))), told

    def push_batches(self, more: DataFrame, batch: str) -> tuple[RecordQueue, DataFrame]:
        """As ``push``, but a batch is taken whole or not at all (and then leaves no room used)."""
        sizes = more.groupBy(self.host, batch).agg(F.count(F.lit(1)).alias("queue__n"), F.min(self.seq).alias("queue__first"))
        held = self.rows.groupBy(F.col(self.host).alias("queue__host")).agg(F.count(F.lit(1)).alias("queue__size"))
        state = F.array_sort(F.collect_list(F.struct("queue__first", F.col(batch).alias("b"), "queue__n")))
        rows = sizes.join(held, F.col(self.host).eqNullSafe(F.col("queue__host")), "left").groupBy(self.host).agg(state.alias("s"), F.coalesce(F.max("queue__size"), F.lit(0)).cast("long").alias("used"))
        room = F.lit(self.capacity if self.capacity is not None else 2**62)
        start = F.struct(F.col("used").alias("used"), F.array().cast(dict(more.dtypes)[batch].join(("array<", ">"))).alias("ok"))
        folded = F.aggregate("s", start, lambda a, x: F.when(a["used"] + x["queue__n"] <= room, F.struct((a["used"] + x["queue__n"]).alias("used"), F.array_append(a["ok"], x["b"]).alias("ok"))).otherwise(a))
        ok = rows.select(self.host, F.explode(folded["ok"]).alias(batch), F.lit(True).alias("accepted"))
        told = more.join(ok, [self.host, batch], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).select(*more.columns, "accepted")
        return replace(self, rows=self.rows.unionByName(told.where("accepted").drop("accepted"))), told

    def push_after(self, more: DataFrame, after: str) -> tuple[RecordQueue, DataFrame]:
        """As ``push``, but a row is taken only if ``after`` names the last row of its host at the
        time: of the rows that do, the first in order. Rows that name another one are not taken."""
        last = self.rows.groupBy(F.col(self.host).alias("queue__host")).agg(F.max(self.seq).alias("queue__last"))
        first = more.join(last, F.col(self.host).eqNullSafe(F.col("queue__host"))).where(F.col(after) == F.col("queue__last")).groupBy("queue__host").agg(F.min(self.seq).alias("queue__first"))
        told = more.join(first, F.col(self.host).eqNullSafe(F.col("queue__host")), "left")
        told = told.select(*more.columns, F.coalesce(F.col(self.seq) == F.col("queue__first"), F.lit(False)).alias("accepted"))
        return replace(self, rows=self.rows.unionByName(told.where("accepted").select(*self.rows.columns))), told

    def push_waiting(self, more: DataFrame) -> DataFrame:
        """Pushes that wait for room: each with the number of pops of its host after which it is
        taken (0: at once)."""
        size = self.rows.groupBy(F.col(self.host).alias("queue__host")).agg(F.count(F.lit(1)).alias("queue__size"))
        placed = ticket(more, [self.seq], [self.host], "queue__at").join(size, F.col(self.host).eqNullSafe(F.col("queue__host")), "left")
        pops = F.col("queue__at") + F.coalesce("queue__size", F.lit(0)) + 1 - (self.capacity if self.capacity is not None else 2**62)
        return placed.select(*more.columns, F.greatest(pops, F.lit(0).cast("long")).alias("after_pops"))

    def pop(self, n: int = 1, whole: bool = False) -> tuple[DataFrame, RecordQueue]:
        """(popped, queue): the first n of every host; with ``whole`` nothing where fewer are left."""
        placed = self._tickets()
        if whole:
            size = self.rows.groupBy(F.col(self.host).alias("queue__host")).agg(F.count(F.lit(1)).alias("queue__size"))
            placed = placed.join(size, F.col(self.host).eqNullSafe(F.col("queue__host")))
            out = (F.col("ticket") < n) & (F.col("queue__size") >= n)
        else:
            out = F.col("ticket") < n
        cols = self.rows.columns
        return placed.where(out).select(*cols), replace(self, rows=placed.where(~out).select(*cols))

    def as_vector(self, value: str) -> DataFrame:
        """(host, items): what each host holds, in order, as one array."""
        return self.rows.groupBy(self.host).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(self.seq).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))

    def size(self) -> DataFrame:
        return self.rows.groupBy(self.host).agg(F.count(F.lit(1)).alias("size"))

    def resize(self, n: int) -> RecordQueue:
        """Keep the oldest n of each host and number them from 0."""
        kept = self._tickets().where(F.col("ticket") < n)
        cols = [F.col("ticket").cast(dict(self.rows.dtypes)[c]).alias(c) if c == self.seq else F.col(c) for c in self.rows.columns]
        return replace(self, rows=kept.select(*cols), capacity=n)

    def migrate(self, host) -> RecordQueue:
        """Move everything to another host."""
        return replace(self, rows=self.rows.withColumn(self.host, F.lit(host).cast(dict(self.rows.dtypes)[self.host])))

    def ring(self, capacity: int) -> DataFrame:
        """The rows with their ring slot and lap, the last writer of a slot only."""
        slotted = self._tickets().withColumns({"slot": F.col("ticket") % capacity, "lap": F.expr(f"ticket div {capacity}")})
        last = slotted.groupBy(F.col(self.host).alias("queue__host"), F.col("slot").alias("queue__slot")).agg(F.max("lap").alias("queue__lap"))
        on = F.col(self.host).eqNullSafe(F.col("queue__host")) & (F.col("slot") == F.col("queue__slot")) & (F.col("lap") == F.col("queue__lap"))
        return slotted.join(last, on).select(*self.rows.columns, "slot", "lap")

    @staticmethod
    def _checksum(value: str, capacity: int) -> Column:
        h = F.xxhash64(value)
        h = F.when(h == 0, F.lit(42).cast("long")).otherwise(h)
        return F.when(F.expr(f"ticket div {capacity}") % 2 == 1, F.bitwise_not(h)).otherwise(h)

    def with_checksum(self, value: str, capacity: int) -> DataFrame:
        """Rows with a checksum that tells laps apart: 42 for a hash of 0, inverted on odd laps."""
        return self._tickets().withColumn("checksum", self._checksum(value, capacity))

    def slabs(self, slab: int) -> DataFrame:
        """Rows with the slab (segment) of an unbounded queue and the place in it."""
        return self._tickets().withColumns({"slab": F.expr(f"ticket div {slab}"), "at": F.col("ticket") % slab}).drop("ticket")


def pop_checked(rows: DataFrame, host: str, value: str, capacity: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(popped, left) of rows with ticket and checksum: of each host the first n whose checksum
    fits, as far as there is none before them that does not (its writer is not done: a pop waits)."""
    ok = F.col("checksum") == RecordQueue._checksum(value, capacity)
    bad = rows.where(~F.coalesce(ok, F.lit(False))).groupBy(F.col(host).alias("queue__host")).agg(F.min("ticket").alias("queue__bad"))
    first = rows.groupBy(F.col(host).alias("queue__of")).agg(F.min("ticket").alias("queue__first"))
    joined = rows.join(bad, F.col(host).eqNullSafe(F.col("queue__host")), "left").join(first, F.col(host).eqNullSafe(F.col("queue__of")))
    out = (F.col("ticket") < F.coalesce("queue__bad", F.lit(2**62))) & (F.col("ticket") < F.col("queue__first") + n)
    return joined.where(out).select(*rows.columns), joined.where(~out).select(*rows.columns)


def merge_producers(rows: DataFrame, host: str, producer: str, seq: str) -> DataFrame:
    """One ring for each producer, drained in turns: order by the place in the producer's own
    ring, then by producer."""
    own = ticket(rows, [seq], [host, producer], "turn")
    return ticket(own, ["turn", producer], [host], "ticket").drop("turn")
