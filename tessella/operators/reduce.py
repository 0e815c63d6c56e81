"""Collective reductions, replication, and atomic updates over rows in a given order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import exclusive_scan

OPS: dict[str, Callable[[Column], Column]] = {"plus": F.sum, "min": F.min, "max": F.max, "or": F.bit_or, "and": F.bit_and, "xor": F.bit_xor, "land": F.bool_and, "lor": F.bool_or}
#: How the value of a cell and an operand combine; ``swap`` takes the operand.
COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda a, b: a + b,
    "min": F.least,
    "max": F.greatest,
    "or": lambda a, b: a.bitwiseOR(b),
    "and": lambda a, b: a.bitwiseAND(b),
    "xor": lambda a, b: a.bitwiseXOR(b),
    "swap": lambda a, b: b,
}


def reduce_all(df: DataFrame, column: str, ops: list[str], order: list[str] | None = None) -> DataFrame:
    """One row with a column for each operation: partial reductions on every task, then one of
    them. ``swap`` leaves the last value in ``order``."""
    made = [F.max_by(column, F.struct(*order)) if op == "swap" else OPS[op](column) for op in ops]
    return df.agg(*[m.alias(op) for m, op in zip(made, ops, strict=True)])


def allreduce(df: DataFrame, column: str, op: str, into: str) -> DataFrame:
    """Every row with the reduction over all rows (one row, which is broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(OPS[op](column).alias(into))))


def broadcast_from(df: DataFrame, rank: str, root: int, columns: list[str], limit: int = 1_000_000) -> DataFrame:
    """Every rank (distinct value of ``rank``) with the rows of the root: its value, vector or
    table. A root of more than ``limit`` rows is an error, as it is held by every task."""
    held = df.where(F.col(rank) == root).select(*columns)
    n = held.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"rank {root} holds more than {limit} rows")
    return df.select(rank).distinct().crossJoin(F.broadcast(held))


def reduce_ordered(df: DataFrame, keys: list[str], order: str, column: str, init: Column, step: Callable[[Column, Column], Column], into: str) -> DataFrame:
    """A left fold of any function over the values of each key in order. The values of a key meet
    in one row, as the function need not be associative; an operation of ``OPS`` is better."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda x: x["v"])
    return df.groupBy(*keys).agg(items.alias("reduce__items")).select(*keys, F.aggregate("reduce__items", init, step).alias(into))


def fetch_and(op: str, df: DataFrame, cell: list[str], order: list[str], operand: Column, init: Column, into: str = "before") -> DataFrame:
    """Each row with the value of its cell before its own operation (plus, min, max, or, and, xor,
    swap), which begins at ``init``. A cell with very many operations is scanned by many tasks."""
    before = exclusive_scan(df.withColumn("fetch__operand", operand), F.col("fetch__operand"), order, cell, "fetch__before", op)
    value = F.when(F.col("fetch__before").isNull(), init).otherwise(COMBINE[op](init, F.col("fetch__before")))
    return before.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(into))


def fetch_and_add(df: DataFrame, cell: list[str], order: list[str], delta: Column, into: str = "before") -> DataFrame:
    """``fetch_and`` of plus, with cells that begin at 0."""
    return fetch_and("plus", df, cell, order, delta, F.lit(0), into)


def claim(df: DataFrame, cell: list[str], order: list[str], value: str, into: str = "winner") -> DataFrame:
    """Compare-and-swap on an empty cell: the first writer in order wins."""
    first = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")))
    return df.groupBy(*cell).agg(first.getField("v").alias(into))


def compare_and_swap(df: DataFrame, cell: list[str], order: str, expected: str, desired: str, init: Column, into: str = "final") -> DataFrame:
    """The cell's value after all compare-and-swap operations in order, and how many took. A
    cell's operations depend on each other and meet in one row."""
    ops = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(expected).alias("e"), F.col(desired).alias("d"))))
    start = F.struct(init.cast("long").alias("v"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate("cas__ops", start, lambda a, x: F.when(a["v"] == x["e"], F.struct(x["d"].cast("long").alias("v"), (a["n"] + 1).alias("n"))).otherwise(a))
    return df.groupBy(*cell).agg(ops.alias("cas__ops")).select(*cell, fold.alias("f")).select(*cell, F.col("f.v").alias(into), F.col("f.n").alias("swaps"))
