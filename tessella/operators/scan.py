"""Prefix scans that stay parallel: no window holds more than one cell of a large group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a cell, and cells at most.
PER_CELL, CELLS = 100_000, 8192
Fold = Callable[[Column], Column]
#: What a scan can combine, as an aggregate.
SCANS: dict[str, Fold] = {"plus": F.sum, "min": F.min, "max": F.max, "or": F.bit_or, "and": F.bit_and, "xor": F.bit_xor, "swap": F.last}


def as_number(df: DataFrame, column: str) -> Column:
    """A double that ascends with the column (equal for some that differ), nulls first."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "string":
        number = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif kind == "date":
        number = F.unix_date(c).cast("double")
    elif kind == "boolean":
        number = c.cast("int").cast("double")
    elif kind.startswith(("array", "map", "struct", "binary")):
        raise TypeError(f"no order by quantiles for {kind}")
    else:
        number = c.cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def _bucket(df: DataFrame, number: str, bounds: list[float], into: str) -> DataFrame:
    """``df`` plus the number of bounds up to ``number``, by binary search in the JVM."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return df.withColumn(into, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=number, outputCol=into, handleInvalid="keep").transform(df).withColumn(into, F.col(into).cast("int"))


#: Quantiles that the first look at an order takes.
LOOK = 1024


def _bounds(df: DataFrame, number: str, cells: int) -> list[float]:
    """Quantiles that cut the rows into cells; a value of several cells stands several times."""
    found = df.agg(F.percentile_approx(number, [k / cells for k in range(1, cells)], max(10_000, 4 * cells))).first()[0]
    return [x for x in found or [] if abs(x) != float("inf")]


def with_cells(df: DataFrame, order: list[str], partition: list[str], per_cell: int, most: int) -> DataFrame:
    """``df`` plus ``scan__cell``, which ascends with ``order``: quantiles of its first column,
    and where a single value fills several cells, of the second one too. One cell where no group
    is larger than a cell. One job counts and finds the bounds (another one where there are more
    than ``LOOK`` cells, or values of several)."""
    if partition and (df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0) <= per_cell:
        return df.withColumn("scan__cell", F.lit(0))
    first = df.withColumn("scan__first", as_number(df, order[0]))
    total, look = first.agg(F.count(F.lit(1)), F.percentile_approx("scan__first", [k / LOOK for k in range(1, LOOK)])).first()
    cells = min(most, -(-total // per_cell))
    if cells < 2:
        return df.withColumn("scan__cell", F.lit(0))
    if cells > LOOK:
        found = _bounds(first, "scan__first", cells)
    else:
        found = [x for x in (look[k * LOOK // cells - 1] for k in range(1, cells)) if abs(x) != float("inf")]
    heavy = sorted({a for a, b in zip(found, found[1:]) if a == b})
    marked = _bucket(first, "scan__first", sorted(set(found)), "scan__cell")
    if heavy and len(order) > 1:
        inside = F.col("scan__first").isin(heavy)
        second = marked.withColumn("scan__second", F.when(inside, as_number(df, order[1])).otherwise(F.lit(float("-inf"))))
        own = sorted(set(_bounds(second.where(inside), "scan__second", cells)))
        marked = _bucket(second, "scan__second", own, "scan__sub").withColumn("scan__cell", F.col("scan__cell") * (len(own) + 2) + F.col("scan__sub")).drop("scan__second", "scan__sub")
    return marked.drop("scan__first")


def exclusive_scan(df: DataFrame, value: Column, order: list[str], partition: list[str] | None = None, into: str = "scan", op: str = "plus", per_cell: int = PER_CELL, cells: int = CELLS, cell: Column | None = None) -> DataFrame:
    """``df`` plus ``into``: ``op`` over ``value`` in the rows of the same partition that come
    before in ``order`` (columns of numbers, dates, times or strings; ties go by the next ones).
    Sums begin at 0 and keep the type of a sum of the values; other operations begin at null.

    A group larger than a cell is cut by quantiles of the order. Totals of cells are one partial
    aggregate; their running totals join the rows as the first row of each cell, so the rows move
    once, and each cell is a window of its own. A group without end is thus scanned by many tasks.
    Who knows the order's values gives the number of each row's ``cell``, and no job looks for it.
    """
    partition, fold = partition or [], SCANS[op]
    marked = df.withColumn("scan__cell", cell) if cell is not None else with_cells(df, order, partition, per_cell, cells)
    marked = marked.withColumn("scan__value", value)
    at = F.struct(*order)
    total = F.max_by("scan__value", at) if op == "swap" else fold("scan__value")
    keys = [*partition, "scan__cell"]
    sums = marked.groupBy(*keys).agg(total.alias("scan__value"))
    earlier = Window.partitionBy(*partition).orderBy("scan__cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*keys, fold("scan__value").over(earlier).alias("scan__value"), F.lit(0).alias("scan__row"))
    heads = heads.where("scan__value is not null")
    kind = dict(heads.dtypes)["scan__value"]
    both = marked.select(*[F.col(f"`{c}`") for c in df.columns], "scan__cell", F.col("scan__value").cast(kind).alias("scan__value"), F.lit(1).alias("scan__row")).unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy(*keys).orderBy("scan__row", *order).rowsBetween(Window.unboundedPreceding, -1)
    found = fold("scan__value").over(inside)
    if op == "plus":
        found = F.coalesce(found, F.lit(0).cast(kind)).cast(kind)
    return both.withColumn(into, found).where("scan__row = 1").select(*[F.col(f"`{c}`") for c in df.columns if c != into], into)


def ticket(df: DataFrame, order: list[str], partition: list[str] | None = None, into: str = "ticket") -> DataFrame:
    """``df`` plus its place from 0 in ``order`` within the partition."""
    return exclusive_scan(df, F.lit(1).cast("long"), order, partition, into)
