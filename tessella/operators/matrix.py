"""Sparse and dense matrices as (i, j, v): element-wise, slicing, tiles, reductions, products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.layout import Blocking
from .scan import CELLS, PER_CELL, exclusive_scan

Fold = Callable[[Column], Column]
#: Reductions of a semiring that combine before the shuffle.
REDUCE: dict[str, Fold] = {"plus": F.sum, "min": F.min, "max": F.max, "or": F.bool_or, "and": F.bool_and}
#: Rows of a factor up to which it may be broadcast: 24 bytes each.
BROADCAST_ROWS = 500_000
#: Cells, and entries, of a matrix that the driver may gather.
GATHER = 1 << 24
#: Products of one inner index that may meet in one task when salts are chosen from the counts.
PER_SALT = 1 << 20
#: Pairs of tiles that a product by tiles is dealt into at least.
PARALLEL = 64


def times(a: Column, b: Column) -> Column:
    return a * b


@dataclass(frozen=True)
class Matrix:
    """``cells(i long, j long, v)`` with unique (i, j), of a shape. ``dense`` matrices hold
    every cell; sparse ones hold stored entries, explicit zeros included."""

    cells: DataFrame
    shape: tuple[int, int]
    dense: bool = False

    # building
    @classmethod
    def from_coo(cls, rows: DataFrame, shape: tuple[int, int], duplicates: str = "sum", order: str | None = None) -> Matrix:
        """From (i, j, v) rows; equal coordinates are summed, or the first or last in ``order`` stays."""
        pick = {"sum": F.sum("v"), "first": F.min_by("v", order or "v"), "last": F.max_by("v", order or "v")}[duplicates]
        return cls(rows.groupBy("i", "j").agg(pick.alias("v")), shape)

    @classmethod
    def from_vectors(cls, rows: DataFrame, row: str, vector: str, shape: tuple[int, int]) -> Matrix:
        return cls(rows.select(F.col(row).cast("long").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v"), shape, True)

    @classmethod
    def zeros(cls, spark, shape: tuple[int, int]) -> Matrix:
        return cls(spark.createDataFrame([], "i long, j long, v double"), shape)

    @classmethod
    def fill_range(cls, spark, shape: tuple[int, int], bound: int) -> Matrix:
        """v = (i n + j) mod bound."""
        n = shape[1]
        every = spark.range(shape[0] * n)
        return cls(every.select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"), (F.col("id") % bound).cast("double").alias("v")), shape, True)

    @classmethod
    def random(cls, spark, shape: tuple[int, int], seed: int = 0) -> Matrix:
        """Every cell from [0, 1) by a hash of its place and the seed: the same on every run."""
        n = shape[1]
        unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        return cls(spark.range(shape[0] * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"), unit.alias("v")), shape, True)

    # element-wise
    def apply(self, fn: Callable[[Column], Column]) -> Matrix:
        return replace(self, cells=self.cells.select("i", "j", fn(F.col("v")).alias("v")))

    def apply_by_index(self, fn: Callable[[Column, Column, Column], Column]) -> Matrix:
        return replace(self, cells=self.cells.select("i", "j", fn(F.col("i"), F.col("j"), F.col("v")).alias("v")))

    def fill(self, value) -> Matrix:
        return self.apply(lambda v: F.lit(value).cast(dict(self.cells.dtypes)["v"]))

    def zip(self, other: Matrix, fn: Callable[[Column, Column], Column]) -> Matrix:
        """fn of both cells. Where one sparse matrix has no entry it counts as 0."""
        b = other.cells.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv"))
        how = "inner" if self.dense and other.dense else "full_outer"
        both = self.cells.join(b, (F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj")), how)
        a_v, b_v = (F.col("v"), F.col("bv")) if how == "inner" else (F.coalesce("v", F.lit(0)), F.coalesce("bv", F.lit(0)))
        return Matrix(both.select(F.coalesce("i", "bi").alias("i"), F.coalesce("j", "bj").alias("j"), fn(a_v, b_v).alias("v")), self.shape, self.dense or other.dense)

    def __add__(self, other: Matrix) -> Matrix:
        return self.zip(other, lambda a, b: a + b)

    def __sub__(self, other: Matrix) -> Matrix:
        return self.zip(other, lambda a, b: a - b)

    def __mul__(self, other: Matrix) -> Matrix:
        return self.zip(other, times)

    def __truediv__(self, other: Matrix) -> Matrix:
        return self.zip(other, lambda a, b: F.try_divide(a, b))

    def masked(self, other: Matrix, fn: Callable[[Column, Column], Column]) -> Matrix:
        """fn of stored entries and the other matrix's cells there; nothing is added."""
        b = other.cells.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv"))
        both = self.cells.join(b, (F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj")), "left")
        return replace(self, cells=both.select("i", "j", fn(F.col("v"), F.coalesce("bv", F.lit(0))).alias("v")))

    def remove_zeros(self) -> Matrix:
        return replace(self, cells=self.cells.where("v <> 0"), dense=False)

    @property
    def T(self) -> Matrix:  # noqa: N802
        return Matrix(self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.shape[::-1], self.dense)

    def slice(self, rows: tuple[int, int], cols: tuple[int, int]) -> Matrix:
        """[r0, r1) by [c0, c1), upper ends clipped, numbered from 0."""
        (r0, r1), (c0, c1) = (rows[0], min(rows[1], self.shape[0])), (cols[0], min(cols[1], self.shape[1]))
        cut = self.cells.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))
        return Matrix(cut.select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), (max(0, r1 - r0), max(0, c1 - c0)), self.dense)

    def row(self, i: int) -> DataFrame:
        return self.cells.where(F.col("i") == i).select("j", "v")

    def put(self, new: DataFrame, order: list[str] | None = None) -> Matrix:
        """Overwrite the cells in ``new(i, j, v)``. Of several writes of a cell the last in
        ``order`` stays, without an order the one of the greatest value."""
        once = new.groupBy("i", "j").agg(F.max_by("v", F.struct(*(order or []), "v")).alias("v"))
        kept = self.cells.join(once.select("i", "j"), ["i", "j"], "left_anti")
        return replace(self, cells=kept.unionByName(once))

    # tiles
    def tiled(self, blocking: Blocking) -> DataFrame:
        """Cells with their tile (ti, tj) and its owner."""
        return self.cells.withColumns(blocking.columns(*self.shape))

    def tile(self, blocking: Blocking, ti: int, tj: int) -> Matrix:
        tm, tn = blocking.tile_shape(*self.shape)
        return self.slice((ti * tm, ti * tm + tm), (tj * tn, tj * tn + tn))

    def tile_nnz(self, blocking: Blocking) -> DataFrame:
        return self.tiled(blocking).groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("nnz"))

    def imbalance(self, parts: int = 10) -> DataFrame:
        """Greatest and mean entries of a tile in a parts by parts grid, empty tiles counted."""
        tiles = self.tile_nnz(Blocking((parts, parts)))
        mean = F.sum("nnz").cast("double") / F.lit(float(parts * parts))
        return tiles.agg(F.max("nnz").cast("double").alias("max_nnz"), mean.alias("avg_nnz"), (F.max("nnz").cast("double") / mean).alias("imbalance"))

    # reductions
    def sum(self) -> DataFrame:
        return self.cells.agg(F.sum("v").alias("total"))

    def checksum(self) -> DataFrame:
        return self.cells.agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("sum_v"), F.sum("j").alias("sum_j"))

    def row_ptr(self) -> DataFrame:
        """(i, row_ptr) for i from 0 to m: the entries before each row, and at last all of them."""
        counts = self.cells.groupBy("i").agg(F.count(F.lit(1)).alias("csr__n"))
        every = self.cells.sparkSession.range(self.shape[0] + 1).select(F.col("id").alias("i"))
        placed = every.join(counts, "i", "left").withColumn("csr__n", F.coalesce("csr__n", F.lit(0).cast("long")))
        width = max(PER_CELL, -(-self.shape[0] // CELLS))
        return exclusive_scan(placed, F.col("csr__n"), ["i"], [], "row_ptr", cell=F.expr(f"i div {width}")).select("i", "row_ptr")

    def to_csr(self) -> DataFrame:
        """(i, row_ptr, col_ind, vals) for every row of the matrix, columns ascending: a row in one
        row, so a row's entries are bounded by what one array holds."""
        rows = self.cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))
        joined = self.row_ptr().where(F.col("i") < self.shape[0]).join(rows, "i", "left")
        return joined.select("i", "row_ptr", *[F.coalesce(F.col(f"e.{c}"), F.array().cast(f"array<{dict(self.cells.dtypes)[c]}>")).alias(n) for c, n in (("j", "col_ind"), ("v", "vals"))])

    @classmethod
    def from_csr(cls, rows: DataFrame, shape: tuple[int, int]) -> Matrix:
        return cls(rows.select("i", F.explode(F.arrays_zip("col_ind", "vals")).alias("e")).select("i", F.col("e.col_ind").alias("j"), F.col("e.vals").alias("v")), shape)

    def verify(self) -> DataFrame:
        """Number of entries outside the shape, and of repeated coordinates: both 0 if sound."""
        m, n = self.shape
        out = F.sum(F.when((F.col("i") < 0) | (F.col("i") >= m) | (F.col("j") < 0) | (F.col("j") >= n), F.col("k")).otherwise(F.lit(0)))
        return self.cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(out, F.lit(0)).cast("long").alias("outside"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("repeated"))

    def allclose(self, other: Matrix, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
        """Number of coordinates where one has no entry or |a - b| > atol + rtol |b|."""
        b = other.cells.select("i", "j", F.col("v").alias("bv"))
        both = self.cells.join(b, ["i", "j"], "full_outer")
        bad = F.col("v").isNull() | F.col("bv").isNull() | (F.abs(F.col("v") - F.col("bv")) > atol + rtol * F.abs("bv"))
        return both.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("differing"))

    def to_numpy(self, limit: int = GATHER) -> np.ndarray:
        """The whole matrix on the driver, cells without an entry as 0. A shape of more than
        ``limit`` cells is an error."""
        if self.shape[0] * self.shape[1] > limit:
            raise ValueError(f"{self.shape} has more than {limit} cells")
        out = np.zeros(self.shape)
        rows = self.cells.toPandas()
        out[rows["i"], rows["j"]] = rows["v"]
        return out

    def gather_csr(self, limit: int = GATHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row pointers (m + 1), columns and values on the driver. More than ``limit`` rows or
        entries are an error."""
        if self.shape[0] > limit or (n := self.cells.limit(limit + 1).count()) > limit:
            raise ValueError(f"more than {limit} rows or entries")
        found = self.cells.orderBy("i", "j").toPandas()
        ptr = np.concatenate([[0], np.cumsum(np.bincount(found["i"].to_numpy(np.int64) if n else np.empty(0, np.int64), minlength=self.shape[0]))])
        return ptr, found["j"].to_numpy(), found["v"].to_numpy()

    def gather_shared(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Row pointers (i, row_ptr) and entries (i, j, v), gathered below a path that driver and
        executors share, in files in order of (i, j). It has no limit: what the driver holds does
        not grow with the matrix."""
        spark = self.cells.sparkSession
        ordered = self.cells.select("i", "j", "v").repartitionByRange("i", "j").sortWithinPartitions("i", "j")
        ordered.write.parquet(f"{path}/entries")
        entries = spark.read.schema(ordered.schema).parquet(f"{path}/entries")
        pointers = replace(self, cells=entries).row_ptr()
        pointers.write.parquet(f"{path}/row_ptr")
        return spark.read.schema(pointers.schema).parquet(f"{path}/row_ptr"), entries

    def info(self) -> dict:
        """Shape, kind, number of stored entries and the types of the cells."""
        return {"shape": self.shape, "dense": self.dense, "nnz": self.cells.count(), "types": dict(self.cells.dtypes)}

    def show(self, cells: int = 20) -> str:
        """Prints (and returns) shape, number of entries and the first cells in order."""
        head = self.cells.orderBy("i", "j").limit(cells).collect()
        facts = self.info()
        text = "\n".join([f"{facts['shape'][0]} by {facts['shape'][1]}, {facts['nnz']} entries", *(f"({r['i']}, {r['j']}) {r['v']}" for r in head)])
        print(text)
        return text

    # products
    def dot(self, other: Matrix, reduce: str | Fold = "plus", map: Callable[[Column, Column], Column] = times, salt: int | str = 1) -> Matrix:
        """A B over a semiring: c_ij = reduce over k of map(a_ik, b_kj), by the name of a monoid or
        any aggregate of a column. An equi-join on k, whose skewed partitions adaptive execution
        splits, then an aggregate with map-side combine. ``salt`` > 1 also splits every k into so
        many tasks; ``auto`` splits each k by the number of products that it makes."""
        if self.shape[1] != other.shape[0]:
            raise ValueError(f"{self.shape} by {other.shape}")
        a = self.cells.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
        b = other.cells.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("bv"))
        on = ["k"]
        if salt != 1:
            if salt == "auto":
                per = self._per_inner(other).select("k", F.least(F.ceil(F.col("na") * F.col("nb") / PER_SALT), "na").cast("int").alias("salts"))
                a, b = a.join(per, "k"), b.join(per, "k")
            else:
                a, b = (x.withColumn("salts", F.lit(salt)) for x in (a, b))
            a = a.withColumn("s", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int")).drop("salts")
            b = b.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
            on = ["k", "s"]
        small = other.dense and other.shape[0] * other.shape[1] <= BROADCAST_ROWS  # a dense shape bounds its size
        joined = a.join(F.broadcast(b) if small and salt == 1 else b, on)
        fold = REDUCE[reduce] if isinstance(reduce, str) else reduce
        return Matrix(joined.groupBy("i", "j").agg(fold(map(F.col("av"), F.col("bv"))).alias("v")), (self.shape[0], other.shape[1]), self.dense and other.dense)

    def _per_inner(self, other: Matrix) -> DataFrame:
        """(k, na, nb): entries in A's column and B's row, where both have some."""
        a = self.cells.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("na"))
        b = other.cells.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("nb"))
        return a.join(b, "k")

    def gemm(self, other: Matrix, into: Matrix, reduce: str = "plus", map: Callable[[Column, Column], Column] = times) -> Matrix:
        """C reduced with A B: C's entries take part."""
        both = self.dot(other, reduce, map).cells.unionByName(into.cells)
        return Matrix(both.groupBy("i", "j").agg(REDUCE[reduce]("v").alias("v")), into.shape, into.dense)

    def dot_tiled(self, other: Matrix, tile: int = 128) -> Matrix:
        """A B by square tiles of numpy arrays, for large dense factors. Entries travel as tiles;
        pairs of tiles that share an inner index meet by a join, which salts spread where there
        are few such indices; what a task makes for one tile of the result is summed there, sorted
        by tile, and again after an exchange of tiles. Cells appear only in the result."""
        size = tile * tile

        def packed(m: Matrix, names: tuple[str, str], into: str) -> DataFrame:
            at = (F.col("i") % tile * tile + F.col("j") % tile).cast("int").alias("p")
            entries = F.collect_list(F.struct(at, F.col("v").cast("double").alias("v")))
            grouped = m.cells.groupBy(F.expr(f"i div {tile}").alias(names[0]), F.expr(f"j div {tile}").alias(names[1])).agg(entries.alias("e"))
            return grouped.select(*names, F.col("e.p").alias(f"{into}p"), F.col("e.v").alias(f"{into}v"))

        def summed(rows):
            """Rows (ti, tj, sum) in order of tiles, equal ones added up."""
            here, total = None, None
            for ti, tj, c in rows:
                if (ti, tj) != here:
                    if here is not None:
                        yield (*here, total)
                    here, total = (ti, tj), c
                else:
                    total = total + c
            if here is not None:
                yield (*here, total)

        def frames(rows):
            held = []
            for row in rows:
                held.append(row)
                if len(held) * size >= 1 << 20:
                    yield pd.DataFrame(held, columns=["ti", "tj", "c"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["ti", "tj", "c"])

        def dense(places: np.ndarray, values: np.ndarray) -> np.ndarray:
            m = np.zeros(size)
            m[places] = values
            return m.reshape(tile, tile)

        def product(batches):
            def rows():
                for pdf in batches:
                    for ti, tj, ap, av, bp, bv in zip(*(pdf[c] for c in ("ti", "tj", "ap", "av", "bp", "bv")), strict=True):
                        yield ti, tj, (dense(ap, av) @ dense(bp, bv)).ravel()

            yield from frames(summed(rows()))

        def added(batches):
            yield from frames(summed((ti, tj, c) for pdf in batches for ti, tj, c in zip(pdf["ti"], pdf["tj"], pdf["c"], strict=True)))

        salts = max(1, min(-(-self.shape[0] // tile), PARALLEL // max(1, -(-self.shape[1] // tile))))
        a = packed(self, ("ti", "k"), "a").withColumn("s", (F.col("ti") % salts).cast("int"))
        b = packed(other, ("k", "tj"), "b").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = a.join(b, ["k", "s"]).select("ti", "tj", "ap", "av", "bp", "bv").sortWithinPartitions("ti", "tj")
        schema = "ti long, tj long, c array<double>"
        tiles = pairs.mapInPandas(product, schema).repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInPandas(added, schema)
        cells = tiles.select("ti", "tj", F.posexplode("c").alias("p", "v")).select((F.col("ti") * tile + F.expr(f"p div {tile}")).alias("i"), (F.col("tj") * tile + F.col("p") % tile).alias("j"), "v")
        return Matrix(cells.where((F.col("i") < self.shape[0]) & (F.col("j") < other.shape[1])), (self.shape[0], other.shape[1]), True)

    def flops(self, other: Matrix) -> DataFrame:
        """Products that A B takes: the sum over k of entries in A's column and B's row."""
        return self._per_inner(other).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long").alias("flops"))

    def compression(self, other: Matrix) -> DataFrame:
        """flops and flops over the entries of A B."""
        made = self.dot(other).cells.agg(F.count(F.lit(1)).alias("nnz"))
        return self.flops(other).crossJoin(made).select("flops", "nnz", F.try_divide(F.col("flops").cast("double"), F.col("nnz").cast("double")).alias("compression"))

    def row_dots(self) -> DataFrame:
        """(i, dot): each row with the next."""
        b = self.cells.select((F.col("i") - 1).alias("i"), "j", F.col("v").alias("bv"))
        return self.cells.join(b, ["i", "j"]).groupBy("i").agg(F.sum(F.col("v") * F.col("bv")).alias("dot"))


def check_csr(rows: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Numbers of rows of (i, row_ptr, col_ind, vals) whose columns do not ascend strictly, of
    columns outside the shape, and of rows whose number of values is another."""
    j = F.col("col_ind")
    up = F.forall(F.sequence(F.lit(1), F.greatest(F.size(j) - 1, F.lit(1))), lambda k: F.coalesce(F.get(j, k) > F.get(j, k - 1), F.lit(True)))
    out = F.size(F.filter(j, lambda x: (x < 0) | (x >= shape[1])))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(count(~up).alias("unsorted"), count(out).alias("outside"), count(F.size(j) != F.size("vals")).alias("uneven"))
