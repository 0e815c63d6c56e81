"""Matrix files: Matrix Market text, raw binary CSR, k-mer lists, and generated matrices."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Matrix
from ..operators.scan import exclusive_scan
from ..session import drop, scratch

BANNER = "%%MatrixMarket"


@dataclass(frozen=True)
class MatrixInfo:
    shape: tuple[int, int]
    nnz: int


def file_type(path: str) -> str:
    """``mtx`` or ``binary`` from the last suffix."""
    suffix = path.rsplit(".", 1)[-1]
    if suffix not in ("mtx", "binary"):
        raise ValueError(f"unknown matrix file {path}")
    return suffix


def matrix_info(spark: SparkSession, path: str) -> MatrixInfo:
    """Shape and number of entries, from the header alone."""
    if file_type(path) == "binary":
        m, n, nnz = struct.unpack("<QQQ", b"".join(spark.sparkContext.binaryRecords(path, 8).take(3)))
        return MatrixInfo((m, n), nnz)
    return _header(spark, path)[0]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, where their part of it begins, and a number that ascends in a part."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _header(spark: SparkSession, path: str) -> tuple[MatrixInfo, dict, list[str]]:
    """Sizes, where their line is, and the words of the banner. Of several part files one has both."""
    lines = _lines(spark, path).where("block = 0")
    banner = lines.where(F.col("value").startswith(BANNER)).orderBy("file", "line").first()
    if banner is None:
        size = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).orderBy("file", "line").first()
    else:
        size = lines.where((F.col("file") == banner["file"]) & ~F.col("value").startswith("%") & (F.trim("value") != "")).orderBy("line").first()
    m, n, nnz = map(int, size["value"].split())
    return MatrixInfo((m, n), nnz), size.asDict(), banner["value"].split() if banner else []


def read_matrix_market(spark: SparkSession, path: str, one_indexed: bool = True) -> Matrix:
    """Coordinate files, any field (``pattern`` reads as 1), general or symmetric. Of equal
    coordinates the first line stays. Errors: another banner or symmetry, entries outside the
    shape, more entries than declared; fewer are accepted."""
    info, header, banner = _header(spark, path)
    if len(banner) < 5 or [b.lower() for b in banner[1:3]] != ["matrix", "coordinate"]:
        raise ValueError(f"not a coordinate Matrix Market file: {path}")
    field, symmetry = banner[3].lower(), banner[4].lower()
    if symmetry not in ("general", "symmetric"):
        raise ValueError(f"unsupported symmetry {symmetry}")
    data = _lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    (m, n), nnz = info.shape, info.nnz
    parts, shift = F.split(F.trim("value"), r"\s+"), int(one_indexed)
    v = F.lit(1.0) if field == "pattern" else parts[2].cast("double")
    # in a part file lines are known by file, part and number
    line = F.struct("file", "block", "line")
    rest = data.where((F.col("file") != header["file"]) | (F.col("block") != 0) | (F.col("line") != header["line"]))
    rows = rest.select((parts[0].cast("long") - shift).alias("i"), (parts[1].cast("long") - shift).alias("j"), v.alias("v"), line.alias("line"))
    found, low_i, low_j, high_i, high_j = rows.agg(F.count(F.lit(1)), F.min("i"), F.min("j"), F.max("i"), F.max("j")).first()
    if found > nnz:
        raise ValueError(f"{found} entries where {nnz} are declared")
    if found and not (0 <= low_i and 0 <= low_j and high_i < m and high_j < n):
        raise ValueError("an entry lies outside the shape")
    if symmetry == "symmetric":
        rows = rows.unionByName(rows.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v", "line"))
    return Matrix.from_coo(rows, (m, n), "first", "line")


def write_matrix_market(matrix: Matrix, path: str, one_indexed: bool = True, parts: int | None = 1) -> None:
    """Text in order of (i, j), with the field of the values: one file, or with ``parts`` None as
    many part files as the sort makes (the first one holds the header; ``read_matrix_market``
    reads the folder). One file is sorted by many tasks too, and their parts are put together as
    streams of bytes."""
    kind = dict(matrix.cells.dtypes)["v"]
    field = "integer" if kind in ("bigint", "int", "smallint", "tinyint") else "real"
    nnz = matrix.cells.count()
    shift = int(one_indexed)
    spark = matrix.cells.sparkSession
    head = spark.createDataFrame([(-2, -1, f"{BANNER} matrix coordinate {field} general"), (-1, -1, f"{matrix.shape[0]} {matrix.shape[1]} {nnz}")], "i long, j long, value string")
    body = matrix.cells.select("i", "j", F.concat_ws(" ", (F.col("i") + shift).cast("string"), (F.col("j") + shift).cast("string"), F.col("v").cast("string")).alias("value"))
    both = head.unionByName(body)
    several = [parts] if parts and parts > 1 else []
    ordered = both.repartitionByRange(*several, "i", "j").sortWithinPartitions("i", "j").select("value")
    if parts != 1:
        ordered.write.text(path)
        return
    made = scratch(spark, "parts")
    ordered.write.text(made)
    with _Sink(spark, f"{path}/part-00000.txt") as out:
        for part, size in _parts(spark, made):
            out.copy(part, [(0, size)])
    drop(spark, made)


#: Bytes of a record that a binary file is read in, at most.
RECORD = 1 << 20


def _words(spark: SparkSession, path: str, total: int) -> DataFrame:
    """(at, raw): a binary file of ``total`` 8-byte words in records, with the number of their
    first word; tasks read parts of the file."""
    per = max(d for d in range(1, min(total, RECORD // 8) + 1) if total % d == 0)
    records = spark.sparkContext.binaryRecords(path, 8 * per).zipWithIndex()
    return spark.createDataFrame(records.map(lambda x: (x[1] * per, bytearray(x[0]))), "at long, raw binary")


def read_binary(spark: SparkSession, path: str, value: str = "<f8", index: str = "<i8", rows: tuple[int, int] | None = None) -> Matrix:
    """Raw CSR: three uint64 (rows, columns, entries), values, column indices, row pointers; with
    ``rows`` only [first, end) of them, numbered from 0, of which no other entry is kept.

    Files of 8-byte values and indices are read in parts by many tasks; words find their entry by
    its number, and entries their row by a scan over the row pointers. Others are read whole by
    one task (up to 2 GB)."""
    info = matrix_info(spark, path)
    (m, n), nnz = info.shape, info.nnz
    if np.dtype(value).itemsize == np.dtype(index).itemsize == 8:
        words = _words(spark, path, 4 + 2 * nnz + m)

        def section(begin: int, size: int, dtype: str, kind: str) -> DataFrame:
            """(e, x): words begin .. begin + size as numbers, numbered from 0."""

            def decode(batches):
                for pdf in batches:
                    for at, raw in zip(pdf["at"], pdf["raw"], strict=True):
                        x = np.frombuffer(raw, dtype)
                        e = np.arange(at - begin, at - begin + len(x))
                        inside = (e >= 0) & (e < size)
                        yield pd.DataFrame({"e": e[inside], "x": x[inside]})

            near = words.where((F.col("at") < begin + size) & (F.col("at") + F.octet_length("raw") / 8 > begin))
            return near.mapInPandas(decode, f"e long, x {kind}")

        pointers = section(3 + 2 * nnz, m + 1, index, "long")
        first, end = rows or (0, m)
        end = min(end, m)
        low, high = 0, nnz
        if rows:  # two pointers tell which entries the rows hold
            ends = {r["e"]: r["x"] for r in pointers.where(F.col("e").isin(first, end)).collect()}
            low, high = ends[first], ends[end]
        inside = (F.col("e") >= low) & (F.col("e") < high)
        values = section(3, nnz, value, "double").where(inside).withColumnRenamed("x", "v")
        columns = section(3 + nnz, nnz, index, "long").where(inside).withColumnRenamed("x", "j")
        entries = values.join(columns, "e").select("e", F.lit(1).alias("of"), F.lit(None).cast("long").alias("i"), "j", "v")
        starts = pointers.where((F.col("e") >= first) & (F.col("e") < end)).select(F.col("x").alias("e"), F.lit(0).alias("of"), F.col("e").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("v"))
        placed = exclusive_scan(entries.union(starts), F.col("i"), ["e", "of", "i"], [], "row", "max").where("of = 1")
        return Matrix(placed.select((F.col("row") - first).alias("i"), "j", "v"), (max(0, end - first), n))

    def decode(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                wv, wi = np.dtype(value).itemsize, np.dtype(index).itemsize
                v = np.frombuffer(raw, value, nnz, 24)
                j = np.frombuffer(raw, index, nnz, 24 + wv * nnz)
                ptr = np.frombuffer(raw, index, m + 1, 24 + (wv + wi) * nnz)
                i = np.repeat(np.arange(m), np.diff(ptr))
                for a in range(0, nnz, 100_000):
                    cut = slice(a, a + 100_000)
                    yield pd.DataFrame({"i": i[cut].astype(np.int64), "j": j[cut].astype(np.int64), "v": v[cut].astype(np.float64)})

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "i long, j long, v double")
    whole = Matrix(cells, info.shape)
    return whole.slice(rows, (0, n)) if rows else whole


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Part files of a folder in their order, with their sizes."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((str(f.getPath()), f.getLen()) for f in found if f.getPath().getName().startswith("part-"))


class _Sink:
    """A file in any store that Spark reaches, written from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._context = spark.sparkContext
        at = self._context._jvm.org.apache.hadoop.fs.Path(path)
        self._out = at.getFileSystem(self._context._jsc.hadoopConfiguration()).create(at, True)

    def write(self, raw: bytes) -> None:
        self._out.write(bytearray(raw))

    def copy(self, path: str, ranges: list[tuple[int, int]]) -> None:
        """Append stretches (begin, size) of another file, through a short buffer of the JVM."""
        at = self._context._jvm.org.apache.hadoop.fs.Path(path)
        source = at.getFileSystem(self._context._jsc.hadoopConfiguration()).open(at)
        try:
            for begin, size in ranges:
                source.seek(begin)
                copied = self._context._jvm.org.apache.commons.io.IOUtils.copyLarge(source, self._out, 0, size)
                if copied != size:
                    raise OSError(f"{path} ends after {begin + copied} bytes")
        finally:
            source.close()

    def __enter__(self) -> _Sink:
        return self

    def __exit__(self, *_) -> None:
        self._out.close()


#: Entries of a stretch of raw bytes.
STRETCH = 1 << 16


def _raw_parts(df: DataFrame, kinds: list[tuple[str, str]], path: str) -> list[tuple[str, int]]:
    """The columns of ``kinds`` (name, type) as raw bytes in part files, by as many tasks as there are
    partitions, in order: of each stretch of rows the bytes of one column after the other, each with
    a line end that is not part of them. Returns the files with their numbers of rows."""

    def encode(batches):
        held = [np.empty(0, kind) for _, kind in kinds]

        def told(k: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[:k].tobytes() for h in held], pa.binary())], names=["raw"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(name).to_numpy(zero_copy_only=False).astype(kind)]) for h, (name, kind) in zip(held, kinds, strict=True)]
            while len(held[0]) >= STRETCH:
                yield told(STRETCH)
                held = [h[STRETCH:] for h in held]
        if len(held[0]):
            yield told(len(held[0]))

    spark = df.sparkSession
    df.select(*[name for name, _ in kinds]).mapInArrow(encode, "raw binary").select(F.col("raw").cast("string")).write.option("lineSep", "\n").text(path)
    width = sum(np.dtype(kind).itemsize for _, kind in kinds)
    full = STRETCH * width + len(kinds)
    return [(part, size // full * STRETCH + max(0, size % full - len(kinds)) // width) for part, size in _parts(spark, path)]


def _ranges(rows: int, kinds: list[tuple[str, str]], which: int) -> list[tuple[int, int]]:
    """Where the bytes of a column are in a part file of so many rows."""
    widths = [np.dtype(kind).itemsize for _, kind in kinds]
    found, at = [], 0
    for first in range(0, rows, STRETCH):
        n = min(STRETCH, rows - first)
        found.append((at + n * sum(widths[:which]) + which, n * widths[which]))
        at += n * sum(widths) + len(widths)
    return found


def write_binary(matrix: Matrix, path: str, value: str = "<f8", index: str = "<i8") -> None:
    """The inverse of ``read_binary``. Tasks sort the entries and make the bytes of each array in
    parts; the format is one file of contiguous arrays, so the driver puts the parts together, as
    streams of bytes: no rows come to it."""
    spark, (m, n) = matrix.cells.sparkSession, matrix.shape
    entries, pointers = [("v", value), ("j", index)], [("row_ptr", index)]
    ordered = matrix.cells.select("i", "j", "v").repartitionByRange("i", "j").sortWithinPartitions("i", "j")
    made, marks = scratch(spark, "entries"), scratch(spark, "pointers")
    parts = _raw_parts(ordered, entries, made)
    marked = _raw_parts(matrix.row_ptr().repartitionByRange("i").sortWithinPartitions("i"), pointers, marks)
    with _Sink(spark, path) as out:
        out.write(struct.pack("<QQQ", m, n, sum(rows for _, rows in parts)))
        for which in (0, 1):
            for part, rows in parts:
                out.copy(part, _ranges(rows, entries, which))
        for part, rows in marked:
            out.copy(part, _ranges(rows, pointers, 0))
    for step in (made, marks):
        drop(spark, step)


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    return read_binary(spark, path) if file_type(path) == "binary" else read_matrix_market(spark, path)


def read_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(kmer, bwd, fwd) from lines of a k-mer, a space and two extensions."""
    line = F.col("value")
    return spark.read.text(path).where(F.length(line) >= k + 3).select(F.substring(line, 1, k).alias("kmer"), F.substring(line, k + 2, 1).alias("bwd"), F.substring(line, k + 3, 1).alias("fwd"))


def write_contigs(contigs: DataFrame, path: str, least: int) -> None:
    contigs.where(F.length("contig") >= least).select("contig").write.text(path)


def uniform_keys(spark: SparkSession, n: int, bound: int, seed: int = 0) -> DataFrame:
    """n keys below a bound, the same on every run."""
    return spark.range(n).select(F.col("id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bound)).alias("value"))


def generate_sparse(spark: SparkSession, shape: tuple[int, int], nnz_per_row: float, alpha: float = 0.0, seed: int = 0) -> DataFrame:
    """(i, j, v = 1) rows, duplicates kept: per row max(1, 2 u nnz_per_row) draws of a column,
    uniform for alpha 0 and else Zipf with weight (column + 1)^-alpha."""
    m, n = shape
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40)) / float(1 << 40)
    rows = spark.range(m).select(F.col("id").alias("i"), F.greatest(F.lit(1), (unit("id", F.lit(seed)) * 2 * nnz_per_row).cast("int")).alias("n"))
    draws = rows.select("i", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("u", unit("i", "k", F.lit(seed + 1)))
    if alpha == 0:
        return draws.select("i", F.floor(F.col("u") * n).cast("long").alias("j"), F.lit(1.0).alias("v"))
    cdf = np.cumsum(np.arange(1, n + 1, dtype=float) ** -alpha)
    cdf /= cdf[-1]

    @F.pandas_udf("long")
    def column(u: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(cdf, u.to_numpy(), "right"), n - 1))

    return draws.select("i", column("u").alias("j"), F.lit(1.0).alias("v"))
