"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 60-bit ring; a document belongs to the first point
clockwise of the hash of its id. Shards have capacities that add up to the number of rows, as
equal as can be, so every shard ends exactly full: law ``rows``, counts at most one apart. A
shard takes the rows of its own arcs in ring order until it is full; the rest go on clockwise,
past full shards, to the next one with room. A row moves only if its own shard is full.

The ring is cut at its points (arcs) and each arc into cells. Counts of rows per cell are one
aggregate; what overflows where is settled on those counts alone, whose number depends on the
parameters and not on the data. Rows are ranked inside their cell, so a window holds
rows / cells of them whatever repeats in the data: equal texts have different ids.

Results in odd cases: a null text has size 8 and the crc32 of the empty text; a null doc_id
hashes as the empty string; rows that repeat an id are told apart by text hash and then rank,
and rows equal in both are interchangeable; extra columns pass through; an empty table gives an
empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, VNODES, CELLS = 24, 64, 4096
_DIGITS = 15


def _point(name: str) -> int:
    return int(md5(name.encode()).hexdigest()[:_DIGITS], 16)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in clockwise order. A shard's points depend on
    its number only, so one more shard leaves the others where they are."""
    return sorted((_point(f"shard-{s}-{v}"), s) for s in range(shards) for v in range(vnodes))


def position(key: Column) -> Column:
    """Place of a key on the ring: the leading 60 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def flow(counts: list[int], owners: list[int], capacity: dict[int, int]) -> list[list[tuple[int, int, int, int]]]:
    """For each cell, in clockwise order, pieces (first rank, last rank + 1, shard, first slot).

    ``counts`` and ``owners`` give the rows and the shard of every cell. First each shard takes
    its own rows in ring order up to its capacity; then what is left over walks clockwise, in
    the order in which it overflowed, and fills the shards that it passes.
    """
    filled = dict.fromkeys(capacity, 0)
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    left = []
    for cell, (n, s) in enumerate(zip(counts, owners, strict=True)):
        take = min(n, capacity[s] - filled[s])
        if take:
            pieces[cell].append((0, take, s, filled[s]))
            filled[s] += take
        left.append((take, n))
    queue: list[list[int]] = []
    size = len(counts)
    for step in range(2 * size):
        cell = step % size
        s = owners[cell]
        while queue and filled[s] < capacity[s]:
            head = queue[0]
            take = min(head[2] - head[1], capacity[s] - filled[s])
            pieces[head[0]].append((head[1], head[1] + take, s, filled[s]))
            filled[s] += take
            head[1] += take
            if head[1] == head[2]:
                queue.pop(0)
        if step < size and left[cell][0] < left[cell][1]:
            queue.append([cell, *left[cell]])
    return pieces


def assign_shards(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ring__shard`` (int) and ``ring__slot`` (long, gapless from 0 in a shard)."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    width = (1 << 4 * _DIGITS) // cells
    bounds = sorted({p for p, _ in points} | {width * i for i in range(cells)})  # ends of cells; a cell holds (previous end, end]
    at = [p for p, _ in points]
    owners = [points[bisect_left(at, b) % len(points)][1] for b in bounds]
    owners.append(points[0][1])  # past the last bound, the ring goes on to its first point

    counted = _with_cells(docs, bounds, width, id_col, text_col)
    got = {r["ring__cell"]: r["n"] for r in counted.groupBy("ring__cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # cells + points at most
    counts = [got.get(k, 0) for k in range(len(owners))]
    total = sum(counts)
    capacity = {s: total // shards + (s < total % shards) for s in range(shards)}
    rows = [(k, first, last, s, slot) for k, cell in enumerate(flow(counts, owners, capacity)) for first, last, s, slot in cell]
    pieces = spark.createDataFrame(rows, "ring__cell int, ring__from long, ring__to long, ring__shard int, ring__base long")
    within = F.row_number().over(Window.partitionBy("ring__cell").orderBy("ring__at", f"`{id_col}`", "ring__text")).cast("long") - 1
    ranked = counted.withColumn("ring__rank", within)
    # as many pieces as cells, points and shards together: a bound that the parameters set
    found = ranked.join(F.broadcast(pieces), "ring__cell").where("ring__rank >= ring__from and ring__rank < ring__to")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "ring__shard", (F.col("ring__base") + F.col("ring__rank") - F.col("ring__from")).alias("ring__slot"))


def _with_cells(docs: DataFrame, bounds: list[int], width: int, id_col: str, text_col: str) -> DataFrame:
    """Adds place, text hash and cell. The ring is cut into even slices; a slice lists the few
    bounds inside it, and the bounds that lie before a place give the number of its cell."""
    slices: list[list[int]] = [[] for _ in range((1 << 4 * _DIGITS) // width + 1)]
    for b in bounds:
        slices[b // width].append(b)
    rows, before = [], 0
    for number, own in enumerate(slices):
        rows.append((number, before, own))
        before += len(own)
    table = docs.sparkSession.createDataFrame(rows, "ring__slice long, ring__before int, ring__bounds array<bigint>")
    keyed = docs.withColumns({"ring__at": position(F.col(f"`{id_col}`")), "ring__text": F.xxhash64(F.col(f"`{text_col}`"))}).withColumn("ring__slice", F.expr(f"ring__at div {width}"))
    place = F.col("ring__at")
    return keyed.join(F.broadcast(table), "ring__slice").withColumn("ring__cell", F.col("ring__before") + F.size(F.filter("ring__bounds", lambda b: b < place))).drop("ring__slice", "ring__before", "ring__bounds")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # the texts stay behind: what moves is an id, two numbers and a hash
    small = docs.select("doc_id", (F.length("text").cast("long") + 8).alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("text"))
    return assign_shards(small).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("ring__shard").alias("shard"), F.col("ring__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
