"""Pieces that several operators share: written steps, doc hashes, connected components."""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop, scratch

#: The ASCII white space of the word and line contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is (``lower`` would fold other scripts too)."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as lower-cased UTF-8 (surrogates pass through)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a step to the shared folder and read it back: later steps survive lost executors
    and nothing before it runs twice. The written files go when the session ends; shuffle files
    of the steps before go first, as the JVM is asked to collect what is unreachable."""
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = scratch(spark, "step")
    df.write.option("compression", codec).parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_step(df: DataFrame) -> None:
    """Delete the files of a settled step that no later step reads, and what it left in shuffles."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop(df.sparkSession, folder)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


_kept: dict = {}


def only(key, build):
    """``build()``, which a reused Python worker keeps for ``key`` until another key is asked for:
    a worker holds one operator's tables at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def sliced(batches, rows: int = 512):
    """Arrow batches cut to a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def _forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """(u, v) edges to a star forest over the same nodes: each non-root points at the least id."""
    ids, flat = np.unique(pairs[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    parent = np.arange(len(ids))
    a, b = flat[0::2], flat[1::2]
    while len(a):
        ra, rb = parent[a], parent[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(ids))
    return pd.DataFrame({"u": ids[moved], "v": ids[parent[moved]]})


def _forests(batches):
    for pdf in batches:
        if len(pdf):
            yield _forest(pdf)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: rows (id, component) for every node
    with a link, the component being its least id.

    Alternating large-star and small-star steps, each an aggregate and a join on a node, so a
    node with very many links is pre-aggregated and its join side can be split. Within a batch
    edges shrink to a forest first. Rounds grow with the log of the longest chain.
    """
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = settle(e.mapInPandas(_forests, "u long, v long").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        drop_step(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
