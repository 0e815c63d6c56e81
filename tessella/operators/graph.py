"""Chains over keyed tables: each node names the next, and pointer jumping finds every start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import next_kmer
from ..session import drop, scratch


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """A round's rows in the shared folder, and where."""
    path = scratch(df.sparkSession, "chain")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def walk(nodes: DataFrame, node: str, following: str) -> DataFrame:
    """(node, start, place): each node's chain and distance from its start. Rounds double the
    distance jumped, so they grow with the log of the longest chain. Nodes of cycles, which
    have no start, are left out."""
    # in the joins both sides grow with the nodes, whose files tell little of what a broadcast would hold
    before = nodes.where(F.col(following).isNotNull()).select(F.col(following).alias("node"), F.col(node).alias("to"))
    every = nodes.select(F.col(node).alias("node"))
    state = every.join(before.hint("merge"), "node", "left").select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("far"), F.col("to").isNull().alias("done"))
    left, last = None, None
    while True:
        state, path = _written(state)
        if last:
            drop(nodes.sparkSession, last)  # this round was made of it
        last = path
        now = state.where("not done").count()
        if now == 0 or now == left:
            break
        left = now
        hop = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moving = state.where("not done").join(hop.hint("merge"), "to").select("node", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), "done2").withColumnRenamed("done2", "done")
        # a node whose target is a start is done: its distance is final
        state = state.where("done").unionByName(moving)
    return state.where("done").select("node", F.col("to").alias("start"), F.col("far").alias("place"))


def contigs(kmers: DataFrame) -> DataFrame:
    """(start, contig, nodes) from (kmer, bwd, fwd): chains from bwd = 'F' to fwd = 'F'."""
    linked = kmers.select("kmer", "bwd", "fwd", F.when(F.col("fwd") != "F", next_kmer(F.col("kmer"), F.col("fwd"))).alias("following"))
    placed = walk(linked, "kmer", "following").join(kmers.withColumnRenamed("kmer", "node").hint("merge"), "node")
    begins = kmers.where("bwd = 'F'").select(F.col("kmer").alias("start"))
    steps = placed.join(begins.hint("merge"), "start", "left_semi").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "fwd"))).alias("s"))
    text = F.concat("start", F.array_join(F.transform(F.filter("s", lambda x: x["fwd"] != "F"), lambda x: x["fwd"]), ""))
    return steps.select("start", text.alias("contig"), F.size("s").cast("long").alias("nodes"))
