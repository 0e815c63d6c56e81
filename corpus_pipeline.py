"""A cleaning pipeline over ``documents``: each stage applies one operator to all that the
stage before kept, and its rows are written as Parquet and read again for the next.

1. language ID: documents go that have no letter, or of whose language the network is less sure
   than of any window of text that it has learned from;
2. line dedup: lines of ten documents or more go;
3. n-gram Jaccard join: of each group of near copies the least id stays;
4. benchmark decontamination: documents that hold a test item go;
5. SentencePiece encoding: what is left, as ids with their source spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import settle
from tessella.llm.decontaminate import find_items
from tessella.llm.language import UNDECIDED, fit, identify
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.pieces import encode_documents, model_bytes
from tessella.llm.registry import found_by_workers
from tessella.llm.shingle_join import keep_one


@found_by_workers
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are ``und`` (null, or without a letter) or whose score is below
    ``Network.floor``, which is less by a margin than that of any window that the network has
    learned from: clean text of a learned language is surer. The network learns from the labelled
    documents; where there are none it rejects nothing, and all documents stay."""
    net = fit(docs, F.lit(True))
    if net is None:
        return docs
    found = identify(docs, net)
    return found.where((F.col("language__pred") != UNDECIDED) & (F.col("language__score") >= net.floor)).select(docs.columns)


@found_by_workers
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` is the length of what is left. A null text becomes an empty
    one; every row stays, also those that repeat an id or have none."""
    found = dedup_lines(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


@found_by_workers
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays, with all rows of that id.
    Rows without words, or with a null id, link with nothing and stay."""
    return keep_one(docs)


@found_by_workers
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go. Null and blank texts hold none and stay, as
    do all rows where the benchmark is empty; rows that repeat an id are each searched."""
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("decontaminate__items") == 0).select(docs.columns)


@found_by_workers
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and span ends of the pieces, and their number; a row for each document, of a
    null or empty text with none."""
    found = encode_documents(docs.select("doc_id", "text"), model_bytes())
    return found.select("doc_id", F.col("pieces__ids").alias("ids"), F.col("pieces__ends").alias("ends"), F.size("pieces__ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: A recurrent network and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
