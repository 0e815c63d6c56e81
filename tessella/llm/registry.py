"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import reachable
from . import context_tree, decontaminate, language, line_dedup, near_vectors, pieces, sharding, shingle_join, suffix_dedup, surrogates


def found_by_workers(fn):
    """``fn``, whose session's Python workers can import this package."""

    @wraps(fn)
    def run(spark: SparkSession, *args):
        reachable(spark)
        return fn(spark, *args)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_shingle_join": shingle_join.op2_shingle_join,
        "op3_language": language.op3_language,
        "op4_surrogates": surrogates.op4_surrogates,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_pieces": pieces.op7_pieces,
        "op8_near_vectors": near_vectors.op8_near_vectors,
        "op9_context_tree": context_tree.op9_context_tree,
        "op10_sharding": sharding.op10_sharding,
    }
    return {name: found_by_workers(fn) for name, fn in every.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_shingle_join": shingle_join.SQL, "op5_line_dedup": line_dedup.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op8_near_vectors": near_vectors.SQL}
