"""Ship a function to the data: a table of calls is sent to its destinations and evaluated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import distribute


def call(calls: DataFrame, functions: dict[str, Callable[..., Column]], args: list[str], name: str = "fn", into: str = "result") -> DataFrame:
    """``calls`` with the result of the function that each row names, as one expression."""
    out = F.lit(None)
    for key, fn in functions.items():
        out = F.when(F.col(name) == key, fn(*[F.col(a) for a in args])).otherwise(out)
    return calls.withColumn(into, out)


class Pending:
    """A job that runs on its own thread: ``done`` asks, ``get`` waits for its rows."""

    def __init__(self, df: DataFrame, path: str):
        self._spark, self._schema, self._path, self._error = df.sparkSession, df.schema, path, None

        def run() -> None:
            try:
                df.write.parquet(path)
            except Exception as e:  # told to who asks for the rows
                self._error = e

        self._thread = InheritableThread(target=run)
        self._thread.start()

    def done(self) -> bool:
        return not self._thread.is_alive()

    def get(self) -> DataFrame:
        self._thread.join()
        if self._error:
            raise self._error
        return self._spark.read.schema(self._schema).parquet(self._path)


def call_async(calls: DataFrame, functions: dict[str, Callable[..., Column]], args: list[str], path: str, **how) -> Pending:
    """``call`` as a job of its own, whose results go to ``path`` (which all machines share)."""
    return Pending(call(calls, functions, args, **how), path)


def call_remote(calls: DataFrame, dest: str, ranks: int, functions: dict[str, Callable[..., Column]], args: list[str], **how) -> DataFrame:
    """``call``, with every call moved to its destination first (``rank`` tells where it ran).
    What a task sends to a destination travels together."""
    return call(distribute(calls, dest, ranks).withColumn("rank", F.spark_partition_id()), functions, args, **how)


def call_at(calls: DataFrame, dest: str, ranks: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Calls go to partition ``dest`` and a Python function takes them in batches there."""
    return calls.repartitionById(ranks, F.col(dest).cast("int")).mapInPandas(lambda batches: (fn(b) for b in batches), schema)


def launch(spark, extent: int, fn: Callable[[Column], Column], into: str = "value") -> DataFrame:
    """fn of every index below an extent."""
    return spark.range(extent).select(F.col("id"), fn(F.col("id")).alias(into))
