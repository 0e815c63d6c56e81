"""Session and table helpers shared by every query."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "tessella") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Bytes of a batch that goes to a Python worker, where the session names no limit of its own.
BATCH = 4 << 20


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the
    session was started in (where executors have it installed this changes nothing), and bound the
    batches that they get by bytes: ten thousand long texts in one would cost an executor more
    memory than the work on them."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH")]))
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(limit):
        spark.conf.set(limit, str(BATCH))


#: Bytes of a file that a task reads, and of shuffled data (compressed) that it gets; bytes of a
#: table for each partition of a shuffle, and partitions that are added for tables at most.
SPLIT, SHARE, PER_PARTITION, PARTITIONS = 16 << 20, 4 << 20, 256 << 10, 2048


def share_out(spark: SparkSession, size: int) -> None:
    """Let the number of tasks grow with the input, not what one of them holds: short splits and
    shuffled shares, and for a table of ``size`` bytes enough partitions to be put together again.
    Adaptive execution would else deal 64 MB of compressed rows to each core. What the session
    names itself stays."""
    conf = spark._jsparkSession.sessionState().conf()
    given = spark.sparkContext.__dict__.setdefault("_tessella_shares", {})
    partitions = min(PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_PARTITION)))
    wanted = {"spark.sql.files.maxPartitionBytes": SPLIT, "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHARE, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": partitions}
    for key, value in wanted.items():
        own = not conf.contains(key) or spark.conf.get(key) == given.get(key)
        if own and value > int(given.get(key, 0)):
            given[key] = str(value)
            spark.conf.set(key, given[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; projections and filters reach the scan, and
    tasks are as many as its size asks for."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    share_out(spark, int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, whose files go when the session ends.
    Where that is unset a local session gets a temporary folder; a cluster must name one that all
    its machines share."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_tessella_scratch", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = context._tessella_scratch = tempfile.mkdtemp(prefix="tessella-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of ``scratch`` that nothing reads any more."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
