"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One handle or chat may own a third of all rows. The lookup joins carry no
    # broadcast hint, so Spark broadcasts a lookup side only when its measured
    # size is below the threshold, and splits hot partitions otherwise.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Message rows of a shuffle partition, some 100 to 200 MB.
_ROWS_PER_PARTITION = 500_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call on a running session."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def path_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row with the total size of the files below a path; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("size_bytes"))


def shuffles_for(spark: SparkSession, rows: int):
    """While this holds, shuffles start with partitions that fit in memory for so many messages.

    Adaptive execution merges small partitions but never adds any, so at many terabytes the
    default number would leave partitions too large for memory. Only ever raises the number.
    """
    wanted = max(-(-rows // _ROWS_PER_PARTITION), shuffle_partitions(spark))
    return _setting(spark, {_INITIAL_PARTITIONS: str(wanted)})


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that shuffles start with."""
    return int(spark.conf.get(_INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def _setting(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def placement_by_block(spark: SparkSession):
    """While this holds, sides that are placed by one of their join keys are joined in place."""
    return _setting(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def answers_from_footers(spark: SparkSession):
    """While this holds, counts, minima and maxima of whole Parquet tables that are read and
    answered within come from the files' footers."""
    return _setting(spark, {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"})


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name for tables a job writes and reads back.

    It lies in the shared folder named by spark.checkpoint.dir. Only a local
    session without that setting gets a folder on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="msgloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row."""
    stacked = first
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"
