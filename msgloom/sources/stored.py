"""Reading the stored dataset: its rows, its files, its columns and its status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.errors import SchemaMismatch
from msgloom.schemas import MESSAGES, SCHEMA_VERSION
from msgloom.session import one_row, path_bytes
from msgloom.sources.commits import (
    ROWS, column_list, current_commit, live_files, needed_files, read_files, read_runs, run_row, within,
)

__all__ = ["check_schema", "data_files", "read_messages", "read_runs", "schema_gate", "status"]

# Units of the size text.
KB, MB = 1024, 1024 * 1024


def read_messages(
    spark: SparkSession, dataset: str, start: dt.date | None = None, end: dt.date | None = None,
    first_id: int | None = None, last_id: int | None = None,
) -> DataFrame:
    """The current `messages` table, or its rows of some days or ids, all bounds included.

    Only files whose ranges meet the bounds are listed, and rows are filtered inside them.
    A dataset of another schema is refused.
    """
    commit = current_commit(spark, dataset)
    check_schema(dataset, commit)
    rows = read_files(spark, needed_files(spark, dataset, commit, (start, end), (first_id, last_id)))
    for test in (within("date", "date", start, end), within("message_id", "message_id", first_id, last_id)):
        rows = rows if test is None else rows.where(test)
    return rows


def data_files(spark: SparkSession, dataset: str) -> DataFrame:
    """The files of the current table, with their rows, bytes, and ranges of ids and days."""
    return live_files(spark, dataset, current_commit(spark, dataset))


def check_schema(dataset: str, commit: dict) -> None:
    """Refuse a dataset of another schema, for readers and for writers that add to it. The commit
    names the columns of every load in it, so no file is opened."""
    if commit["schema_version"] != SCHEMA_VERSION:
        raise SchemaMismatch(
            f"{dataset} has schema version {commit['schema_version']}, expected {SCHEMA_VERSION}: "
            "migrate it, or sync with force=True"
        )
    if any(columns != column_list() for columns in commit["columns"]):
        raise SchemaMismatch(f"{dataset} holds other columns than expected: migrate it, or sync with force=True")


def schema_gate(spark: SparkSession, dataset: str) -> DataFrame:
    """What the gate looks at, from the files themselves: one row per load of the current table
    with its files and rows, the columns it lacks or has beyond the expected ones, those of another
    type, and whether readers accept it.

    One footer per load is opened: a load is written by one job, so its files agree.
    """
    commit = current_commit(spark, dataset)
    files = live_files(spark, dataset, commit).withColumn("load", F.regexp_extract("path", "load=([^/]*)", 1))
    loads = files.groupBy("load").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("path").alias("path"))
    expected = {f.name: f.dataType for f in MESSAGES.fields}
    rows = []
    for load in loads.collect():  # as many as there are loads, which `compact` keeps few
        found = {f.name: f.dataType for f in spark.read.parquet(f"{dataset}/{ROWS}/{load['path']}").schema.fields}
        missing, extra = sorted(expected.keys() - found.keys()), sorted(found.keys() - expected.keys())
        other = sorted(c for c in expected.keys() & found.keys() if expected[c] != found[c])
        version = commit["schema_version"]
        accepted = not (missing or extra or other) and version == SCHEMA_VERSION
        rows.append((load["load"], load["files"], load["rows"], version, ",".join(missing), ",".join(extra), ",".join(other), accepted))
    return spark.createDataFrame(
        rows,
        "load string, files long, rows long, schema_version int, missing_columns string, extra_columns string, "
        "other_types string, accepted boolean",
    )


def status(spark: SparkSession, dataset: str) -> DataFrame:
    """One row about the dataset: rows, last sync, size, schema, contacts. `size_bytes` is what
    readers read, `superseded_bytes` what older or unfinished loads still take. The log and the
    manifests answer; no data file is opened."""
    commit = current_commit(spark, dataset)
    check_schema(dataset, commit)
    files = live_files(spark, dataset, commit).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"), F.max("max_timestamp").alias("last_message_at")
    )
    row = run_row(spark, commit)
    if commit["manifests"]:
        every = path_bytes(spark, f"{dataset}/{ROWS}").withColumnRenamed("size_bytes", "every_byte")
    else:
        every = spark.createDataFrame([(0,)], "every_byte long")
    row = one_row(row, files, every)
    warning = F.when(F.col("contacts_resolved") == 0, F.lit("contact names were not resolved"))
    return row.select(
        "total_messages",
        F.format_number("total_messages", 0).alias("messages_text"),
        "last_message_id",
        "last_message_at",
        F.col("finished_at").alias("last_sync"),
        "size_bytes",
        size_text(F.col("size_bytes")).alias("size_text"),
        (F.col("every_byte") - F.col("size_bytes")).alias("superseded_bytes"),
        "schema_version",
        "contacts_resolved",
        warning.alias("warning"),
    )


def size_text(size):
    """Bytes as text in B, KB or MB."""
    return (
        F.when(size >= MB, F.format_string("%.1f MB", size / F.lit(float(MB))))
        .when(size >= KB, F.format_string("%.1f KB", size / F.lit(float(KB))))
        .otherwise(F.format_string("%d B", size))
    )
