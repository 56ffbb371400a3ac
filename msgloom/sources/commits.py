"""The commit log of a stored dataset and the manifests of its files.

    messages/generation=<n>/load=<run>/    rows, one folder per load
    manifest/<run>/                        one row per data file: its ids, days and size
    commits/<version>.json                 one file per commit, numbered without gaps

A commit names the manifests of the files that make up the table, and carries the totals on:
nothing is listed or counted again. It is created only if no other writer has taken its number,
so that of two writers one fails and its files are never seen. Readers follow the newest commit.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgloom.errors import CommitConflict, DatasetNotFound
from msgloom.schemas import DATA_FILES, INGEST_RUNS, MESSAGES, SCHEMA_VERSION
from msgloom.sources.paths import Folder

COMMITS, MANIFESTS, ROWS = "commits", "manifest", "messages"


def load_path(dataset: str, generation: int, run_id: str) -> str:
    return f"{dataset}/{ROWS}/generation={generation:05d}/load={run_id}"


def log_folder(spark: SparkSession, dataset: str) -> Folder:
    return Folder(spark, f"{dataset}/{COMMITS}")


def _name(version: int) -> str:
    return f"{version:020d}.json"


def latest_commit(spark: SparkSession, dataset: str) -> dict | None:
    """The commit readers follow, or None for a new dataset. One listing of the log and one
    small file; no job."""
    folder = log_folder(spark, dataset)
    names = [n for n in folder.names() if n.endswith(".json")]
    return json.loads(folder.read(names[-1])) if names else None


def current_commit(spark: SparkSession, dataset: str) -> dict:
    found = latest_commit(spark, dataset)
    if found is None:
        raise DatasetNotFound(f"no dataset at {dataset}: sync it first")
    return found


def append_commit(spark: SparkSession, dataset: str, base: dict | None, **fields) -> dict:
    """Log a commit on top of `base`. Fails if another writer has committed since."""
    version = 1 if base is None else base["version"] + 1
    now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")
    record = {"version": version, "schema_version": SCHEMA_VERSION, "finished_at": now, **fields}
    if not log_folder(spark, dataset).create(_name(version), json.dumps(record)):
        raise CommitConflict(f"another writer has made commit {version} of {dataset}: run again")
    return record


def carried(commit: dict) -> dict:
    """What a commit that adds nothing takes over from the one before."""
    return {k: v for k, v in commit.items() if k not in ("version", "finished_at")}


def run_row(spark: SparkSession, commit: dict) -> DataFrame:
    """A commit as one row of the run log."""
    values = {**commit, "finished_at": dt.datetime.fromisoformat(commit["finished_at"])}
    return spark.createDataFrame([tuple(values[f] for f in INGEST_RUNS.fieldNames())], INGEST_RUNS)


def read_runs(spark: SparkSession, dataset: str) -> DataFrame:
    """The run log, one row per commit."""
    current_commit(spark, dataset)
    return spark.read.schema(INGEST_RUNS).json(f"{dataset}/{COMMITS}/*.json")


def column_list() -> str:
    """The columns of the `messages` table, as a commit names them."""
    return MESSAGES.simpleString()


# --- manifests ---------------------------------------------------------------


def write_manifest(files: DataFrame, dataset: str, run_id: str) -> DataFrame:
    path = f"{dataset}/{MANIFESTS}/{run_id}"
    files.select(*DATA_FILES.fieldNames()).write.parquet(path)
    return files.sparkSession.read.schema(DATA_FILES).parquet(path)


def described_files(spark: SparkSession, load: str) -> DataFrame:
    """One row per file of a load just written: rows, bytes, and its ranges of ids and days. Reads
    three columns; combines per file before the shuffle."""
    rows = spark.read.schema(MESSAGES).parquet(load).select("message_id", "date", "timestamp", "_metadata.file_path", "_metadata.file_size")
    return rows.groupBy(F.substring_index("file_path", f"/{ROWS}/", -1).alias("path"), F.col("file_size").alias("bytes")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.expr(f"{f}({column}) AS {f}_{name}") for column, name in (("message_id", "id"), ("date", "date")) for f in ("min", "max")],
        F.max("timestamp").alias("max_timestamp"),
    )


def live_files(spark: SparkSession, dataset: str, commit: dict) -> DataFrame:
    """The manifest rows of the files that make up the table."""
    paths = [f"{dataset}/{MANIFESTS}/{run}" for run in commit["manifests"]]
    if not paths:
        return spark.createDataFrame([], DATA_FILES)
    return spark.read.schema(DATA_FILES).parquet(*paths)


def within(low: str, high: str, first, last) -> Column | None:
    """Files whose range meets first .. last; open where that is None."""
    tests = ([] if first is None else [F.col(high) >= F.lit(first)]) + ([] if last is None else [F.col(low) <= F.lit(last)])
    return functools.reduce(operator.and_, tests) if tests else None


def needed_files(
    spark: SparkSession, dataset: str, commit: dict, days: tuple = (None, None), ids: tuple = (None, None)
) -> list[str]:
    """Paths of the files that can hold rows of the days and ids: the names a scan is given, as
    many as it opens."""
    files = live_files(spark, dataset, commit)
    for test in (within("min_date", "max_date", *days), within("min_id", "max_id", *ids)):
        files = files if test is None else files.where(test)
    return [f"{dataset}/{ROWS}/{r['path']}" for r in files.select("path").collect()]


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in MESSAGES.fields]))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of some data files, with the fixed schema."""
    if not paths:
        return empty_messages(spark)
    return spark.read.schema(MESSAGES).parquet(*paths)
