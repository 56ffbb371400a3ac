"""Daily counts of the stored table: what the analyses need, without the texts.

    summary/<run>/    one part per load, named by the commits like the manifests

A row counts the messages that agree in contact, day, direction, kind of chat and labels. Counts
of parts add up, so a load adds its own part and nothing is counted again; rows that a late link
changes are counted off and on again. Days that are active are those with a count above zero.

`read_daily` gives rows with the columns of the `messages` table that the analyses group and filter
by, and their number in `n_messages`: `top_contacts`, `time_series`, `reactions`, `effects`, `links`,
`seasonality`, `search_contacts`, `contact_stats` and `group_message_count` take it like the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.schemas import DAILY
from msgloom.sources.commits import current_commit
from msgloom.sources.stored import check_schema

SUMMARIES = "summary"
#: Column that counts the messages a row stands for.
COUNT = "n_messages"
_KEYS = [f.name for f in DAILY.fields if f.name not in (COUNT, "last_id")]


def summarised(messages: DataFrame) -> DataFrame:
    """One row per contact, day, direction, kind of chat and labels. Combined before the shuffle,
    so that a hot contact arrives as a row per day."""
    # Chats count as none, direct or group.
    rows = messages.withColumn("chat_size", F.least("chat_size", F.lit(2).cast("long")))
    return rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias(COUNT), F.max("message_id").alias("last_id"))


def write_summary(rows: DataFrame, dataset: str, run_id: str) -> None:
    rows.select(*DAILY.fieldNames()).write.parquet(f"{dataset}/{SUMMARIES}/{run_id}")


def _parts(spark: SparkSession, dataset: str, commit: dict) -> DataFrame:
    paths = [f"{dataset}/{SUMMARIES}/{run}" for run in commit["summaries"]]
    return spark.read.schema(DAILY).parquet(*paths) if paths else spark.createDataFrame([], DAILY)


def merged_counts(spark: SparkSession, dataset: str, commit: dict) -> DataFrame:
    """The parts of a commit added up, without rows that cancel out."""
    sums = _parts(spark, dataset, commit).groupBy(*_KEYS).agg(F.sum(COUNT).alias(COUNT), F.max("last_id").alias("last_id"))
    return sums.where(F.col(COUNT) != 0)


def change_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """The part that takes one set of rows off and puts another on."""
    off = summarised(before).withColumn(COUNT, -F.col(COUNT))
    return off.unionByName(summarised(after))


def read_daily(spark: SparkSession, dataset: str) -> DataFrame:
    """The daily counts of the current table, for the analyses. `timestamp` is the start of the day."""
    commit = current_commit(spark, dataset)
    check_schema(dataset, commit)
    return _parts(spark, dataset, commit).select("*", *_calendar())


def _calendar() -> list[Column]:
    return [
        F.month("date").cast("byte").alias("month"),
        F.expr("try_cast(year(date) AS SMALLINT) AS year"),
        F.col("date").cast("timestamp").alias("timestamp"),
    ]


def contact_names(spark: SparkSession, dataset: str) -> DataFrame:
    """Contact keys of received messages and the name on the newest one, as a contact table."""
    rows = _parts(spark, dataset, current_commit(spark, dataset))
    received = rows.where(f"is_from_me <> 1 AND contact_info IS NOT NULL AND name IS NOT NULL AND {COUNT} > 0")
    return received.groupBy(F.col("contact_info").alias("contact_key")).agg(F.max_by("name", "last_id").alias("name"))
