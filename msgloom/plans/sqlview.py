"""Free SQL over the `messages` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW = "messages"


def register(messages: DataFrame) -> None:
    """Make the table known to SQL as `messages`; call again after a sync."""
    messages.createOrReplaceTempView(VIEW)


def query(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """Run a statement in Spark's SQL; `args` bind named or positional parameters."""
    return spark.sql(sql, args=args)
