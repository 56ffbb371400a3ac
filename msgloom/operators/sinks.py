"""Writing tables and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOOKED_UP = ("name", "updated_contact_info")


def write_load(messages: DataFrame, path: str) -> None:
    """Write one load of messages to a folder of its own, in the order in which rows come, with
    Bloom filters on the columns by which contacts are looked up.

    A load that fails leaves a folder that no commit names; a repeated one makes another.
    """
    filters = {f"parquet.bloom.filter.enabled#{column}": "true" for column in LOOKED_UP}
    adaptive = {"parquet.bloom.filter.adaptive.enabled": "true"}  # as large as a row group's values need
    messages.write.mode("errorifexists").options(compression="snappy", **filters, **adaptive).parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """Every value as text: NULL empty, timestamps in ISO form with a Z."""

    def text(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.coalesce(column.cast("string"), F.lit("")).alias(field.name)

    return df.select(*[text(field) for field in df.schema.fields])


def json_rows(df: DataFrame, limit: int | None = None, stringify: bool = False) -> DataFrame:
    """One JSON object per row, in a column `json`. Values keep their types unless
    `stringify`; NULL fields are written as null."""
    capped = df if limit is None else df.limit(limit)
    rows = as_text(capped) if stringify else capped
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, limit: int | None = None, stringify: bool = False) -> None:
    """JSON lines."""
    json_rows(df, limit, stringify).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV with header; quotes where needed, doubled inside. Values are kept whole, with blanks
    and line breaks at their borders. NULL is an empty field and '' a quoted one."""
    rows = df if limit is None else df.limit(limit)
    rows.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
