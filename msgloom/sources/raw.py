"""Reading the four raw tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgloom.errors import SourceNotFound
from msgloom.schemas import MESSAGE, RAW, RawTables
from msgloom.session import answers_from_footers, is_missing_path


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", since: int = 0, **options) -> RawTables:
    """Read `<path>/message`, `handle`, `chat_message_join` and `chat_handle_join`.

    Any file format Spark reads will do; the schemas are explicit, so nothing is
    inferred. Formats of plain text carry the binary column in base 64. CSV has a header and
    quoted fields as `write_csv` makes them. A malformed row, or a NULL id in any format,
    is an error. `since` keeps messages above that row id, see `rows_above`.
    """
    reader = spark.read.options(**{**_STRICT.get(fmt, {}), **options})
    try:
        tables = {
            name: reader.schema(_text_schema(schema) if fmt == "csv" else schema).format(fmt).load(f"{path}/{name}")
            for name, schema in RAW.items()
        }
    except AnalysisException as error:
        if is_missing_path(error):
            raise SourceNotFound(f"a raw table is missing below {path}: {error}") from error
        raise
    if fmt == "csv":
        message = tables["message"]
        tables["message"] = message.withColumn("attributedBody", F.unbase64("attributedBody"))
    tables = {name: _with_ids(table, RAW[name], fmt) for name, table in tables.items()}
    return rows_above(RawTables(**tables), since)


# Text formats fail on a malformed row rather than drop or cut it.
_STRICT = {
    "csv": {"mode": "FAILFAST", "header": "true", "multiLine": "true", "quote": '"', "escape": '"'},
    "json": {"mode": "FAILFAST"},
}


def _with_ids(table: DataFrame, schema: T.StructType, fmt: str) -> DataFrame:
    """The table, or an error where a column that must be set is NULL.

    Columnar files are asked beforehand, which their statistics answer, so that later
    filters still reach the scan. Rows of text are checked as they are read.
    """
    required = [f.name for f in schema.fields if not f.nullable]
    if fmt in _STRICT:
        checks = {
            name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"NULL in {name}"))).otherwise(F.col(name))
            for name in required
        }
        return table.withColumns(checks)
    if not table.where(" OR ".join(f"{name} IS NULL" for name in required)).isEmpty():
        raise ValueError(f"NULL in one of {', '.join(required)}")
    return table


def _text_schema(schema: T.StructType) -> T.StructType:
    """The schema with text in place of bytes."""
    binary = T.BinaryType()
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.dataType == binary else f.dataType, f.nullable) for f in schema.fields
    ])


def read_raw_jdbc(
    spark: SparkSession, url: str, lower: int, upper: int, partitions: int, since: int = 0, **options
) -> RawTables:
    """Read the same tables from a database, `message` and its chat links in parallel
    slices of the row id. NULL ids are an error as in files. `options` name the driver class, user and so on."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    sliced = reader.options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
    tables = {
        "message": sliced.options(dbtable="message", partitionColumn="ROWID").load(),
        "handle": reader.option("dbtable", "handle").load(),
        "chat_message_join": sliced.options(dbtable="chat_message_join", partitionColumn="message_id").load(),
        "chat_handle_join": reader.option("dbtable", "chat_handle_join").load(),
    }
    typed = {
        name: tables[name].select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        for name, schema in RAW.items()
    }
    checked = {name: _with_ids(table, RAW[name], "jdbc") for name, table in typed.items()}
    return rows_above(RawTables(**checked), since)


def rows_above(raw: RawTables, since: int) -> RawTables:
    """Keep messages above the watermark, and only their chat links.

    Both filters reach the scan, so an incremental load reads and shuffles the
    new rows and not the history.
    """
    return raw._replace(
        message=raw.message.where(F.col("ROWID") > since),
        chat_message_join=raw.chat_message_join.where(F.col("message_id") > since),
    )


def high_watermark(messages: DataFrame, since: int = 0, id_column: str = "message_id") -> DataFrame:
    """One row: the largest row id, or `since` if there are no rows."""
    return messages.agg(F.coalesce(F.max(id_column), F.lit(since)).cast("long").alias("watermark"))


def watermark_of_files(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The watermark of a folder of raw Parquet tables, from the footers of its message files: one
    row, and no data page is read."""
    with answers_from_footers(spark):
        found = high_watermark(spark.read.schema(MESSAGE).parquet(f"{path}/message"), since, "ROWID").first()
    return spark.createDataFrame([(found["watermark"],)], "watermark long")
