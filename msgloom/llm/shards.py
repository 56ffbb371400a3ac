"""Sharding by a two-pass external shuffle.

First every record is scattered into one of as many buckets as memory asks for, by a seeded
hash of its key and its texts. Then the records' numbers in each bucket are shuffled by
Fisher-Yates, which Spark's `shuffle` is, and the records are sorted by the places so drawn and
written. Buckets one after another are a uniform random order of all records; shards are
equal ranges of it, so their counts differ by one at most (the law `rows`), a bucket lies
within one shard or on one border, and every file is one bucket's part of a shard.

Only one exchange moves whole records. Where a bucket starts comes from the counts of all
buckets, and reaches the bucket as one more row. A task has one bucket. It holds the records' numbers
as one list; the records themselves are in sorts and windows, which spill, and never in a list.

The seed fixes the buckets. The order inside one is a fresh draw wherever a task runs
again; what is written is one draw, and readers read that. A bucket holds some
thirty-second part of an executor's memory for one of two tasks, whatever the
number of records; only a record of that size itself, or many alike, make a larger one, which spills.

Only records alike in key and texts share a bucket for sure; rows that repeat a key, or lack it,
spread. NULL keys are a key, NULL texts are empty. Columns named
like one of the results (shard, slot) are kept with `_in` behind their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgloom.llm.tables import Scratch

SEED = 20240607
#: Parts of an executor's memory that a bucket may fill.
MEMORY_SHARE = 64
LEAST_BUCKET = 4 << 20
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bucket_bytes(spark: SparkSession) -> int:
    """Bytes of records for a bucket, from the memory of an executor."""
    text = spark.sparkContext.getConf().get("spark.executor.memory", "1g").lower().rstrip("b")
    size = int(float(text[:-1]) * _UNITS[text[-1]]) if text[-1] in _UNITS else int(text)
    return max(LEAST_BUCKET, size // MEMORY_SHARE)


def renamed(docs: DataFrame) -> DataFrame:
    """The table with `_in` behind names that the results take."""
    taken, names = {"shard", "slot", *(c.lower() for c in docs.columns)}, []
    for name in docs.columns:
        if name.lower() in ("shard", "slot"):
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        names.append(name)
    return docs.toDF(*names)


def external_shuffle(
    docs: DataFrame,
    scratch: Scratch,
    shards: int = 8,
    key: tuple[str, ...] = ("doc_id",),
    seed: int = SEED,
    size: int | None = None,
) -> str:
    """Write all rows in random order below `shard=<k>/`, each with its `slot` in the shard,
    gapless from 0. Returns the path. `size` is that of a bucket."""
    spark, docs = docs.sparkSession, renamed(docs)
    # One row: rows, and bytes of the records' texts and a few more for the rest.
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in docs.dtypes if kind == "string"), F.lit(32))
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    buckets = max(1, -(-total // (size or bucket_bytes(spark))))
    # Texts too, so that rows which share a key, or lack it, do not share a bucket.
    texts = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind == "string"]
    spot = F.pmod(F.xxhash64(F.lit(seed), *key, *texts), F.lit(buckets)).cast("int").alias("bucket")

    counts = docs.select(spot).groupBy("bucket").agg(F.count("*").alias("n"))
    # One short row per bucket: their number is what the memory of executors makes it.
    starts = counts.selectExpr(
        "bucket", "CAST(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS start", "n"
    )
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    none = F.lit(None).cast("long")
    records = docs.select(spot, none.alias("start"), none.alias("n"), record.alias("record"))
    heads = starts.select("bucket", "start", "n", F.lit(None).cast(records.schema["record"].dataType).alias("record"))
    scattered = records.union(heads).repartitionById(buckets, "bucket")
    # The head comes first, then the records, numbered from 0 as they come.
    by = Window.partitionBy("bucket")
    numbered = scattered.withColumn("at", F.row_number().over(by.orderBy(F.col("start").asc_nulls_last())) - 2)
    # Fisher-Yates over the records' numbers; the head becomes a row for each place and the number drawn for it.
    draw = F.when(F.col("start").isNotNull(), F.shuffle(F.expr("sequence(0L, n - 1)"), F.lit(seed)))
    dealt = numbered.select("bucket", "start", "at", "record", F.posexplode_outer(draw).alias("turn", "drawn"))
    dealt = dealt.selectExpr("bucket", "coalesce(drawn, at) AS at", "start + turn AS place", "record")
    # A record stands behind the row that drew its number, and takes that place.
    met = dealt.withColumn("taken", F.lag("place").over(by.orderBy("at", F.col("place").asc_nulls_last())))
    place = met.where("place IS NULL").select(F.col("taken").alias("place"), "record.*")
    # Shard k holds the places from ceil(k rows / shards) on.
    sharded = place.withColumn("shard", F.expr(f"CAST(place * {shards} DIV {max(rows, 1)} AS INT)"))
    sharded = sharded.withColumn("slot", F.expr(f"place - (shard * {rows}L + {shards - 1}) DIV {shards}")).drop("place")
    path = scratch.path("shards")
    (
        sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite")
        .option("compression", "zstd").partitionBy("shard").parquet(path)
    )
    return path


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows written for a table of `schema` (after `renamed`), with shard and slot."""
    whole = T.StructType([*schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(whole).parquet(path)
