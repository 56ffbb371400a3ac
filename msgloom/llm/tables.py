"""Tables a job writes and reads back, in the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgloom.session import configure, scratch_dir

# Python workers get batches of so many rows and bytes.
_BATCH_ROWS = "500"
_BATCH_BYTES = str(8 << 20)


class Scratch:
    """Tables below one new folder. `drop` removes those no result reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = configure(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
        self.root = scratch_dir(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: lineage ends, and a lost executor costs no more
        than the tasks it held."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables of this folder, or all of it."""
        for path in [self.path(n) for n in names] or [self.root]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
