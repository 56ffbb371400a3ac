"""Micro-batch ingest: new message files become loads of the stored dataset, and chat links that
arrive after their messages are applied to what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from msgloom.errors import CommitConflict
from msgloom.plans.ingest import load_above
from msgloom.plans.upkeep import apply_links
from msgloom.schemas import CHAT_MESSAGE_JOIN, MESSAGE, RawTables
from msgloom.sources.commits import latest_commit, needed_files, read_files
from msgloom.sources.stored import check_schema

_ATTEMPTS = 5


def start_ingest(
    spark: SparkSession,
    message_path: str,
    statics: RawTables,
    contacts: DataFrame,
    dataset: str,
    checkpoint: str,
    normalize: bool = False,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process the message files that arrived since the last run, then stop.

    Each micro-batch is enriched like a batch load and committed as one. Handles, chats and
    contacts are the static tables of `statics`, whose `message` is not used. Nothing is kept in
    state: messages of a batch that are stored already, as when a batch is repeated after a failure
    or another checkpoint, are left out by their ids, which are looked up in the files whose
    ranges meet the batch, mostly none. A NULL id is an error that stores nothing of its batch.
    """
    commit = latest_commit(spark, dataset)
    if commit is not None:
        check_schema(dataset, commit)
    stream = (
        spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(message_path)
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        commit = latest_commit(session, dataset)
        # Chat links are read from the smallest id of the batch on; one row.
        ids = batch.agg(F.min("ROWID").alias("low"), F.max("ROWID").alias("high"), F.expr("count_if(ROWID IS NULL)").alias("nulls")).first()
        if ids["nulls"]:
            raise ValueError(f"NULL in ROWID of {ids['nulls']} messages of batch {batch_id}: nothing of it was stored")
        if ids["low"] is None:
            return
        known = needed_files(session, dataset, commit, ids=(ids["low"], ids["high"])) if commit else []
        if known:
            stored = read_files(session, known).select("message_id").where(F.col("message_id").between(ids["low"], ids["high"]))
            batch = batch.join(stored, F.col("ROWID") == F.col("message_id"), "left_anti")
            if batch.isEmpty():
                return
        load_above(session, statics._replace(message=batch), contacts, dataset, commit, ids["low"] - 1, "stream", normalize)

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_links(
    spark: SparkSession,
    link_path: str,
    statics: RawTables,
    contacts: DataFrame,
    dataset: str,
    checkpoint: str,
    normalize: bool = False,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process the files of chat links that arrived since the last run, then stop.

    The second stream beside `start_ingest`, whose `statics` should read the same folder of links:
    a link that is there before its message is found by the message's batch, a later one is applied
    here. No state is held for either, and a repeated batch changes nothing. Whichever of the two
    commits second on the same base conflicts; this one then tries again, the other is started again.
    """
    stream = (
        spark.readStream.schema(CHAT_MESSAGE_JOIN).option("maxFilesPerTrigger", files_per_batch).parquet(link_path)
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.where("chat_id IS NULL OR message_id IS NULL").isEmpty():
            raise ValueError(f"NULL in a chat link of batch {batch_id}: nothing of it was applied")
        for attempt in range(_ATTEMPTS):
            try:
                apply_links(batch.sparkSession, dataset, batch, statics, contacts, normalize)
                return
            except CommitConflict:
                if attempt == _ATTEMPTS - 1:
                    raise

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
