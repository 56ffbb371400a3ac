"""Keeping a stored `messages` dataset up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.operators.blocks import IdBlocks, blocks_for, id_blocks
from msgloom.operators.messages import build_messages
from msgloom.operators.sinks import write_load
from msgloom.schemas import RawTables
from msgloom.session import placement_by_block, shuffles_for
from msgloom.sources.commits import (
    append_commit, column_list, described_files, latest_commit, load_path, read_files, run_row, write_manifest,
)
from msgloom.sources.raw import read_raw
from msgloom.sources.stored import check_schema
from msgloom.sources.summaries import summarised, write_summary


def full_build(
    spark: SparkSession, raw: RawTables, contacts: DataFrame, dataset: str, normalize: bool = False
) -> DataFrame:
    """Build a new generation from everything. The current one stays until the commit."""
    return load_above(spark, raw, contacts, dataset, latest_commit(spark, dataset), 0, "full", normalize)


def refresh(
    spark: SparkSession, raw: RawTables, contacts: DataFrame, dataset: str, normalize: bool = False
) -> DataFrame:
    """Add the messages above the stored watermark; everything if nothing is stored.

    Messages stored earlier keep their chat and names until a full build.
    """
    commit = latest_commit(spark, dataset)
    if commit is None:
        return full_build(spark, raw, contacts, dataset, normalize)
    check_schema(dataset, commit)
    return load_above(spark, raw, contacts, dataset, commit, commit["last_message_id"], "incremental", normalize)


def sync(
    spark: SparkSession,
    raw: RawTables,
    contacts: DataFrame,
    dataset: str,
    force: bool = False,
    normalize: bool = False,
) -> DataFrame:
    """First run or `force`: full build, else a refresh. Returns the logged run, one row."""
    step = full_build if force else refresh
    return step(spark, raw, contacts, dataset, normalize)


def sync_files(
    spark: SparkSession,
    source: str,
    contacts: DataFrame,
    dataset: str,
    fmt: str = "parquet",
    force: bool = False,
    normalize: bool = False,
) -> DataFrame:
    """Sync from a folder of raw tables."""
    return sync(spark, read_raw(spark, source, fmt), contacts, dataset, force, normalize)


def load_above(
    spark: SparkSession,
    raw: RawTables,
    contacts: DataFrame,
    dataset: str,
    base: dict | None,
    since: int,
    mode: str,
    normalize: bool = False,
) -> DataFrame:
    """Enrich and write the messages above `since` as one load, and commit it on top of `base`.

    Rows are placed by ranges of ids, one per file, as ids follow time: a filter on days or ids
    then needs few files. A small load makes one file and is joined as Spark likes.
    """
    new = raw.message.where(f"ROWID > {since} OR ROWID IS NULL").select("ROWID")
    size = new.agg(
        F.count(F.lit(1)).alias("rows"), F.expr("count_if(ROWID IS NULL)").alias("nulls"), F.max("ROWID").alias("last")
    ).first()
    if size["nulls"]:
        raise ValueError(f"NULL in ROWID of {size['nulls']} messages: nothing was stored")
    blocks = id_blocks(new, size["rows"], blocks_for(size["rows"], _parallelism(spark)))
    run_id = uuid.uuid4().hex
    generation = 1 if base is None else base["generation"] + (mode == "full")
    if size["rows"]:
        # Links of messages that come later would all fall into the last block.
        raw = raw._replace(chat_message_join=raw.chat_message_join.where(F.col("message_id") <= size["last"]))
        with placement_by_block(spark), shuffles_for(spark, size["rows"]):
            if len(blocks) > 1:
                rows = build_messages(raw, contacts, since, normalize=normalize, blocks=blocks)
            else:
                rows = build_messages(raw, contacts, since, normalize=normalize).repartition(1).sortWithinPartitions("message_id")
            write_load(rows, load_path(dataset, generation, run_id))
    known = contacts.agg(F.count_distinct("contact_key").alias("known")).first()["known"]
    return commit_load(spark, dataset, base, generation, run_id, mode, since, size["rows"] > 0, contacts_resolved=known)


def commit_load(
    spark: SparkSession, dataset: str, base: dict | None, generation: int, run_id: str, mode: str, since: int,
    written: bool, **fields,
) -> DataFrame:
    """Describe the files of a load and log it. Totals are the previous ones and those of the load."""
    before = base if base is not None and mode not in _REPLACING else None
    rows, last, own = 0, since, []
    if written:
        path = load_path(dataset, generation, run_id)
        files = write_manifest(described_files(spark, path), dataset, run_id)
        write_summary(summarised(read_files(spark, [path])), dataset, run_id)
        told = files.agg(F.sum("rows").alias("rows"), F.max("max_id").alias("last")).first()
        rows, last, own = told["rows"], told["last"], [run_id]
    commit = append_commit(
        spark, dataset, base,
        run_id=run_id,
        generation=generation,
        mode=mode,
        since=since,
        last_message_id=max(last, before["last_message_id"] if before else 0),
        rows_written=rows,
        total_messages=rows + (before["total_messages"] if before else 0),
        columns=sorted({column_list(), *(before["columns"] if before else [])}),
        manifests=(before["manifests"] if before else []) + own,
        summaries=(before["summaries"] if before else []) + own,
        search=before.get("search") if before else None,
        **fields,
    )
    return run_row(spark, commit)


#: Loads that replace all that was there.
_REPLACING = ("full", "migrated")


def _parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def placed_rows(rows: DataFrame, blocks: IdBlocks) -> DataFrame:
    """Rows of the table in blocks of ids, in order."""
    return blocks.place(rows).sortWithinPartitions("message_id").select(*rows.columns)
