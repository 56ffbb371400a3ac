"""Upkeep of a stored dataset: late chat links, small files, older columns, and what is superseded.

Each step reads what a commit names and makes a new commit. Readers of the old one go on undisturbed,
since files are only removed by age.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.errors import SchemaMismatch
from msgloom.functions.times import utc_date
from msgloom.operators.blocks import BLOCK, ROWS_PER_FILE, blocks_for, id_blocks
from msgloom.operators.chats import first_chat
from msgloom.operators.messages import by_direction, with_chat_members
from msgloom.operators.sinks import write_load
from msgloom.plans.ingest import commit_load, placed_rows
from msgloom.schemas import DATA_FILES, MESSAGES, RawTables
from msgloom.session import placement_by_block, shuffles_for
from msgloom.sources.commits import (
    COMMITS, MANIFESTS, ROWS, append_commit, carried, current_commit, described_files, empty_messages, live_files, load_path,
    needed_files, read_files, run_row, write_manifest,
)
from msgloom.sources.paths import Folder
from msgloom.sources.search import SEARCH
from msgloom.sources.stored import check_schema, schema_gate
from msgloom.sources.summaries import SUMMARIES, change_of, merged_counts, write_summary

#: Columns that follow from others of the table, so that a dataset written before them can be migrated.
FOLLOWING = {
    "text_combined": "coalesce(text, inferred_text)",
    "body_text": "coalesce(text, inferred_text)",
    "date": utc_date("unix_seconds(timestamp)"),
    "month": f"CAST(month({utc_date('unix_seconds(timestamp)')}) AS BYTE)",
    "year": f"try_cast(year({utc_date('unix_seconds(timestamp)')}) AS SMALLINT)",
}
_PATH = f"substring_index(_metadata.file_path, '/{ROWS}/', -1)"


def merge_plan(files: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Which files to merge: path and bin. Files of less than half the rows wanted are binned
    with their neighbours in order of ids, never across a file that is large enough, so
    that ranges stay narrow. Works on the manifest, one row per file."""
    by_id = Window.orderBy("min_id", "path")
    large = F.col("rows") * 2 >= rows_per_file
    marked = files.select("path", "rows", "min_id", large.alias("large"), F.sum(large.cast("int")).over(by_id).alias("run"))
    before = F.sum("rows").over(Window.partitionBy("run").orderBy("min_id", "path")) - F.col("rows")
    binned = marked.where("NOT large").withColumn("part", F.floor(before / rows_per_file))
    shared = binned.withColumn("files", F.count(F.lit(1)).over(Window.partitionBy("run", "part"))).where("files > 1")
    return shared.select("path", "rows", (F.dense_rank().over(Window.orderBy("run", "part")) - 1).alias(BLOCK))


def compact(spark: SparkSession, dataset: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Merge small files and collapse the manifests into one. Returns the newest run, one row;
    without small files to merge nothing is written."""
    commit = current_commit(spark, dataset)
    check_schema(dataset, commit)
    # One row per small file.
    plan = merge_plan(live_files(spark, dataset, commit), rows_per_file).collect()
    if not plan:
        return run_row(spark, commit)
    return _rewrite(spark, dataset, commit, plan, "compact")


def _bins(spark: SparkSession, plan: list[Row]) -> DataFrame:
    """Path and bin of the files of a plan: one row per file, for broadcast."""
    return F.broadcast(spark.createDataFrame([(r["path"], r[BLOCK]) for r in plan], f"path string, {BLOCK} int"))


def _rewrite(
    spark: SparkSession, dataset: str, commit: dict, plan: list[Row], mode: str,
    change: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Replace the files of a plan (path, rows, bin) by one file per bin, with their rows changed but
    none added or lost. The other files stay as they are; one manifest names them all, and one summary
    counts all rows.

    Rows are shuffled once, each bin into one partition, where `change` may join what is placed alike."""
    run_id, bins, merged = uuid.uuid4().hex, 1 + max(r[BLOCK] for r in plan), sum(r["rows"] for r in plan)
    path, chosen = load_path(dataset, commit["generation"], run_id), _bins(spark, plan)
    rows = read_files(spark, [f"{dataset}/{ROWS}/{r['path']}" for r in plan])
    with placement_by_block(spark), shuffles_for(spark, merged):
        placed = rows.withColumn("path", F.expr(_PATH)).join(chosen, "path").drop("path").repartitionById(bins, F.col(BLOCK))
        placed = placed if change is None else change(placed)
        write_load(placed.sortWithinPartitions(BLOCK, "message_id").select(*MESSAGES.fieldNames()), path)
    kept = live_files(spark, dataset, commit).join(chosen, "path", "left_anti")
    files = write_manifest(kept.unionByName(described_files(spark, path)), dataset, run_id)
    written = files.where(F.col("path").contains(f"load={run_id}/")).agg(F.sum("rows").alias("n")).first()["n"]
    if written != merged:
        raise RuntimeError(f"new files hold {written} rows instead of {merged}: nothing was committed")
    if change is None:
        write_summary(merged_counts(spark, dataset, commit), dataset, run_id)
        summaries, search = [run_id], commit.get("search")
        # The same contacts in one part: what the index covers in full it still does.
        if search and set(commit["summaries"]) <= set(search["covers"]):
            commit = {**commit, "search": {**search, "covers": [run_id]}}
    else:
        write_summary(change_of(rows, read_files(spark, [path])), dataset, run_id)
        summaries = [*commit["summaries"], run_id]
    return run_row(spark, append_commit(spark, dataset, commit, **{
        **carried(commit), "run_id": run_id, "mode": mode, "rows_written": 0, "manifests": [run_id], "summaries": summaries,
    }))


def apply_links(
    spark: SparkSession, dataset: str, links: DataFrame, statics: RawTables, contacts: DataFrame, normalize: bool = False
) -> DataFrame:
    """Give stored messages the chats of links that arrived after them, as a full build would: a
    message is in its smallest chat. Returns the newest run, one row.

    Only files that hold a changed message are rewritten, found by the ids of the links; of `statics`
    the chats' members and the handles are used. Links of messages that are not stored yet change
    nothing. There is a commit in any case, so that a load that has read the links before these
    arrived conflicts and is run again.
    """
    commit = current_commit(spark, dataset)
    check_schema(dataset, commit)
    new = first_chat(links).selectExpr("message_id", "chat_id AS new_chat")
    ids = links.agg(F.min("message_id").alias("low"), F.max("message_id").alias("high")).first()
    paths = needed_files(spark, dataset, commit, ids=(ids["low"], ids["high"])) if ids["low"] is not None else []
    changed, plan = None, []
    if paths:
        # Only messages in the range of the links: what else the files hold is not shuffled.
        stored = read_files(spark, paths).where(F.col("message_id").between(ids["low"], ids["high"]))
        changed = stored.select("message_id", "chat_id", F.expr(_PATH).alias("path")).join(new, "message_id")
        changed = changed.where("chat_id IS NULL OR new_chat < chat_id")
        by_path = Window.orderBy("path")  # one row per file
        plan = live_files(spark, dataset, commit).join(changed.select("path").distinct(), "path").select(
            "path", "rows", (F.row_number().over(by_path) - 1).alias(BLOCK)
        ).collect()
    if not plan:
        return run_row(spark, append_commit(spark, dataset, commit, **{
            **carried(commit), "run_id": uuid.uuid4().hex, "mode": "links", "rows_written": 0,
        }))
    # Each file is one bin, and so are its changed messages.
    pairs = changed.groupBy("message_id", "path").agg(F.min("new_chat").alias("chat_id")).join(_bins(spark, plan), "path").drop("path")
    placed = with_chat_members(pairs, statics, contacts, normalize, few=True)
    placed = placed.withColumnsRenamed({c: f"_new_{c}" for c in placed.columns if c not in ("message_id", BLOCK)})
    placed = placed.repartitionById(1 + max(r[BLOCK] for r in plan), F.col(BLOCK))
    return _rewrite(spark, dataset, commit, plan, "links", lambda rows: _with_chat(rows, placed))


def _with_chat(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with the columns that follow from a message's chat replaced where there is a new one. Both
    sides are placed by block."""
    columns = {
        "chat_id": "_new_chat_id",
        "chat_size": "coalesce(_new_chat_size, 0L)",
        "chat_members_handles": "_new_chat_members_handles",
        "chat_members_contact_info": "_new_chat_members_contact_info",
        "updated_contact_info": by_direction("_new_only_member", "contact_info", "_new_chat_size"),
    }
    new = {c: F.expr(f"if(_new_chat_id IS NULL, {c}, {value})") for c, value in columns.items()}
    joined = rows.join(placed, [BLOCK, "message_id"], "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def migrate(spark: SparkSession, dataset: str) -> DataFrame:
    """Rewrite a dataset of older columns as a new generation of the present ones. Missing columns
    that follow from stored ones are derived, columns no longer in the table are left out; any other
    difference is a SchemaMismatch. Returns the newest run, one row."""
    commit = current_commit(spark, dataset)
    gate = schema_gate(spark, dataset).collect()
    if gate and all(load["accepted"] for load in gate):
        return run_row(spark, commit)
    for load in gate:
        lost = set(filter(None, load["missing_columns"].split(","))) - FOLLOWING.keys()
        if lost or load["other_types"]:
            raise SchemaMismatch(f"columns {sorted(lost)} {load['other_types']} cannot be derived: sync with force=True")
    paths: dict[str, list[str]] = {}
    for r in live_files(spark, dataset, commit).selectExpr("path", "regexp_extract(path, 'load=([^/]*)', 1) AS load").collect():
        paths.setdefault(r["load"], []).append(f"{dataset}/{ROWS}/{r['path']}")
    rows, total = empty_messages(spark), sum(load["rows"] for load in gate)
    for missing in {load["missing_columns"] for load in gate}:
        own = [p for load in gate if load["missing_columns"] == missing for p in paths[load["load"]]]
        derived = {c: F.expr(FOLLOWING[c]) for c in filter(None, missing.split(","))}
        rows = rows.unionByName(read_files(spark, own).withColumns(derived))
    run_id, generation = uuid.uuid4().hex, commit["generation"] + 1
    if total:
        blocks = id_blocks(rows.select("message_id"), total, blocks_for(total, spark.sparkContext.defaultParallelism))
        with shuffles_for(spark, total):
            write_load(placed_rows(rows, blocks), load_path(dataset, generation, run_id))
    return commit_load(
        spark, dataset, commit, generation, run_id, "migrated", 0, bool(total), contacts_resolved=commit["contacts_resolved"]
    )


def remove_superseded(spark: SparkSession, dataset: str, older_than: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """Remove files that no commit of the last `older_than` names, such as those of superseded
    generations, merged files, and loads that failed. One row: files and bytes removed.

    Kept are the newest commit, and every one that was the newest at some moment since then, so
    a reader has that long. Younger files stay, as a writer may be about to commit them.
    """
    newest = current_commit(spark, dataset)
    cutoff = dt.datetime.now(dt.timezone.utc) - older_than
    log = spark.read.schema(
        "version long, finished_at timestamp, manifests array<string>, summaries array<string>, search struct<run: string>"
    ).json(f"{dataset}/{COMMITS}/*.json")
    # The log is narrow; a commit's time as the newest ends with the next one.
    ended = log.withColumn("ended", F.lead("finished_at").over(Window.orderBy("version")))
    held = ended.where(F.col("ended").isNull() | (F.col("ended") >= F.lit(cutoff)))
    manifests = {r["m"] for r in held.select(F.explode("manifests").alias("m")).distinct().collect()} | set(newest["manifests"])
    named = spark.createDataFrame([], DATA_FILES)
    if manifests:
        named = spark.read.schema(DATA_FILES).parquet(*[f"{dataset}/{MANIFESTS}/{m}" for m in sorted(manifests)])
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{dataset}/{ROWS}").select(
        F.substring_index("path", f"/{ROWS}/", -1).alias("path"), "length", "modificationTime"
    ) if Folder(spark, f"{dataset}/{ROWS}").names() else spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    old = listed.where(F.col("modificationTime") < F.lit(cutoff)).join(named.select("path").distinct(), "path", "left_anti")
    rows, files, size = Folder(spark, f"{dataset}/{ROWS}"), 0, 0
    for r in old.select("path", "length").toLocalIterator():
        rows.delete(r["path"])
        files, size = files + 1, size + r["length"]
    summaries = {r["m"] for r in held.select(F.explode("summaries").alias("m")).distinct().collect()} | set(newest["summaries"])
    indexes = {r["run"] for r in held.select("search.run").distinct().collect()}
    for place, used in ((MANIFESTS, manifests), (SUMMARIES, summaries), (SEARCH, indexes)):
        notes = Folder(spark, f"{dataset}/{place}")
        for name in notes.names(before=cutoff):
            if name not in used:
                notes.delete(name)
    return spark.createDataFrame([(files, size)], "files long, bytes long")
