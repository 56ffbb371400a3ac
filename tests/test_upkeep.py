"""Merging, migration and removal of stored files."""

import datetime as dt

import pytest
from conftest import contact_table
from pyspark.sql import functions as F
from test_ingest import content, dataset, expected, upto, write_load  # noqa: F401
from test_plans import many_messages

from msgloom.errors import CommitConflict, DatasetNotFound, SchemaMismatch
from msgloom.operators.messages import build_messages
from msgloom.plans import ingest, upkeep
from msgloom.schemas import DATA_FILES
from msgloom.session import path_bytes
from msgloom.sources import commits, stored
from msgloom.streaming.ingest import start_ingest, start_links

NOW = dt.timedelta(seconds=-60)  # file times may have whole seconds


def test_merge_plan(spark):
    rows = [("a", 3), ("b", 4), ("c", 5), ("big", 50), ("d", 2), ("big2", 10), ("e", 9), ("f", 9), ("g", 9), ("h", 9)]
    files = spark.createDataFrame(
        [(p, 1, n, 10 * i, 10 * i + 5, None, None, None) for i, (p, n) in enumerate(rows)], DATA_FILES
    )
    plan = {r["path"]: r["_block"] for r in upkeep.merge_plan(files, 20).collect()}
    # d stands alone between large files; e to g fill a file, which leaves h alone.
    assert plan == {"a": 0, "b": 0, "c": 0, "e": 1, "f": 1, "g": 1}
    assert upkeep.merge_plan(files.limit(0), 20).count() == 0


def test_small_loads_become_one_file(spark, small_raw, small_contacts, dataset, expected):  # noqa: F811
    for last in (2, 3, 5, 8, 10):
        ingest.sync(spark, upto(small_raw, last), small_contacts, dataset)
    before = stored.read_messages(spark, dataset)  # a reader that has begun
    assert stored.data_files(spark, dataset).count() == 5
    run = upkeep.compact(spark, dataset).first()
    assert (run["mode"], run["total_messages"], run["last_message_id"], run["rows_written"]) == ("compact", 10, 10, 0)
    files = stored.data_files(spark, dataset).collect()
    assert [(f["rows"], f["min_id"], f["max_id"]) for f in files] == [(10, 1, 10)]
    assert content(stored.read_messages(spark, dataset)) == content(before) == expected
    # Nothing is left to merge, and loads go on.
    assert upkeep.compact(spark, dataset).first()["run_id"] == run["run_id"]
    assert ingest.sync(spark, small_raw, small_contacts, dataset).first()["total_messages"] == 10


def test_merging_leaves_large_files_and_narrow_ranges(spark, small_raw, small_contacts, dataset):  # noqa: F811
    raw = many_messages(spark, small_raw, 300)
    for last in (10, 20, 220, 230, 240, 250):
        ingest.sync(spark, upto(raw._replace(message=raw.message.where("ROWID < 100000")), last), small_contacts, dataset)
    want = content(stored.read_messages(spark, dataset))
    upkeep.compact(spark, dataset, rows_per_file=100)
    files = stored.data_files(spark, dataset).orderBy("min_id").collect()
    assert all(a["max_id"] < b["min_id"] for a, b in zip(files, files[1:]))
    assert sum(f["rows"] for f in files) == len(want) and len(files) == 2
    assert content(stored.read_messages(spark, dataset)) == want
    assert commits.latest_commit(spark, dataset)["manifests"] == [commits.latest_commit(spark, dataset)["run_id"]]


def test_what_is_superseded_is_removed_by_age(spark, small_raw, small_contacts, dataset, expected):  # noqa: F811
    for last in (4, 10):
        ingest.sync(spark, upto(small_raw, last), small_contacts, dataset)
    upkeep.compact(spark, dataset)
    ingest.sync(spark, small_raw, small_contacts, dataset, force=True)
    from msgloom.operators import sinks

    sinks.write_load(build_messages(small_raw, small_contacts), commits.load_path(dataset, 2, "failed"))
    assert upkeep.remove_superseded(spark, dataset).first()["files"] == 0  # all too young
    before = stored.status(spark, dataset).first()
    gone = upkeep.remove_superseded(spark, dataset, NOW).first()
    assert gone["files"] == 4 and gone["bytes"] == before["superseded_bytes"] > 0
    assert content(stored.read_messages(spark, dataset)) == expected
    assert stored.status(spark, dataset).first()["superseded_bytes"] == 0
    assert path_bytes(spark, f"{dataset}/messages").first()["size_bytes"] == before["size_bytes"]
    assert stored.read_runs(spark, dataset).count() == 4  # the log stays
    assert upkeep.remove_superseded(spark, dataset, NOW).first()["files"] == 0


def test_an_older_dataset_is_migrated(spark, small_raw, small_contacts, dataset, expected):  # noqa: F811
    built = build_messages(small_raw, small_contacts)
    older = built.drop("body_text", "month", "year").withColumn("mood", F.lit(1))
    base = write_load(spark, older.where("message_id <= 4"), dataset, None, schema_version=1, columns=[older.schema.simpleString()])
    rest = built.where("message_id > 4").drop("date")
    told = sorted([older.schema.simpleString(), rest.schema.simpleString()])
    write_load(spark, rest, dataset, base, schema_version=1, columns=told, manifests=["load-0", "load-1"], total_messages=10)
    with pytest.raises(SchemaMismatch):
        stored.read_messages(spark, dataset)
    run = upkeep.migrate(spark, dataset).first()
    assert (run["mode"], run["schema_version"], run["total_messages"], run["last_message_id"]) == ("migrated", 2, 10, 10)
    assert content(stored.read_messages(spark, dataset)) == expected
    assert all(r["accepted"] for r in stored.schema_gate(spark, dataset).collect())
    assert upkeep.migrate(spark, dataset).first()["run_id"] == run["run_id"]
    assert ingest.sync(spark, small_raw, small_contacts, dataset).first()["rows_written"] == 0


def test_columns_that_do_not_follow_are_not_made_up(spark, small_raw, small_contacts, dataset):  # noqa: F811
    built = build_messages(small_raw, small_contacts).drop("reaction")
    write_load(spark, built, dataset, None, schema_version=1, columns=[built.schema.simpleString()])
    with pytest.raises(SchemaMismatch, match="reaction"):
        upkeep.migrate(spark, dataset)


def test_upkeep_needs_a_dataset(spark, dataset):  # noqa: F811
    for step in (upkeep.compact, upkeep.migrate, upkeep.remove_superseded, stored.schema_gate, stored.data_files):
        with pytest.raises(DatasetNotFound):
            step(spark, dataset)


def test_an_empty_dataset(spark, small_raw, small_contacts, dataset):  # noqa: F811
    empty = small_raw._replace(message=small_raw.message.limit(0))
    ingest.sync(spark, empty, contact_table(spark, []), dataset)
    assert upkeep.compact(spark, dataset).first()["mode"] == "full"
    assert upkeep.remove_superseded(spark, dataset, NOW).first()["files"] == 0
    assert stored.schema_gate(spark, dataset).count() == stored.data_files(spark, dataset).count() == 0
    assert stored.status(spark, dataset).first()["size_bytes"] == 0


def without_links(raw, condition):
    return raw._replace(chat_message_join=raw.chat_message_join.where(condition))


def test_late_links_are_applied(spark, small_raw, small_contacts, dataset, expected):  # noqa: F811
    for last in (5, 10):  # two files, of which the second is touched first
        ingest.sync(spark, upto(without_links(small_raw, "message_id < 3"), last), small_contacts, dataset)
    first = {f["path"] for f in stored.data_files(spark, dataset).where("max_id <= 5").collect()}
    late = small_raw.chat_message_join.where("message_id > 5")
    run = upkeep.apply_links(spark, dataset, late, small_raw, small_contacts).first()
    assert (run["mode"], run["total_messages"], run["rows_written"]) == ("links", 10, 0)
    assert first < {f["path"] for f in stored.data_files(spark, dataset).collect()}
    # Repeated links, larger chats, and messages that are not stored change nothing.
    more = spark.createDataFrame([(9, 7), (1, 6), (1, 99)], "chat_id long, message_id long")
    paths = {f["path"] for f in stored.data_files(spark, dataset).collect()}
    for links in (late, more, more.limit(0)):
        upkeep.apply_links(spark, dataset, links, small_raw, small_contacts)
    assert {f["path"] for f in stored.data_files(spark, dataset).collect()} == paths
    upkeep.apply_links(spark, dataset, small_raw.chat_message_join, small_raw, small_contacts)
    assert content(stored.read_messages(spark, dataset)) == expected


def test_a_smaller_chat_takes_a_message(spark, small_raw, small_contacts, dataset):  # noqa: F811
    ingest.sync(spark, small_raw, small_contacts, dataset)
    links = spark.createDataFrame([(1, 9), (3, 1)], "chat_id long, message_id long")
    upkeep.apply_links(spark, dataset, links, small_raw, small_contacts)
    every = small_raw._replace(chat_message_join=small_raw.chat_message_join.union(links))
    assert content(stored.read_messages(spark, dataset)) == content(build_messages(every, small_contacts))


def test_a_load_that_missed_a_link_conflicts(spark, small_raw, small_contacts, dataset, expected):  # noqa: F811
    ingest.sync(spark, upto(small_raw, 5), small_contacts, dataset)
    base = commits.latest_commit(spark, dataset)
    late = small_raw.chat_message_join.where("message_id = 7")
    upkeep.apply_links(spark, dataset, late, small_raw, small_contacts)  # message 7 is not there yet
    with pytest.raises(CommitConflict):
        ingest.load_above(spark, without_links(small_raw, "message_id <> 7"), small_contacts, dataset, base, 5, "stream")
    ingest.sync(spark, small_raw, small_contacts, dataset)
    assert content(stored.read_messages(spark, dataset)) == expected


def test_two_streams(spark, small_raw, small_contacts, dataset, expected, tmp_path):  # noqa: F811
    landing, links = str(tmp_path / "landing"), str(tmp_path / "links")
    small_raw.message.where("ROWID <= 6").write.parquet(landing)
    small_raw.chat_message_join.where("message_id IN (1, 2, 8, 9)").write.parquet(links)

    def run():
        known = small_raw._replace(chat_message_join=spark.read.parquet(links))
        start_ingest(spark, landing, known, small_contacts, dataset, str(tmp_path / "c1")).awaitTermination()
        start_links(spark, links, small_raw, small_contacts, dataset, str(tmp_path / "c2")).awaitTermination()

    run()
    small_raw.message.where("ROWID > 6").write.mode("append").parquet(landing)
    run()
    small_raw.chat_message_join.where("message_id NOT IN (1, 2, 8, 9)").write.mode("append").parquet(links)
    run()
    assert content(stored.read_messages(spark, dataset)) == expected
    spark.createDataFrame([(None, 3)], "chat_id long, message_id long").write.mode("append").parquet(links)
    with pytest.raises(Exception, match="NULL in a chat link"):
        start_links(spark, links, small_raw, small_contacts, dataset, str(tmp_path / "c2")).awaitTermination()
    assert content(stored.read_messages(spark, dataset)) == expected


def test_a_rewrite_shuffles_whole_rows_once(spark, small_raw, small_contacts, dataset, monkeypatch):  # noqa: F811
    late = small_raw.chat_message_join.where("message_id % 3 = 0")
    known = small_raw._replace(chat_message_join=small_raw.chat_message_join.where("message_id % 3 > 0"))
    for last in (4, 10):
        ingest.sync(spark, upto(known, last), small_contacts, dataset)
    plans, write = [], upkeep.write_load

    def kept(rows, path):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, path)

    monkeypatch.setattr(upkeep, "write_load", kept)
    upkeep.apply_links(spark, dataset, late, small_raw, small_contacts)
    upkeep.compact(spark, dataset)
    links, merge = ([line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line] for plan in plans)
    assert len(merge) == 1 and "REPARTITION_BY_NUM" in merge[0]
    # Rows and the new chats, both by block; then only narrow pairs are shuffled.
    assert sum("REPARTITION_BY_NUM" in line for line in links) == 2
    assert content(stored.read_messages(spark, dataset)) == content(build_messages(small_raw, small_contacts))
