"""Stored datasets: full, incremental, repeated, failed and streamed loads."""

import pytest
from conftest import contact_table, message, raw_tables
from pyspark.sql import functions as F

from msgloom.errors import CommitConflict, DatasetNotFound, SchemaMismatch, SourceNotFound
from msgloom.operators import sinks
from msgloom.operators.messages import build_messages
from msgloom.plans import ingest
from msgloom.schemas import MESSAGES
from msgloom.session import scratch_dir
from msgloom.sources import commits, stored, summaries
from msgloom.sources.raw import read_raw
from msgloom.streaming.ingest import start_ingest


def content(df):
    return sorted(map(tuple, df.collect()))


def upto(raw, last):
    return raw._replace(message=raw.message.where(F.col("ROWID") <= last))


@pytest.fixture()
def dataset(spark):
    return scratch_dir(spark, "test")


@pytest.fixture(scope="module")
def expected(small_raw, small_contacts):
    return content(build_messages(small_raw, small_contacts))


def test_increments_equal_a_full_build(spark, small_raw, small_contacts, dataset, expected):
    modes = []
    for last in (3, 3, 7, 10, 10):
        run = ingest.sync(spark, upto(small_raw, last), small_contacts, dataset).first()
        modes.append((run["mode"], run["since"], run["rows_written"], run["total_messages"], run["last_message_id"]))
    assert modes == [
        ("full", 0, 3, 3, 3), ("incremental", 3, 0, 3, 3), ("incremental", 3, 4, 7, 7),
        ("incremental", 7, 3, 10, 10), ("incremental", 10, 0, 10, 10),
    ]
    got = stored.read_messages(spark, dataset)
    assert content(got) == expected
    assert got.columns == MESSAGES.fieldNames()
    assert [f.dataType for f in got.schema.fields] == [f.dataType for f in MESSAGES.fields]


def test_force_rebuilds_with_new_names(spark, small_raw, small_contacts, dataset):
    ingest.sync(spark, small_raw, small_contacts, dataset)
    renamed = contact_table(spark, [("+14155550001", "Alicia")])
    ingest.sync(spark, small_raw, renamed, dataset)
    names = {r["name"] for r in stored.read_messages(spark, dataset).collect()}
    assert "Alice" in names and "Alicia" not in names
    run = ingest.sync(spark, small_raw, renamed, dataset, force=True).first()
    names = {r["name"] for r in stored.read_messages(spark, dataset).collect()}
    assert "Alicia" in names and "Alice" not in names
    assert (run["generation"], run["total_messages"], run["contacts_resolved"]) == (2, 10, 1)


def write_load(spark, rows, dataset, base, **changes):
    """A load committed as another version of the code would have left it."""
    run_id = changes.get("run_id", f"load-{(base or {'version': 0})['version']}")
    sinks.write_load(rows, commits.load_path(dataset, 1, run_id))
    described = commits.described_files(spark, commits.load_path(dataset, 1, run_id))
    commits.write_manifest(described, dataset, run_id)
    whole = spark.read.schema(MESSAGES).parquet(commits.load_path(dataset, 1, run_id)) if base is None else rows
    if {"name", "date"} <= set(whole.columns):
        summaries.write_summary(summaries.summarised(whole), dataset, run_id)
    fields = {
        "run_id": run_id, "generation": 1, "mode": "full", "since": 0, "last_message_id": 10, "rows_written": rows.count(),
        "total_messages": rows.count(), "columns": [commits.column_list()], "contacts_resolved": 1, "manifests": [run_id], "summaries": [run_id],
    }
    return commits.append_commit(spark, dataset, base, **{**fields, **changes})


def test_a_load_written_but_not_committed_is_not_seen(spark, small_raw, small_contacts, dataset, expected):
    ingest.sync(spark, upto(small_raw, 4), small_contacts, dataset)
    left = build_messages(upto(small_raw, 8), small_contacts, since=4)
    sinks.write_load(left, commits.load_path(dataset, 1, "left-over"))
    assert content(stored.read_messages(spark, dataset)) == expected[:4]
    run = ingest.sync(spark, small_raw, small_contacts, dataset).first()
    assert (run["since"], run["rows_written"], run["total_messages"]) == (4, 6, 10)
    assert content(stored.read_messages(spark, dataset)) == expected


def test_of_two_writers_one_wins(spark, small_raw, small_contacts, dataset, expected):
    ingest.sync(spark, upto(small_raw, 4), small_contacts, dataset)
    base = commits.latest_commit(spark, dataset)
    ingest.load_above(spark, small_raw, small_contacts, dataset, base, 4, "incremental")
    with pytest.raises(CommitConflict):
        ingest.load_above(spark, small_raw, small_contacts, dataset, base, 4, "stream")
    assert content(stored.read_messages(spark, dataset)) == expected
    assert [r["total_messages"] for r in stored.read_runs(spark, dataset).orderBy("finished_at").collect()] == [4, 10]
    # The loser runs again, on what the winner left.
    assert ingest.sync(spark, small_raw, small_contacts, dataset).first()["rows_written"] == 0


def test_two_first_writers(spark, small_raw, small_contacts, dataset, expected):
    ingest.load_above(spark, small_raw, small_contacts, dataset, None, 0, "full")
    with pytest.raises(CommitConflict):
        ingest.load_above(spark, small_raw, small_contacts, dataset, None, 0, "full")
    assert content(stored.read_messages(spark, dataset)) == expected


def test_no_load_lists_or_opens_the_others(spark, small_raw, small_contacts, dataset):
    """Totals are carried: a load works though the rows of the one before cannot be read."""
    ingest.sync(spark, upto(small_raw, 4), small_contacts, dataset)
    first = commits.latest_commit(spark, dataset)
    from msgloom.sources.paths import Folder

    Folder(spark, commits.load_path(dataset, 1, first["run_id"])).delete()
    run = ingest.sync(spark, small_raw, small_contacts, dataset).first()
    assert (run["rows_written"], run["total_messages"]) == (6, 10)


def test_an_unfinished_rebuild_is_not_seen(spark, small_raw, small_contacts, dataset, expected):
    ingest.sync(spark, small_raw, small_contacts, dataset)
    sinks.write_load(build_messages(upto(small_raw, 5), small_contacts), commits.load_path(dataset, 2, "left-over"))
    assert content(stored.read_messages(spark, dataset)) == expected
    ingest.sync(spark, small_raw, small_contacts, dataset, force=True)
    assert content(stored.read_messages(spark, dataset)) == expected


def test_null_ids_store_nothing(spark, small_raw, small_contacts, dataset):
    nameless = small_raw.message.where("ROWID > 8").withColumn("ROWID", F.lit(None).cast("long"))
    raw = small_raw._replace(message=small_raw.message.unionByName(nameless))
    with pytest.raises(ValueError, match="NULL in ROWID of 2"):
        ingest.sync(spark, raw, small_contacts, dataset)
    with pytest.raises(DatasetNotFound):
        stored.read_messages(spark, dataset)


def test_an_empty_source(spark, dataset, small_contacts):
    empty = raw_tables(spark, [], [], [], [])
    run = ingest.sync(spark, empty, small_contacts, dataset).first()
    assert (run["rows_written"], run["total_messages"], run["last_message_id"]) == (0, 0, 0)
    assert stored.read_messages(spark, dataset).count() == 0


def test_missing_things_are_named(spark, tmp_path, dataset):
    with pytest.raises(SourceNotFound):
        read_raw(spark, str(tmp_path))
    with pytest.raises(DatasetNotFound):
        stored.read_messages(spark, dataset)
    with pytest.raises(DatasetNotFound):
        stored.status(spark, dataset)


def test_another_schema_is_refused(spark, small_raw, small_contacts, dataset):
    write_load(spark, build_messages(small_raw, small_contacts), dataset, None, schema_version=1)
    with pytest.raises(SchemaMismatch):
        stored.read_messages(spark, dataset)
    assert [r["accepted"] for r in stored.schema_gate(spark, dataset).collect()] == [False]


def test_mixed_columns_are_refused(spark, small_raw, small_contacts, dataset):
    built = build_messages(small_raw, small_contacts)
    base = write_load(spark, built, dataset, None)
    fewer = built.drop("name").withColumn("chat_size", F.col("chat_size").cast("int")).withColumn("mood", F.lit(1))
    told = sorted([commits.column_list(), fewer.schema.simpleString()])
    write_load(spark, fewer, dataset, base, columns=told, manifests=["load-0", "load-1"])
    with pytest.raises(SchemaMismatch):
        stored.read_messages(spark, dataset)
    with pytest.raises(SchemaMismatch):
        ingest.refresh(spark, small_raw, small_contacts, dataset)
    gate = {r["load"]: r for r in stored.schema_gate(spark, dataset).collect()}
    assert gate["load-0"]["accepted"] and not gate["load-1"]["accepted"]
    assert [gate["load-1"][c] for c in ("missing_columns", "extra_columns", "other_types")] == ["name", "mood", "chat_size"]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_raw_files(spark, small_raw, small_contacts, expected, tmp_path, fmt):
    for name, table in small_raw._asdict().items():
        if fmt == "csv" and name == "message":
            table = table.withColumn("attributedBody", F.base64("attributedBody"))
        table.write.format(fmt).options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).save(str(tmp_path / name))
    raw = read_raw(spark, str(tmp_path), fmt)
    assert content(build_messages(raw, small_contacts)) == expected
    assert content(build_messages(read_raw(spark, str(tmp_path), fmt, since=6), small_contacts)) == expected[6:]


def test_status(spark, small_raw, small_contacts, dataset):
    ingest.sync(spark, small_raw, small_contacts, dataset)
    row = stored.status(spark, dataset).first()
    assert (row["total_messages"], row["messages_text"], row["last_message_id"]) == (10, "10", 10)
    assert row["size_bytes"] > 0 and row["size_text"].endswith((" B", " KB", " MB"))
    assert (row["schema_version"], row["contacts_resolved"], row["warning"]) == (2, 1, None)
    ingest.sync(spark, small_raw, contact_table(spark, []), dataset, force=True)
    assert stored.status(spark, dataset).first()["warning"] is not None


def test_size_text(spark):
    sizes = [0, 1023, 1024, 1536, 1048575, 1048576, 123456789]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", stored.size_text(F.col("n")).alias("t"))
    assert [r["t"] for r in df.orderBy("n").collect()] == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "117.7 MB",
    ]


def test_stream(spark, small_raw, small_contacts, dataset, expected, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")

    def run():
        start_ingest(spark, landing, small_raw, small_contacts, dataset, checkpoint).awaitTermination()
        return stored.read_messages(spark, dataset)

    small_raw.message.where("ROWID <= 6").write.parquet(landing)
    assert content(run()) == expected[:6]
    small_raw.message.where("ROWID > 6").write.mode("append").parquet(landing)
    assert content(run()) == expected
    assert content(run()) == expected
    modes = stored.read_runs(spark, dataset).orderBy("last_message_id").collect()
    assert [(r["mode"], r["total_messages"]) for r in modes] == [("stream", 6), ("stream", 10)]


def test_a_repeated_stream_batch_adds_nothing(spark, small_raw, small_contacts, dataset, expected, tmp_path):
    landing = str(tmp_path / "landing")
    small_raw.message.write.parquet(landing)
    # Two fresh checkpoints: batch 0 runs twice, as after a failure before the commit.
    for attempt in ("a", "b"):
        start_ingest(
            spark, landing, small_raw, small_contacts, dataset, str(tmp_path / attempt)
        ).awaitTermination()
    assert content(stored.read_messages(spark, dataset)) == expected


def test_results_as_json_and_csv(spark, small_raw, small_contacts, tmp_path):
    built = build_messages(small_raw, small_contacts).orderBy("message_id")
    small = built.select("message_id", "name", "timestamp", "date")
    assert sinks.json_rows(small, 1).first()["json"].startswith('{"message_id":1,"name":"Alice","timestamp":"2024')
    text = [r["json"] for r in sinks.json_rows(small, 2, stringify=True).collect()]
    assert text == [
        '{"message_id":"1","name":"Alice","timestamp":"2024-01-15T12:00:00Z","date":"2024-01-15"}',
        '{"message_id":"2","name":"","timestamp":"2024-01-15T12:01:00Z","date":"2024-01-15"}',
    ]
    sinks.write_json(small, str(tmp_path / "json"), limit=3)
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    odd = spark.createDataFrame([(1, 'a "quoted", text\nand more'), (2, None)], "i int, t string")
    sinks.write_csv(odd, str(tmp_path / "csv"))
    back = spark.read.schema(odd.schema).csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True)
    assert content(back.na.fill("none")) == content(odd.na.fill("none"))
    sinks.write_csv(odd, str(tmp_path / "one"), limit=1)
    files = list((tmp_path / "one").glob("*.csv"))
    assert "".join(f.read_text() for f in files) == 'i,t\n1,"a ""quoted"", text\nand more"\n'


def test_sync_from_files_in_steps(spark, small_raw, small_contacts, dataset, expected, tmp_path):
    source = str(tmp_path)
    for name, table in small_raw._asdict().items():
        kept = table.where("ROWID <= 6") if name == "message" else table
        kept.write.parquet(f"{source}/{name}")
    ingest.sync_files(spark, source, small_contacts, dataset)
    small_raw.message.where("ROWID > 6").write.mode("append").parquet(f"{source}/message")
    run = ingest.sync_files(spark, source, small_contacts, dataset).first()
    assert (run["mode"], run["rows_written"]) == ("incremental", 4)
    assert content(stored.read_messages(spark, dataset)) == expected


def test_csv_keeps_blanks_and_line_breaks(spark, tmp_path):
    odd = spark.createDataFrame([(1, "  lead"), (2, "trail \n"), (3, "\ttab\r\n x "), (4, ' "q" ')], "i int, t string")
    sinks.write_csv(odd, str(tmp_path / "csv"))
    back = spark.read.schema(odd.schema).csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True)
    assert content(back) == content(odd)


@pytest.mark.parametrize(
    "fmt, row", [("csv", "ROWID,id\nx,+1415\n"), ("csv", "ROWID,id\n,+1415\n"), ("json", '{"ROWID": null, "id": "k"}\n')]
)
def test_bad_raw_rows_are_errors(spark, small_raw, tmp_path, fmt, row):
    for name, table in small_raw._asdict().items():
        table = table.withColumn("attributedBody", F.base64("attributedBody")) if name == "message" else table
        (sinks.write_csv if fmt == "csv" else sinks.write_json)(table, str(tmp_path / name))
    (tmp_path / "handle" / "bad.txt").write_text(row)
    with pytest.raises(Exception, match="NULL in ROWID|MALFORMED_RECORD"):
        read_raw(spark, str(tmp_path), fmt).handle.collect()


def test_columnar_files_without_ids_are_errors(spark, small_raw, tmp_path):
    for name, table in small_raw._asdict().items():
        table.write.parquet(str(tmp_path / name))
    spark.createDataFrame([(None, "k")], "ROWID long, id string").write.mode("append").parquet(str(tmp_path / "handle"))
    with pytest.raises(ValueError, match="NULL"):
        read_raw(spark, str(tmp_path))


def test_an_older_schema_is_not_written_to(spark, small_raw, small_contacts, dataset, tmp_path):
    write_load(spark, build_messages(upto(small_raw, 5), small_contacts), dataset, None, schema_version=1)
    with pytest.raises(SchemaMismatch):
        ingest.refresh(spark, small_raw, small_contacts, dataset)
    with pytest.raises(SchemaMismatch):
        start_ingest(spark, str(tmp_path), small_raw, small_contacts, dataset, str(tmp_path / "c"))
    assert stored.read_runs(spark, dataset).count() == 1
    ingest.sync(spark, small_raw, small_contacts, dataset, force=True)
    assert stored.read_messages(spark, dataset).count() == 10


def test_a_stream_logs_the_rows_of_each_batch(spark, small_raw, small_contacts, dataset, tmp_path):
    landing = str(tmp_path / "landing")
    for part in ("ROWID > 4", "ROWID <= 4"):  # older ids arrive second
        small_raw.message.where(part).write.mode("append").parquet(landing)
        start_ingest(spark, landing, small_raw, small_contacts, dataset, str(tmp_path / "c")).awaitTermination()
    runs = stored.read_runs(spark, dataset).orderBy("finished_at").collect()
    assert [(r["rows_written"], r["total_messages"]) for r in runs] == [(6, 6), (4, 10)]


def test_status_counts_the_current_generation(spark, small_raw, small_contacts, dataset):
    ingest.sync(spark, small_raw, small_contacts, dataset)
    first = stored.status(spark, dataset).first()
    ingest.sync(spark, small_raw, small_contacts, dataset, force=True)
    second = stored.status(spark, dataset).first()
    assert abs(second["size_bytes"] - first["size_bytes"]) < 0.1 * first["size_bytes"]
    assert first["superseded_bytes"] == 0 < second["superseded_bytes"]


def test_a_stream_with_null_ids_stores_nothing_of_the_batch(spark, small_raw, small_contacts, dataset, tmp_path):
    landing = str(tmp_path / "landing")
    small_raw.message.where("ROWID <= 6").write.parquet(landing)
    start_ingest(spark, landing, small_raw, small_contacts, dataset, str(tmp_path / "c")).awaitTermination()
    rows = small_raw.message.where("ROWID > 6").withColumn("ROWID", F.expr("if(ROWID = 8, NULL, ROWID)"))
    rows.write.mode("append").parquet(landing)
    with pytest.raises(Exception, match="NULL in ROWID"):
        start_ingest(spark, landing, small_raw, small_contacts, dataset, str(tmp_path / "c")).awaitTermination()
    assert stored.read_messages(spark, dataset).count() == 6


def test_a_stream_and_a_sync_share_a_dataset(spark, small_raw, small_contacts, dataset, expected, tmp_path):
    ingest.sync(spark, upto(small_raw, 6), small_contacts, dataset)
    small_raw.message.where("ROWID > 3").write.parquet(str(tmp_path / "landing"))
    for checkpoint in ("a", "b"):
        start_ingest(
            spark, str(tmp_path / "landing"), small_raw, small_contacts, dataset, str(tmp_path / checkpoint)
        ).awaitTermination()
    assert content(stored.read_messages(spark, dataset)) == expected
    assert [r["rows_written"] for r in stored.read_runs(spark, dataset).orderBy("finished_at").collect()] == [6, 4]
