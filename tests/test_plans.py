"""What the plans look like: pruned scans, no Python, split hot keys."""

import datetime as dt

import pytest
from conftest import contact_table
from pyspark.sql import functions as F

from msgloom.operators.messages import build_messages
from msgloom.plans import analyses as A
from msgloom.plans import conversations as K
from msgloom.plans import ingest
from msgloom.operators.blocks import IdBlocks, blocks_for, id_blocks
from msgloom.session import placement_by_block, scratch_dir, shuffle_partitions, shuffles_for
from msgloom.sources import commits, stored
from msgloom.sources.raw import read_raw


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def files(spark, small_raw, small_contacts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw"))
    for name, table in small_raw._asdict().items():
        table.write.parquet(f"{path}/{name}")
    small_contacts.write.parquet(f"{path}/contacts")
    return path


@pytest.fixture(scope="module")
def dataset(spark, small_raw, small_contacts):
    path = scratch_dir(spark, "plans")
    ingest.sync(spark, small_raw, small_contacts, path)
    return path


@pytest.fixture(scope="module")
def table(spark, dataset):
    return stored.read_messages(spark, dataset)


def test_filters_and_columns_reach_the_scan(table):
    plan = plan_of(A.top_contacts(table, year=2024, direct_only=True, way="received"))
    assert "EqualTo(year,2024)" in plan and "EqualTo(chat_size,1)" in plan and "IsNotNull(name)" in plan
    assert "ReadSchema: struct<is_from_me:tinyint,chat_size:bigint,name:string,year:smallint>" in plan
    assert "TakeOrderedAndProject" in plan
    series = plan_of(A.time_series(table, start=dt.date(2024, 1, 1)))
    assert "GreaterThanOrEqual(date,2024-01-01)" in series and "ReadSchema: struct<date:date>" in series


def test_watermark_reaches_both_large_scans(spark, files, small_contacts):
    built = build_messages(read_raw(spark, files), small_contacts, since=5)
    plan = plan_of(built)
    assert "GreaterThan(ROWID,5)" in plan and "GreaterThan(message_id,5)" in plan


def test_joins_nobody_needs_are_left_out(spark, files, small_contacts):
    raw = read_raw(spark, files)
    effects = plan_of(A.effects(build_messages(raw, small_contacts, columns=["message_effect"])))
    assert "Join" not in effects and "ReadSchema: struct<ROWID:bigint,expressive_send_style_id:string>" in effects
    names = plan_of(A.top_contacts(build_messages(raw, small_contacts, columns=["name"])))
    assert "chat_id" not in names and "attributedBody" not in names


def test_message_rows_are_shuffled_once_without_the_blob(spark, files, small_contacts):
    plan = plan_of(build_messages(read_raw(spark, files), small_contacts).sortWithinPartitions("message_id"), "simple")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(message_id" in line]
    assert len(exchanges) == 3  # messages, their senders' ids, and chat links; small tables are joined in place
    # The join leaves rows in order, so the sort asked for costs nothing.
    assert plan.index("SortMergeJoin [message_id") < plan.index("Sort [message_id")
    assert "rangepartitioning" not in plan
    large = plan_of(build_messages(read_raw(spark, files), small_contacts))
    before = [block for block in large.split("\n\n") if "Exchange" in block and "message_effect" in block]
    assert before and all("attributedBody" not in block for block in before)


def many_messages(spark, small_raw, rows):
    """A message an hour, with a gap and an outlier in the ids."""
    message = spark.range(1, rows + 1, 1, 6).select(
        F.expr(f"CASE WHEN id = {rows} THEN 1L << 60 WHEN id > {rows // 2} THEN id + 5000000 ELSE id END").alias("ROWID"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.lit(None).cast("binary").alias("attributedBody"), (F.col("id") % 3).alias("handle_id"),
        F.lit(0).cast("long").alias("is_from_me"), (F.col("id") * 3600).alias("date"),
        F.lit(0).cast("long").alias("associated_message_type"),
        *[F.lit(None).cast("string").alias(c) for c in
          ("expressive_send_style_id", "thread_originator_guid", "balloon_bundle_id")],
        F.lit(0).cast("long").alias("is_audio_message"),
    )
    return small_raw._replace(message=message)


@pytest.fixture()
def without_broadcasts(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_stored_files_hold_ranges_of_ids(spark, small_raw, small_contacts, without_broadcasts, monkeypatch):
    """One shuffle with texts, none for the write, files of disjoint ids, and few files for a week."""
    rows, size = 33_000, 1_000
    monkeypatch.setattr("msgloom.operators.blocks.ROWS_PER_FILE", size)
    raw = many_messages(spark, small_raw, rows)
    blocks = id_blocks(raw.message.select("ROWID"), rows, blocks_for(rows, 4))
    assert len(blocks) == 33
    with placement_by_block(spark):
        plan = plan_of(build_messages(raw, small_contacts, blocks=blocks), "simple")
    # Messages, their senders' ids and chat links; by id alone only the first chats are found.
    assert plan.count("Exchange shufflepartitionidpassthrough") == 3
    assert plan.count("hashpartitioning(message_id") == plan.count("partial_min(chat_id") == 1
    assert "SortMergeJoin [_block" in plan and "Exchange rangepartitioning" not in plan
    path = scratch_dir(spark, "blocks")
    ingest.sync(spark, raw, small_contacts, path)
    files = stored.data_files(spark, path).orderBy("min_id").collect()
    assert len(files) == 33 and sum(f["rows"] for f in files) == rows and max(f["rows"] for f in files) < 2 * size
    assert all(a["max_id"] < b["min_id"] and a["max_date"] <= b["min_date"] for a, b in zip(files, files[1:]))
    week = stored.read_messages(spark, path, start=dt.date(2001, 6, 4), end=dt.date(2001, 6, 10))
    assert week.count() == 7 * 24 and len(week.inputFiles()) <= 2
    assert "GreaterThanOrEqual(date,2001-06-04)" in plan_of(week)
    some = stored.read_messages(spark, path, first_id=100, last_id=1200)
    assert some.count() == 1101 and len(some.inputFiles()) <= 3
    assert stored.read_messages(spark, path, start=dt.date(1999, 1, 1), end=dt.date(1999, 2, 1)).count() == 0
    ids = stored.read_messages(spark, path).select("message_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    held = ids.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "message_id"))).alias("own")).collect()
    for row in held:
        assert [o["message_id"] for o in row["own"]] == sorted(o["message_id"] for o in row["own"])


def test_blocks_of_ids(spark):
    assert [blocks_for(n, 8) for n in (0, 20_000, 20_001, 100_000, 10**9)] == [1, 1, 2, 8, 1000]
    ids = spark.range(1000).selectExpr("(1L << 60) + id DIV 500 AS id")  # two ids, one double
    blocks = id_blocks(ids, 1000, 7)
    placed = blocks.place(ids, "id").select("id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r["p"] for r in placed}) == 1
    assert len(id_blocks(ids.limit(0), 1000, 7)) == len(id_blocks(ids, 1000, 1)) == 1
    exact = IdBlocks([10.0, 20.0]).place(spark.range(30), "id").select("id", F.spark_partition_id().alias("p")).collect()
    assert {r["id"]: r["p"] for r in exact} == {i: i // 10 for i in range(30)}


def test_a_small_load_is_one_file_without_placement(spark, small_raw, small_contacts):
    path = scratch_dir(spark, "small")
    ingest.sync(spark, small_raw, small_contacts, path)
    assert [f["rows"] for f in stored.data_files(spark, path).collect()] == [10]


def test_status_opens_no_data_file(spark, dataset, table):
    scans = [line for line in plan_of(stored.status(spark, dataset)).splitlines() if line.startswith("Location")]
    assert scans and all("generation=" not in line for line in scans)


def test_no_python_and_no_cross_joins(spark, files, dataset, table, small_contacts):
    built = build_messages(read_raw(spark, files), small_contacts)
    for df in (
        built, A.contact_stats(table), A.time_series(table, fill_gaps=True), A.search_contacts(table, "a"),
        K.group_chats(table), K.needs_reply(table, dt.date(2024, 2, 1), party="name"),
        K.compare_contacts(table, ["Alice"], party="name"),
        K.compare_periods(table, *[(dt.date(2024, 1, 1), dt.date(2024, 1, 9))] * 2),
        stored.status(spark, dataset),
    ):
        plan = plan_of(df)
        for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan, node


def test_no_hint_forces_a_broadcast(spark, files, small_contacts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(build_messages(read_raw(spark, files), small_contacts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contact_stats_are_counted_per_day_before_the_contact(table):
    plan = plan_of(A.contact_stats(table), "simple")
    assert plan.count("Exchange hashpartitioning(name") == 2 and "partial_count(1)" in plan


def test_a_hot_handle_and_a_hot_chat_are_split(spark, tmp_path):
    rows = 30_000
    numbers = spark.range(1, rows + 1, 1, 6).withColumn("third", F.col("id") % 3 == 0)
    numbers.select(
        F.col("id").alias("ROWID"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.lit(None).cast("binary").alias("attributedBody"),
        F.when(F.col("third"), 1).otherwise(F.col("id") % 500 + 2).alias("handle_id"),
        F.lit(0).cast("long").alias("is_from_me"), F.lit(0).cast("long").alias("date"),
        F.lit(0).cast("long").alias("associated_message_type"),
        *[F.lit(None).cast("string").alias(c) for c in
          ("expressive_send_style_id", "thread_originator_guid", "balloon_bundle_id")],
        F.lit(0).cast("long").alias("is_audio_message"),
    ).write.parquet(str(tmp_path / "message"))
    handles = spark.range(1, 503).withColumn("key", F.concat(F.lit("h"), F.col("id").cast("string")))
    handles.select(F.col("id").alias("ROWID"), F.col("key").alias("id")).write.parquet(str(tmp_path / "handle"))
    chat = F.when(F.col("third"), 1).otherwise(F.col("id") % 500 + 2)
    numbers.select(chat.alias("chat_id"), F.col("id").alias("message_id")).write.parquet(
        str(tmp_path / "chat_message_join")
    )
    handles.select(F.col("id").alias("chat_id"), F.col("id").alias("handle_id")).write.parquet(
        str(tmp_path / "chat_handle_join")
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        built = build_messages(read_raw(spark, str(tmp_path)), contact_table(spark, [("h1", "Hot")]))
        built.write.parquet(str(tmp_path / "out"))
        by_name = built.groupBy("name").count()
        assert by_name.where("name = 'Hot'").first()["count"] == rows // 3
        wanted = built.select("message_id", "name", "chat_size")
        wanted.collect()
        final = wanted._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in final
        assert "_salt" in final
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert spark.read.parquet(str(tmp_path / "out")).where("chat_size = 1").count() == rows


def test_shuffles_grow_with_the_rows_and_go_back(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for rows, partitions in ((10, 4), (5 * 10**8, 1000), (4 * 10**11, 800_000)):
        with shuffles_for(spark, rows):
            assert shuffle_partitions(spark) == partitions
    assert spark.conf.get(key, None) is None


def test_links_of_later_messages_are_left_out_of_a_load(spark, small_raw, small_contacts, tmp_path, monkeypatch):
    raw = many_messages(spark, small_raw, 300)
    seen, build = [], ingest.build_messages

    def kept(raw, *arguments, **named):
        seen.append(raw.chat_message_join.agg({"message_id": "max"}).first()[0])
        return build(raw, *arguments, **named)

    monkeypatch.setattr(ingest, "build_messages", kept)
    ingest.sync(spark, raw._replace(message=raw.message.where("ROWID <= 7")), small_contacts, str(tmp_path / "d"))
    assert seen == [7]
