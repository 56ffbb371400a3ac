"""Daily counts, contact lookups on a stored table, and answers from footers."""

import datetime as dt

import pytest
from conftest import contact_table
from pyspark.sql import functions as F
from test_ingest import content, dataset, upto  # noqa: F401
from test_plans import plan_of

from msgloom.operators import sinks
from msgloom.operators.messages import build_messages
from msgloom.plans import analyses as A
from msgloom.plans import conversations as K
from msgloom.plans import ingest, upkeep
from msgloom.session import answers_from_footers
from msgloom.sources import search, stored, summaries
from msgloom.sources.raw import high_watermark, watermark_of_files

ANALYSES = [
    lambda m: A.top_contacts(m), lambda m: A.top_contacts(m, year=2024, direct_only=True, way="received"),
    lambda m: A.time_series(m), lambda m: A.time_series(m, contact="Alice", start=dt.date(2024, 1, 1), fill_gaps=True),
    lambda m: A.reactions(m, "Alice", 2024, "received"), A.effects, A.links, A.seasonality_month,
    lambda m: A.seasonality_dow(m, split=True), lambda m: A.search_contacts(m, "155"), A.contact_stats, A.group_message_count,
]


def test_daily_counts_answer_like_the_table(spark, small_raw, small_contacts, dataset):  # noqa: F811
    links = small_raw.chat_message_join
    known = small_raw._replace(chat_message_join=links.where("message_id NOT IN (2, 9, 10)"))

    def check():
        daily, table = summaries.read_daily(spark, dataset), stored.read_messages(spark, dataset)
        for analysis in ANALYSES:
            assert analysis(daily).collect() == analysis(table).collect()

    for last in (4, 10):
        ingest.sync(spark, upto(known, last), small_contacts, dataset)
        check()
    upkeep.apply_links(spark, dataset, links, small_raw, small_contacts)  # off and on again
    assert summaries.read_daily(spark, dataset).where(f"{summaries.COUNT} < 0").count() > 0
    check()
    upkeep.compact(spark, dataset)
    daily = summaries.read_daily(spark, dataset)
    assert daily.where(f"{summaries.COUNT} <= 0").count() == 0 and daily.agg(F.sum(summaries.COUNT)).first()[0] == 10
    check()
    ingest.sync(spark, small_raw, small_contacts, dataset, force=True)
    check()
    upkeep.remove_superseded(spark, dataset, dt.timedelta(seconds=-60))
    check()


def test_daily_counts_of_nothing(spark, small_raw, small_contacts, dataset):  # noqa: F811
    ingest.sync(spark, upto(small_raw, 0), small_contacts, dataset)
    daily = summaries.read_daily(spark, dataset)
    assert [analysis(daily).count() for analysis in ANALYSES] == [0] * 11 + [1]
    assert A.group_message_count(daily).first()["group_messages"] == 0


def test_analyses_of_daily_counts_read_nothing_else(spark, small_raw, small_contacts, dataset):  # noqa: F811
    ingest.sync(spark, small_raw, small_contacts, dataset)
    for analysis in ANALYSES:
        scans = [x for x in plan_of(analysis(summaries.read_daily(spark, dataset))).splitlines() if x.startswith("Location")]
        assert scans and all("/summary/" in x for x in scans)


def test_contacts_are_read_by_one_filter(spark, small_raw, small_contacts, dataset):  # noqa: F811
    ingest.sync(spark, small_raw, small_contacts, dataset)
    table, names = stored.read_messages(spark, dataset), summaries.contact_names(spark, dataset)
    plan = plan_of(K.contact_deep_dive(table, "Alice", names=names))
    assert "Join" not in plan and plan.count("Scan parquet") == 2  # the node, and its details
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "Or(" in pushed and "name,Alice" in pushed and "updated_contact_info, [+14155550001" in pushed


def test_contacts_by_name_key_and_group(spark, small_raw, small_contacts, dataset, monkeypatch):  # noqa: F811
    """Against names looked up for every message, with a key that got another name later."""
    ingest.sync(spark, upto(small_raw, 5), small_contacts, dataset)
    ingest.sync(spark, small_raw, contact_table(spark, [("+14155550001", "Alicia")]), dataset)
    table, names = stored.read_messages(spark, dataset), summaries.contact_names(spark, dataset)
    assert {r["contact_key"]: r["name"] for r in names.collect()} == {
        "+14155550001": "Alicia", "friend@example.com": "friend@example.com"
    }
    assert content(names) == content(K.known_names(table))
    for wanted in (["Alicia"], ["Alice"], ["Alice", "Alicia", "group-chat"], ["+14155550001"], ["friend@example.com", "nobody"]):
        got = K.compare_contacts(table, wanted, names=names).collect()
        assert got == K.compare_contacts(table, wanted).collect()
        with monkeypatch.context() as patch:
            patch.setattr(K, "MAX_KEYS", -1)  # as if there were too many keys for a filter
            assert got == K.compare_contacts(table, wanted, names=names).collect()


def test_lookup_columns_have_bloom_filters(spark, small_raw, small_contacts, dataset):  # noqa: F811
    """Where their values are too many for a dictionary."""
    rows = build_messages(small_raw, small_contacts).where("message_id = 1")
    many = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(80_000)))).withColumns(
        {c: F.concat(F.lit(f"a longer value of {c} "), F.col("n").cast("string")) for c in ("name", "updated_contact_info", "text")}
    )
    sinks.write_load(many.drop("n").coalesce(1), dataset)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(spark.read.parquet(dataset).inputFiles()[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf)
    )
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    found = {c.getPath().toDotString() for c in columns if c.getBloomFilterOffset() > 0}
    reader.close()
    assert found == {"name", "updated_contact_info"}


def test_watermark_from_footers(spark, small_raw, tmp_path):
    small_raw.message.write.parquet(str(tmp_path / "message"))
    with answers_from_footers(spark):
        found = high_watermark(spark.read.schema(small_raw.message.schema).parquet(str(tmp_path / "message")), 0, "ROWID")
        assert "PushedAggregation: [MAX(ROWID)]" in plan_of(found)
    assert watermark_of_files(spark, str(tmp_path)).first()["watermark"] == 10
    small_raw.message.limit(0).write.parquet(str(tmp_path / "none" / "message"))
    assert watermark_of_files(spark, str(tmp_path / "none"), since=7).first()["watermark"] == 7
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


@pytest.mark.parametrize("name", ["Alice", "nobody"])
def test_daily_rows_are_built_like_the_table(spark, small_raw, small_contacts, name):
    built = build_messages(small_raw, small_contacts)
    counted = summaries.summarised(built).where(F.col("name") == name)
    assert counted.agg(F.coalesce(F.sum(summaries.COUNT), F.lit(0))).first()[0] == built.where(F.col("name") == name).count()


def test_search_by_index(spark, small_raw, small_contacts, dataset):  # noqa: F811
    ingest.sync(spark, upto(small_raw, 8), small_contacts, dataset)
    texts = ["ali", "LICE", "155", "friend@", "end@ex", "zzz", "a%c", "li", "", "alicex", "+14155550001"]

    def check():
        table = stored.read_messages(spark, dataset)
        for text in texts:
            assert search.search_stored(spark, dataset, text).collect() == A.search_contacts(table, text).collect(), text

    check()  # no index yet
    search.index_contacts(spark, dataset)
    check()
    plan = plan_of(search.search_stored(spark, dataset, "alice"))
    assert "In(triple, [ali,ice,lic])" in plan and "/messages/" not in plan
    ingest.sync(spark, small_raw, small_contacts, dataset)  # brings another contact
    check()
    upkeep.compact(spark, dataset)
    check()
    run = search.index_contacts(spark, dataset).first()
    assert (run["mode"], run["total_messages"]) == ("index", 10)
    upkeep.remove_superseded(spark, dataset, dt.timedelta(seconds=-60))
    check()


def test_triples(spark):
    pairs = spark.createDataFrame([("Ann", "ann@x"), ("Ann", "ann@x"), (None, "ab"), ("ÉÉé", None)], "name string, contact_info string")
    got = sorted((r["triple"], r["name"]) for r in search.contact_triples(pairs).collect())
    assert got == [("ann", "Ann"), ("n@x", "Ann"), ("nn@", "Ann"), ("ééé", "ÉÉé")]
