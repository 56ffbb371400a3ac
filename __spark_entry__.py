"""

The four raw tables are derived from `events` and `customer`. Analyses run over
`messages` built from them without a detour through storage; the joins that an
analysis does not need are left out. Entries named `ingest_*` and `status` write a
dataset to the scratch folder and read it back.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from msgloom.functions.body_text import marked_text, structured_text  # noqa: E402
from msgloom.functions.links import link_domain  # noqa: E402
from msgloom.operators import contacts as C  # noqa: E402
from msgloom.operators import sinks  # noqa: E402
from msgloom.operators.chats import chat_members, first_chat, participants  # noqa: E402
from msgloom.operators.messages import COUNTERPARTY, build_messages, with_counterparty  # noqa: E402
from msgloom.plans import analyses as A  # noqa: E402
from msgloom.plans import conversations as K  # noqa: E402
from msgloom.plans import ingest, sqlview, upkeep  # noqa: E402
from msgloom.schemas import CHAT_MESSAGE_JOIN, MESSAGES, RawTables  # noqa: E402
from msgloom.session import configure, scratch_dir  # noqa: E402
from msgloom.sources import commits, derived, search, stored, summaries  # noqa: E402
from msgloom.sources.contacts import address_book_entries, read_contacts  # noqa: E402
from msgloom.sources.raw import high_watermark, read_raw, rows_above, watermark_of_files  # noqa: E402
from msgloom.streaming.ingest import start_ingest, start_links  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_ONE = "Customer#000000017"
_SEVERAL = [_ONE, "Customer#000000093", "group-chat"]
_WEEK = (dt.date(2024, 1, 8), dt.date(2024, 1, 14))
_NEXT = (dt.date(2024, 1, 12), dt.date(2024, 1, 21))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> RawTables:
    return derived.raw_from_events(_table(spark, sf_dir, "events"))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.contacts_from_customers(_table(spark, sf_dir, "customer"))


def _messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return build_messages(_raw(spark, sf_dir), _contacts(spark, sf_dir), columns=columns or None)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_book_entries(derived.address_book_from_customers(_table(spark, sf_dir, "customer")))


def _comparable(messages: DataFrame) -> DataFrame:
    """Small integers widened and times as Unix seconds, for the result comparison."""

    def column(field: T.StructField):
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_seconds(field.name).alias(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(field.name).cast("long").alias(field.name)
        return F.col(field.name)

    return messages.select(*[column(f) for f in messages.schema.fields])


def _over_years(function: Callable[..., DataFrame], *columns: str, **arguments) -> Query:
    """An analysis of messages of several years, made of `orders`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = derived.raw_from_orders(_table(spark, sf_dir, "orders"))
        return _comparable(function(build_messages(raw, _contacts(spark, sf_dir), columns=columns), **arguments))

    return run


def _analysis(function: Callable[..., DataFrame], *columns: str, **arguments) -> Query:
    """An analysis over the columns it reads."""
    return lambda spark, sf_dir: _comparable(function(_messages(spark, sf_dir, *columns), **arguments))


def _columns(*columns: str) -> Query:
    return lambda spark, sf_dir: _comparable(_messages(spark, sf_dir, *columns))


# --- raw tables and contacts ------------------------------------------------


def _raw_since_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    # The watermark of an earlier run: one number.
    half = high_watermark(raw.message, id_column="ROWID").first()["watermark"] // 2
    return rows_above(raw, half).message.select(F.col("ROWID").alias("message_id"), "date", "text")


def _high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_watermark(_raw(spark, sf_dir).message, id_column="ROWID")


def _high_watermark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(configure(spark), "watermark")
    _raw(spark, sf_dir).message.write.parquet(f"{path}/message")
    return watermark_of_files(spark, path)


def _message_chat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_chat(_raw(spark, sf_dir).chat_message_join)


def _chat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return chat_members(participants(raw.chat_handle_join, raw.handle))


def _address_book_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select(
        "contact_key", "name", "ord.contact_id", F.col("ord.place").cast("long").alias("place")
    )


def _contact_keys_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _address_book_entries(spark, sf_dir).select("contact_id", "place", "contact_key")


def _contact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = derived.overrides_from_customers(_table(spark, sf_dir, "customer"))
    return C.resolve(C.first_per_key(_entries(spark, sf_dir)), overrides)


def _display_name_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = C.first_per_key(_entries(spark, sf_dir))
    return build_messages(_raw(spark, sf_dir), book, columns=["message_id", "name"], normalize=True)


def _display_counterparty(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _messages(spark, sf_dir, "message_id", "is_from_me", "name", "updated_contact_info")
    return with_counterparty(kept, _contacts(spark, sf_dir)).select("message_id", COUNTERPARTY)


def _conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.raw_from_conversations(_table(spark, sf_dir, "conversations"))
    return _comparable(build_messages(raw, _contacts(spark, sf_dir)))


# --- text -------------------------------------------------------------------


def _body_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{derived.stream_blob('text')} AS blob")
    return blobs.select("doc_id", F.expr(structured_text("blob")).alias("inferred_text"))


def _body_text_marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = "CAST('..NSString' || text || 'NSDictionary..' AS BINARY)"
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{marked_text(blob)} AS inferred_text")


def _link_domain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").selectExpr("page_id", f"{link_domain('url')} AS link_domain")


def _label_counts(column: str) -> Query:
    return lambda spark, sf_dir: (
        _messages(spark, sf_dir, column).groupBy(column).agg(F.count(F.lit(1)).alias("messages"))
    )


# --- stored datasets --------------------------------------------------------


def _ingest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = scratch_dir(configure(spark), "full")
    ingest.sync(spark, _raw(spark, sf_dir), _contacts(spark, sf_dir), dataset)
    return _comparable(stored.read_messages(spark, dataset))


def _older(raw: RawTables, spark: SparkSession) -> RawTables:
    """The source as it was when half of the messages had arrived."""
    half = high_watermark(raw.message, id_column="ROWID").first()["watermark"] // 2
    return raw._replace(message=raw.message.where(F.col("ROWID") <= half))


def _synced_twice(spark: SparkSession, sf_dir: str) -> str:
    dataset = scratch_dir(configure(spark), "incremental")
    raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
    ingest.sync(spark, _older(raw, spark), contacts, dataset)
    ingest.sync(spark, raw, contacts, dataset)
    return dataset


def _ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(stored.read_messages(spark, _synced_twice(spark, sf_dir)))


def _in_quarters(spark: SparkSession, sf_dir: str) -> str:
    """A dataset of four loads."""
    dataset = scratch_dir(configure(spark), "quarters")
    raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
    last = high_watermark(raw.message, id_column="ROWID").first()["watermark"]
    for quarter in range(1, 5):
        part = raw._replace(message=raw.message.where(F.col("ROWID") <= last * quarter // 4))
        ingest.sync(spark, part, contacts, dataset)
    return dataset


def _ingest_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads merged into fewer files, and the old files removed."""
    dataset = _in_quarters(spark, sf_dir)
    upkeep.compact(spark, dataset)
    upkeep.remove_superseded(spark, dataset, dt.timedelta(seconds=-60))
    return _comparable(stored.read_messages(spark, dataset))


def _ingest_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written before some columns were added, brought up to date."""
    dataset = scratch_dir(configure(spark), "migrated")
    run = ingest.sync(spark, _raw(spark, sf_dir), _contacts(spark, sf_dir), dataset).first()
    older = stored.read_messages(spark, dataset).drop("body_text", "month", "year")
    sinks.write_load(older, commits.load_path(dataset, 1, "older"))
    commits.write_manifest(commits.described_files(spark, commits.load_path(dataset, 1, "older")), dataset, "older")
    base = commits.current_commit(spark, dataset)
    changes = {"run_id": "older", "schema_version": 1, "columns": [older.schema.simpleString()], "manifests": ["older"]}
    fields = {k: v for k, v in base.items() if k not in ("version", "finished_at")}
    commits.append_commit(spark, dataset, base, **{**fields, **changes})
    assert run["total_messages"] == upkeep.migrate(spark, dataset).first()["total_messages"]
    return _comparable(stored.read_messages(spark, dataset))


def _messages_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few days of a stored table, from the files that can hold them."""
    rows = stored.read_messages(spark, _in_quarters(spark, sf_dir), start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 12))
    return _comparable(rows.select("message_id", "date", "body_text", "name"))


def _data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say about all files, and how many ranges of ids overlap."""
    files = stored.data_files(spark, _in_quarters(spark, sf_dir))
    before = files.selectExpr("*", "max(max_id) OVER (ORDER BY min_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto")
    return before.selectExpr(
        "sum(rows) AS messages", "min(min_id) AS first_id", "max(max_id) AS last_id", "CAST(min(min_date) AS STRING) AS first_date",
        "CAST(max(max_date) AS STRING) AS last_date", "count_if(min_id <= upto) AS overlapping",
    )


def _schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's report on two loads."""
    gate = stored.schema_gate(spark, _synced_twice(spark, sf_dir))
    return gate.selectExpr(
        "rows", "CAST(schema_version AS LONG) AS schema_version", "missing_columns", "extra_columns", "other_types", "accepted"
    )


def _ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = _synced_twice(spark, sf_dir)
    raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
    ingest.sync(spark, raw, contacts, dataset)
    ingest.sync(spark, raw, contacts, dataset)
    return _comparable(stored.read_messages(spark, dataset))


def _ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a first sync, a refresh, and one that found nothing new."""
    dataset = _synced_twice(spark, sf_dir)
    ingest.sync(spark, _raw(spark, sf_dir), _contacts(spark, sf_dir), dataset)
    return stored.read_runs(spark, dataset).select(
        "mode", "since", "last_message_id", "rows_written", "total_messages", "contacts_resolved"
    )


def _ingest_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = _synced_twice(spark, sf_dir)
    ingest.sync(spark, _raw(spark, sf_dir), _contacts(spark, sf_dir), dataset, force=True)
    return _comparable(stored.read_messages(spark, dataset))


def _ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(configure(spark), "stream")
    landing, dataset = f"{folder}/landing", f"{folder}/dataset"
    raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
    half = high_watermark(raw.message, id_column="ROWID").first()["watermark"] // 2
    for part in (F.col("ROWID") <= half, F.col("ROWID") > half):
        raw.message.where(part).write.mode("append").parquet(landing)
        start_ingest(spark, landing, raw, contacts, dataset, f"{folder}/checkpoint").awaitTermination()
    return _comparable(stored.read_messages(spark, dataset))


def _ingest_stream_late_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and chat links as two streams: a third of the links come with the messages, a third
    after them, and a third before."""
    folder = scratch_dir(configure(spark), "links")
    landing, links, dataset = f"{folder}/landing", f"{folder}/links", f"{folder}/dataset"
    raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
    half = high_watermark(raw.message, id_column="ROWID").first()["watermark"] // 2
    for number, part in enumerate(("ROWID <= {0}", "ROWID > {0}")):
        raw.message.where(part.format(half)).write.mode("append").parquet(landing)
        # First the links of every third message of either half, then all others.
        some = "message_id % 3 = 0" if number == 0 else f"message_id % 3 = 1 AND message_id > {half}"
        raw.chat_message_join.where(some).write.mode("append").parquet(links)
        known = raw._replace(chat_message_join=spark.read.schema(CHAT_MESSAGE_JOIN).parquet(links))
        start_ingest(spark, landing, known, contacts, dataset, f"{folder}/checkpoint").awaitTermination()
        start_links(spark, links, raw, contacts, dataset, f"{folder}/links-checkpoint").awaitTermination()
    late = f"NOT (message_id % 3 = 0 OR message_id % 3 = 1 AND message_id > {half})"
    raw.chat_message_join.where(late).write.mode("append").parquet(links)
    start_links(spark, links, raw, contacts, dataset, f"{folder}/links-checkpoint").awaitTermination()
    return _comparable(stored.read_messages(spark, dataset))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = scratch_dir(configure(spark), "status")
    ingest.sync(spark, _raw(spark, sf_dir), _contacts(spark, sf_dir), dataset)
    return _comparable(stored.status(spark, dataset)).select(
        "total_messages", "messages_text", "last_message_id", "schema_version", "contacts_resolved", "warning"
    )


# --- SQL and results --------------------------------------------------------


def _sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlview.register(_messages(spark, sf_dir))
    return sqlview.query(
        spark,
        """SELECT chat_id, COUNT(*) AS n, SUM(CASE WHEN is_audio_message = 1 THEN 1 ELSE 0 END) AS audio
        FROM messages WHERE chat_size >= :size GROUP BY chat_id""",
        {"size": 1},
    )


def _result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(A.top_contacts(_messages(spark, sf_dir, "name"), limit=100))


def _result_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir, "message_id", "body_text", "timestamp", "date")
    return sinks.json_rows(rows, limit=None, stringify=True)


def _result_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(configure(spark), "csv")
    rows = _messages(spark, sf_dir, "message_id", "name", "body_text", "chat_members_contact_info")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def _roundtrip(rows: DataFrame, fmt: str, label: str) -> DataFrame:
    """Rows written by a sink and read back."""
    path = scratch_dir(configure(rows.sparkSession), label)
    (sinks.write_csv if fmt == "csv" else sinks.write_json)(rows, path)
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"} if fmt == "csv" else {}
    return rows.sparkSession.read.schema(rows.schema).format(fmt).options(**options).load(path)


def _documents_roundtrip(fmt: str) -> Query:
    """Whole texts, with blanks put around some, through a sink."""
    text = "CASE doc_id % 3 WHEN 0 THEN concat(' \t', text, ' \n') ELSE text END AS text"
    return lambda spark, sf_dir: _roundtrip(_table(spark, sf_dir, "documents").selectExpr("doc_id", text), fmt, f"doc-{fmt}")


def _raw_files(fmt: str) -> Query:
    """All raw tables written as files and read back through `read_raw`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, raw = scratch_dir(configure(spark), f"raw-{fmt}"), _raw(spark, sf_dir)
        for name, rows in raw._asdict().items():
            if fmt == "csv" and name == "message":
                rows = rows.withColumn("attributedBody", F.base64("attributedBody"))
            (sinks.write_csv if fmt == "csv" else sinks.write_json)(rows, f"{path}/{name}")
        return _comparable(build_messages(read_raw(spark, path, fmt), _contacts(spark, sf_dir)))

    return run


def _contact_overrides_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(configure(spark), "overrides")
    sinks.write_csv(derived.overrides_from_customers(_table(spark, sf_dir, "customer")), path)
    return C.resolve(C.first_per_key(_entries(spark, sf_dir)), read_contacts(spark, path))


def _stored_analysis(function: Callable[[DataFrame], DataFrame]) -> Query:
    """An analysis over a stored table, as a reader calls it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dataset = scratch_dir(configure(spark), "stored")
        ingest.sync(spark, _raw(spark, sf_dir), _contacts(spark, sf_dir), dataset)
        return _comparable(function(stored.read_messages(spark, dataset)))

    return run


def _daily_analysis(function: Callable[..., DataFrame], **arguments) -> Query:
    """An analysis over the daily counts of a dataset made of several loads, late links and a merge."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dataset = scratch_dir(configure(spark), "daily")
        raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
        known = raw._replace(chat_message_join=raw.chat_message_join.where("message_id % 3 > 0"))
        ingest.sync(spark, _older(known, spark), contacts, dataset)
        upkeep.apply_links(spark, dataset, raw.chat_message_join.where("message_id % 3 = 0"), raw, contacts)
        ingest.sync(spark, raw, contacts, dataset)
        upkeep.compact(spark, dataset)
        return _comparable(function(summaries.read_daily(spark, dataset), **arguments))

    return run


def _search_index(text: str) -> Query:
    """A search by the index of a stored table that has grown since."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dataset = scratch_dir(configure(spark), "search")
        raw, contacts = _raw(spark, sf_dir), _contacts(spark, sf_dir)
        ingest.sync(spark, _older(raw, spark), contacts, dataset)
        search.index_contacts(spark, dataset)
        ingest.sync(spark, raw, contacts, dataset)
        return search.search_stored(spark, dataset, text)

    return run


def _deep_dive_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of a stored table, with their keys from its summaries."""
    dataset = _synced_twice(spark, sf_dir)
    names = summaries.contact_names(spark, dataset)
    return _comparable(K.compare_contacts(stored.read_messages(spark, dataset), _SEVERAL, names=names))


def _needs_reply(messages: DataFrame, as_of: dt.date = dt.date(2024, 2, 1)) -> DataFrame:
    return K.needs_reply(messages, as_of=as_of)


def _needs_reply_past(messages: DataFrame) -> DataFrame:
    return _needs_reply(messages, dt.date(2024, 1, 15))


_PARTY = (
    COUNTERPARTY, "chat_size", "is_from_me", "timestamp", "date", "reaction", "link_domain", "is_audio_message",
)

_QUERIES: dict[str, Query] = {
    "raw_since_watermark": _raw_since_watermark,
    "high_watermark": _high_watermark,
    "high_watermark_files": _high_watermark_files,
    "message_chat_dedup": _message_chat_dedup,
    "message_handle_join": _columns("message_id", "handle_id", "contact_info", "chat_id"),
    "chat_members": _chat_members,
    "address_book_entries": _address_book_entries,
    "contact_keys_first": lambda spark, sf_dir: C.first_per_key(_entries(spark, sf_dir)),
    "contact_conflicts": lambda spark, sf_dir: C.conflicts(_entries(spark, sf_dir)),
    "contact_map": _contact_map,
    "contact_keys_normalized": _contact_keys_normalized,
    "apple_timestamps": _columns("message_id", "timestamp", "date", "month", "year"),
    "body_text": _columns("message_id", "text", "inferred_text", "text_combined", "body_text"),
    "body_text_documents": _body_text_documents,
    "body_text_marked_documents": _body_text_marked_documents,
    "reaction_label": _label_counts("reaction"),
    "effect_label": _label_counts("message_effect"),
    "link_domain": _columns("message_id", "link_domain"),
    "link_domain_pages": _link_domain_pages,
    "flags": _columns("message_id", "is_from_me", "is_audio_message", "is_thread_reply"),
    "recipient": _columns("message_id", "chat_size", "updated_contact_info"),
    "display_name": _columns("message_id", "contact_info", "name", COUNTERPARTY),
    "display_counterparty": _display_counterparty,
    "display_name_normalized": _display_name_normalized,
    "messages_full": _columns(),
    "conversation_messages": _conversation_messages,
    "top_contacts": _analysis(A.top_contacts, "name"),
    "top_contacts_year": _analysis(A.top_contacts, "name", "year", year=2024),
    "top_contacts_direct": _analysis(A.top_contacts, "name", "chat_size", direct_only=True),
    "top_contacts_sent": _analysis(A.top_contacts, "name", "is_from_me", way="sent"),
    "top_contacts_received": _analysis(A.top_contacts, "name", "is_from_me", way="received"),
    "time_series": _analysis(A.time_series, "date"),
    "time_series_contact": _analysis(A.time_series, "date", "name", contact=_ONE, window=7),
    "time_series_range": _analysis(
        A.time_series, "date", "is_from_me",
        start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 20), window=3, way="sent",
    ),
    "time_series_year": _analysis(A.time_series, "date", year=2024),
    "time_series_filled": _analysis(A.time_series, "date", fill_gaps=True),
    "time_series_display": _analysis(lambda m: A.display(A.time_series(m), "time_series"), "date"),
    "reactions": _analysis(A.reactions, "reaction"),
    "reactions_contact": _analysis(
        A.reactions, "reaction", "name", "year", "is_from_me", contact=_ONE, year=2024, way="received"
    ),
    "effects": _analysis(A.effects, "message_effect"),
    "effects_year": _analysis(A.effects, "message_effect", "year", year=2024),
    "links": _analysis(A.links, "link_domain"),
    "seasonality_dow": _analysis(A.seasonality, "timestamp", "date", kind="dow"),
    "seasonality_dow_sent": _analysis(A.seasonality_dow, "timestamp", "date", "is_from_me", way="sent"),
    "seasonality_month": _analysis(A.seasonality, "month", kind="month"),
    "seasonality_split": _analysis(A.seasonality, "timestamp", "date", "is_from_me", kind="dow", split=True),
    "seasonality_month_split": _analysis(A.seasonality, "month", "is_from_me", kind="month", split=True),
    "seasonality_month_years": _over_years(A.seasonality_month, "month"),
    "seasonality_month_years_split": _over_years(A.seasonality_month, "month", "is_from_me", split=True),
    "seasonality_dow_years": _over_years(A.seasonality_dow, "timestamp", "date", way="received"),
    "time_series_years": _over_years(A.time_series, "date", fill_gaps=True),
    "time_series_display_years": _over_years(lambda m: A.display(A.time_series(m), "time_series"), "date"),
    "top_contacts_years": _over_years(A.top_contacts, "name", "year", "chat_size", year=2005, direct_only=True, limit=50),
    "search_contacts": _analysis(A.search_contacts, "name", "contact_info", query="R#00000001"),
    "search_contacts_literal": _analysis(A.search_contacts, "name", "contact_info", query="_1"),
    "search_contacts_percent": _analysis(A.search_contacts, "name", "contact_info", query="%"),
    "contact_stats": _analysis(A.contact_stats, "name", "date"),
    "contact_stats_one": _analysis(A.contact_stats, "name", "date", contact=_ONE),
    "sql_passthrough": _sql_passthrough,
    "group_message_count": _analysis(A.group_message_count, "chat_size"),
    "ingest_full": _ingest_full,
    "ingest_incremental": _ingest_incremental,
    "ingest_idempotent": _ingest_idempotent,
    "ingest_stream": _ingest_stream,
    "ingest_stream_late_links": _ingest_stream_late_links,
    "ingest_compacted": _ingest_compacted,
    "ingest_migrated": _ingest_migrated,
    "messages_of_days": _messages_of_days,
    "data_files": _data_files,
    "schema_gate": _schema_gate,
    "status": _status,
    "result_json": _result_json,
    "result_json_text": _result_json_text,
    "result_csv_roundtrip": _result_csv_roundtrip,
    "contact_deep_dive": _analysis(K.contact_deep_dive, *_PARTY, contact=_ONE),
    "compare_contacts": _analysis(K.compare_contacts, *_PARTY, contacts=_SEVERAL),
    "needs_reply": _analysis(
        _needs_reply, COUNTERPARTY, "message_id", "chat_id", "chat_size", "is_from_me", "timestamp", "date", "reaction"
    ),
    "needs_reply_past": _analysis(
        _needs_reply_past,
        COUNTERPARTY, "message_id", "chat_id", "chat_size", "is_from_me", "timestamp", "date", "reaction",
    ),
    "needs_reply_stored": _stored_analysis(_needs_reply),
    "contact_deep_dive_stored": _stored_analysis(lambda m: K.contact_deep_dive(m, _ONE)),
    "compare_contacts_stored": _deep_dive_by_names,
    "top_contacts_daily": _daily_analysis(A.top_contacts, year=2024, direct_only=True, way="received", limit=30),
    "time_series_daily": _daily_analysis(A.time_series),
    "reactions_daily": _daily_analysis(A.reactions),
    "effects_daily": _daily_analysis(A.effects, year=2024),
    "links_daily": _daily_analysis(A.links),
    "seasonality_dow_daily": _daily_analysis(A.seasonality_dow, split=True),
    "seasonality_month_daily": _daily_analysis(A.seasonality_month),
    "search_contacts_daily": _daily_analysis(A.search_contacts, query="R#00000001"),
    "contact_stats_daily": _daily_analysis(A.contact_stats),
    "group_message_count_daily": _daily_analysis(A.group_message_count),
    "search_contacts_index": _search_index("R#00000001"),
    "search_contacts_index_short": _search_index("_1"),
    "raw_files_csv": _raw_files("csv"),
    "raw_files_json": _raw_files("json"),
    "contact_overrides_file": _contact_overrides_file,
    "documents_csv_roundtrip": _documents_roundtrip("csv"),
    "documents_json_lines": _documents_roundtrip("json"),
    "ingest_forced": _ingest_forced,
    "ingest_runs": _ingest_runs,
    "period_in_review": _analysis(K.period_in_review, "name", "date", "is_from_me", start=_WEEK[0], end=_WEEK[1]),
    "group_chats": _analysis(K.group_chats, "chat_id", "chat_size", "handle_id", "is_from_me", "date"),
    "compare_periods": _analysis(K.compare_periods, "name", "date", "is_from_me", first=_WEEK, second=_NEXT),
}


def _llm():
    """The queries and SQL of the training-data subpackage, where it is installed."""
    try:
        import corpus_pipeline
        from msgloom.llm import queries as llm
    except ImportError:
        return {}, {}
    found, expected = {**llm.QUERIES, "pipeline": corpus_pipeline.run}, dict(llm.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        expected["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, expected


def entry(spark: SparkSession) -> DataFrame:
    """Top contacts at the smallest scale."""
    return _QUERIES["top_contacts"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {**_QUERIES, **_llm()[0]}


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE

    return {**ORACLE, **_llm()[1]}
