"""The ten-message fixture and hand-made edge cases through the enrichment."""

import datetime as dt

from conftest import contact_table, message, raw_tables

from msgloom.operators.messages import COUNTERPARTY, build_messages, with_counterparty
from msgloom.operators.salted import salted_left_join
from msgloom.schemas import MESSAGES, SCHEMA_VERSION
from msgloom.sources.raw import high_watermark, rows_above


def by_id(df):
    return {row["message_id"]: row for row in df.collect()}


def test_schema_is_fixed(spark, small_raw, small_contacts):
    built = build_messages(small_raw, small_contacts)
    assert built.columns == MESSAGES.fieldNames() and len(built.columns) == 23
    assert [f.dataType for f in built.schema.fields] == [f.dataType for f in MESSAGES.fields]
    assert SCHEMA_VERSION == 2


def test_reads_and_watermark(small_raw):
    assert small_raw.message.count() == 10
    assert high_watermark(small_raw.message, id_column="ROWID").first()["watermark"] == 10
    above = rows_above(small_raw, 5)
    assert above.message.count() == 5
    assert above.chat_message_join.count() == 5
    assert high_watermark(rows_above(small_raw, 99).message, 7, "ROWID").first()["watermark"] == 7


def test_ten_messages(spark, small_raw, small_contacts):
    rows = by_id(build_messages(small_raw, small_contacts))
    assert sorted(rows) == list(range(1, 11))
    first = rows[1]
    assert (first["reaction"], first["message_effect"], first["chat_size"]) == ("no-reaction", "no-effect", 1)
    assert (first["year"], first["month"], first["date"]) == (2024, 1, dt.date(2024, 1, 15))
    assert first["timestamp"] == dt.datetime(2024, 1, 15, 12, 0)
    assert (first["name"], first["contact_info"]) == ("Alice", "+14155550001")
    assert rows[2]["updated_contact_info"] == "+14155550001" and rows[2]["name"] is None
    assert rows[3]["text"] is None
    assert {rows[3][c] for c in ("inferred_text", "text_combined", "body_text")} == {"Call me later"}
    assert rows[4]["reaction"] == "Loved"
    assert rows[5]["message_effect"] == "Fireworks"
    assert [rows[i]["is_thread_reply"] for i in (5, 6)] == [0, 1]
    assert rows[7]["link_domain"] == "open.spotify.com"
    assert rows[8]["is_audio_message"] == 1 and rows[8]["body_text"] is None
    assert rows[9]["chat_size"] == 2 and rows[9]["updated_contact_info"] == "friend@example.com"
    assert rows[9]["chat_members_handles"] == "[1,2]"
    assert rows[9]["chat_members_contact_info"] == '["+14155550001","friend@example.com"]'
    assert rows[10]["updated_contact_info"] == "group-chat"


def test_counterparty(spark, small_raw, small_contacts):
    rows = by_id(build_messages(small_raw, small_contacts, columns=["message_id", COUNTERPARTY]))
    assert [rows[i][COUNTERPARTY] for i in (1, 2, 9, 10)] == ["Alice", "Alice", "friend@example.com", "group-chat"]


def test_any_subset_of_columns_agrees_with_the_full_table(spark, small_raw, small_contacts):
    full = by_id(build_messages(small_raw, small_contacts))
    for column in MESSAGES.fieldNames():
        part = by_id(build_messages(small_raw, small_contacts, columns=dict.fromkeys(["message_id", column])))
        assert {i: r[column] for i, r in part.items()} == {i: r[column] for i, r in full.items()}, column


def test_edge_cases(spark):
    raw = raw_tables(
        spark,
        [
            message(1, date=None, is_from_me=None, handle_id=None, is_audio_message=None, associated_message_type=None),
            message(2, date=-978307200, text=""),
            message(3, date=-978307199),
            message(4, date=10**12),  # still seconds
            message(5, date=10**12 + 1),  # nanoseconds
            message(6, text="kept", attributedBody=b"NSStringotherNSDictionary"),
            message(7, text="https://a.example/x", balloon_bundle_id=None),
            message(8, is_from_me=1),
            message(9, is_from_me=1),
            message(10, text="", attributedBody=b"NSStringotherNSDictionary"),
        ],
        [(1, 'say "hi"\n')],
        # Message 8 stands in two chats, 9 in one without members.
        [(5, 8), (4, 8), (9, 9)],
        [(4, 1), (4, 77), (5, 1), (5, 1)],
    )
    rows = by_id(build_messages(raw, contact_table(spark, [])).drop("timestamp", "date"))
    assert [rows[1][c] for c in ("is_from_me", "handle_id", "is_audio_message", "reaction")] == [0, 0, 0, "no-reaction"]
    assert rows[1]["year"] is None and rows[2]["year"] is None
    assert (rows[3]["year"], rows[3]["month"]) == (1970, 1)
    assert rows[5]["year"] == 2001
    assert rows[4]["month"] is not None and rows[4]["year"] is None  # the year 33658 does not fit
    assert rows[2]["body_text"] == "" and rows[10]["body_text"] == "" and rows[10]["inferred_text"] == "other"
    assert (rows[6]["body_text"], rows[6]["inferred_text"]) == ("kept", "other")
    assert rows[7]["link_domain"] is None
    assert (rows[8]["chat_id"], rows[8]["chat_size"]) == (4, 1)  # smallest chat, unknown handle not counted
    assert rows[8]["chat_members_contact_info"] == '["say \\"hi\\"\\n"]'
    assert rows[8]["updated_contact_info"] == 'say "hi"\n'
    assert (rows[9]["chat_id"], rows[9]["chat_size"], rows[9]["updated_contact_info"]) == (9, 0, None)
    assert rows[9]["chat_members_handles"] is None


def test_repeated_members_and_contacts_do_not_multiply_rows(spark):
    raw = raw_tables(spark, [message(1, handle_id=1)], [(1, "A@x.org")], [(5, 1), (5, 1)], [(5, 1), (5, 1)])
    contacts = contact_table(spark, [("A@x.org", "B"), ("A@x.org", "A"), (None, "nobody")])
    (row,) = build_messages(raw, contacts).collect()
    assert (row["chat_size"], row["name"], row["chat_members_handles"]) == (2, "A", "[1,1]")


def test_keys_match_raw_or_normalised(spark):
    raw = raw_tables(
        spark, [message(1, handle_id=1), message(2, handle_id=2)], [(1, "Ann@X.org"), (2, "+1 (415) 5")], [], []
    )
    contacts = contact_table(spark, [("ann@x.ORG", "Ann"), ("+14155", "Bob")])
    columns = ["message_id", "name"]
    assert {r["name"] for r in by_id(build_messages(raw, contacts, columns=columns)).values()} == {
        "Ann@X.org", "+1 (415) 5",
    }
    assert {r["name"] for r in by_id(build_messages(raw, contacts, columns=columns, normalize=True)).values()} == {
        "Ann", "Bob",
    }


def test_results_do_not_depend_on_the_session_time_zone(spark, small_raw, small_contacts):
    columns = ["message_id", "date", "month", "year"]
    before = by_id(build_messages(small_raw, small_contacts, columns=columns))
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        assert by_id(build_messages(small_raw, small_contacts, columns=columns)) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_counterparty_of_a_stored_table(spark, small_raw, small_contacts):
    stored = build_messages(small_raw, small_contacts)
    added = with_counterparty(stored, small_contacts)
    assert added.columns == [*stored.columns, COUNTERPARTY]
    rows = by_id(added)
    built = by_id(build_messages(small_raw, small_contacts, columns=["message_id", COUNTERPARTY]))
    assert {i: r[COUNTERPARTY] for i, r in rows.items()} == {i: r[COUNTERPARTY] for i, r in built.items()}


def test_rows_without_a_key_are_spread_and_the_lookup_is_not_broadcast(spark):
    rows = spark.range(4000).selectExpr("id AS message_id", "CASE WHEN id % 4 = 1 THEN 5L WHEN id % 4 = 2 THEN 0L END AS key")
    lookup = spark.createDataFrame([(0, "zero"), (5, "five")], "key long, name string")
    joined = salted_left_join(rows, lookup, "key", "message_id", common="0")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    found = {(r["key"], r["name"]): r["count"] for r in joined.groupBy("key", "name").count().collect()}
    assert found == {(None, None): 2000, (5, "five"): 1000, (0, "zero"): 1000}
    with_salt = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(key" in with_salt.lower()  # a NULL key has more shares than a real one
