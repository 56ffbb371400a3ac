"""The analyses against plain Python over the same rows, and their properties."""

import datetime as dt
from collections import Counter, defaultdict

import pytest
from conftest import SF, message, raw_tables
from pyspark.sql import functions as F

from msgloom.operators.messages import COUNTERPARTY, build_messages
from msgloom.plans import analyses as A
from msgloom.plans import conversations as K
from msgloom.plans import sqlview
from msgloom.schemas import MESSAGES
from msgloom.sources.derived import contacts_from_customers, raw_from_events


@pytest.fixture(scope="module")
def messages(spark):
    raw = raw_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    contacts = contacts_from_customers(spark.read.parquet(f"{SF}/customer.parquet"))
    return build_messages(raw, contacts, columns=[*MESSAGES.fieldNames(), COUNTERPARTY]).cache()


@pytest.fixture(scope="module")
def rows(messages):
    return [r.asDict() for r in messages.collect()]


def values(df):
    return [tuple(r) for r in df.collect()]


def ranked(counter, limit=None):
    return sorted(counter.items(), key=lambda item: (-item[1], item[0]))[:limit]


def test_one_row_per_raw_message(spark, messages, rows):
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count() == len({r["message_id"] for r in rows})


@pytest.mark.parametrize("way, flag", [(None, None), ("sent", 1), ("received", 0)])
@pytest.mark.parametrize("direct", [False, True])
def test_top_contacts(messages, rows, way, flag, direct):
    want = Counter(
        r["name"] for r in rows
        if r["name"] is not None and flag in (None, r["is_from_me"]) and (not direct or r["chat_size"] == 1)
    )
    assert values(A.top_contacts(messages, 7, direct_only=direct, way=way)) == ranked(want, 7)


@pytest.mark.parametrize("window", [0, 1, 3, 28])
def test_time_series(messages, rows, window):
    days = sorted(Counter(str(r["date"]) for r in rows if r["date"]).items())
    counts = [n for _, n in days]
    size = max(window, 1)
    means = [sum(counts[max(0, i - size + 1): i + 1]) / min(size, i + 1) for i in range(len(counts))]
    got = values(A.time_series(messages, window=window))
    assert [(d, n) for d, n, _ in got] == days
    assert [a for _, _, a in got] == pytest.approx(means)
    assert sum(n for _, n, _ in got) == sum(counts)
    if size == 1:
        assert all(a == n for _, n, a in got)


def test_time_series_arguments(messages, rows):
    assert values(A.time_series(messages, year=2024)) == values(
        A.time_series(messages, start=dt.date(2024, 1, 1), end=dt.date(2024, 12, 31))
    )
    with pytest.raises(ValueError):
        A.time_series(messages, year=2024, start=dt.date(2024, 1, 1))
    assert values(A.time_series(messages, contact="nobody' OR '1'='1", fill_gaps=True)) == []
    filled = values(A.time_series(messages, year=2024, fill_gaps=True, window=2))
    dates = [dt.date.fromisoformat(d) for d, _, _ in filled]
    assert dates == [dates[0] + dt.timedelta(i) for i in range(len(dates))]
    assert A.display(A.time_series(messages), "time_series", 3).count() == 3


def test_counts(messages, rows):
    assert values(A.reactions(messages)) == ranked(Counter(r["reaction"] for r in rows if r["reaction"] != "no-reaction"))
    assert values(A.effects(messages, 2024)) == ranked(
        Counter(r["message_effect"] for r in rows if r["message_effect"] != "no-effect" and r["year"] == 2024)
    )
    assert values(A.links(messages, 3)) == ranked(Counter(r["link_domain"] for r in rows if r["link_domain"]), 3)
    assert A.group_message_count(messages).first()[0] == sum(r["chat_size"] > 1 for r in rows)


def test_seasonality(messages, rows):
    # isoweekday is 7 on Sundays.
    per_day = Counter(r["timestamp"].isoweekday() % 7 for r in rows if r["timestamp"])
    assert values(A.seasonality(messages)) == [(d, A.DAY_NAMES[d], per_day[d]) for d in sorted(per_day)]
    total = {d: n for d, _, n in values(A.seasonality_dow(messages))}
    split = {d: s + r for d, _, s, r in values(A.seasonality_dow(messages, split=True))}
    assert split == total
    per_month = Counter(r["month"] for r in rows if r["month"])
    assert values(A.seasonality(messages, "month")) == sorted(per_month.items())
    with pytest.raises(ValueError):
        A.seasonality(messages, "week")


def test_direction_flags():
    assert [A.direction(*f) for f in ((1, 0), (0, 1), (1, 1), (0, 0))] == ["sent", "received", None, None]


@pytest.mark.parametrize(
    "query, found",
    [("%", {"100%"}), ("_", {"a_b"}), ("\\", {"back\\slash"}), ("'", {"o'neil"}), ("O'NEIL", {"o'neil"}),
     ("", {"100%", "a_b", "back\\slash", "o'neil", "plain"}), ("a_b", {"a_b"}), ("axb", set())],
)
def test_search_is_literal(spark, query, found):
    keys = ["100%", "a_b", "back\\slash", "o'neil", "plain"]
    raw = raw_tables(
        spark, [message(i + 1, handle_id=i + 1) for i in range(6)], [(i + 1, k) for i, k in enumerate(keys)], [], []
    )
    built = build_messages(raw, spark.createDataFrame([], "contact_key string, name string"))
    assert {r["contact_info"] for r in A.search_contacts(built, query).collect()} == found


def test_contact_stats(messages, rows):
    groups = defaultdict(list)
    for r in rows:
        if r["name"] is not None:
            groups[r["name"]].append(r["date"])
    want = {}
    for name, dates in groups.items():
        known = [d for d in dates if d]
        if not known:
            want[name] = (len(dates), None, None, 0, None)
            continue
        span = (max(known) - min(known)).days + 1
        mean = (200 * len(dates) + span) // (2 * span) / 100
        want[name] = (len(dates), str(min(known)), str(max(known)), len(set(known)), mean)
    got = {r[0]: tuple(r)[1:] for r in A.contact_stats(messages, limit=10_000).collect()}
    assert got == want
    one = next(iter(want))
    assert values(A.contact_stats(messages, one)) == [(one, *want[one])]


def test_undated_contact_has_no_mean(spark):
    raw = raw_tables(spark, [message(1, handle_id=1, date=None)], [(1, "x")], [], [])
    built = build_messages(raw, spark.createDataFrame([], "contact_key string, name string"))
    assert values(A.contact_stats(built)) == [("x", 1, None, None, 0, None)]


def test_conversations(messages, rows):
    party = Counter(r[COUNTERPARTY] for r in rows if r[COUNTERPARTY] not in (None, "group-chat")).most_common(1)[0][0]
    mine = [r for r in rows if r[COUNTERPARTY] == party]
    deep = K.contact_deep_dive(messages, party).first()
    assert deep["total_messages"] == len(mine)
    direct = [r for r in mine if r["chat_size"] == 1]
    assert (deep["sent_direct"], deep["received_direct"]) == (
        sum(r["is_from_me"] for r in direct), sum(1 - r["is_from_me"] for r in direct),
    )
    hours = Counter(r["timestamp"].hour for r in mine if r["timestamp"])
    assert deep["busiest_hour"] == min(hours, key=lambda h: (-hours[h], h))
    days = Counter(r["timestamp"].isoweekday() % 7 for r in mine if r["timestamp"])
    assert deep["busiest_day"] == A.DAY_NAMES[min(days, key=lambda d: (-days[d], d))]

    last = {}
    for r in sorted((r for r in rows if r["timestamp"]), key=lambda r: (r["timestamp"], r["message_id"])):
        if r["chat_size"] == 1 and r["reaction"] == "no-reaction":
            last[r["chat_id"]] = r
    want = {c: (r["message_id"], (dt.date(2024, 3, 1) - r["date"]).days) for c, r in last.items() if not r["is_from_me"]}
    got = {r["chat_id"]: (r["message_id"], r["days_waiting"]) for r in K.needs_reply(messages, dt.date(2024, 3, 1)).collect()}
    assert got == want

    groups = Counter(r["chat_id"] for r in rows if r["chat_size"] > 1)
    assert [(r["chat_id"], r["messages"]) for r in K.group_chats(messages, 4).collect()] == ranked(groups, 4)


def test_needs_reply_looks_no_further_than_its_day(messages, rows):
    day = sorted(r["date"] for r in rows if r["date"])[len(rows) // 2]
    last = {}
    for r in sorted((r for r in rows if r["timestamp"]), key=lambda r: (r["timestamp"], r["message_id"])):
        if r["chat_size"] == 1 and r["reaction"] == "no-reaction" and r["date"] <= day:
            last[r["chat_id"]] = r
    want = {c: (day - r["date"]).days for c, r in last.items() if not r["is_from_me"]}
    got = {r["chat_id"]: r["days_waiting"] for r in K.needs_reply(messages, day).collect()}
    assert got == want and min(got.values()) >= 0


def test_a_stored_table_needs_no_further_column(messages):
    names = [r["name"] for r in messages.where("is_from_me = 0").select("name").distinct().orderBy("name").limit(5).collect()]
    plain = messages.drop("counterparty_name")
    columns = ["name", "total_messages", "received_direct", "sent_direct"]
    got = K.compare_contacts(plain, names).select(*columns).collect()
    assert got == K.compare_contacts(messages, names).select(*columns).collect() and got


def test_periods(messages, rows):
    first, second = (dt.date(2024, 1, 2), dt.date(2024, 1, 9)), (dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    one, two = (K.period_in_review(messages, *p).first() for p in (first, second))
    inside = [r for r in rows if r["date"] and first[0] <= r["date"] <= first[1]]
    assert one["messages"] == len(inside) == one["sent"] + one["received"]
    assert one["active_contacts"] == len({r["name"] for r in inside} - {None})
    compared = {r["metric"]: r for r in K.compare_periods(messages, first, second).collect()}
    assert set(compared) == set(K.METRICS)
    for metric, r in compared.items():
        assert (r["first_period"], r["second_period"]) == (one[metric], two[metric])
        assert r["change_percent"] == pytest.approx(100 * (two[metric] - one[metric]) / one[metric])
    empty = (dt.date(1999, 1, 1), dt.date(1999, 1, 2))
    assert tuple(K.period_in_review(messages, *empty).first())[1:] == (0,) * 5
    assert all(r["change_percent"] is None for r in K.compare_periods(messages, empty, empty).collect())


def test_free_sql(spark, messages):
    sqlview.register(messages)
    assert sqlview.query(spark, "SELECT COUNT(*) FROM messages").first()[0] == messages.count()
    bound = sqlview.query(spark, "SELECT COUNT(*) AS n FROM messages WHERE name = :who", {"who": "x' OR 'a'='a"})
    assert bound.first()["n"] == 0
    assert sqlview.query(spark, "DESCRIBE messages").where(F.col("col_name") == "body_text").count() == 1
