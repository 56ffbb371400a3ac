"""Analyses of conversations: one contact, several contacts, chats and periods.

Contacts are matched on a column of names, by default `counterparty_name`, which
unlike `name` is also set on messages sent in direct chats. A stored table lacks it; it is
then derived from the names that the table's received messages show for each key.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom.functions.labels import NO_REACTION
from msgloom.functions.times import utc_hour
from msgloom.operators.messages import COUNTERPARTY, GROUP_CHAT, with_counterparty
from msgloom.plans.analyses import DAY_NAMES, contact_totals
from msgloom.session import one_row

#: Keys of the contacts asked for that a filter takes; beyond them a join does.
MAX_KEYS = 1_000
_HOURS = range(24)
_DAYS = range(7)


def known_names(messages: DataFrame) -> DataFrame:
    """Contact keys of received messages and the name on the newest one, as a contact table. A
    stored table has it ready: `contact_names`."""
    received = messages.where("is_from_me <> 1 AND contact_info IS NOT NULL AND name IS NOT NULL")
    return received.groupBy(F.col("contact_info").alias("contact_key")).agg(F.max_by("name", "message_id").alias("name"))


def _rows_of(messages: DataFrame, contacts: Sequence[str], names: DataFrame) -> DataFrame:
    """The messages from or to some contacts, with the contact in `counterparty_name`.

    The keys that stand for the contacts come first, from the contact table. The messages are then
    read by one filter on direction, name and key, which reaches the scan and its Bloom filters. If
    the contacts have more keys than a filter takes, sent messages look their names up in a join.
    """
    wanted = [c for c in contacts if c is not None]
    # Keys that show a wanted name, and wanted texts that are keys of others.
    told = names.where(F.col("name").isin(wanted) | F.col("contact_key").isin(wanted)).limit(MAX_KEYS + 1).collect()
    if len(told) > MAX_KEYS:
        return with_counterparty(messages, names).where(F.col(COUNTERPARTY).isin(wanted))
    shown = {r["contact_key"]: r["name"] for r in told}
    # A key without a name stands for itself, and groups for their common value.
    sent = sorted({k for k, name in shown.items() if name in wanted} | {w for w in wanted if w not in shown})
    sent = [k for k in sent if k != GROUP_CHAT] + [GROUP_CHAT] * (GROUP_CHAT in wanted)
    received = (F.col("is_from_me") != 1) & F.col("name").isin(wanted)
    mine = messages.where(received | ((F.col("is_from_me") == 1) & F.col("updated_contact_info").isin(sent)))
    key = F.col("updated_contact_info")
    named = {k: name for k, name in shown.items() if k in sent and k != GROUP_CHAT}
    pairs = [F.lit(x) for pair in named.items() for x in pair]
    party = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key
    return mine.withColumn(COUNTERPARTY, F.when(F.col("is_from_me") != 1, F.col("name")).otherwise(party))


def compare_contacts(
    messages: DataFrame, contacts: Sequence[str], party: str | None = None, names: DataFrame | None = None
) -> DataFrame:
    """One row per contact: totals, direction in direct chats, habits, kinds of message.

    `party` names the column to match. Without it and without `counterparty_name`, as in a stored
    table, names come from `names`, a contact table such as `contact_names` gives, or else from
    the received messages.

    Counted per contact and day, then per contact. Both steps combine before their
    shuffle, and hours and week days are a fixed number of counters.
    """
    hour = utc_hour("timestamp")
    tests = {
        "sent_direct": "chat_size = 1 AND is_from_me = 1",
        "received_direct": "chat_size = 1 AND is_from_me = 0",
        "reactions": f"reaction <> '{NO_REACTION}'",
        "links": "link_domain IS NOT NULL",
        "audio_messages": "is_audio_message = 1",
    }
    tests |= {f"_hour{h}": f"hour = {h}" for h in _HOURS}
    party = party or COUNTERPARTY
    if party == COUNTERPARTY and party not in messages.columns:
        mine = _rows_of(messages, contacts, known_names(messages) if names is None else names)
    else:
        mine = messages.where(F.col(party).isin(list(contacts)))
    kept = mine.selectExpr(
        f"{party} AS name", "date", "chat_size", "is_from_me", "reaction", "link_domain", "is_audio_message",
        f"{hour} AS hour",
    )
    days = kept.groupBy("name", "date").agg(
        F.count(F.lit(1)).alias("messages"), *[F.expr(f"count_if({test}) AS {out}") for out, test in tests.items()]
    )
    totals = days.groupBy("name").agg(
        *contact_totals(),
        *[F.expr(f"sum({out}) AS {out}") for out in tests],
        *[F.expr(f"coalesce(sum(messages) FILTER (WHERE dayofweek(date) = {d + 1}), 0L) AS _dow{d}") for d in _DAYS],
    )
    names = ", ".join(f"'{name}'" for name in DAY_NAMES)
    return totals.selectExpr(
        "name", "total_messages", "first_date", "last_date", "active_days", "avg_per_day",
        "sent_direct", "received_direct",
        f"if(active_days > 0, get(array({names}), {_busiest('_dow', _DAYS)}), NULL) AS busiest_day",
        f"if(active_days > 0, {_busiest('_hour', _HOURS)}, NULL) AS busiest_hour",
        "reactions", "links", "audio_messages",
    ).orderBy("name")


def _busiest(prefix: str, numbers: range) -> str:
    """Number of the largest counter, the first one among equals."""
    ranked = ", ".join(f"struct({prefix}{i} AS n, {-i} AS i)" for i in numbers)
    return f"-array_max(array({ranked})).i"


def contact_deep_dive(
    messages: DataFrame, contact: str, party: str | None = None, names: DataFrame | None = None
) -> DataFrame:
    """The comparison row of a single contact."""
    return compare_contacts(messages, [contact], party, names)


def needs_reply(messages: DataFrame, as_of: dt.date, party: str | None = None) -> DataFrame:
    """Direct chats whose last message up to a day, reactions aside, was received; oldest first.

    The last message is a maximum per chat, combined before the shuffle, rather
    than a window over all messages of the chat.
    """
    relevant = messages.where(
        (F.col("chat_size") == 1) & (F.col("reaction") == NO_REACTION) & F.col("timestamp").isNotNull()
        & (F.col("date") <= F.lit(as_of))
    )
    # The last message was received, so its own name is the other party's.
    party = party or (COUNTERPARTY if COUNTERPARTY in messages.columns else "name")
    last = relevant.groupBy("chat_id").agg(
        F.max(F.struct("timestamp", "message_id", "is_from_me", "date", F.col(party).alias("name"))).alias("last")
    )
    waiting = last.where(F.col("last.is_from_me") == 0)
    return waiting.select(
        "chat_id",
        F.col("last.name").alias("name"),
        F.col("last.message_id").alias("message_id"),
        F.col("last.date").cast("string").alias("last_date"),
        F.datediff(F.lit(as_of), F.col("last.date")).alias("days_waiting"),
    ).orderBy(F.desc("days_waiting"), "chat_id")


def group_chats(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Activity per group chat, busiest first.

    Counted per chat and sender first, so that a hot chat arrives combined.
    """
    sender = F.when(F.col("is_from_me") == 0, F.col("handle_id"))
    per_sender = (
        messages.where(F.col("chat_size") > 1)
        .groupBy("chat_id", sender.alias("sender"))
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.max("chat_size").alias("participants"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
        )
    )
    per_chat = per_sender.groupBy("chat_id").agg(
        F.sum("messages").alias("messages"),
        F.max("participants").alias("participants"),
        F.count("sender").alias("senders"),
        F.min("first").cast("string").alias("first_date"),
        F.max("last").cast("string").alias("last_date"),
    )
    ranked = per_chat.orderBy(F.desc("messages"), "chat_id")
    return ranked if limit is None else ranked.limit(limit)


METRICS = ("messages", "sent", "received", "active_contacts", "active_days")
Period = tuple[dt.date, dt.date]


def _period_totals(messages: DataFrame, **periods: Period) -> DataFrame:
    """One row with a column `<metric>_<label>` per metric and period.

    Messages are combined to one row per day, and to one row per contact with a
    mark for every period it is active in. Periods are applied to those.
    """
    inside = {label: F.col("date").between(F.lit(start), F.lit(end)) for label, (start, end) in periods.items()}
    # Only the periods are read, not what lies between them.
    rows = messages.where(functools.reduce(operator.or_, inside.values()))
    days = rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("is_from_me") == 1).alias("sent"),
        F.count_if(F.col("is_from_me") == 0).alias("received"),
    )
    contacts = rows.where(F.col("name").isNotNull()).groupBy("name").agg(
        *[F.max(test).alias(label) for label, test in inside.items()]
    )
    per_day = days.agg(*[
        F.coalesce(F.sum(F.when(test, F.col(metric))), F.lit(0)).alias(f"{metric}_{label}")
        for label, test in inside.items() for metric in ("messages", "sent", "received")
    ], *[F.count_if(test).alias(f"active_days_{label}") for label, test in inside.items()])
    per_contact = contacts.agg(*[F.count_if(label).alias(f"active_contacts_{label}") for label in periods])
    return one_row(per_day, per_contact)


def period_in_review(messages: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row of totals for the days from start to end, both included."""
    totals = _period_totals(messages, only=(start, end))
    return totals.select(
        F.lit(f"{start} to {end}").alias("period"), *[F.col(f"{metric}_only").alias(metric) for metric in METRICS]
    )


def compare_periods(messages: DataFrame, first: Period, second: Period) -> DataFrame:
    """The totals of two periods side by side, with change and change in percent.
    Periods may overlap."""
    totals = _period_totals(messages, first=first, second=second)
    rows = ", ".join(f"'{metric}', {metric}_first, {metric}_second" for metric in METRICS)
    sides = totals.selectExpr(f"stack({len(METRICS)}, {rows}) AS (metric, first_period, second_period)")
    return sides.selectExpr(
        "*",
        "second_period - first_period AS change",
        "try_divide((second_period - first_period) * 100D, first_period) AS change_percent",
    )
