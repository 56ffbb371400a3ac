"""The named analyses of the `messages` table.

Each takes the table, or its daily counts (`read_daily`), and returns a lazy DataFrame. Ties are ordered by the group
key, so results are repeatable.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.functions.labels import NO_EFFECT, NO_REACTION
from msgloom.sources.summaries import COUNT

# Filters on the direction of a message.
DIRECTIONS = {"sent": 1, "received": 0}
# Number and name of the days of a week.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# Rows shown per analysis unless the caller asks for another number.
DISPLAY_LIMITS = {
    "sql": 50, "time_series": 200, "reactions": 100, "effects": 50, "seasonality": 50, "json_rows": 100,
}


def direction(sent: bool = False, received: bool = False) -> str | None:
    """Two flags to one filter; both or neither mean no filter."""
    if sent == received:
        return None
    return "sent" if sent else "received"


def display(result: DataFrame, analysis: str, limit: int | None = None) -> DataFrame:
    """Cap a result for display, inside the plan."""
    return result.limit(DISPLAY_LIMITS[analysis] if limit is None else limit)


def _where(
    messages: DataFrame, condition: Column, contact: str | None = None, year: int | None = None,
    way: str | None = None,
) -> DataFrame:
    kept = messages.where(condition)
    if contact is not None:
        kept = kept.where(F.col("name") == contact)
    if year is not None:
        kept = kept.where(F.col("year") == year)
    if way is not None:
        kept = kept.where(F.col("is_from_me") == DIRECTIONS[way])
    return kept


def _number(rows: DataFrame, condition: Column | None = None) -> Column:
    """How many messages, of those that meet a condition: rows, or what the rows of daily counts stand for."""
    if COUNT in rows.columns:
        kept = F.col(COUNT) if condition is None else F.when(condition, F.col(COUNT)).otherwise(0)
        return F.coalesce(F.sum(kept), F.lit(0))
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def _counted(rows: DataFrame, *keys: str, count: str) -> DataFrame:
    """Messages per key. Rows of daily counts may cancel out, and then the key has none."""
    counts = rows.groupBy(*keys).agg(_number(rows).alias(count))
    return counts.where(F.col(count) != 0) if COUNT in rows.columns else counts


def _ranking(rows: DataFrame, *keys: str, count: str, limit: int | None = None) -> DataFrame:
    """Count per key, most frequent first."""
    order = [F.desc(count), *[F.asc_nulls_first(k) for k in keys]]
    ranked = _counted(rows, *keys, count=count).orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def top_contacts(
    messages: DataFrame, limit: int = 10, year: int | None = None, direct_only: bool = False, way: str | None = None
) -> DataFrame:
    """Contacts with the most messages, optionally in direct chats only."""
    named = _where(messages, F.col("name").isNotNull(), year=year, way=way)
    if direct_only:
        named = named.where(F.col("chat_size") == 1)
    return _ranking(named, "name", count="message_count", limit=limit)


def time_series(
    messages: DataFrame,
    contact: str | None = None,
    window: int = 28,
    start: dt.date | None = None,
    end: dt.date | None = None,
    year: int | None = None,
    way: str | None = None,
    fill_gaps: bool = False,
) -> DataFrame:
    """Messages per day, and their mean over the last `window` days that have messages.

    `year` stands for its first to last day and excludes `start` and `end`. With
    `fill_gaps` days without messages count as zero.
    """
    if year is not None:
        if start is not None or end is not None:
            raise ValueError("give either year, or start and end")
        start, end = dt.date(year, 1, 1), dt.date(year, 12, 31)
    rows = _where(messages, F.col("date").isNotNull(), contact=contact, way=way)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    daily = _counted(rows, "date", count="messages")
    if fill_gaps:
        spine = daily.agg(F.min("date").alias("_from"), F.max("date").alias("_to")).where(F.col("_from").isNotNull())
        days = spine.select(F.explode(F.sequence("_from", "_to")).alias("date"))
        daily = days.join(daily, "date", "left").select("date", F.coalesce("messages", F.lit(0)).alias("messages"))
    # One row per calendar day at most, so the single window partition stays small.
    recent = Window.orderBy("date").rowsBetween(-max(window - 1, 0), Window.currentRow)
    averaged = daily.select("date", "messages", F.avg("messages").over(recent).alias("rolling_avg"))
    return averaged.orderBy("date").select(F.col("date").cast("string").alias("date"), "messages", "rolling_avg")


def reactions(
    messages: DataFrame, contact: str | None = None, year: int | None = None, way: str | None = None
) -> DataFrame:
    return _ranking(
        _where(messages, F.col("reaction") != NO_REACTION, contact, year, way), "reaction", count="count"
    )


def effects(messages: DataFrame, year: int | None = None) -> DataFrame:
    return _ranking(_where(messages, F.col("message_effect") != NO_EFFECT, year=year), "message_effect", count="count")


def links(messages: DataFrame, limit: int = 20) -> DataFrame:
    """Most shared link domains."""
    return _ranking(messages.where(F.col("link_domain").isNotNull()), "link_domain", count="count", limit=limit)


def _split_or_total(rows: DataFrame, split: bool) -> list[Column]:
    if not split:
        return [_number(rows).alias("messages")]
    return [_number(rows, F.col("is_from_me") == value).alias(way) for way, value in DIRECTIONS.items()]


def seasonality_dow(messages: DataFrame, way: str | None = None, split: bool = False) -> DataFrame:
    """Messages per day of the week, or sent and received ones with `split`."""
    rows = _where(messages, F.col("timestamp").isNotNull(), way=way)
    per_day = rows.groupBy((F.dayofweek("date") - 1).alias("dow_number")).agg(*_split_or_total(rows, split))
    names = F.array(*map(F.lit, DAY_NAMES))
    counts = [c for c in per_day.columns if c != "dow_number"]
    return per_day.orderBy("dow_number").select(
        "dow_number", F.get(names, F.col("dow_number")).alias("day_of_week"), *counts
    )


def seasonality_month(messages: DataFrame, way: str | None = None, split: bool = False) -> DataFrame:
    """Messages per month of the year, or sent and received ones with `split`."""
    rows = _where(messages, F.col("month").isNotNull(), way=way)
    return rows.groupBy("month").agg(*_split_or_total(rows, split)).orderBy("month")


def seasonality(messages: DataFrame, kind: str = "dow", way: str | None = None, split: bool = False) -> DataFrame:
    kinds = {"dow": seasonality_dow, "month": seasonality_month}
    if kind not in kinds:
        raise ValueError(f"kind must be one of {sorted(kinds)}, not {kind!r}")
    return kinds[kind](messages, way, split)


def search_contacts(messages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Contacts whose name or key contains the text, in any case; no wildcards."""
    needle = F.lower(F.lit(query))

    def has(column: str) -> Column:
        return F.contains(F.lower(F.coalesce(column, F.lit(""))), needle)

    either = F.col("name").isNotNull() | F.col("contact_info").isNotNull()
    hits = messages.where(either & (has("name") | has("contact_info")))
    return _ranking(hits, "name", "contact_info", count="message_count", limit=limit)


def two_decimals(part: Column, whole: Column) -> Column:
    """part / whole rounded half up to two decimals, decided in integers."""
    scaled = F.call_function("div", part * 200 + whole, whole * 2)
    return scaled.cast("double") / 100


def contact_totals() -> list[Column]:
    """Aggregates over one row per contact and day with a column `messages`."""
    span = F.datediff(F.max("date"), F.min("date")).cast("long") + 1
    total = F.sum("messages")
    return [
        total.alias("total_messages"),
        F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"),
        F.count("date").alias("active_days"),
        two_decimals(total, span).alias("avg_per_day"),
    ]


def contact_stats(messages: DataFrame, contact: str | None = None, limit: int = 50) -> DataFrame:
    """Totals per contact, with first and last day, active days and mean per day.

    Rows are counted per contact and day first: a contact with a third of all
    messages reaches the second aggregate as one row per day.
    """
    rows = _where(messages, F.col("name").isNotNull(), contact=contact)
    days = _counted(rows, "name", "date", count="messages")
    return days.groupBy("name").agg(*contact_totals()).orderBy(F.desc("total_messages"), "name").limit(limit)


def group_message_count(messages: DataFrame) -> DataFrame:
    """How many messages stand in group chats."""
    return messages.where(F.col("chat_size") > 1).agg(_number(messages).alias("group_messages"))

