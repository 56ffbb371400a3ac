"""Timings of the headline queries, as one JSON line.

    BENCH_SF_DIR   folder of the input tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     warm runs per analysis, the median counts (default 3)

Ingest is timed once per kind: a full build of the derived raw tables, and a
refresh with the last percent of the messages. Every analysis then runs on the
stored dataset, as a user would run it.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from msgloom.functions.body_text import inferred_text  # noqa: E402
from msgloom.plans import analyses as A  # noqa: E402
from msgloom.plans import conversations as K  # noqa: E402
from msgloom.plans import ingest, sqlview  # noqa: E402
from msgloom.session import configure, scratch_dir  # noqa: E402
from msgloom.sources import derived, stored  # noqa: E402
from msgloom.sources.raw import high_watermark, read_raw  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
_FEBRUARY = dt.date(2024, 2, 1)
_WEEKS = (dt.date(2024, 1, 8), dt.date(2024, 1, 14)), (dt.date(2024, 1, 15), dt.date(2024, 1, 21))


def analyses(spark: SparkSession, messages: DataFrame) -> dict:
    return {
        "top_contacts": lambda: A.top_contacts(messages),
        "top_contacts_filtered": lambda: A.top_contacts(messages, year=2024, direct_only=True, way="received"),
        "time_series": lambda: A.time_series(messages),
        "time_series_contact": lambda: A.time_series(messages, contact="Customer#000000017", year=2024),
        "reactions": lambda: A.reactions(messages),
        "effects": lambda: A.effects(messages),
        "links": lambda: A.links(messages),
        "seasonality_dow": lambda: A.seasonality_dow(messages),
        "seasonality_month": lambda: A.seasonality_month(messages),
        "search_contacts": lambda: A.search_contacts(messages, "customer#00000001"),
        "contact_stats": lambda: A.contact_stats(messages),
        "group_message_count": lambda: A.group_message_count(messages),
        "sql": lambda: sqlview.query(spark, "SELECT year, month, COUNT(*) AS n FROM messages GROUP BY year, month"),
        "contact_deep_dive": lambda: K.contact_deep_dive(messages, "Customer#000000017", party="name"),
        "needs_reply": lambda: K.needs_reply(messages, _FEBRUARY, party="name"),
        "group_chats": lambda: K.group_chats(messages, 20),
        "compare_periods": lambda: K.compare_periods(messages, *_WEEKS),
    }


def seconds(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("msgloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    folder = scratch_dir(spark, "bench")
    source = derived.raw_from_events(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    people = derived.contacts_from_customers(spark.read.parquet(f"{SF_DIR}/customer.parquet"))
    for name, table in source._asdict().items():
        table.write.parquet(f"{folder}/raw/{name}")
    people.write.parquet(f"{folder}/contacts")

    raw = read_raw(spark, f"{folder}/raw")
    contacts = spark.read.parquet(f"{folder}/contacts")
    newest = high_watermark(raw.message, id_column="ROWID").first()["watermark"]
    early = newest - newest // 100
    older = raw._replace(message=raw.message.where(F.col("ROWID") <= early))

    timings = {
        "ingest_warm_up": seconds(lambda: ingest.sync_files(spark, f"{folder}/raw", contacts, f"{folder}/warm")),
        "ingest_full": seconds(lambda: ingest.sync(spark, older, contacts, f"{folder}/dataset")),
        "ingest_refresh": seconds(lambda: ingest.sync(spark, raw, contacts, f"{folder}/dataset")),
    }
    warm_up = timings.pop("ingest_warm_up")
    blobs = raw.message.where(F.col("attributedBody").isNotNull()).selectExpr(f"{inferred_text('attributedBody')} AS t")
    steps = {"body_text": lambda: blobs.agg(F.count("t"), F.sum(F.length("t")))}

    messages = stored.read_messages(spark, f"{folder}/dataset")
    sqlview.register(messages)
    steps |= analyses(spark, messages)
    for name, build in steps.items():
        build().collect()
        timings[name] = statistics.median(seconds(lambda build=build: build().collect()) for _ in range(RUNS))

    rows = messages.count()
    print(json.dumps({
        "metric": "total seconds of ingest and all analyses, median of warm runs",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in timings.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows": rows,
        "ingest_full_rows_per_second": round(early / timings["ingest_full"]),
        "first_ingest_seconds": round(warm_up, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
