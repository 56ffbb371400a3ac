"""Search for contacts by an index of character triples.

    search/<run>/    triple, name, contact key; sorted by triple

The index covers the different (name, contact key) pairs of the daily counts, not the messages. A text of
three characters or more is looked up by all its triples; pairs that hold them all are candidates, which
the search itself then confirms. Parts loaded after the index was made are searched directly, so that
results never depend on it. Making it again is a step of upkeep; loads stay as cheap as without it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.plans.analyses import search_contacts
from msgloom.schemas import DAILY
from msgloom.sources.commits import append_commit, carried, current_commit, run_row
from msgloom.sources.stored import check_schema
from msgloom.sources.summaries import SUMMARIES, read_daily

SEARCH = "search"
_INDEX = "triple string, name string, contact_info string"
_PAIR = ("name", "contact_info")


def _triples(column: str) -> str:
    text = f"lower(coalesce({column}, ''))"
    return f"if(length({text}) < 3, array(), transform(sequence(1, length({text}) - 2), i -> substr({text}, i, 3)))"


def contact_triples(pairs: DataFrame) -> DataFrame:
    """One row per pair and different triple in its name or key."""
    every = f"explode(array_distinct(concat({_triples('name')}, {_triples('contact_info')}))) AS triple"
    return pairs.select(*_PAIR).distinct().selectExpr(every, *_PAIR)


def _pairs(spark: SparkSession, dataset: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "name string, contact_info string")
    return spark.read.schema(DAILY).parquet(*[f"{dataset}/{SUMMARIES}/{p}" for p in parts]).select(*_PAIR)


def index_contacts(spark: SparkSession, dataset: str) -> DataFrame:
    """Make the index over all contacts of the current table. Returns the newest run, one row. A triple
    that very many contacts share is spread over several files."""
    commit = current_commit(spark, dataset)
    check_schema(dataset, commit)
    run_id = uuid.uuid4().hex
    rows = contact_triples(_pairs(spark, dataset, commit["summaries"]))
    rows = rows.repartitionByRange("triple", *_PAIR).sortWithinPartitions("triple", *_PAIR)
    rows.select("triple", *_PAIR).write.parquet(f"{dataset}/{SEARCH}/{run_id}")
    made = {"run_id": run_id, "mode": "index", "rows_written": 0, "search": {"run": run_id, "covers": commit["summaries"]}}
    return run_row(spark, append_commit(spark, dataset, commit, **{**carried(commit), **made}))


def candidates(spark: SparkSession, dataset: str, commit: dict, text: str) -> DataFrame | None:
    """Pairs that can hold a text in lower case; None if the index cannot tell."""
    index = commit.get("search")
    if index is None or len(text) < 3:
        return None
    triples = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    held = spark.read.schema(_INDEX).parquet(f"{dataset}/{SEARCH}/{index['run']}").where(F.col("triple").isin(triples))
    # Triples of a pair are different ones, so their number tells.
    full = held.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(triples)).select(*_PAIR)
    rest = _pairs(spark, dataset, [p for p in commit["summaries"] if p not in index["covers"]])
    return full.unionByName(rest).distinct()


def search_stored(spark: SparkSession, dataset: str, query: str, limit: int = 20) -> DataFrame:
    """`search_contacts` over a stored table: same rows, from the index and the daily counts. Without
    an index, or for fewer than three characters, all pairs are searched."""
    commit = current_commit(spark, dataset)
    daily = read_daily(spark, dataset)
    # One value, in Spark's own lower case.
    text = spark.range(1).select(F.lower(F.lit(query)).alias("t")).first()["t"]
    found = candidates(spark, dataset, commit, text)
    if found is not None:
        found = found.selectExpr("name AS _name", "contact_info AS _key")
        same = F.col("name").eqNullSafe(F.col("_name")) & F.col("contact_info").eqNullSafe(F.col("_key"))
        daily = daily.join(found, same, "left_semi")
    return search_contacts(daily, query, limit)
