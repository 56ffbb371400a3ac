"""Building the contact map: one name per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.functions.keys import contact_key


def first_per_key(entries: DataFrame) -> DataFrame:
    """Keep the first name of every key. A partial aggregate, so a key that many
    entries share is combined before the shuffle."""
    return entries.groupBy("contact_key").agg(F.min_by("name", "ord").alias("name"))


def conflicts(entries: DataFrame) -> DataFrame:
    """Keys with more than one name: the name kept and how many there are."""
    per_name = entries.groupBy("contact_key", "name").agg(F.min("ord").alias("ord"))
    per_key = per_name.groupBy("contact_key").agg(
        F.min_by("name", "ord").alias("kept"), F.count(F.lit(1)).alias("names")
    )
    return per_key.where(F.col("names") > 1)


def resolve(automatic: DataFrame, overrides: DataFrame) -> DataFrame:
    """Merge two contact maps; overrides win."""
    ranked = automatic.select("contact_key", "name", F.lit(0).alias("rank")).unionByName(
        overrides.select("contact_key", "name", F.lit(1).alias("rank"))
    )
    return ranked.groupBy("contact_key").agg(F.max_by("name", F.struct("rank", "name")).alias("name"))


def one_name_per_key(contacts: DataFrame, normalize: bool = False) -> DataFrame:
    """The map with every key once, so that a lookup never multiplies rows; keys as
    written or in normalised spelling. If keys fall together the smallest name stays."""
    key = contact_key("contact_key") if normalize else "contact_key"
    spelled = contacts.selectExpr(f"{key} AS contact_key", "name")
    return spelled.groupBy("contact_key").agg(F.min("name").alias("name"))
