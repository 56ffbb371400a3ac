"""Connected components of a graph given as links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch


def _toward(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Smallest neighbour of each node, itself included. Written, so that the join with it
    has a shuffle of its own on both sides and a hub can be split."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return scratch.table(least, name)


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """`node`, `component`: for every node of `links` (u, v) the smallest reachable one.

    Alternates the two star steps of Kiveris et al. (2014): first every node hands its
    larger neighbours to its smallest one, then its smaller ones, until the links are
    stars. The number of links never grows; nothing is gathered but counts. NULL ends
    and loops link nothing.
    """
    links = links.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    stars = scratch.table(links, f"{label}-0")
    before, turn = None, 0
    while True:
        # One row: a fingerprint of the links.
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if state == before:
            break
        before, turn = state, turn + 1
        both = stars.union(stars.selectExpr("v AS u", "u AS v"))
        least = _toward(both, scratch, f"{label}-large-{turn}")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        large = scratch.table(large, f"{label}-mid-{turn}")
        least = _toward(large, scratch, f"{label}-small-{turn}")
        small = large.join(least, "u").where("v > m").selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
        made = scratch.table(small.where("u <> v").distinct(), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}", *[f"{label}-{x}-{turn}" for x in ("large", "mid", "small")])
        stars = made
    roots = stars.selectExpr("v AS node", "v AS component").distinct()
    return stars.selectExpr("u AS node", "v AS component").union(roots)
