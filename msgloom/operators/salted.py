"""A lookup join that spreads hot keys over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SALTS = 8
#: Shares of a key that is known to be on very many rows.
COMMON_SALTS = 512


def salted_left_join(
    rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, salts: int = SALTS, common: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Left join to a table with one row per key.

    Rows of a key are divided by a hash of `spread_by`; the lookup side, which is
    much smaller, is repeated once per share. Rows without a key match nothing and are
    spread over all tasks. `common` is the SQL of a key that is known to be on very many
    rows: it alone gets many more shares. The join then has its own shuffle on
    both sides, which also lets adaptive execution split what is still too large.

    A repeated lookup is never broadcast: adaptive execution would go by its size before it
    is repeated, and every executor would hold it `salts` times. With `few`, for a lookup known to
    have few rows, and otherwise no strategy is forced.
    """
    spread = f"xxhash64({spread_by})"
    last = str(salts - 1)
    share = f"pmod({spread}, {salts})"
    if common is not None:
        last = f"if({key} = {common}, {COMMON_SALTS - 1}, {last})"
        share = f"if({key} = {common}, pmod({spread}, {COMMON_SALTS}), {share})"
    left = rows.selectExpr("*", f"if({key} IS NULL, {spread}, {share}) AS _salt")
    right = lookup.selectExpr("*", f"explode(sequence(0L, CAST({last} AS BIGINT))) AS _salt")
    return left.join(right if few or salts == 1 else right.hint("merge"), [key, "_salt"], "left").drop("_salt")


def known_small(table: DataFrame) -> bool:
    """Whether Spark's estimate, which comes from its input files alone, is below the size for a broadcast."""
    most = int(table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return most > 0 and not table.isStreaming and int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most
