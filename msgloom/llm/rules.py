"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger keeps for each document its measurements and
one long whose bit b is set if rule b fails. Policies are versioned sets of rules; applying
one is a mask on the bits, and what each rule does in it is counted from the different bit
patterns alone, so neither reads a text again.

All of it is SQL over one row: words are an array, and the windows that occur twice come
from sorting one long for each window, the hash above and the place below, with words
compared where neighbours share a hash.

NULL and empty texts have no words: their measurements are 0 and they fail as too short.
Rows that repeat a doc_id, or lack it, stay separate. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    bit: int
    name: str
    fails: str  # SQL over the measurements


# What counts as a sign, and white space.
SIGNS = "#*$%&|<>"
SPACE = r"\x20\x09-\x0D"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "signs", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars > 10 * n_words OR word_chars < 3 * n_words"),
    Rule(5, "capitals", "100 * n_capitals > 30 * word_chars"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_words"),
    "v1": ("too_short", "repeated_words", "signs", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def bound(value: str, name: str, body: str) -> str:
    """SQL that computes `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """SQL for the number of words within three-word windows that occur twice or more.

    A window becomes (hash << b) | place, with as many bits b as places need. The repeated
    places, in order, cover three words each less what the one before covers already."""
    same = "w[{0}] = w[{1}] AND w[{0} + 1] = w[{1} + 1] AND w[{0} + 2] = w[{1} + 2]"
    place = "CAST({0} & (shiftleft(1L, b) - 1) AS INT)"

    def meets(other: str) -> str:
        words_equal = same.format(place.format("k"), place.format(other))
        return f"(shiftright({other}, b) = shiftright(k, b) AND {words_equal})"

    windows = (
        "sort_array(transform(sequence(0, size(w) - 3), "
        "i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | CAST(i AS BIGINT)))"
    )
    near = f"(j > 0 AND {meets('s[greatest(j - 1, 0)]')}) OR (j + 1 < size(s) AND {meets('s[least(j + 1, size(s) - 1)]')})"
    repeated = f"sort_array(transform(filter(s, (k, j) -> {near}), k -> {place.format('k')}))"
    covered = f"""aggregate({repeated}, struct(0L AS n, -3 AS last),
        (acc, p) -> struct(acc.n + least(3, p - acc.last) AS n, p AS last), acc -> acc.n)"""
    bits = "CAST(ceil(log2(size(w) + 1)) AS INT)"
    count = bound(bits, "b", bound(windows, "s", covered))
    return bound(words, "w", f"CASE WHEN size(w) < 4 THEN 0L ELSE {count} END")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of each text."""
    text = "coalesce(text, '')"
    words = f"array_remove(split({text}, r'[{SPACE}]+'), '')"
    lines = f"filter(split({text}, '\\n'), l -> l RLIKE r'[^{SPACE}]')"
    blank = r"' \t\n\u000b\u000c\r'"

    def without(chars: str) -> str:
        return f"CAST(length({text}) - length(translate({text}, {chars}, '')) AS BIGINT)"

    counted = bound(lines, "l", "struct(size(l) AS n, size(l) - size(array_distinct(l)) AS dup)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").selectExpr(
        "doc_id",
        bound(words, "w", f"struct(CAST(size(w) AS BIGINT) AS n, {repeat_words('w')} AS repeats)") + " AS words",
        f"CAST(length(translate({text}, {blank}, '')) AS BIGINT) AS word_chars",
        f"{without(repr(SIGNS))} AS n_symbols",
        f"{without(repr(CAPITALS))} AS n_capitals",
        f"{counted} AS lines",
    )
    # `words` and `lines` are used twice below: as columns of their own they are computed once.
    return rows.selectExpr(
        "doc_id", "words.n AS n_words", "word_chars", "n_symbols", "CAST(lines.n AS BIGINT) AS n_lines",
        "CAST(lines.dup AS BIGINT) AS n_dup_lines", "words.repeats AS n_repeat_words", "n_capitals",
    )


def ledger(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements, and `failures`: the bits of the rules that fail."""
    bits = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END" for r in rules) or "0L"
    return measured(docs).selectExpr("*", f"{bits} AS failures")


def mask(policy: str | Iterable[str], rules: Iterable[Rule] = RULES) -> int:
    """The bits of a policy, given by its version or as names of rules."""
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    known = {r.name: 1 << r.bit for r in rules}
    return sum(known[name] for name in set(names))


def passes(policy: str | Iterable[str], rules: Iterable[Rule] = RULES) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy, rules))) == 0


def apply_policy(rows: DataFrame, policy: str | Iterable[str], rules: Iterable[Rule] = RULES) -> DataFrame:
    """A ledger with `kept`: no rule of the policy fails."""
    return rows.withColumn("kept", passes(policy, rules))


def ablation(rows: DataFrame, policy: str | Iterable[str], rules: Iterable[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that
    the policy keeps with and without it.

    Ledger rows are counted by their bits under the mask; all figures come from these counts.
    """
    wanted = mask(policy, rules)
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(wanted)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                               for r in rules if wanted >> r.bit & 1])).alias("of")
    counted = patterns.select("bits", "n", each).select("bits", "n", "of.*")
    return counted.groupBy("rule", "bit").agg(
        F.expr("sum(CASE WHEN bits & bit <> 0 THEN n ELSE 0 END)").alias("failed"),
        F.expr("sum(CASE WHEN bits = bit THEN n ELSE 0 END)").alias("failed_alone"),
        F.expr("sum(CASE WHEN bits = 0 THEN n ELSE 0 END)").alias("kept"),
        F.expr("sum(CASE WHEN bits & ~bit = 0 THEN n ELSE 0 END)").alias("kept_without"),
    ).drop("bit")
