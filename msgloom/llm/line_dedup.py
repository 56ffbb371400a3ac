"""Removal of lines that many documents share, in Spark's own functions.

Texts are split at line feeds. A line's key is the line without white space at its ends, with
A-Z in lower case. Keys of enough characters are exploded with their positions and hashed to 128
bits; documents are counted per hash, different doc_ids only. Hashes found in enough documents lose all
their lines except in the document of the largest doc_id. The dropped positions of a document meet its
text once, by doc_id and a hash of the text, and the other lines are put together by position.

Counting combines before its shuffle. Both joins are between tables that have been written and a
scan, so that adaptive execution splits a line that a third of all documents hold. A document's
dropped positions are as many as its lines; no other group is gathered.

A NULL or empty text is one empty line, which has no key and stays. Rows that share a doc_id are one
document: each keeps or loses lines like the other. Rows without doc_id count as one document, which
is never the largest unless no other holds the line. Repeated rows come out repeated. An empty table
gives none, and all columns of the input are kept beside those added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch

#: Characters of the keys that may be dropped, and documents that make a line shared.
MIN_CHARACTERS = 40
MIN_DOCUMENTS = 5
# White space at the ends of a line, and the letters that change case.
SPACE = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = "split(coalesce({}, ''), '\\n', -1)"
_TEXT_KEY = "xxhash64(coalesce(text, ''))"


def _key(line: str) -> str:
    return f"btrim({line}, '{SPACE}')"


def keyed_lines(docs: DataFrame, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """doc_id, text_key, position and hash of every line that may be dropped."""
    lines = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", f"{_TEXT_KEY} AS text_key", f"posexplode({LINES.format('text')}) AS (position, line)")
    keys = lines.selectExpr("doc_id", "text_key", "position", f"{_key('line')} AS key").where(f"length(key) >= {min_characters}")
    return keys.selectExpr("doc_id", "text_key", "position", f"unhex(md5(CAST(translate(key, '{CAPITALS}', '{SMALL}') AS BINARY))) AS line")


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Hashes found in enough documents, and the largest doc_id that holds each."""
    counted = lines.groupBy("line").agg(
        F.count_distinct("doc_id").alias("ids"), F.max(F.col("doc_id").isNull()).alias("unnamed"), F.max("doc_id").alias("keeper")
    )
    return counted.where(f"ids + CAST(unnamed AS INT) >= {min_documents}").select("line", "keeper")


def drop_shared_lines(
    docs: DataFrame, scratch: Scratch, min_characters: int = MIN_CHARACTERS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """The documents with `kept_text`, `n_lines` before dropping, and `n_dropped`. Columns of
    these names in the input give way."""
    lines = keyed_lines(docs, min_characters)
    shared = scratch.table(shared_lines(lines, min_documents), "shared")
    gone = lines.join(shared, "line").where("NOT doc_id <=> keeper")
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("gone"))
    gone = scratch.table(gone, "gone")
    # Columns of the input travel in one, so that their names clash with nothing.
    added = {"kept_text", "n_lines", "n_dropped"}
    columns = [c for c in docs.columns if c not in added]
    texts = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.expr("CAST(doc_id AS LONG) AS id"), F.expr(f"{_TEXT_KEY} AS key")
    )
    # A merge at every size, so that the disk it takes follows the input.
    matched = texts.join(gone.hint("merge"), F.expr("id <=> doc_id AND key = text_key"), "left").select(
        "row", "gone", F.expr(LINES.format("row.text")).alias("lines")
    )
    # Dropping is by position: a set difference of numbers keeps their order.
    kept = """if(gone IS NULL, coalesce(row.text, ''), array_join(transform(
        array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i)), '\\n'))"""
    return matched.select(
        *[F.col(f"row.`{c}`") for c in columns],
        F.expr(kept).alias("kept_text"),
        F.expr("CAST(size(lines) AS LONG)").alias("n_lines"),
        F.expr("CAST(if(gone IS NULL, 0, size(gone)) AS LONG)").alias("n_dropped"),
    )
