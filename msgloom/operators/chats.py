"""Chats: which one a message belongs to, and who takes part in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_chat(chat_message_join: DataFrame) -> DataFrame:
    """One chat per message, the smallest id, so that no message is duplicated."""
    return chat_message_join.groupBy("message_id").agg(F.min("chat_id").alias("chat_id"))


def participants(chat_handle_join: DataFrame, handle: DataFrame) -> DataFrame:
    """Chat, handle and contact of every participant whose handle is known."""
    known = handle.selectExpr("ROWID AS handle_id", "id AS contact_info")
    return chat_handle_join.join(known, "handle_id").select("chat_id", "handle_id", "contact_info")


def chat_members(members: DataFrame) -> DataFrame:
    """Per chat: size, its only participant if there is one, and the participants
    as JSON lists ordered by handle.

    Lists are built once per chat here, never once per message. They must hold
    every participant, since they are cells of the result; the size and the only
    participant are partial aggregates and do not depend on them.
    """
    grouped = members.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("chat_size"),
        F.min("contact_info").alias("smallest"),
        F.expr("array_sort(collect_list(struct(handle_id, contact_info)))").alias("members"),
    )
    return grouped.selectExpr(
        "chat_id",
        "chat_size",
        "CASE WHEN chat_size = 1 THEN smallest END AS only_member",
        "to_json(members.handle_id) AS chat_members_handles",
        "to_json(members.contact_info) AS chat_members_contact_info",
    )
