"""Explicit schemas of the raw tables, the `messages` table and the run log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_LONG, _BYTE, _STR = T.LongType(), T.ByteType(), T.StringType()

MESSAGE = _struct(
    ("ROWID", _LONG, False),
    ("text", _STR, True),
    ("attributedBody", T.BinaryType(), True),
    ("handle_id", _LONG, True),
    ("is_from_me", _LONG, True),
    ("date", _LONG, True),
    ("associated_message_type", _LONG, True),
    ("expressive_send_style_id", _STR, True),
    ("thread_originator_guid", _STR, True),
    ("balloon_bundle_id", _STR, True),
    ("is_audio_message", _LONG, True),
)
HANDLE = _struct(("ROWID", _LONG, False), ("id", _STR, False))
CHAT_MESSAGE_JOIN = _struct(("chat_id", _LONG, False), ("message_id", _LONG, False))
CHAT_HANDLE_JOIN = _struct(("chat_id", _LONG, False), ("handle_id", _LONG, False))

RAW = {
    "message": MESSAGE,
    "handle": HANDLE,
    "chat_message_join": CHAT_MESSAGE_JOIN,
    "chat_handle_join": CHAT_HANDLE_JOIN,
}

CONTACTS = _struct(("contact_key", _STR, True), ("name", _STR, True))
ADDRESS_BOOK = _struct(
    ("contact_id", _LONG, False),
    ("given_name", _STR, True),
    ("family_name", _STR, True),
    ("phones", T.ArrayType(_STR), True),
    ("emails", T.ArrayType(_STR), True),
)

# The analytic table: names, order and types are fixed.
SCHEMA_VERSION = 2
MESSAGES = _struct(
    ("message_id", _LONG, False),
    ("is_from_me", _BYTE, False),
    ("text", _STR, True),
    ("inferred_text", _STR, True),
    ("text_combined", _STR, True),
    ("body_text", _STR, True),
    ("handle_id", _LONG, False),
    ("contact_info", _STR, True),
    ("updated_contact_info", _STR, True),
    ("chat_id", _LONG, True),
    ("chat_members_handles", _STR, True),
    ("chat_members_contact_info", _STR, True),
    ("chat_size", _LONG, False),
    ("is_audio_message", _BYTE, False),
    ("message_effect", _STR, False),
    ("reaction", _STR, False),
    ("is_thread_reply", _BYTE, False),
    ("link_domain", _STR, True),
    ("name", _STR, True),
    ("timestamp", T.TimestampType(), True),
    ("date", T.DateType(), True),
    ("month", _BYTE, True),
    ("year", T.ShortType(), True),
)

INGEST_RUNS = _struct(
    ("run_id", _STR, False),
    ("generation", _LONG, False),
    ("mode", _STR, False),
    ("since", _LONG, False),
    ("last_message_id", _LONG, False),
    ("rows_written", _LONG, False),
    ("total_messages", _LONG, False),
    ("schema_version", T.IntegerType(), False),
    ("contacts_resolved", _LONG, False),
    ("finished_at", T.TimestampType(), False),
)
# One row per data file of the stored table: its path below the rows, and what lies in it.
DATA_FILES = _struct(
    ("path", _STR, False),
    ("bytes", _LONG, False),
    ("rows", _LONG, False),
    ("min_id", _LONG, True),
    ("max_id", _LONG, True),
    ("min_date", T.DateType(), True),
    ("max_date", T.DateType(), True),
    ("max_timestamp", T.TimestampType(), True),
)

# Daily counts of the stored table.
DAILY = _struct(
    ("name", _STR, True),
    ("contact_info", _STR, True),
    ("date", T.DateType(), True),
    ("is_from_me", _BYTE, False),
    ("chat_size", _LONG, False),
    ("reaction", _STR, False),
    ("message_effect", _STR, False),
    ("link_domain", _STR, True),
    ("n_messages", _LONG, False),
    ("last_id", _LONG, True),
)


class RawTables(NamedTuple):
    """The four source tables, as DataFrames of the schemas above."""

    message: DataFrame
    handle: DataFrame
    chat_message_join: DataFrame
    chat_handle_join: DataFrame
