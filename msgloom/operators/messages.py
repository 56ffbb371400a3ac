"""The `messages` table: raw rows joined with senders and chats, and enriched.

Shuffle design. Message rows with their texts are the large side and are shuffled once, by
message id, to meet their chat and their sender. Before that the binary text column is
replaced by the text found in it. Everything else is joined where it is small: contact
names to handles, handles to (message id, handle id) pairs, and chat members to
(message id, chat id) pairs. The message id is unique, so that the last joins have no hot
key, and their output is already in message id order for the writer. No broadcast is forced:
Spark broadcasts handles when they are small enough and else splits hot ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.functions.body_text import inferred_text
from msgloom.functions.keys import contact_key
from msgloom.functions.labels import effect_label, reaction_label
from msgloom.functions.links import link_domain
from msgloom.functions.times import unix_seconds, utc_date
from msgloom.operators.blocks import BLOCK, IdBlocks
from msgloom.operators.chats import chat_members, first_chat, participants
from msgloom.operators.contacts import one_name_per_key
from msgloom.operators.salted import known_small, salted_left_join
from msgloom.schemas import MESSAGES, RawTables
from msgloom.sources.raw import rows_above

GROUP_CHAT = "group-chat"
COUNTERPARTY = "counterparty_name"

_SENDER = {"contact_info", "updated_contact_info", "name", COUNTERPARTY}
_MEMBERS = {"chat_size", "chat_members_handles", "chat_members_contact_info", "updated_contact_info", COUNTERPARTY}
_CHAT = _MEMBERS | {"chat_id"}
_TEXTS = {"text", "inferred_text", "text_combined", "body_text"}


def build_messages(
    raw: RawTables,
    contacts: DataFrame,
    since: int = 0,
    columns: Sequence[str] | None = None,
    normalize: bool = False,
    blocks: IdBlocks | None = None,
) -> DataFrame:
    """All messages above row id `since`, one row each, with the given columns.

    `columns` defaults to the full table; joins that no wanted column needs are
    left out. `counterparty_name` may be added: the name of the other party, also
    on messages sent in a direct chat. Contact keys are matched as written, or in
    normalised spelling with `normalize`.

    `blocks` is for writers of the full table: the shuffle then puts each block of ids into
    one partition, ordered by id, under `placement_by_block`.
    """
    wanted = list(columns or MESSAGES.fieldNames())
    raw = rows_above(raw, since)
    by = [BLOCK, "message_id"] if blocks else ["message_id"]

    def placed(df: DataFrame) -> DataFrame:
        return blocks.place(df) if blocks else df

    rows = placed(_own_columns(raw.message))
    if _SENDER & set(wanted):
        looked_up = senders(raw.handle, contacts, normalize)
        if _TEXTS & set(wanted) and _CHAT & set(wanted):
            # Texts are shuffled anyway, by message id: look senders up on narrow rows and
            # meet them there. Messages without a handle never enter the lookup.
            ids = raw.message.where("handle_id <> 0").selectExpr("ROWID AS message_id", "handle_id AS _handle")
            rows = rows.join(placed(ids.join(looked_up, "_handle").drop("_handle")), by, "left")
        else:
            # Handle 0 is none and may be on half of all rows.
            rows = salted_left_join(rows, looked_up, "_handle", "message_id", salts=1, common="0")
    if _CHAT & set(wanted):
        with_members = bool(_MEMBERS & set(wanted))
        rows = rows.join(placed(placement(raw, contacts, normalize, with_members, few=since > 0)), by, "left")
    if blocks:
        rows = rows.sortWithinPartitions(*by)
    return rows.selectExpr(*[f"{_DERIVED.get(name, name)} AS {name}" for name in wanted])


def senders(handle: DataFrame, contacts: DataFrame, normalize: bool = False) -> DataFrame:
    """Handle, its contact key as written, and the name to show for it."""
    keyed = handle.selectExpr("ROWID AS _handle", "id AS contact_info")
    return _with_name(keyed, contacts, "contact_info", "name", normalize)


def _with_name(rows: DataFrame, contacts: DataFrame, key: str, out: str, normalize: bool) -> DataFrame:
    names = one_name_per_key(contacts, normalize).selectExpr("contact_key AS _key", "name AS _name")
    lookup = contact_key(key) if normalize else key
    joined = rows.selectExpr("*", f"{lookup} AS _key").join(names, "_key", "left")
    return joined.selectExpr(*rows.columns, f"coalesce(_name, {key}) AS {out}")


def with_counterparty(messages: DataFrame, contacts: DataFrame, normalize: bool = False) -> DataFrame:
    """Add `counterparty_name` to a stored table, by a lookup of the recipient's name.

    One recipient may stand on a third of all rows; the lookup is salted.
    """
    names = one_name_per_key(contacts, normalize).selectExpr("contact_key AS _key", "name AS _name")
    lookup = contact_key("updated_contact_info") if normalize else "updated_contact_info"
    # Group chats need no lookup.
    wanted = f"is_from_me = 1 AND updated_contact_info <> '{GROUP_CHAT}'"
    keyed = messages.selectExpr("*", f"CASE WHEN {wanted} THEN {lookup} END AS _key")
    joined = salted_left_join(keyed, names, "_key", "message_id")
    party = f"""CASE WHEN is_from_me <> 1 THEN name WHEN updated_contact_info = '{GROUP_CHAT}' THEN '{GROUP_CHAT}'
        ELSE coalesce(_name, updated_contact_info) END AS {COUNTERPARTY}"""
    return joined.selectExpr(*messages.columns, party)


def _own_columns(message: DataFrame) -> DataFrame:
    """Everything that needs no other table; the binary column ends here."""
    # The text found is bound once: the optimizer keeps a costly column that is used twice.
    found = message.withColumn("_inferred", F.expr(inferred_text("attributedBody")))
    return found.selectExpr(
        "ROWID AS message_id",
        "handle_id AS _handle",
        "CAST(coalesce(is_from_me, 0) AS BYTE) AS is_from_me",
        "CAST(coalesce(is_audio_message, 0) AS BYTE) AS is_audio_message",
        "text",
        "_inferred AS inferred_text",
        "CAST(thread_originator_guid IS NOT NULL AS BYTE) AS is_thread_reply",
        f"{reaction_label('associated_message_type')} AS reaction",
        f"{effect_label('expressive_send_style_id')} AS message_effect",
        f"""CASE WHEN balloon_bundle_id IS NOT NULL
              THEN {link_domain('coalesce(text, _inferred)')} END AS link_domain""",
        f"{unix_seconds('date')} AS _unix",
    )


def placement(
    raw: RawTables, contacts: DataFrame, normalize: bool = False, with_members: bool = True, few: bool = False
) -> DataFrame:
    """Message id to chat, with the chat's members joined while rows are narrow. With `few` links
    only their chats get member lists."""
    pairs = first_chat(raw.chat_message_join)
    return with_chat_members(pairs, raw, contacts, normalize, few) if with_members else pairs


def with_chat_members(pairs: DataFrame, raw: RawTables, contacts: DataFrame, normalize: bool = False, few: bool = False) -> DataFrame:
    """Rows with a message id and its chat, and the chat's members added."""
    seats = raw.chat_handle_join
    if few:
        # Leave the other chats out before lists are built.
        seats = seats.join(pairs.select("chat_id").distinct(), "chat_id", "left_semi")
    members = chat_members(participants(seats, raw.handle))
    named = _with_name(members, contacts, "only_member", "only_member_name", normalize)
    # A chat may hold a third of all messages, and its member row comes straight from
    # an aggregate, which keeps adaptive execution from splitting the chat; so salt. Spark's estimate
    # of the members is a product of two tables' sizes; where that is small, so are all copies.
    return salted_left_join(pairs, named, "chat_id", "message_id", few=not few and known_small(members))


def by_direction(sent: str, received: str, size: str = "chat_size") -> str:
    """SQL for a value by direction: that of the sender, of a direct chat's other party, or of groups."""
    return f"""CASE WHEN is_from_me <> 1 THEN {received}
        WHEN {size} = 1 THEN {sent} WHEN {size} > 1 THEN '{GROUP_CHAT}' END"""


_DERIVED = {
    "handle_id": "coalesce(_handle, 0L)",
    "text_combined": "coalesce(text, inferred_text)",
    "body_text": "coalesce(text, inferred_text)",
    "chat_size": "coalesce(chat_size, 0L)",
    "updated_contact_info": by_direction("only_member", "contact_info"),
    COUNTERPARTY: by_direction("only_member_name", "name"),
    "timestamp": "timestamp_seconds(_unix)",
    "date": utc_date("_unix"),
    "month": f"CAST(month({utc_date('_unix')}) AS BYTE)",
    "year": f"try_cast(year({utc_date('_unix')}) AS SMALLINT)",
}
