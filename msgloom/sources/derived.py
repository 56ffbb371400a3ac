"""Raw message tables derived from an event log and a customer table.

Plain column arithmetic, so the derived tables grow with the given ones. Group
chats take 15 neighbouring users each: more users give more groups, not larger
ones. FIXTURES.md states the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from msgloom.functions.times import EPOCH_2001
from msgloom.schemas import RawTables

GROUP_BASE = 1_000_000_000
MEMBERLESS_BASE = 2_000_000_000
GROUP_SIZE = 15


def handle_key(user: str) -> str:
    """SQL for the contact key of a user number."""
    return f"""if({user} % 3 = 0, concat('user_', {user}, '@example.com'), concat('+1415', lpad({user}, 10, '0')))"""


def stream_blob(text: str) -> str:
    """SQL for an object stream that holds a text as its first string."""
    head = b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x08NSString\x01\x95\x84\x01+".hex()
    tail = b"\x86\x84\x02iI\x01\x0a\x92\x84\x84\x84\x0cNSDictionary\x00\x95\x84\x01i\x01\x92".hex()
    size = f"octet_length({text})"
    # Sizes are little-endian: one byte, or a mark and two or four bytes.
    low, high = f"hex(mod({size}, 256))", f"hex(mod({size} div 256, 256))"
    two = f"lpad({low}, 2, '0') || lpad({high}, 2, '0')"
    third, fourth = f"hex(mod({size} div 65536, 256))", f"hex({size} div 16777216)"
    four = f"{two} || lpad({third}, 2, '0') || lpad({fourth}, 2, '0')"
    length = f"""CASE WHEN {size} < 128 THEN lpad({low}, 2, '0') WHEN {size} < 65536 THEN '81' || {two}
        ELSE '82' || {four} END"""
    return f"X'{head}' || unhex({length}) || CAST({text} AS BINARY) || X'{tail}'"


def marker_blob(text: str) -> str:
    """SQL for the older form: the text between two class names, after some junk."""
    return f"CAST('xxNSString+2' || {text} || 'NSDictionaryyy' AS BINARY)"


def raw_from_events(events: DataFrame) -> RawTables:
    base = events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ)) - {EPOCH_2001} AS sec",
    )
    message = base.selectExpr(
        "event_id + 1 AS ROWID",
        """CASE WHEN event_id % 11 = 0 THEN NULL
             WHEN event_id % 7 <> 0 THEN concat(event_type, ' ', k)
             WHEN k % 5 = 0
               THEN concat(event_type, ' ', k, ' see https://www.site', k % 10, '.example.com/p/', event_id, '.')
             WHEN k % 5 = 1 THEN concat(event_type, ' ', k, ' (http://Shop.example.org:8080/a?b=c) ok')
             WHEN k % 5 = 2 THEN concat(event_type, ' ', k, ' https://me:pw@cdn_', k, '.example.net/x, y')
             WHEN k % 5 = 3
               THEN concat(event_type, ' ', k, ' http://first.example/ and https://second.example.com!')
             ELSE concat(event_type, ' ', k, ' https:// nothing') END AS text""",
        f"""CASE WHEN event_id % 11 = 0 THEN {marker_blob("concat(event_type, ' hidden ', k)")}
             WHEN event_id % 13 = 0 THEN {stream_blob("concat(event_type, ' café ', k)")} END AS attributedBody""",
        "CASE WHEN k = 94 THEN NULL WHEN event_id % 2 = 1 AND k >= 20 THEN 0L ELSE user_id + 1 END AS handle_id",
        "CASE WHEN k <> 95 THEN event_id % 2 END AS is_from_me",
        """CASE WHEN k = 98 THEN NULL WHEN k = 97 THEN 0L WHEN k = 96 THEN -2000000000L
             WHEN event_id % 5 = 0 THEN sec ELSE sec * 1000000000L END AS date""",
        """CAST(CASE WHEN k < 6 THEN k + 2000 WHEN k < 12 THEN k + 2994 ELSE 0 END AS BIGINT)
             AS associated_message_type""",
        """CASE WHEN k = 12 THEN 'com.apple.MobileSMS.expressivesend.impact'
             WHEN k BETWEEN 13 AND 16 THEN concat('com.apple.messages.effect.CK', initcap(event_type), 'Effect')
             WHEN k = 17 THEN 'trailing.' END AS expressive_send_style_id""",
        "CASE WHEN k BETWEEN 20 AND 29 THEN concat('guid-', event_id) END AS thread_originator_guid",
        "CASE WHEN event_id % 7 = 0 THEN 'URLBalloon' END AS balloon_bundle_id",
        "if(k = 30, 1L, 0L) AS is_audio_message",
    )
    group = f"user_id div {GROUP_SIZE} + {GROUP_BASE}"
    chat_message_join = base.selectExpr(
        f"""explode(CASE WHEN k = 99 THEN array()
             WHEN event_type = 'purchase' THEN array({group})
             WHEN event_type = 'signup' AND k = 93 THEN array(user_id + {MEMBERLESS_BASE})
             WHEN value > 150 THEN array({group}, user_id + 1)
             ELSE array(user_id + 1) END) AS chat_id""",
        "event_id + 1 AS message_id",
    )
    users = events.select("user_id").distinct()
    chat_handle_join = users.selectExpr(
        f"""stack(3, user_id + 1, user_id + 1, {group}, user_id + 1, {group}, -user_id - 1) AS (chat_id, handle_id)"""
    )
    handle = users.selectExpr("user_id + 1 AS ROWID", f"{handle_key('user_id')} AS id")
    return RawTables(message, handle, chat_message_join, chat_handle_join)


def raw_from_conversations(conversations: DataFrame) -> RawTables:
    """Each conversation is a direct chat, a turn a minute long; what the user said is
    sent, as text, and the rest is received, as an object stream with the whole text."""
    message = conversations.selectExpr(
        "conv_id * 100000 + turn + 1 AS ROWID",
        "CASE WHEN role = 'user' THEN text END AS text",
        f"CASE WHEN role <> 'user' THEN {stream_blob('text')} END AS attributedBody",
        "if(role = 'user', 0L, conv_id + 1) AS handle_id",
        "if(role = 'user', 1L, 0L) AS is_from_me",
        "conv_id * 3600 + turn * 60 AS date",
        "0L AS associated_message_type",
        "CAST(NULL AS STRING) AS expressive_send_style_id",
        "CASE WHEN turn > 1 THEN concat('conv-', conv_id) END AS thread_originator_guid",
        "CAST(NULL AS STRING) AS balloon_bundle_id",
        "0L AS is_audio_message",
    )
    chats = conversations.selectExpr("conv_id + 1 AS chat_id", "conv_id * 100000 + turn + 1 AS message_id")
    people = conversations.select("conv_id").distinct()
    handle = people.selectExpr("conv_id + 1 AS ROWID", f"{handle_key('conv_id')} AS id")
    return RawTables(message, handle, chats, people.selectExpr("conv_id + 1 AS chat_id", "conv_id + 1 AS handle_id"))


def contacts_from_customers(customer: DataFrame) -> DataFrame:
    """Contact names; some handles stay unnamed."""
    named = customer.where("c_mktsegment <> 'MACHINERY'")
    return named.selectExpr(f"{handle_key('c_custkey')} AS contact_key", "c_name AS name")


def overrides_from_customers(customer: DataFrame) -> DataFrame:
    """Names set by hand, for customers in debt."""
    owing = customer.where("c_acctbal < 0")
    return owing.selectExpr(f"{handle_key('c_custkey')} AS contact_key", "concat('VIP ', c_name) AS name")


def address_book_from_customers(customer: DataFrame) -> DataFrame:
    """An address book with formatted keys; everybody in a nation shares its switchboard."""
    digits = customer.selectExpr("*", "lpad(c_custkey, 10, '0') AS digits")
    return digits.selectExpr(
        "c_custkey AS contact_id",
        "if(c_mktsegment = 'MACHINERY', ' ', substring_index(c_name, '#', 1)) AS given_name",
        "if(c_mktsegment = 'MACHINERY', NULL, substring_index(c_name, '#', -1)) AS family_name",
        """array(concat('+1 (415) ', substr(digits, 1, 3), '-', substr(digits, 4, 3), '+', substr(digits, 7, 4)),
             concat(' +1-800-', c_nationkey)) AS phones""",
        "array(concat('User_', c_custkey, '@Example.COM')) AS emails",
    )


#: Days between an order and the message made of it, so that all are after 2001.
ORDER_SHIFT = 3653


def raw_from_orders(orders: DataFrame) -> RawTables:
    """A message per order, over several years, in a direct chat with its customer; every fifth
    answers the customer's order."""
    base = orders.selectExpr(
        "o_orderkey", "o_custkey + 1 AS handle", "o_orderpriority",
        f"(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', CAST(o_orderdate AS TIMESTAMP_NTZ)) + {ORDER_SHIFT * 86400} - {EPOCH_2001}) AS sec",
    )
    message = base.selectExpr(
        "o_orderkey + 1 AS ROWID", "concat('order ', o_orderpriority) AS text", "CAST(NULL AS BINARY) AS attributedBody",
        "handle AS handle_id", "if(o_orderkey % 5 = 0, 1L, 0L) AS is_from_me", "sec * 1000000000L AS date",
        "0L AS associated_message_type", "CAST(NULL AS STRING) AS expressive_send_style_id",
        "CAST(NULL AS STRING) AS thread_originator_guid", "CAST(NULL AS STRING) AS balloon_bundle_id", "0L AS is_audio_message",
    )
    handles = base.select("handle").distinct()
    return RawTables(
        message=message,
        handle=handles.selectExpr("handle AS ROWID", f"{handle_key('(handle - 1)')} AS id"),
        chat_message_join=base.selectExpr("handle AS chat_id", "o_orderkey + 1 AS message_id"),
        chat_handle_join=handles.selectExpr("handle AS chat_id", "handle AS handle_id"),
    )
