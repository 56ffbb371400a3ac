import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from msgloom.schemas import RAW, RawTables  # noqa: E402
from msgloom.session import configure  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("msgloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def nanoseconds(text: str) -> int:
    moment = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
    return (int(moment.timestamp()) - 978307200) * 10**9


def message(rowid, **fields):
    """A raw message row; unset fields take the defaults of the source table."""
    row = {
        "ROWID": rowid, "text": None, "attributedBody": None, "handle_id": 0, "is_from_me": 0, "date": 0,
        "associated_message_type": 0, "expressive_send_style_id": None, "thread_originator_guid": None,
        "balloon_bundle_id": None, "is_audio_message": 0,
    }
    assert set(fields) <= set(row)
    return {**row, **fields}


def raw_tables(spark, messages, handles, chat_messages, chat_handles) -> RawTables:
    rows = {
        "message": [tuple(m.values()) for m in messages],
        "handle": handles,
        "chat_message_join": chat_messages,
        "chat_handle_join": chat_handles,
    }
    return RawTables(**{name: spark.createDataFrame(rows[name], RAW[name]) for name in RAW})


def contact_table(spark, rows):
    return spark.createDataFrame(rows, "contact_key string, name string")


DAY = nanoseconds("2024-01-15 12:00:00")
MARKED = b"...NSString+2Call me laterNSDictionary..."


@pytest.fixture(scope="session")
def small_raw(spark):
    """Ten messages in a direct chat (1) and a group (2)."""
    step = 60 * 10**9
    messages = [
        message(1, text="Hello there", handle_id=1, date=DAY),
        message(2, text="Hi!", is_from_me=1, date=DAY + step),
        message(3, attributedBody=MARKED, handle_id=1, date=DAY + 2 * step),
        message(4, text="Loved a message", handle_id=1, date=DAY + 3 * step, associated_message_type=2000),
        message(
            5, text="Boom", is_from_me=1, date=DAY + 4 * step,
            expressive_send_style_id="com.apple.messages.effect.CKFireworksEffect",
        ),
        message(6, text="A reply", handle_id=1, date=DAY + 5 * step, thread_originator_guid="guid-1"),
        message(
            7, text="Listen https://open.spotify.com/track/1", handle_id=1, date=DAY + 6 * step,
            balloon_bundle_id="balloon",
        ),
        message(8, handle_id=1, date=DAY + 7 * step, is_audio_message=1),
        message(9, text="Group hello", handle_id=2, date=DAY + 8 * step),
        message(10, text="Group answer", is_from_me=1, date=DAY + 9 * step),
    ]
    return raw_tables(
        spark,
        messages,
        [(1, "+14155550001"), (2, "friend@example.com")],
        [(1, i) for i in range(1, 9)] + [(2, 9), (2, 10)],
        [(1, 1), (2, 1), (2, 2)],
    )


@pytest.fixture(scope="session")
def small_contacts(spark):
    return contact_table(spark, [("+14155550001", "Alice")])
