"""WARC archives of web pages, and a global index of them by external merge.

Records are built and written by Spark itself: a record is one text, and the text sink's
line separator is the blank lines that end it, so each file is a gzip archive on any
file system Spark knows. Of pages with equal payloads the one with the largest page_id is
written whole, the others as revisits that refer to it; who is who comes from narrow rows
of page_id and digest, pre-aggregated and salted, since one payload may be on a third of all
pages. Files hold a bounded number of records.

Reading goes record by record by Content-Length, with digests checked. Every task sorts what
it read into a run of index entries. The runs are then merged: key ranges are dealt to
tasks, and each task merges its slices of the runs with a loser tree, by URL key, time
and page, which gives all capture histories in one global order. The key includes page_id,
so that a URL with most of the captures is split like any other range.

Captures have no time of their own here: it is `EPOCH` plus page_id seconds.

NULL html is an empty payload; NULL url has an empty key. Pages without page_id are
captures at `EPOCH`, keep a NULL id, and refer to or are referred to as the smallest id.
Pages that repeat a page_id and payload are the same role each. Other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch
from msgloom.operators.salted import salted_left_join

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FILE_RECORDS = 5_000
#: Index entries that a merging task takes, about.
MERGE_ROWS = 250_000

ENTRY = (
    "url_key string, captured_at long, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, file string, record long"
)


def url_key(url: str) -> str:
    """SQL for the key by which captures sort: host with its labels reversed and without
    www, then path and query, all in lower case; no scheme, user, port or fragment."""
    plain = f"lower(regexp_replace(coalesce({url}, ''), r'^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', ''))"
    host = r"regexp_replace(regexp_extract({0}, r'^[^/?]*', 0), r'^.*@|^www[0-9]*\.|:[0-9]*$', '')"
    rest = r"regexp_replace({0}, r'^[^/?]*', '')"
    return (
        f"transform(array({plain}), u -> concat(array_join(reverse(split({host.format('u')}, r'\\.')), ','), ')', "
        f"{rest.format('u')}))[0]"
    )


def base32_sha1(data: str) -> str:
    """SQL for the SHA-1 of a binary value in base 32: ten hex digits are eight of those."""
    parts = ", ".join(f"lpad(conv(substr(x, {1 + 10 * i}, 10), 16, 32), 8, '0')" for i in range(4))
    return f"transform(array(sha1({data})), x -> translate(concat({parts}), '{BASE32_DIGITS}', '{BASE32}'))[0]"


def record_ids(page_id: str) -> str:
    return f"concat('<urn:page:', coalesce(CAST({page_id} AS STRING), ''), '>')"


def records(pages: DataFrame) -> DataFrame:
    """page_id and the WARC record of each page (page_id, url, html), without its end."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").selectExpr(
        "page_id", "coalesce(url, '') AS url", "coalesce(html, '') AS payload",
        f"{base32_sha1('CAST(coalesce(html, \"\") AS BINARY)')} AS digest",
    )
    narrow = rows.select("page_id", "digest")
    copied = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    roles = salted_left_join(narrow, copied.drop("n"), "digest", "page_id", salts=32)
    roles = roles.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = rows.join(roles, ["page_id", "digest"], "left")
    date = f"date_format(timestamp_seconds({int(EPOCH.timestamp())} + coalesce(page_id, 0)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    http = (
        "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', "
        "octet_length(payload), '\\r\\n\\r\\n')"
    )
    rows = rows.selectExpr(
        "*", f"{http} AS http", f"{date} AS date", "refers_to IS NOT NULL AS again",
    ).selectExpr("*", "CASE WHEN again THEN http ELSE concat(http, payload) END AS block")
    # A line break in a URL would end its header.
    url = "replace(replace(url, '\\r', '%0D'), '\\n', '%0A')"
    head = f"""concat('{VERSION}\\r\\nWARC-Type: ', if(again, 'revisit', 'response'),
        '\\r\\nWARC-Record-ID: ', {record_ids('page_id')}, '\\r\\nWARC-Date: ', date,
        '\\r\\nWARC-Target-URI: ', {url}, '\\r\\nWARC-Payload-Digest: sha1:', digest,
        if(again, concat('\\r\\nWARC-Profile: {PROFILE}\\r\\nWARC-Refers-To: ', {record_ids('refers_to')}), ''),
        '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ', octet_length(block),
        '\\r\\n\\r\\n', block)"""
    return rows.selectExpr("page_id", f"{head} AS record")


def write_archives(pages: DataFrame, path: str) -> None:
    (
        records(pages).select("record").write.mode("overwrite")
        .option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.rstrip(b"\r\n") != VERSION.encode():
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(len(RECORD_END)) != RECORD_END.encode():
            raise ValueError("a record does not end with two line breaks")
        yield headers, block


def _page(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _payload(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Size of the full payload, and the payload where the record holds it."""
    head, _, body = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return size, None if headers["WARC-Type"] == "revisit" else body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ENTRY without the key, plus `payload`, NULL in revisits."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content)) as stream:
                    for number, (headers, block) in enumerate(read_records(stream)):
                        size, payload = _payload(headers, block)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None:
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if (found, len(payload)) != (digest, size):
                                raise ValueError(f"{name}, record {number}: payload is not what its digest says")
                        at = dt.datetime.fromisoformat(headers["WARC-Date"])
                        rows.append((
                            int(at.timestamp()), _page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"],
                            headers["WARC-Type"], size, digest, _page(headers.get("WARC-Refers-To")),
                            name, number, payload,
                        ))
                        held += len(block)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, f"{ENTRY.split(', ', 1)[1]}, payload binary")


_TYPES = [
    ("captured_at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
    ("record", pa.int64()), ("payload", pa.binary()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], [n for n, _ in _TYPES])


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next
    item costs one match per level."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = list(runs)
        self.size = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.size)
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self):
        while self.size and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.size) // 2
            while node:
                if self._before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merged(batches):
    """Rows come sorted by run, then key; yields them in key order."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    keys = [table.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "run")]
    page = [-1 if p is None else p for p in keys[2]]
    run = keys[3]
    starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
    slices = [
        ((keys[0][i], keys[1][i], page[i], i) for i in range(a, b)) for a, b in zip(starts, [*starts[1:], len(run)])
    ]
    order = [item[3] for item in LoserTree(slices)]
    yield from table.drop_columns(["run"]).take(pa.array(order)).combine_chunks().to_batches()


def merged_index(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Index entries in global order of url_key, captured_at, page_id.

    Runs are written locally sorted, one per task; ranges of the key are merged by tasks of
    their own."""
    keyed = entries.drop("payload").selectExpr(f"{url_key('url')} AS url_key", "*", "spark_partition_id() AS run")
    runs = scratch.table(keyed.sortWithinPartitions("url_key", "captured_at", "page_id"), "runs")
    ranges = max(2, -(-runs.count() // MERGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "file", "record")
    sliced = dealt.sortWithinPartitions("run", "url_key", "captured_at", "page_id")
    return sliced.mapInArrow(_merged, ENTRY)
