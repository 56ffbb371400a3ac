"""Benchmark passages inside documents, by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, the classes being (u/2, u] for
powers of two u. For each class a document is cut into blocks of u shingles, and every two
neighbouring blocks are a window, so that a passage of an item lies within one window whose
size is within four times its own: against such windows, and not the whole document, the
Jaccard similarity of a contained item is at least about a fifth, and single MinHash
values find it. A window that shares one of `HASHES` minima with an item is a candidate;
the expected loss is (1 - 0.2)^48 = 2e-5 at the lowest similarity, and below 1e-8 for
whole passages. Candidates are verified by exact containment: the share of the item's
shingles in the whole document, compared as words, must reach the threshold.

The documents are not shuffled. Items go to the tasks in blocks of bounded size; a larger
benchmark takes several passes over the documents.

Shingles are five words with A-Z in lower case; a text with fewer words is one shingle.
Items or documents without words, or NULL, match nothing. Rows that repeat an id are
reported each. Other columns are ignored or, in `clean_documents`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch
from msgloom.llm.words import Words, mixed, shingles, text_slices, words_of

HASHES = 48
#: Items that tasks hold at a time, and the bytes of their texts.
ITEM_BLOCK = 20_000
ITEM_BLOCK_BYTES = 16 << 20

_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_NONE = np.iinfo(np.uint32).max

PAIRS = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def _minima(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    return (values * factor >> np.uint64(32)).astype(np.uint32)


class ItemIndex:
    """Shingles of a block of items, and for each size class and hash their minima."""

    def __init__(self, ids: list, texts: list[str], width: int, percent: int):
        self.width, self.percent = width, percent
        words = words_of(pa.array(texts, pa.string()))
        every, offsets = shingles(words.hashes, words.offsets, width)
        self.ids: list = []
        self.sets: list[np.ndarray] = []
        self.words: list[dict[int, bytes]] = []
        for i, item_id in enumerate(ids):
            own = every[offsets[i] : offsets[i + 1]]
            if len(own):
                self.ids.append(item_id)
                self.sets.append(np.unique(own))
                self.words.append(dict(zip(own.tolist(), shingle_words(words, i, width))))
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        sizes = [1 << (len(s) - 1).bit_length() for s in self.sets]
        for size in sorted(set(sizes)):
            members = np.array([i for i, s in enumerate(sizes) if s == size])
            tables = []
            for factor in _FACTORS:
                minima = np.array([_minima(self.sets[i], factor).min() for i in members], np.uint32)
                order = np.argsort(minima, kind="stable")
                near = np.zeros(1 << 16, bool)  # a quick test before the search
                near[minima & 0xFFFF] = True
                tables.append((minima[order], members[order], near))
            self.classes[size] = tables

    def candidates(self, every: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of text and item that share a minimum in some window."""
        counts = np.diff(offsets)
        found: set[tuple[int, int]] = set()
        if not len(every):
            return found
        grids = {}
        for size in self.classes:
            blocks = -(-counts // size)
            owner = np.repeat(np.arange(len(counts)), blocks)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            grids[size] = (offsets[:-1][owner] + within * size, owner, np.append(owner[1:] == owner[:-1], False))
        for k, factor in enumerate(_FACTORS):
            values = _minima(every, factor)
            for size, tables in self.classes.items():
                starts, owner, followed = grids[size]
                least = np.minimum.reduceat(values, starts)
                window = np.minimum(least, np.append(np.where(followed[:-1], least[1:], _NONE), _NONE))
                minima, members, near = tables[k]
                hit = np.flatnonzero(near[window & np.uint32(0xFFFF)])
                low = np.searchsorted(minima, window[hit], "left")
                high = np.searchsorted(minima, window[hit], "right")
                for at, a, b in zip(hit[high > low], low[high > low], high[high > low]):
                    found.update((int(owner[at]), int(m)) for m in members[a:b])
        return found

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """Verified pairs: row, item, shingles of the item, and how many the text has."""
        words = words_of(texts)
        every, offsets = shingles(words.hashes, words.offsets, self.width)
        out = []
        held: tuple[int, dict[int, set[bytes]]] | None = None
        for row, item in sorted(self.candidates(every, offsets)):
            own = every[offsets[row] : offsets[row + 1]]
            shared = np.intersect1d(self.sets[item], own)
            if 100 * len(shared) < self.percent * len(self.sets[item]):
                continue
            at = np.flatnonzero(np.isin(own, shared))
            texts_of: dict[int, set[bytes]] = {}
            for place, text in zip(at, shingle_words(words, row, self.width, at)):
                texts_of.setdefault(int(own[place]), set()).add(text)
            exact = sum(self.words[item][int(h)] in texts_of[int(h)] for h in shared)
            if 100 * exact >= self.percent * len(self.sets[item]):
                out.append((row, item, len(self.sets[item]), exact))
        return out


def shingle_words(words: Words, row: int, width: int, places=None) -> Iterator[bytes]:
    """The words of a text's shingles, in lower case, one blank between."""
    first, last = words.offsets[row], words.offsets[row + 1]
    count = max(1, last - first - width + 1)
    for i in range(count) if places is None else places:
        span = range(first + i, min(first + i + width, last))
        yield b" ".join(words.data[words.starts[w] : words.ends[w]].tobytes().lower() for w in span)


def item_blocks(items: DataFrame, width: int, percent: int) -> Iterator[ItemIndex]:
    """Items in blocks of bounded number and size."""
    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-2 * total["n"] // ITEM_BLOCK), -(-2 * total["size"] // ITEM_BLOCK_BYTES))
    if not total["n"]:
        return
    for block in range(blocks):
        # Bounded: about half of what a block may hold.
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if own:
            yield ItemIndex([r[0] for r in own], [r[1] for r in own], width, percent)


def _pairs(index: ItemIndex):
    def run(batches):
        for part in text_slices(batches, "text"):
            if found := index.matches(part.column("text")):
                rows, items, sizes, shared = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        pa.array([index.ids[i] for i in items], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(shared, pa.int64()),
                        pa.array([s / n for s, n in zip(shared, sizes)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
                )

    return run


def _clean(index: ItemIndex):
    def run(batches):
        for part in text_slices(batches, "text"):
            kept = np.ones(part.num_rows, bool)
            kept[[m[0] for m in index.matches(part.column("text"))]] = False
            yield part.filter(pa.array(kept))

    return run


def contained_items(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document (doc_id, text) and item (item_id, text) contained in it:
    doc_id, item_id, item_shingles, shared_shingles, containment."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], PAIRS)
    for index in item_blocks(items, width, percent):
        found = found.union(rows.mapInArrow(_pairs(index), PAIRS))
    return found


def clean_documents(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, as they are, without those that contain an item."""
    for index in item_blocks(items, width, percent):
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs
