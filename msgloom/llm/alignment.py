"""Alignment of two tokenizers: which tokens of one overlap which of the other.

Tokenizer A is byte-level BPE, B a sentencepiece model that puts a space before a text; both
encode the same bytes, a space and the text. Cuts come from what the tokenizers say: character
spans of A and the span of every piece of B, turned into byte offsets. Where several tokens
share a character, or a byte token has no span of its own, the cut is refined with the tokens'
decoded bytes, counted from the last sure cut.

Neither vocabulary has a token that goes on over a blank between two words, so that a text is
encoded segment by segment, cut at such blanks. Each task keeps the segments it has met, up to
a bound. (With a vocabulary that has such tokens, texts are not cut.) Texts whose tokens do
not give back their bytes, such as those with U+2581, have no tokens.

An id pair counts for a document once. Documents form blocks of bounded text; a block tells
its different pairs with the number of its documents, so that what is shuffled follows
the pairs of a block and not the tokens. Counts come back to the blocks by a join on the
pair, where a pair stands once per block, and a block is small enough for one task.

NULL and empty texts have no tokens: numbers are 0 and `groups` is ''. So are texts that are not
UTF-8. Rows that share a doc_id, also NULL, are separate documents. An empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch
from msgloom.llm.words import text_slices

#: Text bytes of a block of documents.
BLOCK_BYTES = 32 << 20
#: Text bytes that are encoded at a time.
_SLICE_BYTES = 1 << 20
#: Blanks between two words, where texts are cut.
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_GROUP_CHARACTERS = 2_000
_SPACE_MARK = "▁"

_BLOCKS = (
    "part long, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "codes array<int>, times array<int>, pairs array<long>, holders array<long>"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Aligner:
    """Aligned segments, remembered up to a bound, beyond which the more used half stays. Segment `i` has `numbers[i]` (tokens of A, of
    B, groups, links), its links at `starts[i]` of `links`, and its groups as text."""

    REMEMBERED = 450_000
    #: Code of a segment whose tokens do not give back its bytes.
    LOST = -1

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letter[c] for c in token)
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace(_SPACE_MARK, " ").encode()
            for i in range(len(self.b))
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.number = [*map(str, range(max(len(self.bytes_a), len(self.bytes_b))))]
        crossing = any(_BETWEEN_WORDS.search(x.decode("utf-8", "replace")) for x in self.bytes_a + self.bytes_b)
        self.segments = (lambda text: [text]) if crossing else _BETWEEN_WORDS.split
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers = np.empty((0, 4), np.int64)
        self.starts, self.links, self.uses = (np.empty(0, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keep the more used half of the segments."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.REMEMBERED // 2])
        new = np.full(len(self.text), self.LOST)
        new[kept] = np.arange(len(kept))
        self.code = {s: k for s, k in zip(self.code, np.append(new, self.LOST)[np.fromiter(self.code.values(), np.int64)].tolist()) if k != self.LOST}
        self.text = [self.text[k] for k in kept.tolist()]
        counts = self.numbers[kept, 3]
        starts = np.cumsum(counts) - counts
        self.links = self.links[np.arange(counts.sum()) + np.repeat(self.starts[kept] - starts, counts)]
        self.numbers, self.starts, self.uses = self.numbers[kept], starts, self.uses[kept] // 2

    def _encoded(self, bodies: list[str]):
        """Ids, first and end character of every token, for A and for B."""
        bases = np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1]
        coded = self.a.encode_batch([f" {b}" for b in bodies], add_special_tokens=False)
        for ids, spans, shift in (
            ([e.ids for e in coded], [e.offsets for e in coded], 0),
            _pieces(self.b.encode(bodies, return_type="offset_mapping", num_threads=1)),
        ):
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
            ends = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(spans)), np.int64)
            yield flat, ends.reshape(-1, 2) + (np.repeat(bases, [len(x) for x in ids]) + shift)[:, None]

    def learn(self, segments: list[str]) -> None:
        """Encode segments, groups of them at once, and remember them."""
        if not segments:
            return
        data = "".join([f" {s}" for s in segments]).encode()
        bodies, size = [], 0
        for s in segments:
            # A segment with white space at its border is encoded alone.
            alone = s != s.strip()
            if bodies and not alone and size and size + len(s) < _GROUP_CHARACTERS:
                bodies[-1].append(s)
                size += len(s)
            else:
                bodies.append([s])
                size = 0 if alone else len(s)
        (ids_a, spans_a), (ids_b, spans_b) = self._encoded([" ".join(b) for b in bodies])
        bounds = np.cumsum([len(s.encode()) + 1 for s in segments])
        same = all(b"".join([v[i] for i in ids.tolist()]) == data for v, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        if not same:
            if len(segments) == 1:
                self.code[segments[0]] = self.LOST
                return
            half = len(segments) // 2
            self.learn(segments[:half])
            self.learn(segments[half:])
            return
        place = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        a = _cuts(spans_a, place, self.sizes_a[ids_a])
        b = _cuts(spans_b, place, self.sizes_b[ids_b])
        self._remember(segments, bounds, ids_a, a, ids_b, b)

    def _remember(self, segments, bounds, ids_a, a, ids_b, b) -> None:
        a0, b0 = a - self.sizes_a[ids_a], b - self.sizes_b[ids_b]
        first, last = np.searchsorted(b, a0, "right"), np.searchsorted(b0, a, "left")
        partners = last - first
        which_a = np.repeat(np.arange(len(a)), partners)
        which_b = np.arange(len(which_a)) - np.repeat(np.cumsum(partners) - partners, partners) + first[which_a]
        links = ids_a[which_a] << 32 | ids_b[which_b]
        # Both end at a common cut, and so does a group of either.
        match = np.searchsorted(b, a)
        ends_a = np.flatnonzero(b[np.minimum(match, len(b) - 1)] == a)
        ends_b = match[ends_a]
        number = self.number
        text_a, text_b = ([number[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        groups, i, j = [], 0, 0
        for k, m in zip((ends_a + 1).tolist(), (ends_b + 1).tolist()):
            one = k - i == m - j == 1
            groups.append(f"{text_a[i]}|{text_b[j]}" if one else f"{','.join(text_a[i:k])}|{','.join(text_b[j:m])}")
            i, j = k, m
        upto = np.stack([
            np.searchsorted(a, bounds, "right"), np.searchsorted(b, bounds, "right"),
            np.searchsorted(a[ends_a], bounds, "right"),
        ], axis=1)
        upto = np.column_stack([upto, np.concatenate(([0], np.cumsum(partners)))[upto[:, 0]]])
        numbers = np.diff(upto, axis=0, prepend=0)
        begin = 0
        for s, end in zip(segments, upto[:, 2].tolist()):
            self.code[s] = len(self.text)
            self.text.append(";".join(groups[begin:end]))
            begin = end
        self.starts = np.concatenate((self.starts, len(self.links) + upto[:, 3] - numbers[:, 3]))
        self.numbers = np.concatenate((self.numbers, numbers))
        self.links = np.concatenate((self.links, links))
        self.uses = np.concatenate((self.uses, np.zeros(len(segments), np.int64)))

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the segments of all texts in order, and n + 1 offsets."""
        if len(self.text) > self.REMEMBERED:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        flat, offsets = self._looked_up(cut)
        lost = np.unique(np.searchsorted(offsets, np.flatnonzero(flat == self.LOST), "right") - 1).tolist()
        if lost:
            # Whether the text's tokens give back its bytes shows in one piece.
            for i in lost:
                cut[i] = [texts[i]]
            self._looked_up([cut[i] for i in lost])
            for i in lost:
                cut[i] = [] if self.code[texts[i]] == self.LOST else cut[i]
            flat, offsets = self._looked_up(cut)
        self.uses += np.bincount(flat, minlength=len(self.uses))
        return flat, offsets

    def _looked_up(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        new = [*(set(itertools.chain.from_iterable(cut)) - self.code.keys())]
        self.learn(new)
        offsets = np.cumsum([0, *map(len, cut)])
        return np.fromiter(map(self.code.__getitem__, itertools.chain.from_iterable(cut)), np.int64, offsets[-1]), offsets


def _pieces(coded: list[dict]) -> tuple[list, list, int]:
    """Ids and spans of B, whose spans start behind the space that it adds."""
    return [c["ids"] for c in coded], [c["offsets"] for c in coded], 1


def _cuts(spans: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes. A span that is empty or shares a character with the
    next one is no sure cut: such tokens end behind the sure cut before them by the bytes they decode to."""
    begin, end = spans[:, 0], spans[:, 1]
    sure = (end > begin) & (np.append(begin[1:], end[-1:]) >= end)
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(end)), -1))
    return total + np.where(last >= 0, place[end[last]] - total[last], 0)


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker. A task has one core, so no threads are started."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(path_a, path_b)


def _texts(column: pa.Array) -> list[str | None]:
    """Texts, None where they are not UTF-8."""

    def text(data):
        try:
            return None if data is None else data.decode()
        except UnicodeDecodeError:
            return None

    return [text(x) for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _aligned(path_a: str, path_b: str, digest: bool):
    """A row per document, and behind those of a block one with its different id pairs."""
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2

    def batch(count: int, known: dict) -> pa.RecordBatch:
        columns = [known.get(n, pa.nulls(count, t)) for n, t in zip(names, types)]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names)

    def run(batches):
        from pyspark import TaskContext

        aligner = _aligner(path_a, path_b)
        part, block, size = TaskContext.get().partitionId(), 0, 0
        place: dict[int, int] = {}
        holders = np.zeros(0, np.int64)

        def dictionary() -> pa.RecordBatch:
            pairs = np.fromiter(place, np.int64, len(place))
            whole = np.array([0, len(pairs)])
            return batch(1, {
                "part": pa.array([part]), "block": pa.array([block]),
                "pairs": _lists(pairs, whole, pa.int64()), "holders": _lists(holders[: len(pairs)], whole, pa.int64()),
            })

        for rows in text_slices(batches, "text", _SLICE_BYTES):
            texts = _texts(rows.column("text"))
            n = len(texts)
            codes, offsets = aligner.codes(texts)
            upto = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(aligner.numbers[codes], axis=0)])[offsets]
            numbers = np.diff(upto, axis=0)
            told = [";".join(map(aligner.text.__getitem__, codes[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:])]
            if digest:
                told = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]
            # The links of all segments in order, then each pair once per document.
            counts = aligner.numbers[codes, 3]
            at = np.arange(upto[-1, 3]) + np.repeat(aligner.starts[codes] - (np.cumsum(counts) - counts), counts)
            which, different = pd.factorize(aligner.links[at])
            owner = np.repeat(np.arange(n), numbers[:, 3])
            width = max(1, len(different))
            held, times = np.unique(owner * width + which, return_counts=True)
            owner, which = np.divmod(held, width)
            known = np.fromiter((place.setdefault(p, len(place)) for p in different.tolist()), np.int64, len(different))
            if len(place) > len(holders):
                holders = np.concatenate((holders, np.zeros(len(place), np.int64)))
            np.add.at(holders, known[which], 1)
            lists = np.searchsorted(owner, np.arange(n + 1))
            yield batch(n, {
                "part": pa.array(np.full(n, part)), "block": pa.array(np.full(n, block)),
                "doc_id": rows.column("doc_id"), "groups": pa.array(told, pa.string()),
                **{name: pa.array(numbers[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "codes": _lists(known[which], lists, pa.int32()), "times": _lists(times, lists, pa.int32()),
            })
            size += pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0
            if size >= BLOCK_BYTES:
                yield dictionary()
                block, size = block + 1, 0
                place, holders = {}, np.zeros(0, np.int64)
        yield dictionary()

    return run


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block, from the counts of the block's pairs."""
    size = (pc.max(counts.column("code")).as_py() or 0) + 1 if counts.num_rows else 1
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    code = counts.column("code").to_numpy()
    count[code], best[code] = counts.column("holders").to_numpy(), counts.column("best").to_numpy()
    codes, times = (docs.column(c).combine_chunks() for c in ("codes", "times"))
    ends = np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))
    codes, times = (pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in (codes, times))
    for name, values in (("n_best", best), ("count_sum", count)):
        sums = np.concatenate(([0], np.cumsum(values[codes] * times)))[np.concatenate(([0], ends))]
        docs = docs.append_column(name, pa.array(np.diff(sums), pa.int64()))
    return docs.select([f.split()[0] for f in ALIGNED.split(", ")])


def align(docs: DataFrame, scratch: Scratch, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """One row per document: `ALIGNED`. `groups` tells the ids of A and B between common cuts, as
    `a1,a2|b1;a3|b2,b3`, or with `digest` the SHA-256 of that. `n_best` counts links whose pair is in as
    many documents as any pair of its id of A, `count_sum` sums the documents of the pairs over all links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = scratch.table(rows.mapInArrow(_aligned(path_a, path_b, digest), _BLOCKS), "blocks")
    told = blocks.where("pairs IS NOT NULL").selectExpr(
        "part AS _part", "block AS _block", "posexplode(arrays_zip(pairs, holders)) AS (code, pair)"
    )
    counts = told.groupBy("pair.pairs").agg(F.sum("pair.holders").alias("holders"))
    # An id of A has at most as many partners as B has ids.
    counts = scratch.table(
        counts.selectExpr("pairs", "holders", "CAST(holders = max(holders) OVER (PARTITION BY shiftright(pairs, 32)) AS LONG) AS best"),
        "counts",
    )
    needed = told.selectExpr("_part", "_block", "code", "pair.pairs AS pairs").join(counts, "pairs").drop("pairs")
    own = blocks.where("pairs IS NULL").drop("pairs", "holders")
    return own.groupBy("part", "block").cogroup(needed.groupBy("_part", "_block")).applyInArrow(_scored, ALIGNED)
