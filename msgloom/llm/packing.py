"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents one after another. In each round a
source earns its quantum, 4096 times its target share, and sends the whole runs of 512 tokens
that its deficit holds, so that a small source is served seldom and not token by token; the rest is
carried to the next round. After r rounds a source with quantum q has therefore sent min(its
tokens, 512 floor(r q / 512)): less than a run behind its share. The place of every token in the
sequence of all rounds follows from r alone. Windows are cut from that sequence every 4096
tokens; where a window ends within a round, the sources not yet served keep their deficit
for the next window. All windows but the last are full. A queue that runs dry leaves its
place to the others, so a window then spans several rounds.

Because the state at any round is known in closed form, tasks cut their own pieces from
the queue places of their documents and deficits carry across partitions without
passing anything on. Ids are written once, in the order of the input, and never shuffled:
a document's place in its queue is the tokens of its source in the partitions before, plus
those before it in its own partition.

Default targets are the shares of the corpus, which all sources hold to the end. Other
targets hold until a queue runs dry. Quanta are exact multiples of 2^-12 token.

Sources beyond `MAX_QUEUES` share queues: the largest, those that `targets` names and the NULL one keep
their own, the rest go to queues by hash, in which each source's tokens of a partition stay together.

NULL texts are empty and make one end token. Rows that share a doc_id, also NULL, are
separate documents. NULL sources form one queue. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch
from msgloom.llm.words import text_slices, words_of

SEQUENCE = 4096
END_ID = 2
#: Tokens of a queue that are sent together.
RUN = 512
#: Numbers of a table of rounds by sources at a time.
_CELLS = 1 << 20
#: Queues are the components of the mixture, named in a small table each task holds. Of more sources
#: the largest have a queue each, in half of these; the others share the other half.
MAX_QUEUES = 10_000
_FRACTION = 1 << 12

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string"
)


class _Encoder:
    """Ids of texts whose words, ended by white space, are encoded one by one. Each
    different word is encoded once and remembered up to a bound. New words are encoded in
    groups, with a control character between them whose one id tells them apart."""

    REMEMBERED = 1_500_000
    LEARNED_AT_ONCE = 10_000
    GROUP = 50
    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.hashes, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.starts, self.ids = np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        # A word with the mark in it, or any if the mark has several ids, is encoded alone.
        alone = [len(self.mark) > 1 or self.MARK in w for w in words]
        together = [i for i, own in enumerate(alone) if not own]
        order = np.array([*together, *(i for i, own in enumerate(alone) if own)], np.int64)
        between = f" {self.MARK} "
        spans = range(0, len(together), self.GROUP)
        texts = [between.join([words[i] for i in together[at : at + self.GROUP]]) for at in spans]
        coded = self._ids([f"{t} {self.MARK}" for t in texts])
        ends = np.flatnonzero(coded == self.mark[0]) if texts else np.empty(0, np.int64)
        sizes = np.diff(ends, prepend=-1) - 1
        coded = np.delete(coded, ends)
        singly = [self._ids([w]) for w, own in zip(words, alone) if own]
        sizes = np.concatenate((sizes, np.array([len(x) for x in singly], np.int64)))
        ids = np.concatenate((coded, *singly))
        hashes = hashes[order]
        starts = np.cumsum(sizes) - sizes + len(self.ids)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])
        self.starts = np.insert(self.starts, at, starts[order])
        self.ids = np.concatenate((self.ids, ids))

    def _ids(self, texts: list[str]) -> np.ndarray:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter(itertools.chain.from_iterable(e.ids for e in coded), np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text ended by END_ID, and n + 1 offsets."""
        words = words_of(texts)
        each, once = pd.factorize(words.hashes)
        first = np.empty(len(once), np.int64)
        first[each[::-1]] = np.arange(len(each))[::-1]
        if len(self.hashes) > self.REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, once), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != once) if len(self.hashes) else np.arange(len(once))
        for part in np.split(new, range(self.LEARNED_AT_ONCE, len(new), self.LEARNED_AT_ONCE)) if len(new) else ():
            spans = zip(words.starts[first[part]], words.ends[first[part]])
            self.learn([words.data[a:b].tobytes().decode("utf-8", "replace") for a, b in spans], once[part])
        at = np.searchsorted(self.hashes, once)
        sizes, starts = self.sizes[at][each], self.starts[at][each]
        n = len(texts)
        before = np.concatenate(([0], np.cumsum(sizes)))[words.offsets] + np.arange(n + 1)
        total = before[-1]
        ids = np.empty(total, np.uint32)
        ends = before[1:] - 1
        ids[ends] = END_ID
        inside = np.ones(total, bool)
        inside[ends] = False
        shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        ids[inside] = self.ids[np.arange(total - n) + shift]
        return ids, before


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One for all tasks of a Python worker, so that words learned are kept from task to task.
    A task has one core, so the tokenizer starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Encoder(path)


def _encoded(tokenizer: str):
    """Rows in the order of the partition: ids, and the source's tokens before them there."""

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        sent: dict = {}
        for batch in text_slices(batches, "text"):
            ids, offsets = encoder.encode(batch.column("text"))
            sources = batch.column("source").to_pylist()
            sizes = np.diff(offsets)
            before = np.empty(len(sizes), np.int64)
            for i, (source, size) in enumerate(zip(sources, sizes)):
                before[i] = sent.get(source, 0)
                sent[source] = before[i] + size
            narrow = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
            step, data = narrow.itemsize, narrow.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array(np.full(len(sizes), part, np.int64)),
                    pa.array(before),
                    pa.array(sizes),
                    pa.array([data[a * step : b * step] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                ],
                ["doc_id", "source", "part", "before", "doc_tokens", "ids"],
            )

    return run


class Mixture:
    """Tokens and quanta of the sources, in the order in which a round serves them."""

    def __init__(self, tokens: Mapping, targets: Mapping | None = None):
        self.names = sorted(tokens, key=lambda s: (s is not None, s))
        self.index = {s: i for i, s in enumerate(self.names)}
        self.tokens = np.array([tokens[s] for s in self.names], np.int64)
        weights = [int(tokens[s]) if targets is None else targets.get(s, 0) for s in self.names]
        total = sum(weights) or 1
        self.quanta = np.array([max(1, int(w * SEQUENCE * _FRACTION // total)) for w in weights], np.int64)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each source (columns) has sent after so many rounds (rows)."""
        # The product stays below 2^63: a round beyond a queue's last sends nothing more.
        step = RUN * _FRACTION
        last = -(-(-(-self.tokens // RUN) * step) // self.quanta)
        return np.minimum(self.tokens, np.minimum(rounds[:, None], last) * self.quanta // step * RUN)

    def pieces(self, source: int, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens begin .. begin + size of a queue are cut, from 0, and where each
        piece starts in the sequence of all rounds."""
        # A run k is sent in the first round r with floor((r + 1) quantum / run) > k; only such rounds count.
        runs = np.arange(begin // RUN, (begin + size - 1) // RUN + 1)
        served = np.unique(-(-(runs + 1) * (RUN * _FRACTION) // int(self.quanta[source])) - 1)
        lows, places = [], []
        for at in range(0, len(served), max(1, _CELLS // len(self.names))):
            rounds = served[at : at + max(1, _CELLS // len(self.names))]
            before, after = self.sent(rounds), self.sent(rounds + 1)
            own = before[:, source]
            starts = np.maximum(own, begin)
            # A round serves sources in order: those before this one have finished it already.
            places.append(after[:, :source].sum(axis=1) + before[:, source:].sum(axis=1) + starts - own)
            lows.append(starts - begin)
        low, place = np.concatenate(lows), np.concatenate(places)
        lengths = np.diff(low, append=size)
        # Chunks that meet are one; then windows cut.
        joined = np.concatenate(([True], place[1:] != place[:-1] + lengths[:-1]))
        low, place = low[joined], place[joined]
        lengths = np.diff(low, append=size)
        windows = (place + lengths - 1) // SEQUENCE - place // SEQUENCE + 1
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(place, windows)
        cut = np.where(within == 0, start, (start // SEQUENCE + within) * SEQUENCE)
        return np.repeat(low, windows) + cut - start, cut


def _cut(mixture: Mixture):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, source, queue, begin, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, np.uint16 if len(data) == 2 * size else np.uint32).astype("<u4")
                view = memoryview(ids).cast("B")
                at, place = mixture.pieces(mixture.index[queue], begin, size)
                ends = np.append(at[1:], size)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                rows.append((np.full(len(at), -1 if doc_id is None else doc_id), at, ends - at, crc, size, place, doc_id is None, source))
            if not rows:
                continue
            counts = [len(r[1]) for r in rows]
            ids = np.concatenate([r[0] for r in rows])
            none = np.repeat([r[6] for r in rows], counts)
            place = np.concatenate([r[5] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=none),
                    pa.array(np.concatenate([r[1] for r in rows])),
                    pa.array(np.concatenate([r[2] for r in rows])),
                    pa.array(np.concatenate([np.array(r[3], np.int64) for r in rows])),
                    pa.array(np.repeat([r[4] for r in rows], counts)),
                    pa.array(place // SEQUENCE),
                    pa.array(place % SEQUENCE),
                    pa.array([r[7] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), counts))),
                ],
                [f.split()[0] for f in PIECES.split(", ")],
            )

    return run


def _queues(per_part: DataFrame, scratch: Scratch, targets: Mapping | None) -> DataFrame:
    """`per_part` with the queue of each source: NULL, its own, or one of those that are shared."""
    sums = per_part.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if sums.count() < MAX_QUEUES:
        return per_part.selectExpr("*", "concat('s', source) AS queue")
    # Bounded: names for half of the queues, and those of the targets.
    wanted = F.col("source").isin(*(s for s in targets if s is not None)) if targets else F.lit(False)
    largest = sums.where(~wanted).orderBy(F.desc("tokens"), "source").limit(MAX_QUEUES // 2)
    own = largest.union(sums.where(wanted)).selectExpr("source AS _own")
    shared = f"concat('p', pmod(xxhash64(source), {MAX_QUEUES // 2 - 1}))"
    return per_part.join(scratch.table(own, "own"), F.col("source") == F.col("_own"), "left").selectExpr(
        "source", "part", "tokens", f"if(_own IS NOT NULL OR source IS NULL, concat('s', source), {shared}) AS queue"
    )


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, targets: Mapping | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source. `targets` maps sources to the share of tokens wanted; a source it lacks
    comes last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    coded = scratch.table(
        rows.mapInArrow(
            _encoded(tokenizer),
            "doc_id long, source string, part long, before long, doc_tokens long, ids binary",
        ),
        "ids",
    )
    per_part = scratch.table(coded.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens")), "parts")
    queued = _queues(per_part, scratch, targets)
    # One row per queue, a bounded mixture.
    totals = queued.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()
    mixture = Mixture({r["queue"]: r["tokens"] for r in totals}, targets and {s if s is None else f"s{s}": t for s, t in targets.items()})
    starts = queued.selectExpr(
        "source AS _source", "part AS _part", "queue",
        "coalesce(sum(tokens) OVER (PARTITION BY queue ORDER BY part, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " AS _start",
    )
    starts = scratch.table(starts, "starts")
    placed = coded.join(starts, (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("part") == F.col("_part")))
    placed = placed.selectExpr("doc_id", "source", "queue", "_start + before AS begin", "doc_tokens", "ids")
    return placed.mapInArrow(_cut(mixture), PIECES)
