"""Quality by positive-unlabelled learning.

A document is described by statistics of its whole text (length, word lengths, repeated
words, shingles and lines, capitals, digits, signs), each cut into bins at quantiles over all
positive and unlabelled rows. On these a linear scorer is fitted by minimising the non-negative
unbiased risk of Kiryo et al. (2017) with the sigmoid loss,

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]),

where the class prior is estimated from the rows themselves: the smallest ratio, with two
standard errors added, of the unlabelled to the positive share above any score, reached by half the
positives at least, of a scorer
that tells the two apart. There are two such scorers, each fitted on one half of the sample and
applied to all rows of the other half; their counts are added up by quantile of the score. The risk
is minimised by full gradient steps; while the bracket is negative, the step goes against it.

Only trusted positives and unlabelled rows are learned from; rows labelled 0 are not used.
Unlabelled rows are web text without a label. The statistics of all rows are written once; the
quantiles and the shares behind the prior are aggregates over every row. Gradients are taken
on a sample of about `sample` rows of each kind, those of the smallest hashes, one for
each doc_id.

NULL, empty and word-free texts have statistics of zero and are scored like others. Rows
that repeat a doc_id are scored each. Without positives or unlabelled rows every score
is 0.5.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.logistic import fit_logistic, sigmoid
from msgloom.llm.tables import Scratch
from msgloom.llm.words import combined, shingles, text_slices, words_of

#: Positive, and unlabelled, documents that gradients are taken on, about.
SAMPLE = 8_000
BINS = 10
STEPS = 400
RATE = 0.05
PENALTY = 1e-3
THRESHOLD = 0.7

FEATURES = (
    "words", "word_bytes", "longest_word", "new_words", "commonest_word", "new_triples", "lines", "new_lines",
    "words_a_line", "capitals", "digits", "signs", "stops", "beyond_ascii",
)

_CLASSES = np.zeros((5, 256), np.int64)
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = 1
_CLASSES[3, [ord(c) for c in ".,;:?"]] = 1
_CLASSES[4, 128:] = 1


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    words = words_of(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    counts = np.diff(words.offsets)
    if not len(words.hashes):
        return out
    sizes = (words.ends - words.starts).astype(float)
    triples, places = shingles(words.hashes, words.offsets, 3)
    breaks = np.flatnonzero(words.data == 10)
    # Line of each word, and a hash of each line with words.
    line = np.searchsorted(breaks, words.starts)
    owner = np.repeat(np.arange(n), counts)
    fresh = np.flatnonzero(np.diff(line, prepend=-1) | np.diff(owner, prepend=-1))
    per_line = np.diff(np.append(fresh, len(line)))
    spread = words.hashes * (np.arange(len(line), dtype=np.uint64) - np.repeat(fresh, per_line).astype(np.uint64) + np.uint64(1))
    line_hash = combined([np.add.reduceat(spread, fresh)])
    line_places = np.searchsorted(owner[fresh], np.arange(n + 1))
    marks = [np.concatenate(([0], np.cumsum(c[words.data])))[words.text_starts] for c in _CLASSES]
    shares = [np.diff(m) for m in marks]
    for i in np.flatnonzero(counts):
        a, b = words.offsets[i], words.offsets[i + 1]
        ordered = np.sort(words.hashes[a:b])
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total, length = b - a, sizes[a:b]
        own = triples[places[i] : places[i + 1]]
        rows = line_hash[line_places[i] : line_places[i + 1]]
        in_words = length.sum()
        out[i] = (
            np.log(total), in_words / total, np.log(length.max()), len(edges) / total,
            np.diff(np.append(edges, total)).max() / total, len(np.unique(own)) / len(own), np.log(len(rows)),
            len(np.unique(rows)) / len(rows), np.log(total / len(rows)), shares[0][i] / in_words,
            shares[1][i] / in_words, shares[2][i] / total, shares[3][i] / total, shares[4][i] / in_words,
        )
    return out


class Model(NamedTuple):
    edges: list  # for each statistic the limits of its bins
    weights: list  # bias, then one for each bin
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Bins as zeros and ones."""
        parts = []
        for k, edges in enumerate(self.edges):
            parts.append(np.eye(len(edges) + 1)[np.searchsorted(edges, x[:, k], "right")])
        return np.concatenate([np.ones((len(x), 1)), *parts], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), 0.5)
        return sigmoid(self.inputs(x) @ np.array(self.weights))


#: Quantiles at which statistics are cut: finer ones at both ends, where junk lies.
CUTS = [0.002, 0.01, 0.03, *(k / BINS for k in range(1, BINS)), 0.97, 0.99, 0.998]


def fit(positive: np.ndarray, unlabelled: np.ndarray, edges: list, prior: float) -> Model:
    """Model from the statistics of positive and of unlabelled rows."""
    model = Model(edges, [], prior)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w, speed, size = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for step in range(1, STEPS + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        rise = prior * p.T @ (sp * (1 - sp)) / len(p)  # of the share scored good, as of loss(-)
        rise_negative = u.T @ (su * (1 - su)) / len(u) - rise
        loss = su.mean() - prior * sp.mean()
        gradient = (rise_negative - rise if loss >= 0 else -rise_negative) + PENALTY * w
        speed = 0.9 * speed + 0.1 * gradient
        size = 0.999 * size + 0.001 * gradient**2
        w -= RATE * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.999**step)) + 1e-8)
    return model._replace(weights=w.tolist())


class Separator(NamedTuple):
    """Tells positive from unlabelled rows; fitted on one half of the sample."""

    model: Model
    cuts: list  # scores of the sampled positives of the other half, at 51 quantiles

    def places(self, x: np.ndarray) -> np.ndarray:
        """How many of the cuts each row's score reaches."""
        return np.searchsorted(self.cuts, self.model.inputs(x) @ np.array(self.model.weights), "right")


def separators(edges: list, x: np.ndarray, positive: np.ndarray, half: np.ndarray) -> dict[int, Separator]:
    """For each half of the rows the separator learned from the other one, where it has both kinds."""
    found = {}
    for other in (0, 1):
        own, trusted = half != other, x[positive & (half == other)]
        if len(trusted) and len(set(positive[own].tolist())) == 2:
            model = Model(edges, [], 0.5)
            model = model._replace(weights=fit_logistic(model.inputs(x[own])[:, 1:], positive[own].astype(float), penalty=1e-3))
            scores = model.inputs(trusted) @ np.array(model.weights)
            found[other] = Separator(model, np.quantile(scores, np.linspace(0, 0.5, 51), method="lower").tolist())
    return found


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from how many rows of both reach no cut, the
    first only, and so on to all."""
    shares = [np.cumsum(n[::-1])[::-1][1:] / n.sum() for n in (positive, unlabelled)]
    p, u = shares[0][shares[0] > 0], shares[1][shares[0] > 0]
    # Of the ratio, with shares that are not quite 0 or 1.
    n, m = unlabelled.sum(), positive.sum()
    a, b = (u * n + 1) / (n + 2), (p * m + 1) / (m + 2)
    error = u / p * np.sqrt((1 - a) / (a * n) + (1 - b) / (b * m))
    return float(np.clip((u / p + 2 * error).min(initial=1.0), 0.05, 0.99))


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([table.column(f).to_numpy() for f in FEATURES])


def _measured(batches):
    for part in text_slices(batches, "text"):
        x = statistics(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in x.T]], ["doc_id", *FEATURES])


def _counted(found: dict[int, Separator]):
    """Counts of a batch by half, kind and place."""

    def run(batches):
        for batch in batches:
            half, positive = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "positive"))
            place, x = np.zeros(len(half), np.int64), _matrix(batch)
            for own, separator in found.items():
                place[half == own] = separator.places(x[half == own])
            keys, n = np.unique(np.column_stack([half, positive, place]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (*keys.T, n)], ["half", "positive", "place", "n"])

    return run


def _prior(rows: DataFrame, found: dict[int, Separator]) -> float:
    """The class prior over all rows; even odds where no half can be told apart."""
    counts = rows.mapInArrow(_counted(found), "half long, positive long, place long, n long")
    # Bounded: two halves, two kinds, at most 52 places.
    counts = counts.groupBy("half", "positive", "place").agg(F.sum("n").alias("n")).collect()
    tally = np.zeros((2, 52))
    for r in counts:
        if r["half"] in found:
            tally[r["positive"], r["place"]] += r["n"]
    return class_prior(tally[1], tally[0]) if tally.sum(axis=1).all() else 0.5


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE, known: DataFrame | None = None) -> Model:
    """Learn from documents (doc_id, text): positives are those with quality 1 in `labels`
    (doc_id, quality). Rows in `known` (doc_id), by default `labels`, are not unlabelled."""
    trusted = labels.where("quality = 1").select("doc_id").withColumn("positive", F.lit(True))
    seen = (labels if known is None else known).select("doc_id").withColumn("positive", F.lit(False))
    kinds = trusted.union(seen).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("positive").alias("positive"))
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = texts.mapInArrow(_measured, schema).join(kinds, "doc_id", "left").where("coalesce(positive, true)")
    rows = scratch.table(
        measured.selectExpr("doc_id", "coalesce(positive, false) AS positive", "CAST(xxhash64(1, doc_id) & 1 AS INT) AS half", *FEATURES),
        "statistics",
    )
    quantiles = [F.percentile_approx(f, CUTS, 10_000).alias(f) for f in FEATURES]
    totals = rows.agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("unlabelled"), *quantiles).first()
    if not totals["positive"] or not totals["unlabelled"]:
        return Model([], [], 0.5)
    edges = [sorted(set(totals[f])) for f in FEATURES]
    # Hashes are spread evenly, so those below a share of their range are that share of the documents.
    share = {kind: min(1.0, sample / totals[kind]) for kind in ("positive", "unlabelled")}
    drawn = rows.where(
        f"xxhash64(doc_id) / pow(2D, 64) + 0.5D <= if(positive, {share['positive']!r}D, {share['unlabelled']!r}D)"
    ).groupBy("doc_id", "positive", "half").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "positive", "half", "x.*")
    # Bounded by `sample`: a few numbers for each training row, in an order of their own.
    table = drawn.toArrow().sort_by("doc_id")
    kind, x = table.column("positive").to_numpy().astype(bool), _matrix(table)
    if kind.all() or not kind.any():
        return Model([], [], 0.5)
    prior = _prior(rows, separators(edges, x, kind, table.column("half").to_numpy()))
    return fit(x[kind], x[~kind], edges, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of `docs` (doc_id, text)."""

    def run(batches):
        for part in text_slices(batches, "text"):
            scores = model.scores(statistics(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, as they are, that are predicted good, and all if nothing was learned."""

    def run(batches):
        for part in text_slices(batches, "text"):
            scores = model.scores(statistics(part.column("text")))
            yield part.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema) if model.weights else docs
