"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps compatibility forms, homoglyphs of other scripts, and digits and signs within
words to Latin letters, drops invisible characters, and lowers case. Accents stay, since
they tell words apart; whole words without accents are also looked for in the text without.

The lexicon is learned. Its entries are words and stems (beginnings of words) that
toxic training documents have in many different contexts, and others hardly ever, weighted
by the log ratio. A context is the word before and after, so copies of a document and
repeated words count once. Of entries that cover the same occurrences the longest is taken.
Matches are whole words, or start a word. A match inside an exception phrase does not count;
phrases are given, and word pairs around a lexicon word that only harmless training documents
have are added. The sum of weights, alone and divided by length, becomes a probability by
a logistic regression on the training rows.

Training takes at most `sample` labelled rows, those of the smallest hash; scoring takes
every document and its whole text.

NULL, empty and word-free texts get the score of a text without matches. Labels that are NULL
teach nothing. Rows that repeat a doc_id are scored each. Without training rows of both
kinds the lexicon is empty and every score is the share of toxic rows (0.5 if there is none).
"""

from __future__ import annotations

import math
import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.logistic import fit_logistic, sigmoid
from msgloom.llm.tables import Scratch
from msgloom.llm.words import text_slices

#: Most labelled rows that are used for training.
SAMPLE = 10_000
#: Most entries of the lexicon, and most candidates for it.
LEXICON = 2_000
CANDIDATES = 50_000
#: An entry needs so many toxic contexts, also as a share of toxic documents, such a log
#: ratio, and so many standard deviations of it.
LEAST_CONTEXTS = 5
LEAST_SHARE = 0.005
LEAST_WEIGHT = 2.5
LEAST_Z = 3.0
#: Letters of stems, and the part of a stem's contexts that a longer one must keep.
STEM_LETTERS = (3, 12)
KEEPS = 0.9
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and signs for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
}
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "l", "€": "e", "£": "l",
}
# Phrases in which a word that may insult does not.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "loser bracket",
    "losers bracket", "pond scum", "soap scum", "scum line", "not worthless", "not stupid", "not an idiot",
    "idiot light", "idiot proof", "moron number",
)

_LEET = re.compile("(?<=[^\\W\\d_])[" + re.escape("".join(SUBSTITUTES)) + "]+(?=[^\\W\\d_])|"
                   "(?<!\\w)[" + re.escape("".join(c for c in SUBSTITUTES if c not in "!|")) + "](?=[^\\W\\d_])|"
                   "(?<=[^\\W\\d_])[" + re.escape("".join(c for c in SUBSTITUTES if c not in "!|")) + "]+(?!\\w)")
_LETTERS = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")


class _Table(dict):
    """Characters to what they become, worked out once each."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int):
        value = self[code] = self.rule(chr(code))
        return value


_PLAIN = _Table(lambda c: "" if unicodedata.category(c) == "Cf" else c.lower().translate(_LETTERS))
_BARE = _Table(lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))


def folded(text: str | None) -> str:
    if not text:
        return ""
    plain = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).translate(_PLAIN)
    return _LEET.sub(lambda m: m[0].translate(_SIGNS), plain)


class Model(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...]


def _automaton(entries):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, table in entries:
        for text, weight in table.items():
            # A stem that is also a word keeps both.
            automaton.add_word(text, (*automaton.get(text, ()), (kind, len(text), weight)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        phrases = dict.fromkeys(model.exceptions, 0.0)
        self.full = _automaton([("word", model.words), ("stem", model.stems), ("phrase", phrases)])
        plain = {w: x for w, x in model.words.items() if w.isascii()}
        self.bare = _automaton([("word", plain), ("phrase", phrases)])

    @staticmethod
    def _matches(automaton, text: str) -> dict[int, float]:
        """Start of each match that counts, and its weight."""
        hits: dict[int, tuple[int, float]] = {}
        spared = []
        for last, entries in automaton.iter(text):
            ends = last + 1 == len(text) or not text[last + 1].isalnum()
            for kind, size, weight in entries:
                first = last - size + 1
                if (first and text[first - 1].isalnum()) or not (ends or kind == "stem"):
                    continue
                if kind == "phrase":
                    spared.append((first, last))
                elif weight > hits.get(first, (0, 0.0))[1]:
                    hits[first] = (last, weight)
        return {
            first: weight
            for first, (last, weight) in hits.items()
            if not any(a <= first and last <= b for a, b in spared)
        }

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of the weights of what counts, and that per hundred words, as logarithms."""
        text = folded(text)
        if not text or not self.model.words and not self.model.stems:
            return 0.0, 0.0
        total = sum(self._matches(self.full, text).values())
        if not text.isascii() and len(self.bare):
            total = max(total, sum(self._matches(self.bare, text.translate(_BARE)).values()))
        if not total:
            return 0.0, 0.0
        words = text.count(" ") + text.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / words)

    def scores(self, texts: list) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 2)
        bias, *slopes = self.model.coefficients
        return sigmoid(bias + x @ np.array(slopes))


def _occurrences(batches):
    """Folded words and word pairs of training texts. `key` tells toxic contexts apart."""
    for part in text_slices(batches, "text"):
        rows = []
        for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            seq = _WORD.findall(folded(text))
            if label:
                near = zip(seq, ["", *seq], [*seq[1:], ""])
                rows += [(label, 0, w, f"{a} {b}") for w, a, b in set(near)]
            else:
                rows += [(label, 0, w, "") for w in seq]
            rows += [(label, 1, f"{a} {b}", "") for a, b in set(zip(seq, seq[1:]))]
        toxic, kind, word, key = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32()), pa.array(kind, pa.int32()), pa.array(word, pa.string()), pa.array(key, pa.string())],
            ["toxic", "kind", "word", "key"],
        )


def choose(candidates: list[tuple[str, bool, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems from candidates (text, is a stem, contexts, weight): of those that
    begin alike the longest that still has nearly all contexts of the shortest."""
    stems = {t: (n, w) for t, stem, n, w in candidates if stem}
    words = {t: (n, w) for t, stem, n, w in candidates if not stem}
    longer: dict[str, list[str]] = {}
    for text in {**stems, **words}:
        if text[:-1] in stems:
            longer.setdefault(text[:-1], []).append(text)
    chosen: dict[str, float] = {}
    whole: dict[str, float] = {}
    for text in sorted({**stems, **words}, key=lambda t: (len(t), t)):
        if any(text[:k] in chosen for k in range(1, len(text) + 1)):
            continue
        if text not in stems:
            whole[text] = words[text][1]
            continue
        count = stems[text][0]
        at = text
        while True:
            if at in words and words[at][0] >= KEEPS * count:
                whole[at] = words[at][1]
                break
            further = [t for t in longer.get(at, ()) if stems.get(t, (0,))[0] >= KEEPS * count or words.get(t, (0,))[0] >= KEEPS * count]
            if not further:
                chosen[at] = stems[at][1]
                break
            at = further[0]
            if at not in stems:
                whole[at] = words[at][1]
                break
    return whole, chosen


def _features(matcher_of: Model):
    def run(batches):
        matcher = Matcher(matcher_of)
        for part in text_slices(batches, "text"):
            x = np.array([matcher.features(t) for t in part.column("text").to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "total", "density"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """Learn from documents (doc_id, text) with labels (doc_id, toxic). What labels are
    given is what is learned from."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text")
    rows = scratch.table(rows, "training")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(sizes)]
        bias = math.log((share + 1e-3) / (1 - share + 1e-3))
        return Model({}, {}, EXCEPTIONS, (bias, 0.0, 0.0))
    seen = rows.mapInArrow(_occurrences, "toxic int, kind int, word string, key string")
    toxic = seen.where("toxic = 1").distinct().groupBy("kind", "word").agg(F.count("*").alias("bad"))
    clean = seen.where("toxic = 0").groupBy("kind", "word").agg(F.count("*").alias("good"))
    counts = toxic.join(clean, ["kind", "word"], "full").na.fill(0, ["bad", "good"])
    counts = scratch.table(counts, "counts")
    entries = counts.where("kind = 0 AND length(word) > 2").selectExpr("word AS text", "false AS stem", "bad", "good")
    low, high = STEM_LETTERS
    stems = counts.where(f"kind = 0 AND length(word) > {low}").selectExpr(
        f"explode(sequence({low}, least({high}, length(word) - 1))) AS size", "word", "bad", "good"
    )
    # The whole word also has its stem, so that a stem counts every word it begins.
    stems = stems.unionByName(counts.where(f"kind = 0 AND length(word) BETWEEN {low} AND {high}").selectExpr(
        "length(word) AS size", "word", "bad", "good"
    )).groupBy(F.expr("left(word, size)").alias("text"), F.lit(True).alias("stem")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    all_bad, all_good = counts.where("kind = 0").agg(F.sum("bad"), F.sum("good")).first()
    all_bad, all_good = float(all_bad or 0) + 1, float(all_good or 0) + 1
    weight = F.log((F.col("bad") + 0.5) / F.lit(all_bad)) - F.log((F.col("good") + 0.5) / F.lit(all_good))
    deviation = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    least = max(LEAST_CONTEXTS, LEAST_SHARE * sizes[1])
    candidates = (
        entries.unionByName(stems).where(F.col("bad") >= least)
        .withColumns({"weight": weight, "z": weight / deviation})
        .where((F.col("weight") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
        .orderBy(F.desc("z"), "text", "stem")
        .limit(CANDIDATES)
    )
    chosen = candidates.select("text", "stem", "bad", "weight").collect()
    words, stems = choose([(r["text"], r["stem"], r["bad"], float(r["weight"])) for r in chosen])
    best = sorted({**words, **stems}, key=lambda t: (-words.get(t, stems.get(t)), t))[:LEXICON]
    words = {t: w for t, w in words.items() if t in set(best)}
    stems = {t: w for t, w in stems.items() if t in set(best)}
    # Pairs that hold a lexicon word and that only harmless documents have.
    pair = F.split("word", " ")
    harmless = counts.where((F.col("kind") == 1) & (F.col("bad") == 0) & (F.col("good") >= LEAST_CONTEXTS))
    harmless = harmless.where(pair[0].isin(*words) | pair[1].isin(*words)) if words else harmless.limit(0)
    learned = [r["word"] for r in harmless.orderBy(F.desc("good"), "word").limit(LEXICON).select("word").collect()]
    model = Model(words, stems, (*EXCEPTIONS, *learned), (0.0, 0.0, 0.0))
    # Bounded by `sample`: three numbers for each training row.
    table = rows.mapInArrow(_features(model), "toxic int, total double, density double").toArrow()
    x = np.column_stack([table.column("total").to_numpy(), table.column("density").to_numpy()])
    coefficients = fit_logistic(x, table.column("toxic").to_numpy().astype(float), penalty=1e-3)
    # More, or denser, matches never lower a score.
    if min(coefficients[1:]) < 0:
        keep = int(np.argmax(coefficients[1:]))
        one = fit_logistic(x[:, [keep]], table.column("toxic").to_numpy().astype(float), penalty=1e-3)
        coefficients = [one[0], 0.0, 0.0]
        coefficients[1 + keep] = max(0.0, one[1])
    scratch.drop("training", "counts")
    return model._replace(coefficients=tuple(float(c) for c in coefficients))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of `docs` (doc_id, text)."""

    def run(batches):
        matcher = Matcher(model)
        for part in text_slices(batches, "text"):
            scores = matcher.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, as they are, that are not predicted toxic."""

    def run(batches):
        matcher = Matcher(model)
        for part in text_slices(batches, "text"):
            yield part.filter(pa.array(matcher.scores(part.column("text").to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
