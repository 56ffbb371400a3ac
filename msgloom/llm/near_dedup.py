"""Near-duplicate documents by HyperMinHash.

1. Every document becomes its number of distinct word shingles, a 128-bit fingerprint of
   the set, and 128 registers of 16 bits: the smallest hash of each bucket, stored as its
   count of leading zeros and ten mantissa bits. Texts go no further than this.
2. Documents of equal sets form a class, named by its smallest doc_id; only classes go on.
3. Bands of four registers are hashed; an empty register borrows one chosen by a fixed
   random walk, so that short sets band as sharply as long ones. Classes that share a band
   with the smallest class of that band are pairs, thinned by the Jaccard estimate from the
   registers, corrected for chance collisions.
4. The texts of the remaining pairs are fetched and the link is confirmed on full sets.
5. Where a band still holds several components, its members may have links that no
   representative saw. Members that such bands connect are clumps; the registers of a clump are
   compared in blocks, across components only. Texts are fetched for members with a likely
   partner in a pair of blocks, and compared there on full sets; only links that join
   components come out. No link between components can then be missing
   but one that shares no band (at the threshold of 0.8 a chance of 5e-8) or whose
   estimate is off by four standard deviations.
6. Components are found by star steps.

Rows: a group of copies is one class, joins on hot keys have plain shuffles that adaptive
execution splits, and a hot representative is met in 64 shares.

NULL and empty texts, and texts without words, have an empty set, link with nothing and
keep their own id. Rows without doc_id have no component (NULL) and are kept. A row that
repeats a doc_id counts as the same document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.components import components
from msgloom.llm.tables import Scratch
from msgloom.llm.words import mixed, shingle_sets, text_slices

BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
BAND_WIDTH = 4
BANDS = REGISTERS // BAND_WIDTH
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 4.0
#: Shares in which the partners of one representative are met.
SHARES = 64
#: Members of a clump in one block.
BLOCK = 512

_REST_BITS = 64 - BUCKET_BITS
_WORK_BITS = 52  # of the rest, what a double holds exactly


# --- registers ----------------------------------------------------------------


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each sorted set of hashes; 0 marks an empty bucket."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_REST_BITS)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, own in enumerate(sets):
        if len(own):
            at = np.searchsorted(own, bounds)
            full[i] = np.diff(at, append=len(own)) > 0
            least[i] = own[np.minimum(at, len(own) - 1)]
    rest = (least & np.uint64((1 << _REST_BITS) - 1)) >> np.uint64(_REST_BITS - _WORK_BITS)
    _, length = np.frexp(rest.astype(np.float64))
    zeros = (_WORK_BITS - length).astype(np.uint64)
    lead = (rest << zeros) >> np.uint64(_WORK_BITS - 1 - MANTISSA_BITS)
    mantissa = lead & np.uint64((1 << MANTISSA_BITS) - 1)
    packed = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa
    return np.where(full, packed, 0).astype(np.uint16)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates for rows of registers, and how many registers each rests on.

    Equal registers are corrected for those that different sets of these sizes would
    share: both minima in the same binade and the same of its 2^10 cells.
    """
    either = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    edges = np.concatenate((2.0 ** -np.arange(0, 40), [0.0]))
    means = [np.exp(-np.outer(np.asarray(n, float) / REGISTERS, edges)) for n in (n_a, n_b)]
    inside = [m[:, 1:] - m[:, :-1] for m in means]
    chance = REGISTERS * (inside[0] * inside[1]).sum(axis=1) / 2**MANTISSA_BITS
    return (equal - chance) / np.maximum(either - chance, 1e-9), either


def passes(estimate: np.ndarray, basis: np.ndarray, threshold: float) -> np.ndarray:
    return estimate >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(basis, 1))


def _filled(regs: np.ndarray) -> np.ndarray:
    """Registers with their bucket, each empty one taken from the first full bucket on its
    own fixed random walk; the walk is the same for all documents."""
    out = regs.astype(np.uint64) | (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(16))
    rows, cols = np.nonzero(regs == 0)
    turn = np.uint64(0)
    while len(rows):
        turn += np.uint64(1)
        source = (mixed(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn) % np.uint64(REGISTERS)).astype(int)
        found = regs[rows, source] > 0
        r, c, s = rows[found], cols[found], source[found]
        out[r, c] = regs[r, s].astype(np.uint64) | (s.astype(np.uint64) << np.uint64(16))
        rows, cols = rows[~found], cols[~found]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band of each row; a band takes registers that lie far apart."""
    parts = _filled(regs).reshape(len(regs), BAND_WIDTH, BANDS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS))
    for k in range(BAND_WIDTH):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return keys.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


# --- steps on batches -----------------------------------------------------------


def _signatures(width: int):
    def run(batches):
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                ["doc_id", "n_shingles", "fingerprint", "registers"],
            )

    return run


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("registers")))
            ids = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "cls"])


def _estimated(threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column("registers_a")), _matrix(batch.column("registers_b"))
                sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
                kept = pa.array(passes(*jaccard_estimate(a, b, *sizes), threshold))
                yield batch.select(["a", "b"]).filter(kept)

    return run


def _verified(width: int, percent: int):
    """Rows come sorted: the text of a representative, then its partners of this share."""

    def run(batches):
        held = own = None
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            a = part.column("a").to_pylist()
            b = part.column("b").to_pylist()
            share = part.column("share").to_pylist()
            out: list[tuple[int, int]] = []
            for i, own_set in enumerate(sets):
                if b[i] is None:
                    held, own = (a[i], share[i]), own_set
                elif held == (a[i], share[i]):
                    both = len(np.intersect1d(own, own_set, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(own_set) - both):
                        out.append((a[i], b[i]))
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v"])

    return run


def _partners(comp, n, regs, block, i: int, percent: int) -> np.ndarray:
    """Later rows of a group that row i may be linked with, in other components, by size and estimate.
    Groups are sorted by block; those of two blocks meet across them only."""
    other = slice(i + 1, len(n))
    wanted = (comp[other] != comp[i]) & (percent * np.maximum(n[other], n[i]) <= 100 * np.minimum(n[other], n[i]))
    if block[0] != block[-1]:
        wanted &= block[other] != block[i]
    at = np.flatnonzero(wanted) + i + 1
    if not len(at):
        return at
    mine = np.broadcast_to(regs[i], (len(at), REGISTERS))
    return at[passes(*jaccard_estimate(mine, regs[at], np.broadcast_to(n[i], len(at)), n[at]), percent / 100)]


def _likely(percent: int):
    """Groups come sorted by clump and block pair, with registers; yields the members that have a
    likely partner in the group."""
    names = ["clump", "low", "high", "cls", "comp", "block"]

    def members(rows: list[tuple]) -> pa.RecordBatch | None:
        columns = [np.array([r[k] for r in rows], np.int64) for k in range(7)]
        comp, block, n = columns[4:]
        regs = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
        close = np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            at = _partners(comp, n, regs, block, i, percent)
            close[at] = True
            close[i] |= len(at) > 0
        if close.any():
            return pa.RecordBatch.from_arrays([pa.array(c[close]) for c in columns[:6]], names)
        return None

    def run(batches):
        group, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "n", "registers"])):
                if row[:3] != group:
                    if len(rows) > 1 and (found := members(rows)):
                        yield found
                    group, rows = row[:3], []
                rows.append(row)
        if len(rows) > 1 and (found := members(rows)):
            yield found

    return run


def _compared(width: int, percent: int):
    """Groups come sorted by clump and block pair; yields confirmed links that join
    components which nothing in the group has joined before."""

    def links_of(rows: list[tuple[int, int, int, np.ndarray]]) -> tuple[list[int], list[int]]:
        cls, comp, block = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sets = [r[3] for r in rows]
        n, regs = np.array([len(s) for s in sets]), registers(sets)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        u, v = [], []
        for i in range(len(rows) - 1):
            for j in _partners(comp, n, regs, block, i, percent):
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        root[max(a, b)] = min(a, b)
                        u.append(int(cls[i]))
                        v.append(int(cls[j]))
        return u, v

    def run(batches):
        group, rows = None, []
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            columns = (part.column(c).to_pylist() for c in ("clump", "low", "high", "cls", "comp", "block"))
            for clump, low, high, cls, comp, block, own in zip(*columns, sets):
                if (clump, low, high) != group:
                    if len(rows) > 1 and (found := links_of(rows))[0]:
                        yield _links(*found)
                    group, rows = (clump, low, high), []
                rows.append((cls, comp, block, own))
        if len(rows) > 1 and (found := links_of(rows))[0]:
            yield _links(*found)

    return run


def _links(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


# --- the plan -------------------------------------------------------------------


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as links (u, v)."""
    shared = pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    partners = shared.selectExpr("b AS doc_id", "a", "share", "b")
    owners = shared.selectExpr("a AS doc_id", "a", "share").distinct().selectExpr("*", "CAST(NULL AS BIGINT) AS b")
    # Sort-merge at every size: a plan that is right for few pairs is not for many.
    wanted = partners.union(owners).hint("merge")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("a", "share", "b", "text")
    sorted_texts = texts.repartition("a", "share").sortWithinPartitions("a", "share", "b")
    return sorted_texts.mapInArrow(_verified(width, percent), "u long, v long")


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of `width`-word shingles have a Jaccard
    similarity of `percent` or more; component_id is the smallest doc_id reachable.
    """
    spark, threshold = docs.sparkSession, percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.table(
        docs.mapInArrow(
            _signatures(width), "doc_id long, n_shingles long, fingerprint binary, registers binary"
        ),
        "signatures",
    )
    classes = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("fingerprint")
        .agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    )
    classes = scratch.table(classes, "classes")

    # Sets too small to differ in one shingle and still be similar have no partner.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    bands = classes.where(F.col("n") >= least).select("cls", "registers").mapInArrow(_bands, "key long, cls long")
    met = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("rep")).where("size > 1")
    met = scratch.table(met, "met")
    shared = scratch.table(bands.join(met.hint("merge"), "key"), "shared")

    tried = shared.where("cls <> rep").selectExpr("rep AS a", "cls AS b").distinct()
    side = classes.select("cls", "n", "registers")
    left = side.toDF("a", "n_a", "registers_a")
    right = side.toDF("b", "n_b", "registers_b")
    likely = tried.join(right, "b").join(left, "a").mapInArrow(_estimated(threshold), "a long, b long")
    likely = scratch.table(likely, "likely")
    links = scratch.table(_confirm(docs, likely, width, percent), "links")
    found = scratch.table(components(links, scratch, "first"), "found")

    # Bands that still hold several components, with every member's component.
    placed = shared.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.selectExpr("key", "size", "rep", "cls", "coalesce(component, cls) AS comp").where("size > 2")
    open_bands = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_bands = scratch.table(open_bands.select("key"), "open")
    members = scratch.table(placed.join(open_bands, "key", "left_semi").select("cls", "rep", "comp").distinct(), "members")
    if not members.isEmpty():
        # Members that such bands connect are a clump; registers go there once per block pair.
        clumps = components(members.selectExpr("cls AS u", "rep AS v"), scratch, "clump").toDF("cls", "clump")
        clumps = scratch.table(clumps.join(members.select("cls", "comp").distinct(), "cls"), "clumps")
        sizes = clumps.groupBy("clump").agg(F.count("*").alias("size"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = (
            clumps.join(sizes, "clump").join(side, "cls")
            .withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .selectExpr("clump", "CAST(least(block, other) AS LONG) AS low", "CAST(greatest(block, other) AS LONG) AS high", "cls",
                        "comp", "CAST(block AS LONG) AS block", "n", "registers")
        )
        dealt = dealt.repartition("clump", "low", "high").sortWithinPartitions("clump", "low", "high", "block", "cls")
        close = dealt.mapInArrow(_likely(percent), "clump long, low long, high long, cls long, comp long, block long")
        close = scratch.table(close, "close")
        grouped = docs.join(close.withColumn("doc_id", F.col("cls")).hint("merge"), "doc_id").drop("doc_id")
        grouped = grouped.repartition("clump", "low", "high").sortWithinPartitions("clump", "low", "high", "block", "cls")
        extra = scratch.table(grouped.mapInArrow(_compared(width, percent), "u long, v long"), "extra")
        if not extra.isEmpty():
            joined = found.selectExpr("node AS u", "component AS v").union(
                extra.join(found.toDF("u", "cu"), "u", "left").join(found.toDF("v", "cv"), "v", "left")
                .selectExpr("coalesce(cu, u) AS u", "coalesce(cv, v) AS v")
            )
            found = scratch.table(components(joined, scratch, "second"), "all")

    named = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.selectExpr("fingerprint", "coalesce(component, cls) AS component")
    rows = signed.select("doc_id", "n_shingles", "fingerprint").join(named, "fingerprint", "left")
    scratch.drop("met", "shared", "likely", "links", "open")
    own = "CASE WHEN n_shingles > 0 AND doc_id IS NOT NULL THEN component ELSE doc_id END"
    return rows.selectExpr("doc_id", "n_shingles", f"{own} AS component_id").selectExpr(
        "*", "coalesce(doc_id = component_id, true) AS kept"
    )
