"""Tokenizer alignment, centroid clustering and line removal against plain versions."""

import collections
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from msgloom.llm import alignment, clusters, line_dedup, queries
from msgloom.llm.tables import Scratch

PATHS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
LETTERS = alignment.byte_letters()
TEXTS = [
    None, "", " ", "  lead and trail  ", "café 漢字 漢 🙂🙂 naïve", "a▁b c", "<|endoftext|> </s> <s> [INST]", "\n\nx \ty\r\n z",
    "é  x", "\x00 a\x1c b \x85 c", "　x 　 y", "x" * 30_000, " ".join(f"w{i % 900}" for i in range(20_000)),
    "same same same", "same same same", "ﬁ ﬀ x　 y 　z",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_tokens(tokenizers, text):
    """Ids and bytes of both tokenizers over the whole text, or none."""
    if not text:
        return [], []
    a, b = tokenizers
    coded = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in side) == whole for side in (left, right)) else ([], [])


def plain_alignment(tokenizers, text):
    left, right = plain_tokens(tokenizers, text)
    ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (left, right)]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append("|".join(",".join(str(t) for t, _ in side) for side in (left[i:k], right[j:m])))
        for x, y in itertools.product(range(i, k), range(j, m)):
            begin_x, begin_y = (ends[0][x - 1] if x else 0), (ends[1][y - 1] if y else 0)
            if max(begin_x, begin_y) < min(ends[0][x], ends[1][y]):
                links.append((left[x][0], right[y][0]))
        i, j = k, m
    return len(left), len(right), ";".join(groups), links


def check_alignment(tokenizers, rows, got):
    plain = [(i, *plain_alignment(tokenizers, t)) for i, t in rows]
    held = collections.Counter(itertools.chain.from_iterable(set(p[4]) for p in plain))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = collections.Counter(
        (i, na, nb, groups.count(";") + bool(groups), len(links), sum(held[x] == most[x[0]] for x in links),
         sum(held[x] for x in links), groups)
        for i, na, nb, groups, links in plain
    )
    assert collections.Counter(map(tuple, got)) == want


def test_alignment_on_hard_rows(spark, tokenizers, monkeypatch):
    rows = [(None if i == 13 else i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, part int, groups string, codes long")
    got = alignment.align(docs.repartition(3), Scratch(spark, "t"), *PATHS)
    check_alignment(tokenizers, rows, got.collect())
    assert alignment.align(docs.limit(0), Scratch(spark, "t"), *PATHS).count() == 0


def test_alignment_in_small_blocks_that_forget(tokenizers, monkeypatch):
    """Blocks and the bound on remembered segments do not show in what is told."""
    monkeypatch.setattr(alignment.Aligner, "REMEMBERED", 20)
    aligner = alignment.Aligner(*PATHS)
    for _ in range(3):
        for text in ["one two three four", *TEXTS[3:12], " ".join(f"q{i}" for i in range(60)), "one two three four"]:
            codes, offsets = aligner.codes([text])
            na, nb, groups, links = plain_alignment(tokenizers, text)
            assert ";".join(aligner.text[c] for c in codes) == groups
            got = [x for c in codes for x in aligner.links[aligner.starts[c] :][: aligner.numbers[c, 3]].tolist()]
            assert got == [a << 32 | b for a, b in links]
            assert aligner.numbers[codes].sum(axis=0).tolist()[:2] == [na, nb]


def test_alignment_query(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.QUERIES["op11_alignment"](spark, SF).collect()
    whole = alignment.align(queries.table(spark, SF, "documents"), Scratch(spark, "t"), *PATHS).collect()
    check_alignment(tokenizers, rows, whole)
    told = {r.doc_id: hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in whole}
    assert {r.doc_id: r.groups_sha256 for r in got} == told
    assert {tuple(r)[:-1] for r in got} == {tuple(r)[:-1] for r in whole}


def test_text_that_is_not_utf8(tokenizers):
    batch = pa.array([b"ok", b"\xff\xfe", None]).cast(pa.large_binary())
    column = pa.Array.from_buffers(pa.large_string(), 3, batch.buffers())
    assert alignment._texts(column) == ["ok", None, None]


def plain_clusters(rows, k, rounds):
    kept = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for i, vs in members.items():
            centroids[i] = [sum(x) // len(vs) for x in zip(*vs)]
    return collections.Counter((i, *nearest(v)[::-1]) for i, v in kept), centroids


@pytest.mark.parametrize("chunk", [7, clusters.CHUNK])
def test_clusters(spark, monkeypatch, chunk):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, rows[3][1]) for i in (100, 100, 101)] + [(None, rows[5][1]), (None, [0.5] * 64)]  # copies, repeated and missing ids
    rows += [(200, None), (201, []), (202, [0.1] * 63), (203, [None] + [0.1] * 63), (204, [float("nan")] * 64), (205, [float("inf")] * 64)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int")
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    found = clusters.cluster(frame.repartition(2), Scratch(spark, "t"), clusters=9, rounds=4)
    want, centroids = plain_clusters(rows, 9, 4)
    assert found.centroids.tolist() == centroids
    assert collections.Counter(map(tuple, found.assigned.collect())) == want
    # Fewer vectors than clusters, none at all, and a component out of range.
    few = clusters.cluster(frame.where("vec_id < 3"), Scratch(spark, "t"))
    assert len(few.centroids) == 3 and {r.distance for r in few.assigned.collect()} == {0}
    none = clusters.cluster(frame.limit(0), Scratch(spark, "t"))
    assert none.assigned.count() == 0 and not len(none.centroids)
    with pytest.raises(Exception, match="range of distances"):
        clusters.cluster(frame.selectExpr("vec_id", "transform(embedding, x -> x * 1e30f) AS embedding"), Scratch(spark, "t"))


def test_ties_go_to_the_smaller_cluster():
    chunk = clusters._Chunk(pa.array([1]), np.zeros((32, 1), np.uint16), [np.zeros((1, 2), np.int64)] * 32)
    centroids = np.zeros((3, 64), np.int64)
    centroids[0, 0], centroids[1, 0], centroids[2, 1] = 2, 1, -1
    got = chunk.nearest(centroids)
    assert (got[0].tolist(), got[1].tolist()) == ([1], [1])


def plain_lines(rows):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def key(line):
        return line.strip(space).translate(lower)

    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    shared = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or shared[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def test_line_dedup_on_hard_rows(spark):
    a, b = "A shared line of more than forty characters, ending in é", "b" * 40
    rows = [(i, f"start {i}\n \t{a}\r\n{a.lower()}\n\n{b}") for i in range(6)]
    rows += [(7, f"{b[:39]}\n{a.replace('é', 'É')}"), (8, None), (9, ""), (10, "\n\n"), (11, b), (11, b), (11, f"x\n{b}"), (None, b), (None, a), (None, None)]
    rows += [(20 + i, "four documents hold this line, which is not enough") for i in range(4)] * 2
    rows += [(40, "\n".join(f"{'long' * 12} {i % 7}" for i in range(30_000)))] + [(41 + i, "long" * 12 + " 3") for i in range(4)]
    docs = spark.createDataFrame([(i, t, 1, "k", 0.5) for i, t in rows], "doc_id long, text string, n_lines int, line string, gone double")
    got = line_dedup.drop_shared_lines(docs.repartition(3), Scratch(spark, "t"))
    assert got.columns == ["doc_id", "text", "line", "gone", "kept_text", "n_lines", "n_dropped"]
    want = plain_lines(rows)
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert sum(n for (_, _, dropped, _), n in want.items() if dropped) > 8
    assert line_dedup.drop_shared_lines(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = queries.QUERIES["op13_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
