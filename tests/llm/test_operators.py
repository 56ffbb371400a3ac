"""Every operator on hard rows, and against plain versions of itself."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import compare, oracle
from msgloom.llm import chat, decontaminate, licences, packing, pu_quality, queries, rules, shards, toxicity, warc
from msgloom.llm.components import components
from msgloom.llm.near_dedup import jaccard_estimate, near_duplicates, registers
from msgloom.llm.tables import Scratch
from msgloom.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Clashing names of extra columns.
EXTRA = "score double, kept boolean, shard int, slot long, part long, key string, size int"
LONG = " ".join(f"w{i % 40000}" for i in range(60_000))


def spans(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@pytest.fixture(scope="module")
def hard(spark):
    """NULLs, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [
        (1, base), (2, base), (2, base), (3, base + " pi"), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, None),
        (7, LONG), (8, LONG + " end"), (9, "One"), (10, "one"), (11, "one two"), (12, "\x00 ��\ud83d".encode("utf-8", "ignore").decode()),
        (13, "same line\nsame line\nsame line"), (14, "x" * 100_000), (15, base.upper()),
    ]
    data = [(i, t, "en", None, None, 0.5, True, 3, 1, 9, "k", 2) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def plain_components(rows, width, percent=80):
    sets = {i: spans(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("similar, groups, most", [(0.70, 1100, 110), (0.88, 1100, 3300), (0.92, 1, 0)])
def test_a_clump_reads_texts_only_of_likely_pairs(spark, similar, groups, most):
    """Documents that share most of their words with one another, of Jaccard similarity 0.54, 0.79
    and 0.85: no text of a clump is fetched but where estimates come near the threshold."""
    rng = random.Random(4)
    common = [f"c{rng.random()}" for _ in range(int(400 * similar))]
    rows = []
    for i in range(1100):
        own = [f"o{i}.{k}" for k in range(400 - len(common))]
        rows.append((i, " ".join([*common, *own])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "t")
    found = near_duplicates(docs, scratch, width=1).groupBy("component_id").count().collect()
    assert len(found) == groups
    try:
        fetched = spark.read.parquet(scratch.path("close")).count()
    except AnalysisException:
        fetched = 0  # no band was open
    assert fetched <= most


def test_words():
    texts = ["A b", None, "", " c\n", "é f" + "g" * 90, "A\x0bb"]
    words = words_of(pa.array(texts))
    assert words.offsets.tolist() == [0, 2, 2, 2, 3, 5, 7]
    assert words.hashes[0] == words.hashes[5] and words.hashes[1] == words.hashes[6]
    assert len(set(words.hashes.tolist())) == 5


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.permutation(np.unique(rng.integers(0, 2**64, 3000, np.uint64)))
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    guess, basis = jaccard_estimate(*(registers([x]) for x in (a, b)), np.array([2000]), np.array([2000]))
    assert abs(guess[0] - 0.6) < 0.2 and basis[0] == 128


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 20)] + [(100, 50), (50, 70), (7, 7), (None, 3), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t"), "c").collect()
    want = {**{i: 0 for i in range(21)}, 50: 50, 70: 50, 100: 50, 200: 200, 201: 200}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, hard, width):
    rng = random.Random(width)
    rows = []
    for group in range(8):  # chains of edits: some links only run through others
        words = [f"g{group}w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 200]))]
        for copy in range(12):
            rows.append((1000 + 20 * group + copy, " ".join(words)))
            words[rng.randrange(len(words))] = f"e{copy}"
    docs = hard.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = near_duplicates(docs, Scratch(spark, "t"), width).collect()
    assert len(got) == docs.count()
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = plain_components(dict(texts).items(), width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_duplicates(docs.limit(0), Scratch(spark, "t"), width).count() == 0


def test_licences(spark, hard):
    model = licences.train(["of the and", "in a for"])
    text = "Hello\nReleased under the MIT License.\nHer driving license expired.\nAll rights reserved."
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = licences.statements(docs, model).collect()
    assert sorted((r.paragraph, r.family, r.confirmed) for r in got) == 3 * [(1, "MIT", True)] + 3 * [(3, "proprietary", True)]
    assert licences.statements(hard, model).count() == 0
    for family, texts in licences.STATEMENTS.items():
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert {r.family for r in licences.statements(frame, model).collect()} == {family}
    # The score in SQL is the one in NumPy.
    words = licences.grams(licences.tokens("Licensed under CC BY-NC 4.0."))
    z = np.array([b + sum(t.get(g, 0) for g in words) for b, t in zip(model.bias, model.weights)]) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    frame = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert licences.statements(frame, model).first().probability == pytest.approx(p[1:].max(), abs=2e-6)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""


def test_licences_of_other_names_and_wrapped_texts(spark):
    """With the sample of a whole table: what the query learns from."""
    docs = queries.table(spark, SF, "documents")
    sample = licences.sampled_paragraphs(docs)
    assert 0 < len(sample) <= licences.SAMPLE and licences.sampled_paragraphs(docs.limit(0)) == []
    model = licences.train(sample)
    others = [
        "Licensed under the Sleepycat License, version 3.", "Released under the Zope Public License.",
        "Distributed under the terms of the Ruby License 2.0.", "Licensed under the Eclipse Public License 2.0.",
        "Licensed under the Boost Software License, Version 1.0.",
    ]
    ordinary = ["All rights of the tenants were reserved in the license of the hall.", "The software was free of charge for use.", ""]
    wrapped = {"MIT": MIT, "BSD": BSD, "Apache-2.0": APACHE}
    texts = [*others, *ordinary, *wrapped.values(), f"x\n\n{MIT}\n{BSD}\n\nReleased under the MIT License.\nend"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in licences.statements(frame, model).collect():
        got[r.doc_id].append((r.paragraph, r.family, r.confirmed))
    for i, text in enumerate(texts[: len(others)]):
        assert [(f, c) for _, f, c in got[i]] == [("unknown", False)], text
    assert not any(got[len(others) + i] for i in range(len(ordinary)))
    for i, family in enumerate(wrapped, len(others) + len(ordinary)):
        assert [(p, f) for p, f, c in got[i] if c] == [(0, family)]
    assert sorted(p for p in got[len(texts) - 1] if p[2]) == [(2, "MIT", True), (8, "BSD", True), (11, "MIT", True)]
    # Cues are exact: without them the same paragraphs come out.
    every = model._replace(common=())
    whole = sorted(licences.statements(docs, model).collect())
    assert whole and whole == sorted(licences.statements(docs, every).collect())


def plain_licences(model, text):
    """Families of lines and pairs of lines, scored in NumPy."""
    def judge(words):
        g = licences.grams(words)
        z = np.array([b + sum(t.get(x, 0) for x in g) for b, t in zip(model.bias, model.weights)]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = int(p[1:].argmax()) if len(set(p[1:].round(12))) > 1 else len(p) - 2
        if p[0] >= 0.5:
            return None
        family = [*licences.STATEMENTS, licences.UNKNOWN][k]
        shared = {w for t in (*licences.OTHERS, *licences._others()) for w in licences.tokens(t)}
        shared |= {w for f, ts in licences.STATEMENTS.items() if f != family for t in ts for w in licences.tokens(t)}
        best = 0.0
        for t in licences.STATEMENTS.get(family, ()):
            row = [w for w in licences.tokens(t) if w]
            pairs = {f"{a} {b}" for a, b in zip(row, row[1:])}
            own = {w for w in row if w not in shared} or {row[0]}
            best = max(best, len(pairs & g) / len(pairs) * bool(own & g))
        return family, p[1:].max() >= licences.CERTAIN and best >= licences.CONFIRMED

    lines = [[w for w in licences.tokens(x) if w] for x in text.split("\n")]
    single = {i: j for i, w in enumerate(lines) if (j := judge(w))}
    pairs = [i for i in range(len(lines) - 1) if lines[i] and lines[i + 1] and not any(single.get(k, (0, 0))[1] for k in (i, i + 1))
             and (judge(lines[i] + lines[i + 1]) or (0, False))[1]]
    out = [(i, f if c else licences.UNKNOWN) for i, (f, c) in single.items() if not {i, i - 1} & set(pairs)]
    return out + [(i, judge(lines[i] + lines[i + 1])[0]) for i in pairs if i - 1 not in pairs]


def test_licence_query_against_a_plain_version(spark):
    docs = queries.table(spark, SF, "documents")
    model = licences.train(licences.sampled_paragraphs(docs))
    got = collections.Counter((r.doc_id, r.paragraph, r.family) for r in queries.QUERIES["op2_licences"](spark, SF).collect())
    want = collections.Counter((d.doc_id, *hit) for d in docs.collect() if d.text for hit in plain_licences(model, d.text))
    assert got == want and got


def check_pieces(pieces, docs, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = collections.Counter()
    for text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        texts[ids.tobytes()] += 1
    filled = collections.defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    for number, parts in filled.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        if number < max(filled):
            assert sum(n for _, n in parts) == 4096
    assert sum(p.length for p in pieces) == sum(len(k) // 4 * n for k, n in texts.items())
    return texts


def test_packing(spark, hard):
    path = queries.tokenizer_path()
    docs = hard.select("doc_id", "text", "source").union(
        spark.createDataFrame([(100 + i, f"the word number {i} " * (i % 50), f"s{i % 3}") for i in range(300)], hard.select("doc_id", "text", "source").schema)
    )
    pieces = packing.pack(docs, Scratch(spark, "t"), path).collect()
    texts = check_pieces(pieces, [r.text for r in docs.collect()], path)
    ids = {r.doc_id: r.text for r in docs.collect() if r.doc_id and r.doc_id != 2}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for doc_id, text in ids.items():
        own = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == doc_id)
        assert [(a, n, zlib.crc32(own[a : a + n].tobytes())) for a, n, _ in mine] == mine
        assert sum(n for _, n, _ in mine) == len(own)
    sources = {(r.doc_id, r.source) for r in docs.collect()}
    assert {(p.doc_id, p.source) for p in pieces} == sources
    assert texts and packing.pack(docs.limit(0), Scratch(spark, "t"), path).count() == 0


def test_more_sources_than_queues(spark, monkeypatch):
    """Sources that share a queue are packed like others, and the largest keep their own."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 8)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a", "the", "tree"], k=900 if i % 3 else 20)), None if i % 11 == 0 else f"s{i % 3 and i % 40}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    path = queries.tokenizer_path()
    for targets in (None, {"s0": 0.5, "s39": 0.25, None: 0.25}):
        pieces = packing.pack(docs, Scratch(spark, "t"), path, targets).collect()
        check_pieces(pieces, [r[1] for r in rows], path)
        assert {(p.doc_id, p.source) for p in pieces} == {(i, s) for i, _, s in rows}


def test_a_small_source_is_not_cut_into_tokens():
    for total in (10**8, 10**9, 10**10):
        mixture = packing.Mixture({f"s{i}": total // 20 for i in range(20)} | {"tiny": 500})
        at, _ = mixture.pieces(mixture.index["tiny"], 0, 500)
        assert len(at) <= 2
    # A document that is all of a middling source beside many: in bounded memory, runs of 512.
    mixture = packing.Mixture({f"s{i}": 10**8 for i in range(100)} | {"middling": 10**6})
    at, place = mixture.pieces(mixture.index["middling"], 0, 10**6)
    assert len(at) < 1.5 * 10**6 / packing.RUN and (np.diff(place) > 0).all()


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.25, "c": 0.25}])
def test_windows_hold_the_mixture(targets):
    """Every place is taken once, and the tokens of a source never stray far from its share."""
    rng = np.random.default_rng(0)
    tokens = {"a": 100_000, "b": 30_000, "c": 20_000, None: 700, "e": 1}
    mixture = packing.Mixture(tokens, targets)
    owner = np.full(sum(tokens.values()), -1)
    for name, total in tokens.items():
        at = 0
        while at < total:
            size = min(total - at, int(rng.integers(1, 3000)))
            low, place = mixture.pieces(mixture.index[name], at, size)
            for begin, length in zip(place, np.diff(low, append=size)):
                assert (owner[begin : begin + length] == -1).all() and begin // 4096 == (begin + length - 1) // 4096
                owner[begin : begin + length] = mixture.index[name]
            at += size
    assert (owner >= 0).all()
    windows = owner[: len(owner) // 4096 * 4096].reshape(-1, 4096)
    shares = {s: t / sum(tokens.values()) for s, t in tokens.items()} if targets is None else targets
    for name, share in shares.items():
        sent = np.cumsum((windows == mixture.index[name]).sum(axis=1))
        due = share * 4096 * np.arange(1, len(windows) + 1)
        steady = due <= (tokens[name] if targets is None else 0.9 * min(tokens[s] / t for s, t in targets.items()) * share)
        assert np.abs(sent - due)[steady].max() <= packing.RUN * (len(tokens) - 1)


def test_encoder():
    """Ids of words encoded in groups are those of whole texts, also with the mark in a word."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["a\x01b \x01 \x01\x01, The the", "\u0338a \u00a0b\u2003c \u001c x", None, "", " \x0b", "don't DON'T 1,234 \u03a3\u03b1\u03c2"]
    texts += [" ".join(f"word{i}" for i in range(k, k + 70)) for k in (0, 50, 1)]
    tokenizer, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    for mark in (encoder.mark, [1, 2]):  # a mark of several ids sends every word alone
        encoder.mark = mark
        encoder.forget()
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_mixture_targets():
    mixture = packing.Mixture({"a": 40_000, "b": 40_000, None: 500}, {"a": 3, "b": 1})
    seen = np.zeros(80_500, int)
    shares = collections.Counter()
    for source, tokens in zip(range(3), mixture.tokens):
        for begin in range(0, int(tokens), 777):
            size = min(777, int(tokens) - begin)
            at, place = mixture.pieces(source, begin, size)
            for a, n, p in zip(at, np.diff(at, append=size), place):
                seen[p : p + n] += 1
                assert p // 4096 == (p + n - 1) // 4096
                if p // 4096 == 5:
                    shares[mixture.names[source]] += int(n)
    assert (seen == 1).all()
    assert abs(shares["a"] - 3072) <= 2 and abs(shares["b"] - 1024) <= 2


def test_chat(spark):
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("", ""), ("a]\\", "\\<s>\\\\[[INST]")]
    done = chat.render(turns)
    assert chat.parse(done.formatted) == turns and done.rewritten is None
    assert [chat.unescape(done.formatted[a:b]) for a, b in done.mask] == ["</s>[INST] ok [/INST]"]

    def forgetful(turns):  # keeps only the last turn's text in full
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t[:2]}" for i, (r, t) in enumerate(turns))

    assert chat.render([("u", "hello"), ("assistant", "yes"), ("u", "more")], forgetful).rewritten == 1
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "user", "q"), (2, 5, "user", "q"), (2, 5, "user", "q")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(frame).collect()}
    assert got == {1: [("user", ""), ("assistant", "b")], None: [("", "x")], 2: 3 * [("user", "q")]}
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_long_conversations_cost_in_proportion():
    rng = random.Random(8)
    turns = [(rng.choice(["user", "assistant", "tool"]), rng.choice(["", "</s>", "x\\y", "[INST] ok"]) * rng.randrange(4)) for _ in range(900)]
    calls = collections.Counter()

    def counted(turns):
        calls["turns"] += len(turns)
        return chat.template(turns)

    def numbered(turns):  # only appends, but knows its place
        return "".join(f"<{i}>{r}:{t}" for i, (r, t) in enumerate(turns))

    def ending(turns):  # says at the end what no window knows
        return chat.template(turns) + f"<{len(turns)}>"

    def late(turns):  # cuts history off only when it is long
        return chat.template(turns[-500:])

    for n in (chat.WINDOW, chat.WINDOW + 1, 200, 900):
        for with_ in (chat.template, numbered, ending, late):
            assert chat.render(turns[:n], with_) == chat._located(turns[:n], with_, {"assistant"})
    chat.render(turns, counted)
    assert calls["turns"] < 900 * 1.5 * chat.WINDOW
    done = chat.render(turns * 10)
    assert chat.parse(done.formatted) == turns * 10 and len(done.spans) == 9000
    assert [chat.unescape(done.formatted[a:b]) for a, b in done.mask] == [t for r, t in turns * 10 if r == "assistant"]


def test_warc(spark):
    bomb = "WARC/1.1\r\n\r\n\r\n\r\n"
    rows = [
        (1, "http://www.a.org/x?B=1#f", "<p>é"), (2, "https://u@a.org:80/x", "<p>é"), (3, None, None), (4, "b.org", ""),
        (None, "b.org", "<p>é"), (5, "x\r\ny", bomb), (6, "c.org", "z" * 300_000), (2, "https://u@a.org:80/x", "<p>é"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    scratch = Scratch(spark, "t")
    warc.write_archives(pages, scratch.path("w"))
    read = warc.read_archives(spark, scratch.path("w")).persist()
    held = {r.page_id: r.payload for r in read.collect() if r.record_type == "response" and r.page_id}
    assert held[5] == bomb.encode() and held[2] == "<p>é".encode() and 1 not in held
    got = warc.merged_index(read, scratch).collect()
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    for r in got:
        data = next(h for i, h in texts if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {r.page_id: r.refers_to for r in got} == {1: 2, 2: None, 3: 4, 4: None, None: None, 5: None, 6: None}
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows) and "org,a)/x?b=1" in {k for k, _, _ in keys}
    warc.write_archives(pages.limit(0), scratch.path("none"))
    assert warc.read_archives(spark, scratch.path("none")).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for count in range(9):
        runs = [sorted(rng.choices(range(40), k=rng.randrange(9))) for _ in range(count)]
        assert list(warc.LoserTree(map(iter, runs))) == sorted(sum(runs, []))


def test_rules(spark, hard):
    found = rules.apply_policy(rules.ledger(hard), "v2").collect()
    assert len(found) == hard.count()
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id}
    for r in found:
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = collections.Counter(windows)
        twice = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(twice))
    table = spark.createDataFrame([(0b0000,), (0b0001,), (0b0011,), (0b0100,)], "failures long")
    got = {r.rule: (r.failed, r.failed_alone, r.kept, r.kept_without) for r in rules.ablation(table, "base").collect()}
    assert got == {"too_short": (2, 1, 2, 3), "repeated_words": (1, 0, 2, 2)}
    assert rules.ledger(hard.limit(0)).count() == 0


def test_ablation_of_a_whole_ledger(spark):
    """Figures from bit patterns are those of applying each policy to every document."""
    import duckdb

    docs = queries.table(spark, SF, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE TABLE f AS {queries.ORACLE['op6_quality_rules']}")
    found = rules.ledger(docs)
    for policy, bits in {"base": [1, 2], "v1": [1, 2, 4, 8], "v2": [1, 2, 4, 8, 16, 32]}.items():
        got = sorted((r.failed, r.failed_alone, r.kept, r.kept_without) for r in rules.ablation(found, policy).collect())
        mask = sum(bits)
        assert got == sorted(
            con.execute(f"""SELECT count(*) FILTER (failures & {b} > 0), count(*) FILTER (failures & {mask} = {b}),
                count(*) FILTER (failures & {mask} = 0), count(*) FILTER (failures & {mask - b} = 0) FROM f""").fetchone()
            for b in bits
        )
        kept = con.execute(f"SELECT count(*) FROM f WHERE failures & {mask} = 0").fetchone()[0]
        assert rules.apply_policy(found, policy).where("kept").count() == kept > 0


def test_decontamination(spark, hard):
    rng = random.Random(9)
    words = [f"b{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 9, 17, 33, 60])))) for i in range(40)] + [(90, None), (91, "")]
    rows = []
    for i in range(80):
        text = rng.choices(words, k=rng.randrange(10, 900))
        part = items[i % 40][1].split()
        text[5:5] = part[: len(part) - (i % 3)]
        rows.append((500 + i, " ".join(text)))
    docs = hard.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {
        (r.doc_id, i) for r in docs.collect() for i, t in items
        if (own := spans(t, 5)) and 100 * len(own & spans(r.text, 5)) >= 80 * len(own)
    }
    got = decontaminate.contained_items(docs, bench, Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 40
    left = decontaminate.clean_documents(docs, bench, Scratch(spark, "t"))
    assert left.count() == docs.count() - len({i for i, _ in want})
    assert decontaminate.contained_items(docs, bench.limit(0), Scratch(spark, "t")).count() == 0
    assert decontaminate.contained_items(docs.limit(0), bench, Scratch(spark, "t")).count() == 0


def test_folding():
    assert toxicity.folded("Y0u ѕtup1d СLOWN, $cum ​tr​ash ＩＤＩＯＴ 100 café!") == "you stupid clown, scum trash idiot 100 café!"


def test_toxicity(spark, hard):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        text = rng.choices(plain, k=60)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["grobbler", "snarkish", "vexa" + rng.choice(["l", "tt", "rrim"])])
        rows.append((1000 + i, " ".join(text)))
        marks.append((1000 + i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (1000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, Scratch(spark, "t"))
    assert "grobbler" in model.words and any("vexatt".startswith(s) for s in model.stems)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == t for i, t in marks) == len(marks)
    assert toxicity.Matcher(model).scores(["a gr0bbIer".replace("I", "l") + " here"])[0] > 0.7
    scored = toxicity.score(hard, model).collect()
    assert len(scored) == hard.count() and all(0 <= r.score < 0.7 for r in scored)
    assert toxicity.clean_documents(hard, model).count() == hard.count()
    spared = toxicity.Matcher(model._replace(exceptions=("grobbler fish",)))
    assert spared.features("a grobbler fish")[0] == 0 < spared.features("a grobbler fisherman")[0]
    none = toxicity.train(docs, labels.limit(0), Scratch(spark, "t"))
    assert {r.score for r in toxicity.score(hard, none).collect()} == {toxicity.score(hard, none).first().score}


def test_quality(spark, hard):
    rng = random.Random(4)
    words = ["the", "of", "house", "river", "green", "walks", "slowly", "tree", "and", "a"] + [f"n{i}" for i in range(200)]

    def text(good):
        if good:
            return "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(8))
        return " ".join(rng.choices(words[:3], k=90)) + " $$$ ### &&& " * 20

    rows = [(i, text(i % 5 != 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)], "doc_id long, quality int")
    model = pu_quality.train(docs, labels, Scratch(spark, "t"))
    assert 0.7 < model.prior < 0.9
    got = {r.doc_id: r.predicted for r in pu_quality.score(docs, model).collect()}
    assert sum(got[i] == (i % 5 != 0) for i, _ in rows) > 0.97 * len(rows)
    assert pu_quality.score(hard, model).count() == hard.count()
    none = pu_quality.train(docs, labels.limit(0), Scratch(spark, "t"))
    assert {r.score for r in pu_quality.score(docs, none).collect()} == {0.5}
    assert pu_quality.good_documents(docs, none).count() == docs.count()


def test_sharding(spark, hard):
    scratch = Scratch(spark, "t")
    docs = hard.select("doc_id", "text", "shard", "slot").union(
        spark.createDataFrame([(100 + i, f"text {i} " * 40, 1, None) for i in range(1000)], hard.select("doc_id", "text", "shard", "slot").schema)
    )
    path = shards.external_shuffle(docs, scratch, size=20_000)
    got = shards.read_shards(spark, path, shards.renamed(docs).schema).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert collections.Counter((r.doc_id, r.text, r.shard_in) for r in got) == collections.Counter(
        (r.doc_id, r.text, r.shard) for r in docs.collect()
    )
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id and r.doc_id >= 100]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15
    # A key that a third of the rows share, or lack, does not fill one bucket.
    shared = docs.where("doc_id >= 100").withColumn("doc_id", F.expr("if(doc_id % 3 = 0, NULL, if(doc_id % 3 = 1, 7, doc_id))"))
    path = shards.external_shuffle(shared, Scratch(spark, "t"), size=20_000)
    assert shards.read_shards(spark, path, shards.renamed(shared).schema).count() == 1000
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] < 250
    none = shards.external_shuffle(docs.limit(0), Scratch(spark, "t"))
    assert shards.read_shards(spark, none, shards.renamed(docs).schema).count() == 0


def test_sharding_holds_no_list_of_records(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def spy(writer, *args, **kwargs):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    texts = spark.range(1200).selectExpr("id AS doc_id", "repeat(CAST(id % 10 AS STRING), 168) AS text")
    # Rows alike share a bucket, which is larger then.
    docs = texts.union(texts.where("doc_id = 7").withColumn("text", F.explode(F.array_repeat("text", 300))))
    path = shards.external_shuffle(docs, Scratch(spark, "t"), size=10_000)
    assert len(plans) == 1 and "collect_list" not in plans[0] and "ObjectHashAggregate" not in plans[0]
    assert sum("Exchange" in line and "bucket" in line for line in plans[0].splitlines()) == 2  # counts, records
    rows = shards.read_shards(spark, path, docs.schema).select("*", F.input_file_name().alias("file")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(tuple(r) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    # 30 buckets of 40 rows or so, each in a task of its own.
    tasks = collections.Counter(re.search(r"part-(\d+)", r.file)[1] for r in rows if r.doc_id != 7)
    assert len(tasks) == 30 and max(tasks.values()) < 80
    # Rows alike lie anywhere in their bucket, not together as they came.
    place = sorted(rows, key=lambda r: (r.shard, r.slot))
    hot = [r.doc_id == 7 for r in place]
    first, last = hot.index(True), len(hot) - hot[::-1].index(True)
    assert last - first > hot.count(True) and not all(hot[first : first + 250])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    with oracle(SF) as connection:
        assert compare(spark, connection, name, SF) == ""


def test_pipeline(spark):
    """Every stage against its operator's own verdicts on the stage's input."""
    labels = queries.table(spark, SF, "labels")
    docs = queries.table(spark, SF, "documents")
    kept = Scratch(spark, "t")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = kept.table(stage(spark, docs, SF), str(number))
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "packing":
            check_pieces(made.collect(), list(before.values()), queries.tokenizer_path())
            break
        after = {r.doc_id for r in made.collect()}
        assert made.columns == docs.columns and after <= set(before)
        gone = set(before) - after
        if name == "near_dedup":
            want = plain_components(before.items(), 5)
            assert gone == {i for i, (_, c) in want.items() if i != c}
        if name == "decontamination":
            items = [spans(r.text, 5) for r in queries.table(spark, SF, "benchmark").collect()]
            assert gone == {i for i, t in before.items() if any(100 * len(s & spans(t, 5)) >= 80 * len(s) for s in items)}
        if name in ("toxicity", "quality"):
            column = "toxic" if name == "toxicity" else "quality"
            marks = {r.doc_id: r[column] for r in labels.collect() if r.doc_id in before}
            right = sum((i in gone) == (m == (1 if name == "toxicity" else 0)) for i, m in marks.items())
            assert right >= 0.8 * len(marks)
        docs = made
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name, column, accuracy, recall", [("op8_toxicity", "toxic", 0.95, 0.8), ("op9_quality", "quality", 0.9, 0.85)])
def test_held_out_labels_of_a_whole_table(spark, name, column, accuracy, recall):
    """The registered query, on labels that it has not learned from."""
    folder = SF.replace("sf0.001", "sf0.01")
    found = queries.QUERIES[name](spark, folder)
    assert found.count() == queries.table(spark, folder, "documents").count()
    labels = queries.table(spark, folder, "labels").where(f"{column} IS NOT NULL").select("doc_id", F.col(column).alias("truth"))
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = [r.predicted == r.truth for r in rows]
    caught = [r.predicted == 1 for r in rows if r.truth == 1]
    assert sum(right) >= accuracy * len(right) and sum(caught) >= recall * len(caught)
