"""The registered queries of this subpackage, and their results in SQL where it has words.

Each query applies its operator with production parameters to a whole table and derives
the columns of its contract from what the operator returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm import (
    alignment, chat, clusters, decontaminate, licences, line_dedup, pu_quality, rules, shards, toxicity, warc,
)
from msgloom.llm.near_dedup import near_duplicates
from msgloom.llm.packing import pack
from msgloom.llm.tables import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(folds: int, fold: int) -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), width=2, percent=80)


def _licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.statements(docs, licences.train(licences.sampled_paragraphs(docs)))


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), tokenizer_path())


_CHAT = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digests(batches):
    """What the outputs say, read back from them alone."""
    for batch in batches:
        rows = []
        for conv_id, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_mask"))):
            turns = chat.parse(text)
            told = "".join(f"{role}\n{words}\n" for role, words in turns)
            loss = "".join(chat.unescape(text[m["start"] : m["end"]]) for m in mask)
            digests = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (told, loss)]
            rows.append((conv_id, len(turns), digests[0], len(loss), digests[1], len(text)))
        names = [f.split()[0] for f in _CHAT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    Scratch(spark, "op4")  # batch sizes
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text"
    )
    formatted = chat.format_conversations(turns.union(probe))
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(_digests, _CHAT)


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    warc.write_archives(table(spark, sf_dir, "pages"), scratch.path("archives"))
    index = warc.merged_index(warc.read_archives(spark, scratch.path("archives")), scratch)
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at"
    )


def _quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "v2")
    return found.withColumn("base_failed", ~rules.passes("base")).drop("n_lines", "n_capitals")


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.contained_items(docs, items, Scratch(spark, "op7"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    held = held_out(3, 1)
    model = toxicity.train(docs, labels.where(~held), Scratch(spark, "op8"))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    held = held_out(4, 2)
    model = pu_quality.train(docs, labels.where(~held), Scratch(spark, "op9"), known=labels)
    return pu_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shards.external_shuffle(docs, Scratch(spark, "op10"))
    return shards.read_shards(spark, path, docs.schema).selectExpr(
        "doc_id", "CAST(octet_length(coalesce(text, '')) + 1 AS LONG) AS size",
        "crc32(CAST(coalesce(text, '') AS BINARY)) AS text_crc32", "'rows' AS law", "shard", "slot",
        "CAST(NULL AS INT) AS grown_shard",
    )


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), Scratch(spark, "op11"), *paths, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))
    # One row per cluster: 40 at most, which the scan of all vectors meets without a shuffle.
    told = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = told.selectExpr("*", "sum(cluster_inertia) OVER () AS inertia")
    digest = found.described(spark).selectExpr("cluster", "sha2(array_join(centroid, ','), 256) AS centroid_sha256")
    return found.assigned.join(told.join(digest, "cluster"), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op13"))
    return kept.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(CAST(kept_text AS BINARY), 256) AS kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": _near_dedup,
    "op2_licences": _licences,
    "op3_packing": _packing,
    "op4_chat_format": _chat_format,
    "op5_warc": _warc,
    "op6_quality_rules": _quality_rules,
    "op7_decontamination": _decontamination,
    "op8_toxicity": _toxicity,
    "op9_quality": _quality,
    "op10_sharding": _sharding,
    "op11_alignment": _alignment,
    "op12_clusters": _clusters,
    "op13_line_dedup": _line_dedup,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, key: str, width: int) -> str:
    """CTEs with the distinct shingles of a table's texts, as lists of words."""
    return f"""
    {name}_w AS (SELECT {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM {name}),
    {name}_s AS (SELECT DISTINCT {key}, CASE WHEN len(w) < {width} THEN w ELSE w[i : i + {width - 1}] END AS g
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM {name}_w WHERE len(w) > 0)),
    {name}_n AS (SELECT {key}, count(*) AS n FROM {name}_s GROUP BY ALL)"""


# Written out, not taken from the operators, so that a wrong rule or control would show.
_ESCAPED_LENGTH = """length({0}) + length({0}) - length(replace({0}, '\\', ''))
    + (length({0}) - length(replace({0}, '<s>', ''))) // 3 + (length({0}) - length(replace({0}, '</s>', ''))) // 4
    + (length({0}) - length(replace({0}, '[INST]', ''))) // 6 + (length({0}) - length(replace({0}, '[/INST]', ''))) // 7"""
_FAILURES = """CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 10 * n_words OR word_chars < 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 32 ELSE 0 END"""


def _cluster_rounds(clusters: int = 40, rounds: int = 5) -> str:
    """CTEs c0 .. c5 with (cluster, component, x) and a0 .. a5 with (row, cluster, distance)."""
    steps = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS BIGINT[]) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM v
        ORDER BY sha256('2:' || vec_id) LIMIT {clusters})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row, min_by(cluster, [d, cluster]) AS cluster, min(d) AS distance FROM (
        SELECT row, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{k})
        GROUP BY row)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(n.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
        SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS m
            FROM v JOIN a{k} USING (row), range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) n USING (cluster))""")
    return ",\n    ".join(steps)


ORACLE: dict[str, str] = {
    "op1_near_dedup": f"""
    WITH RECURSIVE {_shingles("documents", "doc_id", 2)},
    link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM documents_s a JOIN documents_s b USING (g)
        JOIN documents_n m ON m.doc_id = a.doc_id JOIN documents_n n ON n.doc_id = b.doc_id
        WHERE a.doc_id <> b.doc_id AND 100 * m.n >= 80 * n.n AND 100 * n.n >= 80 * m.n
        GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
    reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, v FROM reach JOIN link ON u = node)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(node) AS component_id, d.doc_id = min(node) AS kept
    FROM documents d JOIN reach USING (doc_id) LEFT JOIN documents_n USING (doc_id) GROUP BY d.doc_id, n""",
    "op4_chat_format": f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(i))
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(3 + sum(17 + {_ESCAPED_LENGTH.format("role")} + {_ESCAPED_LENGTH.format("text")}) AS BIGINT)
            AS formatted_chars
    FROM t GROUP BY conv_id""",
    "op5_warc": rf"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x,
        lower(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g')) AS u FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last,
        regexp_replace(regexp_extract(u, '^[^/?]*'), '^.*@|^www[0-9]*\.|:[0-9]*$', '', 'g') AS host FROM p)
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
        list_aggregate(list_transform(range(32), lambda k: substr('{warc.BASE32}',
            1 + CAST((('0x' || substr(x, CAST(1 + 10 * (k // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (k % 8) AS INT)) & 31
            AS INT), 1)), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id < last THEN last END AS refers_to,
        array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_replace(u, '^[^/?]*', '') AS url_key,
        {int(warc.EPOCH.timestamp())} + page_id AS captured_at
    FROM q""",
    "op6_quality_rules": rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    g AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), range(3) t(k) WHERE n > 1 GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM w),
    m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
        FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    f AS (SELECT *, {_FAILURES} AS bits FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(bits AS BIGINT) AS failures,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, bits = 0 AS kept FROM f""",
    "op7_decontamination": f"""
    WITH {_shingles("documents", "doc_id", 5)}, {_shingles("benchmark", "item_id", 5)}
    SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared_shingles, count(*) / n AS containment
    FROM benchmark_s JOIN benchmark_n USING (item_id) JOIN documents_s USING (g)
    GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
    "op12_clusters": f"""
    WITH {_cluster_rounds()}
    SELECT vec_id, CAST(cluster AS INT) AS cluster, distance,
        CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM v JOIN a5 USING (row) JOIN c5 USING (cluster)""",
    "op13_line_dedup": """
    WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (SELECT *,
        unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN s USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
