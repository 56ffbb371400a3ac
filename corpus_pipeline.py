"""A training corpus from `documents`, in stages.

Toxic documents go, then those of low quality, near-duplicates but one of each group, and
documents with a benchmark passage; the rest is packed into sequences. Every stage takes
what the one before kept, and all but the last return the columns of `documents`. Models are
learned from the stage's own documents and the labels that the queries learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgloom.llm import decontaminate as D
from msgloom.llm import pu_quality, queries, toxicity
from msgloom.llm.near_dedup import near_duplicates
from msgloom.llm.packing import pack
from msgloom.llm.tables import Scratch

#: Scratch of the stage that ran last. Its result has been written once the next one starts.
_finished: list[Scratch] = []


def _scratch(spark: SparkSession, label: str) -> Scratch:
    while _finished:
        old = _finished.pop()
        if old.spark is spark:
            old.drop()
    _finished.append(Scratch(spark, label))
    return _finished[-1]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels").where(~queries.held_out(3, 1))
    return toxicity.clean_documents(docs, toxicity.train(docs, labels, _scratch(spark, "toxicity")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels")
    model = pu_quality.train(docs, labels.where(~queries.held_out(4, 2)), _scratch(spark, "quality"), known=labels)
    return pu_quality.good_documents(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays. Rows
    without doc_id stay, rows that share one stay or go together."""
    scratch = _scratch(spark, "near-dedup")
    found = near_duplicates(docs, scratch, width=5, percent=80)
    gone = scratch.table(found.where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = _scratch(spark, "decontamination")
    return D.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"), scratch)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, _scratch(spark, "packing"), queries.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokens and learned scores are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each one's result written and read again."""
    kept = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = kept.table(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            kept.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    _scratch(spark, "done").drop()
    return docs
