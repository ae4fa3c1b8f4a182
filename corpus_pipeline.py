"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that its predecessor kept, and all but the last return the columns of documents.
Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontam, forest, langid, lines, shared, wfst
from tickloom.llm.queries import _tokenizer

ORACLE_SQL = None  # language ID, fuzzy links and encoding aren't SQL; tests hold them against brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected go: no text, no letter, or far from every language's centroids."""
    model = langid.fit(docs.select("text", "lang"))
    return langid.predict(docs, model).where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which no line stays. n_chars follows the text.

    Null and empty texts, and those without a word, have no lines to lose and stay.
    """
    out = lines.deduplicate(docs, similarity=0.8).where("n_removed = 0 OR n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the least doc_id (nulls last), then text hash.

    Documents are told apart by doc_id and text, so that rows that share a doc_id,
    or have none, lose no text that stands alone. Rows that repeat both become one
    (any of them, where other columns differ). Texts without words all stay.
    """
    found = forest.near_duplicates(docs, shingle=5, num=80, den=100, rows=True).where(~F.col("stays"))
    lost, _ = shared.written(found.select("doc_id", "tid").distinct(), "lost")
    n, named, ids = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    kept = docs if n == named == ids else docs.dropDuplicates(["doc_id", "text"])
    tid, lost_id, lost_tid = (shared.free_name(docs, c) for c in ("tid", "lost_id", "lost_tid"))
    lost = lost.toDF(lost_id, lost_tid)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(lost_id)) & F.col(tid).eqNullSafe(F.col(lost_tid))
    side = F.broadcast(lost) if lost.count() <= lines.BROADCAST else lost
    return kept.withColumn(tid, F.xxhash64("text")).join(side, same, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Rows are searched one by one."""
    found = decontam.contaminate(docs, shared.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: the columns but text, with ids, n_ids, ids_crc32 and round_trip. Null texts have no ids."""
    return wfst.encode_documents(docs, _tokenizer("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
