"""Corpus pipeline: five stages over `documents`, each one operator of the corpus package.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, minhash, ppm, sampled_pieces, templates
from lodestone.llm.common import Scratch, crc_mod, table
from lodestone.llm.queries import piece_model

#: Texts whose language is predicted with less certainty than this are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those of uncertain
    language; the rest is unchanged, repeated rows each. An empty table gives an empty one."""
    trees = ppm.fit_trees(docs, crc_mod("doc_id", 4) != 2, "doc_id", "text", "lang")
    return ppm.accepted(docs, trees, "text", LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clears texts of recurring lines, of which one text keeps each; n_chars follows.

    A document goes if that leaves no word of it: all it has stands in others. Null and
    empty texts stay as they are, repeated rows are treated alike, an empty table gives an
    empty one."""
    out = templates.drop_recurring_lines(docs, "text")
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (that of the least id) of every near-duplicate component.

    Null, empty and wordless texts and rows without an id are near to nothing and stay; rows
    of a repeated id stay or go together. An empty table gives an empty one."""
    classes = minhash.near_duplicate_classes(docs, "doc_id", "text")
    gone = classes.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a test item; null and empty texts overlap with none,
    repeated rows go together, empty tables of either kind drop nothing."""
    found = decontam.find_overlaps(docs, table(spark, sf_dir, "benchmark"), "text").select("key").distinct()
    keyed = docs.withColumn("__key", F.md5(F.col("text").cast("string").cast("binary")))
    return keyed.join(found.hint("merge"), keyed["__key"] == found["key"], "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentations: doc_id, samples, round_trip; null samples for a
    null text, one sample without pieces for the empty one, a row for each repeated row."""
    return sampled_pieces.encode_documents(docs, sampled_pieces.load_vocabulary(spark, piece_model(spark)), "doc_id", "text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Not expressible in SQL; the tests hold it against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of `sf_dir`; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
