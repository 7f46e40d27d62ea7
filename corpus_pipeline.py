"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.llm import langid, minhash, packing, quality, suffix
from fringeworks.llm._shared import stored
from fringeworks.llm.queries import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language, without a letter or of an uncertain one, and rows without a doc_id."""
    docs = docs.filter("doc_id is not null")
    labelled = docs.select("doc_id", "text", "lang").filter(~langid.training_part())
    model = langid.fit(labelled)
    named = langid.predict(docs.select(*COLUMNS), model)
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted of lines of their own; of repeated rows all go if one fails."""
    kept = quality.quality(docs).groupBy("doc_id").agg(F.min("kept").alias("kept")).filter("kept").select("doc_id")
    return docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), "doc_id", "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component, once: of repeated rows the one with the greatest text."""
    kept = minhash.components(docs).filter("kept").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 400 bytes and more that occur twice; bytes of a cut character become the replacement character."""
    cut = suffix.remove_repeats(docs).select("doc_id", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    rest = docs.select("doc_id", "lang", "source")
    return cut.join(rest, "doc_id").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: No SQL: the fit of a language model, hashing and tokenizing are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
