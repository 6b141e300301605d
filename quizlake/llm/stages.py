"""Stages of the corpus pipeline: each applies one operator to all documents it is given.

A stage takes (spark, docs, sf_dir). Decisions are made on whole texts; every column of the
documents is handed on, whatever it is called. Documents without a doc_id are judged by
language and toxicity like all others; the stages that compare documents leave them alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import language, near_texts, packing, suffixes, toxicity
from quizlake.llm.common import stored
from quizlake.llm.queries import BYTE_VOCABULARY, TOXIC_CHAIN, toxicity_labels

#: A text is no text of a learned language if fewer of its n-grams than this belong to one.
LEAST_SCORE = 0.2
#: With fewer n-grams than this a low score is no evidence.
LEAST_GRAMS = 40
TOXIC = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: null texts, texts without a letter and texts that
    fit no language go; a text too short to tell stays."""
    known = language.learn(docs)
    found = docs.withColumn("_language", language.predicted(docs, known))
    fits = (F.col("_language.score") >= LEAST_SCORE) | (F.col("_language.grams") < LEAST_GRAMS)
    fits = (F.col("_language.lang") != language.NONE) & fits
    return found.filter(fits).select(*_names(docs))


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic."""
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXIC_CHAIN)
    return chain.score(docs).filter(F.col("_p_toxic") < TOXIC).select(*_names(docs))


def one_of_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate documents the one with the smallest doc_id; rows that
    repeat a doc_id are one document."""
    kept = near_texts.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept"))
    known = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    known = known.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    return known.unionByName(docs.filter("doc_id is null"))


def without_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that repeat; n_chars follows the text."""
    found = suffixes.deduplicated(docs).filter(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("kept_text").alias("_text"))
    joined = docs.join(found, F.col("doc_id") == F.col("_doc"), "left")
    cut = {"text": F.coalesce("_text", "text")}
    if "n_chars" in docs.columns:
        cut["n_chars"] = F.when(F.col("_doc").isNull(), F.col("n_chars")).otherwise(
            F.length("_text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their place in training sequences."""
    cut = packing.pieces(docs, BYTE_VOCABULARY, end_id=2)
    cut = stored(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.placed(cut)


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]
