"""From documents to packed training sequences: classify, clean, drop near-duplicates, mix, pack.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps with the five columns of documents, other columns left
out; the last returns the packing. ``run`` writes each stage's result to the shared folder and reads it again for the next. An
empty table gives an empty one at every stage. What becomes of NULL, empty and very long texts and of repeated rows, each
stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longloom.llm import mixing, neardup, packing, quality_model, quality_rules
from longloom.llm.catalog import graded_labels, table
from longloom.llm.tokens import public_path
from longloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade of 1 or more is at least one half.

    A NULL text counts as an empty one; every row is judged by its text alone, so that repeated rows stay or go together.
    """
    model = quality_model.fit_grades(docs, graded_labels(table(spark, sf_dir, "labels")), 3)
    return quality_model.grade_documents(docs, model, cut=1, least=0.5).filter("graded.selected").select(*COLUMNS)


def line_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that break a rule.

    NULL and empty texts are too short to be kept; repeated rows stay or go together.
    """
    judged = quality_rules.apply_quality_rules(docs).select(
        "doc_id", F.col("quality.text").alias("text"), "lang", "source", F.col("quality.kept").alias("kept"))
    # stored, because a filter pushed below the rules would work them out again for each of its terms
    kept = materialize(judged).filter("kept")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.80 on.

    Texts without words are linked with nothing and stay; of rows with one id and text one stays. A NULL id is no lowest id.
    """
    return neardup.drop_near_duplicates(docs, percent=80).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words have no size and come as often as their source's whole copies; a NULL source is one of its own.
    """
    return mixing.mix_sources(docs, weights=(1, 2, 3), max_copies=3).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens.

    A NULL text is an empty one, whose one token is the end; repeated rows are packed each by itself.
    """
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), 4096, 1)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", line_cleaning), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

# The trained classifier, 64-bit hashes and the tokenizer have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
