"""A training corpus from raw documents: quality rules, quality classifier, near-dedup, substring dedup, packing.

``STAGES`` are run one after the other; each gets the documents that the one before has kept and written.  Models are
fitted on labelled documents of the whole table: the rules on all of them, the classifier on a bounded sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm import classifier, rules
from listing_lifecycle_spark.llm.arrow_text import stored
from listing_lifecycle_spark.llm.neardup import few, near_duplicates
from listing_lifecycle_spark.llm.packing import packed
from listing_lifecycle_spark.llm.queries import table, tokenizer
from listing_lifecycle_spark.llm.substring import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest; empty texts go."""
    forest = rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.keep(docs, forest)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5.

    The classifier learns from the labelled documents of the whole table, as the rules have removed most of the bad ones.
    """
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), the one of least doc_id.

    Rows without doc_id stay.  A doc_id of several rows stays if one of them is kept; of equal rows one stays.
    """
    groups = stored(near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")), "groups")
    groups = groups.where("doc_id IS NOT NULL")
    left = docs.join(few(groups.where("NOT kept").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = groups.where("kept AND times > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(few(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(few(again), "doc_id", "left_anti").select(*docs.columns).union(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document (or place) has; n_chars follows the text."""
    return cut_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048."""
    return packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express random splits, trained vectors, content-defined chunks or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
