"""Corpus pipeline: five stages, each on the table that its predecessor wrote.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`; the last one adds how often a document is
taken. Rows without doc_id can't be told apart and pass the two stages that compare documents. Null, empty and letterless texts
go in the first stage; ties and repeats are as the operators state; other columns of docs are left behind; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revstrand.llm import decontaminate, language, mixing, near_dup, substring_dedup
from revstrand.llm._spark import cut, drop, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if more than this share of it is explained by no learned language.
MOST_OTHER = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that are mostly of no language."""
    table(spark, sf_dir, "documents")  # bounds the session's Arrow batches
    model = language.train(docs)
    return language.identify(docs.select(COLUMNS), model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("other") <= MOST_OTHER)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near duplicates, and of its repeated rows one; a doc_id's other texts stay."""
    found = cut(near_dup.classes(docs), "pipeline-classes")
    per = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    # what goes and what is there more than once: few ids, so texts don't move where they can be sent round
    apart = cut(per.where("n > 1 OR doc_id != class_id"), "pipeline-apart")
    kept = docs.select(COLUMNS).join(apart.select("doc_id"), "doc_id", "left_anti")
    again = apart.where("doc_id = class_id").select("doc_id")
    drop(found)
    if again.isEmpty():
        return kept
    one = Window.partitionBy("doc_id", "text").orderBy("source", "lang", "n_chars")
    return kept.unionByName(docs.select(COLUMNS).join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").select(COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; documents that had words and have none left go."""
    kept = substring_dedup.dedup(docs, keep=("lang", "source", "n_chars")).where("n_words = 0 OR n_removed < n_words")
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage."""
    return decontaminate.find(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("size(leaks) = 0").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document `copies` times, so that sources meet their targets; documents taken never go."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"), keep_source=True)
    return mixed.where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: Language inference and near duplicates can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        done = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        docs = before = done
    return docs
