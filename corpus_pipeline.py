"""A corpus pipeline: each stage's result is written to the shared folder and read by the next one.

Every stage takes all columns that documents has, whatever their names, and all but the last return them. Nulls: a null text counts as an empty one, stays null
and is a copy of other texts without words; a null doc_id comes after all others, and such rows are told apart by their texts; lang, source and n_chars are only carried.
Empty and very long texts are taken as a whole. Of ties the smallest doc_id, then the text's hash decides. Repeated rows are one document: the near dedup
keeps one of them. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import automaton, linededup, queries, simhash, toxicity, wumanber
from palimpsest.llm.textkit import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the machine trained on the labels scores at 0.7 or more."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeated runs of lines out; documents stay, n_chars follows the text."""
    made = linededup.drop_repeated_lines(docs, removed="n_removed")
    return made.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).drop("n_removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of eight words of any benchmark item."""
    return wumanber.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of what is left."""
    return automaton.bpe_round_trip(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained machine, fingerprint components and merges can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
