"""From raw documents to packed training sequences, in five stages; each is written as Parquet and read by the next.

Every stage works on all rows that the one before kept. A null or empty text passes toxicity by the model's intercept,
is alone in its near-duplicate class, loses nothing to substring dedup, is mixed without adding words, and is packed as
a closing token. Repeated rows of an id and text leave the second stage once, unlike texts of a shared or null id each;
later copies of a document are the mix's repeats.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import _shuffle, mixing, nearjoin, packing, substring, toxicity
from tidewell.llm.queries import table, tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays; rows without an id are told apart by their texts."""
    return nearjoin.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words or more are taken out where they are not first."""
    rows = substring.without_repeats(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document may come up to three times or not at all."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(), ids=True)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("substring_dedup", unrepeated), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the trained model, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; stages before it are written to the folder that all executors share."""
    _shuffle.shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
