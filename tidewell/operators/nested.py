"""Walks of nested documents of unknown depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.streaming.folder import shared_folder


def walk(rows: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, path, key, text): each string below each document, with the key that it stands under and the path to it.

    A level of all documents is opened at a time and written to the checkpoint folder, and levels go on as long as there are objects
    or arrays, so the depth is that of the data. Texts that are no JSON have no strings; a key that stands twice counts once.
    A list's strings stand under its own key; paths name keys and places, as in a.0.b.
    """
    shared_folder(rows.sparkSession)
    spark = rows.sparkSession
    level = rows.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json)).alias("v"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key")).filter("v is not null")
    found = None
    while True:
        opened = spark.sql("SELECT t.id, t.path, t.key AS above, x.pos, x.key AS name, x.value AS v FROM {t} t, LATERAL variant_explode(t.v) x", t=level)
        step = F.coalesce("name", F.col("pos").cast("string"))
        opened = opened.select("id", "v", F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), step).alias("path"), F.coalesce("name", "above").alias("key"), F.schema_of_variant("v").alias("kind"))
        opened = opened.withColumn("v", F.col("v").cast("string")).checkpoint(eager=True)  # nested values as JSON again
        text = opened.filter("kind = 'STRING'").select("id", "path", "key", F.col("v").alias("text"))
        found = text if found is None else found.unionAll(text)
        inner = opened.filter("kind like 'OBJECT%' or kind like 'ARRAY%'")
        if inner.isEmpty():
            return found.withColumnRenamed("id", id_col)
        level = inner.select("id", F.parse_json("v").alias("v"), "path", "key")


def service_urls(rows: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, path, url): the strings under a key `url`, in any case, that name a feature or map service."""
    return walk(rows, id_col, json).filter((F.lower("key") == "url") & F.col("text").rlike("(?i)(FeatureServer|MapServer)")).select(id_col, "path", F.col("text").alias("url"))
