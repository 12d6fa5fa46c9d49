"""The corpus operators as queries over the tables of a folder; OP_SQL has their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import chat, langid, mixing, nearjoin, negatives, packing, pieces, resampling, runs_index, substring, tiff, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_pages(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_report(table(spark, sf_dir, "documents"))


def op7_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_index.run_report(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op1_tiff": op1_tiff, "op2_chat": op2_chat, "op3_mixing": op3_mixing, "op4_langid": op4_langid, "op5_topk": op5_topk, "op6_packing": op6_packing, "op7_nearjoin": op7_nearjoin, "op8_toxicity": op8_toxicity, "op9_runs": op9_runs, "op10_substring": op10_substring, "op1_tiff_pages": op1_tiff_pages, "op11_negatives": op11_negatives, "op12_resampling": op12_resampling, "op13_pieces": op13_pieces}
OP_SQL = {"op3_mixing": mixing.OP3_SQL, "op5_topk": topk.OP5_SQL, "op11_negatives": negatives.OP11_SQL, "op12_resampling": resampling.OP12_SQL}
