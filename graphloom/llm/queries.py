"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, embedding_dedup, language, line_dedup, mixing, ngram_join, secrets, sharding, vector_codes, vector_search, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vector_search.nearest_vectors(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages")).drop("payload")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(_read(spark, sf_dir, "documents")).drop("mixture")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), keep=())


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_texts(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_read(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    log = chat_format.conversation_log(rows.unionByName(added))
    return chat_format.read_back(chat_format.format_conversations(log))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_embedding_dedup, op2_vector_search, op3_warc, op4_line_dedup, op5_mix_sources, op6_language, op7_bpe, op8_shard, op9_secrets, op10_ngram_join,
        op11_vector_codes, op12_chat_format, op13_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.ARCHIVE_SQL,
        "op4_line_dedup": line_dedup.DEDUP_SQL,
        "op5_mix_sources": mixing.MIX_SQL,
        "op10_ngram_join": ngram_join.JOIN_SQL,
        "op11_vector_codes": vector_codes.CODES_SQL,
        "op12_chat_format": chat_format.FORMAT_SQL,
        "op13_collocations": collocations.COLLOCATIONS_SQL,
    }
