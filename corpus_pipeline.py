"""A training corpus from raw documents: language, repeated lines, near duplicates, mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each stage's result as Parquet and rereads it as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, language, line_dedup, mixing, ngram_join
from graphloom.llm.shared import Workspace


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told.

    Null texts, empty ones and such without letters go; a null id or source does not matter, and the language column is only
    learned from, where it is not null. Repeated rows stay or go together. An empty table gives an empty one. All columns pass through.
    """
    return language.known_languages(docs)


def with_row_keys(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row's own, and the name of that column, which no column of ``docs`` has.

    The table is written, so that a row keeps its number however often it is read.
    """
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    return Workspace(spark, name).save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line passages, and documents of which nothing is left. Every row is a document of its own.

    Of a passage the first by id stays; null ids come first, and rows with one id follow their order in the input. Null texts
    and texts of fewer than three lines stay as they are. An empty table gives an empty one. All columns pass through but
    ``text``, and ``n_chars`` where the text has changed.
    """
    keyed, key = with_row_keys(spark, docs, "pipeline-lines")
    keyed = keyed.withColumn(key, F.struct("doc_id", key))
    out = line_dedup.dedup_lines(keyed.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), "text"), id_col="key")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    out = out.where("n_removed = 0 or length(trim(text)) > 0")
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the one with the smallest id (a null one last), of each group of near duplicates.

    Every row is a document of its own: of repeated rows one stays, and a text that shares its id with a copy is not dropped
    with it. Texts without words (null, empty, blank) are no one's duplicates and stay. An empty table gives an empty one. All
    columns pass through.
    """
    keyed, key = with_row_keys(spark, docs, "pipeline-groups")
    found = ngram_join.near_duplicate_texts(keyed.select(key, "text"), id_col=key).where("n_links > 0")
    found = Workspace(spark, "pipeline-members").save(found.select(F.col("doc_id").alias(key), "component_id"), "members")
    ids = found.join(keyed.select(key, "doc_id").hint("shuffle_hash"), key)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("key")))
    chosen = ids.groupBy("component_id").agg(smallest.alias("x")).select(F.col("x.key").alias(key))
    doubles = found.select(key).join(chosen.hint("shuffle_hash"), key, "left_anti")
    return keyed.join(doubles.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every source at its target weight: a row for each time a document is taken.

    Null and blank texts have no words and are not taken; a null source is one of its own, a null id an id like any other.
    Repeated rows are taken alike. An empty table gives an empty one. All columns pass through but ``text`` and ``n_chars`` of
    a document that the cut splits.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the text they decode to.

    A null text is an empty one. Null ids and repeated rows are rows like any other. An empty table gives an empty one. Other
    columns than the id and the text are left out.
    """
    return bpe.encode_texts(docs, keep=("ids",))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mix_sources", mixed),
    ("bpe", encoded),
]

#: Language inference and tokens cannot be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if number:
            work.drop(STAGES[number - 1][0])
    return docs
