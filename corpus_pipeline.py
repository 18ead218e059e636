"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

1. language: the language of every text, learned from the labelled rows; texts without letters go.
2. near_duplicates: one document of each group of near copies stays.
3. repeats: passages of WORDS words or more that also stand elsewhere are taken out of the texts. They are found by
   their windows of WINDOW bytes, so passages of WORDS words on average four bytes long, spaces included, are not missed.
4. secrets: secrets in the texts are replaced by a mark.
5. packing: the texts' token ids are cut into sequences of 1024.

All but the last return the columns of documents. No SQL: none of the five can be told in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import language, minhash, packing, secrets, suffixes
from lorebase.llm.common import Scratch, documents

WINDOW, WORDS = 200, 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs).select(*docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffixes.without_repeats(docs, length=WINDOW, least_words=WORDS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", identify_language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", redact_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written, and its predecessor's then deleted."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
