"""A training-data pipeline over documents: language ID, toxicity, near-duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and all rows that the stage before kept. All but the last return the columns
of docs. ``run`` writes each stage's rows to the shared folder and reads them for the next. Stages that hand texts to Python
let the session's Arrow batches hold ``common.ARROW_ROWS`` rows at most, so that few texts stand in memory at once.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm import bpe, jaccard, langid, mixing, toxicity
from tallyspan.llm.common import shared_dir, small_batches

#: A language that is less sure than this is none.
LEAST_SURE = 0.2
#: From this score on a document is toxic.
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that can be told: texts that are null or without a letter go, and hopeless guesses."""
    small_batches(spark)
    found = langid.predict(docs, langid.train(docs), out_col="stage_language")
    return found.where(f"stage_language.lang_pred <> 'und' and stage_language.score >= {LEAST_SURE}").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are not toxic, as learned from the labels of documents that are still there.

    Null and empty texts hold no n-gram and score as the intercept does; repeated rows score alike.
    """
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out_col="stage_score").where(F.col("stage_score") < TOXIC).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of five-word shingle sets with a similarity of 0.8 or more.

    Null, blank and unlike texts stay, as do rows without an id; rows that repeat a kept id all stay.
    """
    return jaccard.one_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are drawn when sources, languages and topics are raked to flattened shares.

    Null values are a value of their own; documents of cells whose rate is above one come in whole copies.
    """
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text. A null text counts as empty; repeated rows are encoded row by row."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [("language_id", language), ("toxicity", clean), ("ngram_jaccard", distinct), ("mixing", mixed), ("byte_bpe", tokens)]

#: Trained models and subword merges are beyond SQL. tests/llm/test_pipeline.py holds the near-duplicate and token stages against brute-force
#: versions, the two classifiers' stages against their models applied text by text, and mixing against its copies counted document by document.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
