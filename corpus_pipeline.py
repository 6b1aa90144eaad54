"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionledger.llm import jaccard, language, linededup, packing, quality
from sessionledger.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SEQUENCE_TOKENS = 2048
#: Texts that a Python worker receives at a time; all stages share an executor's workers, which keep the most they ever held.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no learned language fits better than the others."""
    model = language.train(docs.select("text", "lang"))
    told = language.identify(docs.select(*COLUMNS), model)
    return told.filter((F.col("language.lang_pred") != language.UNDETERMINED) & (F.col("language.score") >= language.MIN_SCORE)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or lie too far from their language's histograms."""
    return quality.judge(docs.select(*COLUMNS)).filter("quality.kept").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated line passages out of the texts. Every row stays, and ``n_chars`` follows the text."""
    left = linededup.drop_passages(docs.select(*COLUMNS))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of every class of near copies; texts without a word all stay."""
    return jaccard.representatives(docs.select(*COLUMNS), size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS, keep_ids=False)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_class),
    ("best_fit_packing", packed),
]

#: Learned models, a trained vocabulary and searches that stop when bounds say so: no stage list that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
