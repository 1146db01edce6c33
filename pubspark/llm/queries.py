"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, neardup, oracles, pieces, pii, quality, sharding, suffixes, tokens, urls
from .shared import table

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
#: The key under which the registered query and the pipeline replace the test tables' invented data where the session sets none. It is public: for real data set ``pii.SETTING``.
TEST_KEY = "invented data only"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_report(table(spark, sf_dir, "documents"), spark.conf.get(pii.SETTING, TEST_KEY))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.codec_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a page are those of the document of the same number."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), labels).drop("mined")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_quality_rules, op3_pii_pseudonyms, op4_suffix_dedup, op5_sentencepiece,
        op6_near_duplicates, op7_sharding, op8_language_model, op9_decontamination, op10_url_filters,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
