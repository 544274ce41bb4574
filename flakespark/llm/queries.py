"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, digest, jaccard, mixing, nearest, packing, rules, sites, suffix, urlrules
from .common import table
from .sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.fit_domains(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate(table(spark, sf_dir, "conversations"))
    # the mask as text, as SQL engines show lists unlike each other
    mask = F.array_join(F.transform("targets", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return rows.withColumn("targets", mask)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sites.site_quality(docs, sites.fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbour_digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nearest.score(docs, nearest.fit(docs, table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_chat_rotation, op4_packing, op5_quality_rules, op6_url_filter, op7_site_quality, op8_fingerprints, op9_toxicity, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
