"""Cost accounting and the response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dollars for a million tokens in and out.
PRICES = {
    "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4-turbo": (10.0, 30.0), "gpt-4": (30.0, 60.0), "gpt-3.5-turbo": (0.5, 1.5),
    "claude-sonnet-4-20250514": (3.0, 15.0), "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-opus-20240229": (15.0, 75.0), "claude-3-sonnet-20240229": (3.0, 15.0), "claude-3-haiku-20240307": (0.25, 1.25),
    "deepseek-coder": (0.14, 0.28), "deepseek-chat": (0.14, 0.28),
    "meta-llama/Meta-Llama-3.1-70B-Instruct-Turbo": (0.88, 0.88), "meta-llama/Meta-Llama-3.1-8B-Instruct-Turbo": (0.18, 0.18),
    "llama-3.3-70b-versatile": (0.59, 0.79), "llama-3.1-70b-versatile": (0.59, 0.79), "llama-3.1-8b-instant": (0.05, 0.08),
}


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, (a, b) in PRICES.items()], "model string, price_in double, price_out double")


def priced(calls: DataFrame) -> DataFrame:
    """Adds cost; a model without a price costs nothing.  The price table has a fixed 17 rows and is broadcast."""
    with_price = calls.join(F.broadcast(prices(calls.sparkSession)), "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return with_price.withColumn("cost", cost).drop("price_in", "price_out")


def costs(calls: DataFrame) -> DataFrame:
    """calls, tokens and cost in total, by model and by component, in one pass of grouping sets."""
    sums = [F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 4).alias("cost")]
    sets = priced(calls).groupingSets([[], [F.col("model")], [F.col("component")]], F.col("model"), F.col("component"))
    return sets.agg(*sums).select("model", "component", "calls", "tokens_in", "tokens_out", "cost")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Distinct requests that the cache has no answer to."""
    return requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def cached_answers(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(cache, key, "left").withColumn("hit", F.col("response").isNotNull())


def cache_stats(answered: DataFrame) -> DataFrame:
    """requests, hits, rate (0 without requests)."""
    return answered.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits")).withColumn("hit_rate", F.when(F.col("requests") > 0, F.col("hits") / F.nullif(F.col("requests"), F.lit(0))).otherwise(0.0))
