"""Evaluation of diagnoses against annotated causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakespark.functions import replies
from flakespark.operators import model, stats

#: Cosine from which a diagnosis counts as aligned.
ALIGNED = 0.7


def evaluate(diagnoses: DataFrame, causes: DataFrame, keys: list[str], client=model.offline_client) -> DataFrame:
    """Per diagnosis: categories and their match, similarity 1 to 5, correctness, specificity.

    diagnoses: keys, method, diagnosis; causes: keys, cause.  A diagnosis without a
    cause is left out, as nothing can be said of it.  Each question is one call of the model seam.
    """
    pairs = diagnoses.join(causes, keys)
    out = pairs.withColumn("predicted", replies.diagnosis_category("diagnosis")).withColumn("actual", replies.diagnosis_category("cause")).withColumn("category_match", F.col("predicted") == F.col("actual"))
    asked = out.withColumn("prompt", F.concat(F.lit("Compare the diagnosis with the cause.\nDiagnosis: "), "diagnosis", F.lit("\nCause: "), "cause"))
    judged = model.generate(asked, client).withColumn("similarity", replies.similarity_score("response")).withColumn("correctness", replies.correctness("response")).drop("prompt", "cache_key", "response")
    asked = judged.withColumn("prompt", F.concat(F.lit("How specific is this, 1 to 3?\n"), "diagnosis"))
    return model.generate(asked, client).withColumn("specificity", replies.specificity("response")).drop("prompt", "cache_key", "response")


def aligned(rows: DataFrame, cosine: str = "cosine") -> DataFrame:
    return rows.withColumn("aligned", F.coalesce(F.col(cosine), F.lit(0.0)) >= ALIGNED)


def summary(evals: DataFrame, by: str = "method") -> DataFrame:
    """Category accuracy, similarity and specificity over positive scores, shares of Yes, Partial and No."""
    positive = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c)
    share = lambda v: F.avg((F.col("correctness") == v).cast("int")).alias(v.lower())
    return evals.groupBy(by).agg(F.avg(F.col("category_match").cast("int")).alias("category_accuracy"), F.stddev_pop(F.col("category_match").cast("int")).alias("category_std"), positive("similarity"), positive("specificity"), share("Yes"), share("Partial"), share("No"), F.count("*").alias("n"))


def improvement(evals: DataFrame, keys: list[str], score: str, first: str = "individual", second: str = "collective") -> DataFrame:
    return stats.win_loss(evals, keys, "method", score, first, second)
