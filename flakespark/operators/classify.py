"""Classification scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_scores(results: DataFrame, actual: str = "actual", predicted: str = "predicted", categories: list[str] | None = None) -> DataFrame:
    """One-vs-rest precision, recall, f1 and support of every category seen on either side, or of a fixed list, with zeros for what is not seen.

    One aggregation to (actual, predicted) counts; everything else works on those.
    """
    cells = results.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("category"), F.col("n").alias("actual_n"), F.lit(0).cast("long").alias("predicted_n"), F.lit(0).cast("long").alias("hit")), F.struct(F.col("p").alias("category"), F.lit(0).cast("long").alias("actual_n"), F.col("n").alias("predicted_n"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")))).alias("x")).select("x.*")
    if categories is not None:
        zero = results.sparkSession.createDataFrame([(c, 0, 0, 0) for c in categories], "category string, actual_n long, predicted_n long, hit long")
        sides = sides.where(F.col("category").isin(categories)).unionByName(zero)
    s = sides.groupBy("category").agg(F.sum("actual_n").alias("support"), F.sum("predicted_n").alias("predicted_n"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    s = s.withColumn("precision", ratio(F.col("hit"), F.col("predicted_n"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))).otherwise(0.0)).select("category", "precision", "recall", "f1", "support")


def macro_scores(results: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """macro_f1 over categories with support, accuracy, n."""
    f1 = category_scores(results, actual, predicted).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    whole = results.agg(F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return f1.join(whole)  # one row each


def confusion(results: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts of every pair of fixed labels, zeros included."""
    spark = results.sparkSession
    cells = results.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "actual string, predicted string")
    return grid.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
