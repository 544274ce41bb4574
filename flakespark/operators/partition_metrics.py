"""Comparison of a predicted with a true partition (M1 to M5), any number of methods at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(n):
    return n * (n - 1) / 2


def contingency(labels: DataFrame, keys: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """keys, predicted, actual, cell: the only shuffle that sees every row, with partial counts before it."""
    both = F.col(predicted).isNotNull() & F.col(actual).isNotNull()
    return labels.where(both).groupBy(*keys, F.col(predicted).alias("p"), F.col(actual).alias("t")).agg(F.count("*").cast("double").alias("cell"))


def partition_scores(labels: DataFrame, keys: list[str] | None = None, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Per key: n, clusters, ari, nmi, homogeneity, completeness, v_measure, purity.

    Rows labelled on both sides count.  NMI uses the arithmetic mean and natural logs;
    where both entropies are 0 NMI is 0, homogeneity, completeness and V are 1.  ARI is
    0 without pairs, and 1 or 0 by equality where the chance term is all there is.
    """
    keys = keys or []
    cells = contingency(labels, keys, predicted, actual)
    one = [F.lit(0).alias("__one")] if not keys else []
    group = keys or ["__one"]
    cells = cells.select("*", *one)
    total = cells.groupBy(*group).agg(F.sum("cell").alias("n"), F.sum(_pairs(F.col("cell"))).alias("both"))
    rows = cells.groupBy(*group, "p").agg(F.sum("cell").alias("c"), F.max("cell").alias("top"))
    cols = cells.groupBy(*group, "t").agg(F.sum("cell").alias("c"))
    by_row = rows.groupBy(*group).agg(F.sum(_pairs(F.col("c"))).alias("row_pairs"), F.sum("top").alias("tops"), F.count("*").alias("n_predicted"), F.sum(F.col("c") * F.log("c")).alias("row_log"))
    by_col = cols.groupBy(*group).agg(F.sum(_pairs(F.col("c"))).alias("col_pairs"), F.count("*").alias("n_true"), F.sum(F.col("c") * F.log("c")).alias("col_log"))
    by_cell = cells.groupBy(*group).agg(F.sum(F.col("cell") * F.log("cell")).alias("cell_log"))
    x = total.join(by_row, group).join(by_col, group).join(by_cell, group)
    n = F.col("n")
    # entropies from sums of c ln c: H = ln n - sum(c ln c) / n
    h_row, h_col, h_both = (F.log(n) - F.col(c) / n for c in ("row_log", "col_log", "cell_log"))
    flat = lambda h: F.when(F.abs(h) < 1e-12, 0.0).otherwise(h)
    x = x.withColumn("h_p", flat(h_row)).withColumn("h_t", flat(h_col)).withColumn("mi", flat(h_row + h_col - h_both))
    expected = F.when(_pairs(n) > 0, F.col("row_pairs") * F.col("col_pairs") / F.nullif(_pairs(n), F.lit(0.0)))
    most = (F.col("row_pairs") + F.col("col_pairs")) / 2
    x = x.withColumn("expected", expected).withColumn("most", most)
    ari = F.when(_pairs(n) == 0, 0.0).when(F.col("most") == F.col("expected"), F.when(F.col("both") == F.col("expected"), 1.0).otherwise(0.0)).otherwise((F.col("both") - F.col("expected")) / F.nullif(F.col("most") - F.col("expected"), F.lit(0.0)))
    homogeneity = F.when(F.col("h_t") == 0, 1.0).otherwise(F.col("mi") / F.nullif(F.col("h_t"), F.lit(0.0)))
    completeness = F.when(F.col("h_p") == 0, 1.0).otherwise(F.col("mi") / F.nullif(F.col("h_p"), F.lit(0.0)))
    x = x.withColumn("homogeneity", homogeneity).withColumn("completeness", completeness)
    both = F.col("homogeneity") + F.col("completeness")
    out = x.select(
        *keys, n.cast("long").alias("n"), "n_predicted", "n_true", ari.alias("ari"),
        F.when(F.col("h_p") + F.col("h_t") == 0, 0.0).otherwise(F.col("mi") / F.nullif((F.col("h_p") + F.col("h_t")) / 2, F.lit(0.0))).alias("nmi"),
        "homogeneity", "completeness", F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / F.nullif(both, F.lit(0.0))).alias("v_measure"),
        (F.col("tops") / n).alias("purity"),
    )
    return out
