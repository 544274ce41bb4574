"""Summaries over methods, runs and pairs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def method_summary(rows: DataFrame, by: list[str], score: str, positive_only: bool = False) -> DataFrame:
    """mean, population std, median and count of a score; positive_only leaves out values up to 0."""
    x = F.when(F.col(score) > 0, F.col(score)) if positive_only else F.col(score)
    return rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.median(x).alias("median"), F.count(x).alias("n"))


def sample_summary(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """mean, sample std, count."""
    return rows.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n"))


def win_loss(rows: DataFrame, key: list[str], method: str, score: str, first: str, second: str, missing: float = 0.0) -> DataFrame:
    """wins, losses, ties and mean gain of the second method's mean score over the first's, key by key."""
    m = rows.where(F.col(method).isin(first, second)).groupBy(*key).agg(F.avg(F.when(F.col(method) == first, F.col(score))).alias("a"), F.avg(F.when(F.col(method) == second, F.col(score))).alias("b"))
    a, b = F.coalesce("a", F.lit(missing)), F.coalesce("b", F.lit(missing))
    return m.agg(F.count_if(b > a).alias("wins"), F.count_if(b < a).alias("losses"), F.count_if(b == a).alias("ties"), F.avg(b - a).alias("gain"))


def positional_win_loss(first: DataFrame, second: DataFrame, keys: list[str], order: list[str], score: str) -> DataFrame:
    """Pairs the two lists by their places in order within keys (J11); ties are what neither side wins of the first list."""
    place = lambda df, name: df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).select(*keys, "place", F.col(score).alias(name))
    paired = place(first, "a").join(place(second, "b"), [*keys, "place"], "left")
    return paired.groupBy(*keys).agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), (F.count("*") - F.count_if(F.col("b") > F.col("a")) - F.count_if(F.col("b") < F.col("a"))).alias("ties"))


def two_level(rows: DataFrame, item: list[str], method: str, score: str) -> DataFrame:
    """Mean of each item's runs, then mean, population std and median of those means by method."""
    inner = rows.groupBy(*item, method).agg(F.avg(score).alias("item_mean"), F.stddev_pop(score).alias("item_std"))
    return inner.groupBy(method).agg(F.avg("item_mean").alias("mean"), F.stddev_pop("item_mean").alias("std"), F.avg("item_std").alias("mean_run_std"), F.count("*").alias("items"))


def unpivot_metrics(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """mean, std, min, max and n of several metric columns over runs, one row a metric."""
    long = rows.unpivot(by, metrics, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def pivot_mean(rows: DataFrame, by: list[str], method: str, values: list[str], score: str) -> DataFrame:
    """Mean score by method as columns; the values are given, so there is no extra pass to find them."""
    return rows.groupBy(*by).pivot(method, values).agg(F.avg(score))


def row_percent(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts of column values as percent of their row."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    whole = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(by, *[F.when(whole > 0, 100.0 * F.col(v) / F.nullif(whole, F.lit(0))).otherwise(0.0).alias(v) for v in values])


def paired_tests(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """t statistic of a - b, Wilcoxon's W of the non-zero differences, Cohen's d by pooled population std; see with_p_values for their p values."""
    d = pairs.select(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).withColumn("d", F.col("a") - F.col("b"))
    base = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    size = d.where("d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("ties"), F.count_if(F.col("d") > 0).alias("plus"))
    # equal sizes share the mean of their ranks; ranks run over distinct sizes only
    over = Window.partitionBy(*by).orderBy("size")
    upto = F.sum("ties").over(over)
    ranked = size.withColumn("rank", upto - F.col("ties") + (F.col("ties") + 1) / 2)
    w = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("ties") - F.col("plus"))).alias("w_minus"), F.sum("ties").alias("n_nonzero"), F.sum(F.col("ties") ** 3 - F.col("ties")).alias("tie_term"))
    x = base.join(w, by, "left") if by else base.join(w)
    t = F.when(F.col("sd") > 0, F.col("mean_d") / (F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("n")))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    cohen = F.when(pooled > 0, (F.col("ma") - F.col("mb")) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)
    m = F.col("n_nonzero").cast("double")
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("tie_term") / 2) / 24)
    least = F.least("w_plus", "w_minus")
    z = (least - m * (m + 1) / 4) / F.nullif(spread, F.lit(0.0))
    return x.select(*by, "n", t.alias("t"), least.alias("w"), z.alias("z_w"), cohen.alias("cohens_d"), effect_label(cohen).alias("effect"))


def with_p_values(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds p_t (Student's t of n - 1 degrees), p_w (normal approximation) and whether they are below level; null where there is no statistic.

    One row a group comes in, so the two functions run a row at a time.
    """

    def p_of_t(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or k < 2 else t_p_value(x, k - 1) for x, k in zip(t, n)], dtype="float64")

    def p_of_z(z: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else normal_p_value(x) for x in z], dtype="float64")

    out = tests.withColumn("p_t", F.pandas_udf(p_of_t, "double")("t", "n")).withColumn("p_w", F.pandas_udf(p_of_z, "double")("z_w"))
    return out.withColumn("significant_t", F.col("p_t") < level).withColumn("significant_w", F.col("p_w") < level)


def effect_label(d: Column) -> Column:
    x = F.abs(d)
    return F.when(x < 0.2, "negligible").when(x < 0.5, "small").when(x < 0.8, "medium").otherwise("large")


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    return _beta_fraction(df / 2, 0.5, x)


def normal_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > 1e-30 else 1e-30)
        c = 1 + term / c if abs(c) > 1e-30 else 1e30
        f *= c * d
        if k and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) if f > 1 else front * f
