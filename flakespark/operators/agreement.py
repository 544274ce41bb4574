"""Agreement of raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_agreement(pairs: DataFrame, a: str, b: str, categories: list[int]) -> DataFrame:
    """exact, adjacent (within 1), mae, pearson, spearman, kappa, linear and quadratic weighted kappa.

    One aggregation to a table of score pairs; the rest works on its at most
    len(categories)^2 cells.  Ranks of equal scores are their mean.
    """
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    span = float(max(categories) - min(categories)) or 1.0
    w = lambda p: F.pow(F.abs(F.col("a") - F.col("b")) / span, p)
    def ranks(side: str) -> DataFrame:
        m = cells.groupBy(side).agg(F.sum("n").alias("m"))
        upto = F.sum("m").over(Window.orderBy(side))  # one row a category
        return m.select(side, F.col("m").alias(f"m_{side}"), (upto - F.col("m") + (F.col("m") + 1) / 2).alias(f"r_{side}"))

    ra, rb = ranks("a"), ranks("b")
    x = cells.join(ra, "a").join(rb, "b")
    total = x.agg(F.sum("n").alias("n"))
    mean = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    def corr(u, v):
        mu, mv = F.sum(F.col("n") * u), F.sum(F.col("n") * v)
        n = F.sum("n")
        top = n * F.sum(F.col("n") * u * v) - mu * mv
        return top / F.nullif(F.sqrt((n * F.sum(F.col("n") * u * u) - mu * mu) * (n * F.sum(F.col("n") * v * v) - mv * mv)), F.lit(0.0))

    seen = x.agg(
        F.sum("n").cast("long").alias("n"), mean((F.col("a") == F.col("b")).cast("double")).alias("exact"), mean((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("adjacent"),
        mean(F.abs(F.col("a") - F.col("b")).cast("double")).alias("mae"), corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("pearson"), corr(F.col("r_a"), F.col("r_b")).alias("spearman"),
        mean(w(1)).alias("d1"), mean(w(2)).alias("d2"),
    )
    # chance: products of the margins, on at most len(categories)^2 rows
    margins = ra.select("a", "m_a").join(rb.select("b", "m_b"), F.lit(True))
    chance = margins.join(total.withColumnRenamed("n", "all"), F.lit(True)).agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("m_a") * F.col("m_b"))).alias("c0"), F.sum(w(1) * F.col("m_a") * F.col("m_b")).alias("c1"), F.sum(w(2) * F.col("m_a") * F.col("m_b")).alias("c2"), F.max(F.col("all") * F.col("all")).alias("sq")
    )
    y = seen.join(chance, F.lit(True))
    e0 = F.coalesce("c0", F.lit(0.0)) / F.col("sq")
    kappa = lambda d, c: 1 - F.col(d) / F.nullif(F.col(c) / F.col("sq"), F.lit(0.0))
    return y.select("n", "exact", "adjacent", "mae", "pearson", "spearman", ((F.col("exact") - e0) / F.nullif(1 - e0, F.lit(0.0))).alias("kappa"), kappa("d1", "c1").alias("kappa_linear"), kappa("d2", "c2").alias("kappa_quadratic"))


def fleiss_kappa(ratings: DataFrame, item: str, score: str) -> DataFrame:
    """Fleiss' kappa of items with equally many ratings each."""
    counts = ratings.groupBy(item, score).agg(F.count("*").cast("double").alias("c"))
    items = counts.groupBy(item).agg(F.sum("c").alias("k"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    observed = items.agg(F.avg(F.col("agree") / F.nullif(F.col("k") * (F.col("k") - 1), F.lit(0.0))).alias("p"), F.count("*").alias("items"))
    shares = counts.groupBy(score).agg(F.sum("c").alias("c"))
    expected = shares.agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), 2)).alias("e"))
    return observed.join(expected, F.lit(True)).select("items", ((F.col("p") - F.col("e")) / F.nullif(1 - F.col("e"), F.lit(0.0))).alias("fleiss"))
