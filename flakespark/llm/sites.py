"""Quality scores with hierarchical empirical Bayes priors of hosts and paths."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .evidence import SAMPLE_ROWS, Evidence, fit_evidence, weigh

#: A document is kept from this score on.
THRESHOLD = 0.5
#: Bounds of the pseudo-counts that the spread of a level is turned into.
LEAST_PULL, MOST_PULL = 2.0, 10_000.0
#: Log-odds of the words count up to this.
REACH = 200.0
CLASSES = ["good", "bad"]


@dataclass
class QualityModel:
    """Word evidence, and the logistic curve that turns its log-odds into P(good)."""

    evidence: Evidence
    slope: float
    shift: float


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> QualityModel:
    """Fits the words, then the curve, both on the bounded labelled sample; without labels every text scores by its site."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("cls")).where("cls is not null")
    model = fit_evidence(docs, known, CLASSES)
    chosen = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("cls")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    weighed = weigh(docs.join(F.broadcast(chosen), "doc_id"), model, keep=("cls",))
    # whole steps of log-odds within a bound: a few hundred rows, whatever the sample
    step = F.round(F.least(F.greatest(F.col("e0") - F.col("e1"), F.lit(-REACH)), F.lit(REACH))).alias("x")
    bins = weighed.groupBy(step).agg(F.count("*").alias("n"), F.count_if(F.col("cls") == "good").alias("good")).collect()
    return QualityModel(model, *_logistic([(r["x"], r["n"], r["good"]) for r in bins]))


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of P(good) by log-odds: Newton steps on counts, drawn a little towards slope 0.5."""
    a, b = 0.5, 0.0
    if not any(g for _, _, g in bins) or not any(n - g for _, n, g in bins):
        return a, b
    for _ in range(100):
        ga, gb, haa, hab, hbb = 0.1 * (a - 0.5), 1e-3 * b, 0.1, 0.0, 1e-3
        for x, n, g in bins:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * x + b))))
            w = n * p * (1 - p)
            ga, gb = ga + (n * p - g) * x, gb + n * p - g
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da) / 0.5, abs(db) / 5)
        a, b = max(1e-3, a - da / size), b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def _pull(groups: DataFrame, mean: str, towards: F.Column) -> float:
    """Pseudo-counts of a level's prior by the method of moments: binomial spread over that of the group means."""
    got = groups.agg(F.sum(F.col("n") * towards * (1 - towards)).alias("inner"), F.sum(F.col("n") * (F.col(mean) - towards) ** 2).alias("outer")).first()
    if not got["inner"] or not got["outer"]:
        return MOST_PULL
    return min(MOST_PULL, max(LEAST_PULL, got["inner"] / got["outer"] - 1))


def site_quality(docs: DataFrame, model: QualityModel, host_column: str = "source", path_column: str = "lang", threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, evidence (calibrated log-odds of the words), host_prior, path_prior, score (P(good)), kept (score >= threshold).

    The mean posterior of all documents is the global prior; a host's mean is drawn
    towards it, a path's mean towards its host's, each by pseudo-counts from the spread
    of their level, so sparse sites stay near what is above them.  The score adds to the
    words' log-odds how far the path's stand from the global ones.  Grouped sums only: a hot host is one key
    of a partial aggregation, and what is joined back has a row for each path.

    Null host or path: the empty name.  Null and empty texts have no words, so their
    evidence is the curve's shift alone.  One row comes out for each row, whatever its id.
    """
    named = docs.withColumn("__host", F.coalesce(F.col(host_column).cast("string"), F.lit(""))).withColumn("__path", F.coalesce(F.col(path_column).cast("string"), F.lit("")))
    weighed = weigh(named, model.evidence, id_column, text_column, keep=("__host", "__path"))
    bounded = F.least(F.greatest(F.col("e0") - F.col("e1"), F.lit(-REACH)), F.lit(REACH))
    scored = cut(weighed.select("doc_id", F.col("__host").alias("host"), F.col("__path").alias("path"), (model.slope * bounded + model.shift).alias("words")).withColumn("p", 1 / (1 + F.exp(-F.col("words")))))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    middle = (whole["s"] / whole["n"]) if whole["n"] else model.evidence.priors[0]
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("mean", F.col("s") / F.col("n"))
    pull = _pull(hosts, "mean", F.lit(middle))
    hosts = hosts.select("host", ((F.col("s") + pull * middle) / (F.col("n") + pull)).alias("host_prior"))
    joined = paths.join(hosts, "host").withColumn("mean", F.col("s") / F.col("n"))
    inner = _pull(joined, "mean", F.col("host_prior"))
    priors = joined.select("host", "path", "host_prior", ((F.col("s") + inner * F.col("host_prior")) / (F.col("n") + inner)).alias("path_prior"))
    priors = priors.withColumn("path_prior", F.least(F.greatest("path_prior", F.lit(1e-6)), F.lit(1 - 1e-6)))
    # the curve holds the global rate already; a site adds how far it stands from it
    middle = min(max(middle, 1e-6), 1 - 1e-6)
    odds = F.log(F.col("path_prior") / (1 - F.col("path_prior"))) - math.log(middle / (1 - middle)) + F.col("words")
    out = scored.join(priors, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("doc_id").alias(id_column), F.col("words").alias("evidence"), "host_prior", "path_prior", "score", (F.col("score") >= threshold).alias("kept"))
