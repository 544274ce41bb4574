"""Mixing to target weights with soft domain membership and fitted document rates."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .evidence import Evidence, fit_evidence, posteriors, weigh

#: Documents whose posteriors round to one point of a grid of this step are one cell; the step doubles until there are at most CELLS.
GRID, CELLS = 32, 20_000
#: Projected-gradient steps, the weight that holds rates near 1, and the relative error that ends early.
STEPS, RIDGE, CLOSE = 20_000, 1e-5, 2e-4
#: The domains of the labelled table and the production weights.
DOMAINS = ["prose", "junk", "toxic"]
TARGETS = {"prose": 0.90, "junk": 0.08, "toxic": 0.02}


def label_domains(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, cls) from the labels table: toxic first, then junk (quality 0), else prose."""
    return labels.select(F.col(id_column).cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "prose").alias("cls"))


def cell_grid(domains: int) -> int:
    grid = GRID
    while grid > 1 and math.comb(grid + domains - 1, domains - 1) > CELLS:
        grid //= 2
    return grid


def project(tokens: np.ndarray, first: np.ndarray, second: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates a + b . p of each cell's documents by projected gradient, from the sums over the cell of tokens, tokens p and tokens p p'.

    Least squares of the domain totals, each weighed by the inverse of its present
    share, plus RIDGE for leaving rate 1.  A step scales documents by their tokens, so
    it moves a rate by an affine function of p, and a cell's totals are exact.  A rate
    below 0 at the cell's mean is 0 in all of the cell.
    """
    domains = len(want)
    a, b = np.ones(len(tokens)), np.zeros((len(tokens), domains))
    have = first.sum(0)
    total = have.sum()
    middle = first / np.maximum(tokens, 1)[:, None]
    weight = 1 / np.maximum(have / total, 1e-6)
    root = np.sqrt(weight)
    eta = 1 / (float(np.linalg.eigvalsh(root[:, None] * second.sum(0) / total * root[None, :]).max()) + RIDGE)
    live = (have > 0) & (want > 0)
    for _ in range(STEPS):
        now = first.T @ a + np.einsum("cde,ce->d", second, b)
        if (np.abs(now - want)[live] <= CLOSE * want[live]).all():
            break
        pull = (now - want) / total * weight
        a, b = a - eta * RIDGE * (a - 1), b - eta * (pull + RIDGE * b)
        below = a + (b * middle).sum(1) < 0
        a[below], b[below] = 0, 0
    else:
        warnings.warn(f"the rates did not converge: totals {now.round().tolist()}, wanted {want.round().tolist()}", stacklevel=3)
    return a, b


def mix(docs: DataFrame, model: Evidence, targets: dict[str, float], budget: float | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_<domain>.., rate: nonnegative rates that bring expected token totals to targets.

    targets gives each domain's share.  budget is the total of tokens; by default it
    leaves the domain with the largest share with its own expected tokens.  Posteriors
    are exact for each document, and a rate is fitted by project() from distributed sums
    over cells of like posteriors, whose number is bounded (CELLS) whatever the corpus;
    only these sums reach the driver.

    Texts without tokens get the prior's posteriors and a rate too; null ids and
    repeated rows are rows like others.  A wanted domain without expected tokens stays
    at 0; that, and rates that do not converge, give a warning.
    """
    k = len(model.classes)
    grid = cell_grid(k)
    weighed = weigh(docs, model, id_column, text_column)
    soft = cut(weighed.select("doc_id", "n_tokens", *[p.alias(f"p{d}") for d, p in enumerate(posteriors(weighed, model))]))
    # a cell's number: posteriors in steps of the grid, but for the first, which follows from them
    cell = sum(((F.floor(F.col(f"p{d}") * grid + 0.5) * (grid + 1) ** (d - 1)) for d in range(1, k)), F.lit(0)).cast("long")
    placed = soft.withColumn("cell", cell)
    part = lambda *ds: F.sum(math.prod([F.col(f"p{d}") for d in ds], start=F.col("n_tokens")))
    sums = placed.groupBy("cell").agg(F.sum("n_tokens").alias("tokens"), *[part(d).alias(f"s{d}") for d in range(k)], *[part(d, e).alias(f"g{d}_{e}") for d in range(k) for e in range(k)])
    rows = sums.orderBy("cell").collect()  # at most a bounded number, see cell_grid
    a, b = np.ones(len(rows)), np.zeros((len(rows), k))
    tokens, first = np.array([r["tokens"] for r in rows], float), np.array([[r[f"s{d}"] for d in range(k)] for r in rows], float).reshape(len(rows), k)
    wish, have = np.array([targets.get(c, 0.0) for c in model.classes]), first.sum(0)
    if have.sum() > 0 and wish.sum() > 0:
        anchor = int(np.argmax(wish))
        want = wish / wish.sum() * (budget or (have[anchor] * wish.sum() / wish[anchor]))
        for c in np.flatnonzero((have <= 0) & (want > 0)):
            warnings.warn(f"no document has tokens of the wanted domain {model.classes[c]}", stacklevel=2)
        a, b = project(tokens, first, np.array([[[r[f"g{d}_{e}"] for e in range(k)] for d in range(k)] for r in rows], float), want)
    names = ["cell", "a", *[f"b{d}" for d in range(k)]]
    listed = ", ".join(f"({r['cell']}L, {x!r}D, " + ", ".join(f"{float(y)!r}D" for y in ys) + ")" for r, x, ys in zip(rows, a.tolist(), b)) or f"(0L, 1D, {', '.join(['0D'] * k)})"
    fitted = docs.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")
    rate = F.greatest(F.lit(0.0), sum((F.col(f"b{d}") * F.col(f"p{d}") for d in range(k)), F.col("a")))
    return placed.join(F.broadcast(fitted), "cell").select(F.col("doc_id").alias(id_column), "n_tokens", *[F.col(f"p{d}").alias(f"p_{c}") for d, c in enumerate(model.classes)], rate.alias("rate"))


def draw(rate: F.Column, key: F.Column) -> F.Column:
    """Copies to take: the rate rounded up or down by a hash of the key, so that its mean is the rate."""
    u = F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def fit_domains(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Evidence:
    renamed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return fit_evidence(renamed, label_domains(labels, id_column), DOMAINS)
