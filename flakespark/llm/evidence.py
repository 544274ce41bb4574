"""Native word evidence: presence and absence of telling words, weighed by class log-ratios (naive Bayes)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bound of a fit, labelled rows read; rows that a word needs.
SAMPLE_ROWS, WORD_ROWS = 20000, 5
#: Up to so many words (about 10 MB) the model is broadcast; a larger one is joined by a shuffle.
BROADCAST_WORDS = 200_000
#: Standard deviations by which a word must favour some class.
TELLING = 4.0
#: Least log-ratio of a word for its best class; many weak words would outvote a few telling ones.
LEAST_WEIGHT = 0.7
#: Words of a text support each other, so their evidence counts in part.
DAMPING = 0.5
_GAPS = r"[\x20\x09-\x0D]+"
#: A word that every text is given, so that none is lost in the join with the model.
_EVERY = "^"


def signed(texts: DataFrame, keys: list[F.Column]) -> DataFrame:
    """keys, words (with _EVERY at the end), n_tokens, sign: the hash of how seldom new words come in how long a text.

    The text is split once, and nothing is trimmed or joined to the array, which would
    cost more than the splitting.
    """
    split = texts.select(*keys, F.split(F.concat("text", F.lit(" " + _EVERY)), _GAPS).alias("words"))
    n_tokens = F.size("words") - 1 - (F.get("words", F.lit(0)) == "").cast("int")
    counted = split.select("*", n_tokens.cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).alias("n_distinct"))
    fresh = F.floor(20 * F.col("n_distinct") / (F.col("n_tokens") + 1))
    bulk = F.floor(F.log(F.col("n_tokens") + 1.0) / math.log(4))
    return counted.select("*", F.xxhash64(F.concat_ws(":", F.lit("^"), fresh.cast("string"), bulk.cast("string"))).alias("sign")).drop("n_distinct")


class Evidence:
    """Class priors, the table (word, one weight a class) of a fit's n words, and what a text without any of them has."""

    def __init__(self, classes: list[str], priors: list[float], table: DataFrame, without: list[float], n: int):
        self.classes, self.priors, self.table, self.without, self.n = classes, priors, table, without, n

    def sent(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.n <= BROADCAST_WORDS else table


def fit_evidence(docs: DataFrame, labelled: DataFrame, classes: list[str], id_column: str = "doc_id", text_column: str = "text") -> Evidence:
    """Weights from at most SAMPLE_ROWS rows of labelled(id, cls), those with the smallest id hashes.

    Every class starts with one row, so that none is impossible; without labels all are
    as likely and no word tells anything.
    """
    chosen = labelled.where(F.col("cls").isin(*classes) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.min("cls").alias("cls")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # copies would pass their own words for telling ones
    distinct = texts.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("text_hash")).agg(F.min("cls").alias("cls"), F.first("text").alias("text"))
    sample = cut(signed(distinct, [F.col("cls")]).select("cls", F.array_distinct(F.array_append(F.transform("words", lambda w: F.xxhash64(w)), F.col("sign"))).alias("keys")))
    found = {r["cls"]: r["n"] for r in sample.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    sizes = [found.get(c, 0) + 1 for c in classes]
    total = sum(sizes)
    counts = sample.select("cls", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), *[F.count_if(F.col("cls") == c).alias(f"n{k}") for k, c in enumerate(classes)]).where((F.col("n") >= WORD_ROWS) & ~F.col("key").isin(F.xxhash64(F.lit(_EVERY)), F.xxhash64(F.lit(""))))
    share = [s / total for s in sizes]
    z = F.greatest(*[(F.col(f"n{k}") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1e-9) for k, p in enumerate(share)], F.lit(0.0))
    # P(word | class), smoothed towards its share in all of the sample, against that share
    overall = F.col("n") / F.lit(float(total))
    here = [(F.col(f"n{k}") + 2 * overall) / (s + 2) for k, s in enumerate(sizes)]
    told = [F.log(p / overall).alias(f"p{k}") for k, p in enumerate(here)]
    untold = [F.log((1 - p) / (1 - overall)).alias(f"a{k}") for k, p in enumerate(here)]
    ks = range(len(classes))
    strong = counts.withColumn("z", z).where(F.col("z") > TELLING).select("key", "z", *told, *untold).where(F.greatest(*[F.col(f"p{k}") for k in ks]) >= LEAST_WEIGHT)
    # a word that is there takes back what its absence would have said
    table = cut(strong.select("key", *[(F.col(f"p{k}") - F.col(f"a{k}")).alias(f"w{k}") for k in ks], *[f"a{k}" for k in ks]))
    *absent, n = table.agg(*[F.coalesce(F.sum(f"a{k}"), F.lit(0.0)).alias(f"a{k}") for k in ks], F.count("*").alias("n")).first()
    return Evidence(classes, share, table.select("key", *[f"w{k}" for k in ks]), absent, n)


def weigh(docs: DataFrame, model: Evidence, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, n_tokens and e0..: evidence sums by class, of every row.

    Sums are taken once for each distinct text; the model is broadcast if it is small.
    Null and empty texts have no evidence.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = [F.xxhash64("text").alias("text_hash"), F.length("text").alias("n_chars")]
    texts = docs.select(text.alias("text"))
    ks = range(len(model.classes))
    every = docs.sparkSession.range(1).select(F.xxhash64(F.lit(_EVERY)).alias("key"), *[F.lit(0.0).alias(f"w{k}") for k in ks])
    # words are exploded and looked up in generated code; only known ones go on
    own = ["text_hash", "n_chars", "n_tokens", "sign"]
    exploded = signed(texts, key).select(*own, F.explode("words").alias("word")).select(*own, F.xxhash64("word").alias("key"))
    known = exploded.join(model.sent(model.table.unionByName(every)), "key").groupBy(*own, "key").agg(*[F.first(f"w{k}").alias(f"w{k}") for k in ks])
    by_word = known.groupBy(*own).agg(*[F.sum(f"w{k}").alias(f"s{k}") for k in ks])
    told = by_word.join(model.sent(model.table), by_word.sign == model.table.key, "left").select("text_hash", "n_chars", "n_tokens", *[(F.col(f"s{k}") + F.coalesce(f"w{k}", F.lit(0.0))).alias(f"e{k}") for k in ks])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *keep, text.alias("text")).select("doc_id", *keep, *key)
    return rows.join(told, ["text_hash", "n_chars"]).select("doc_id", *keep, "n_tokens", *[F.when(F.col("n_tokens") > 0, F.coalesce(f"e{k}", F.lit(0.0)) + x).otherwise(0.0).alias(f"e{k}") for k, x in enumerate(model.without)])


def posteriors(weighed: DataFrame, model: Evidence) -> list[F.Column]:
    """Class probabilities of a row of weigh()."""
    logits = [F.lit(float(math.log(p))) + DAMPING * F.col(f"e{k}") for k, p in enumerate(model.priors)]
    top = F.greatest(*logits, F.lit(-1e300))
    parts = [F.exp(x - top) for x in logits]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]
