"""Quality rules: fixed per-text checks, then the frequency of lines across a host's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, let

#: The base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW, SYMBOLS = 10, 20, 5, "#*$%&|<>"
#: A line goes if more than LINE_DOCS documents of its host, and more than LINE_PERCENT of them, hold it.
LINE_DOCS, LINE_PERCENT = 10, 2
#: A document is depleted if its removed lines had more than this part of its words.
LOST_PERCENT = 70
#: Removed lines are broadcast up to so many (about 2 MB), joined by a shuffle in SALTS parts beyond.
BROADCAST_LINES, SALTS = 50_000, 16
_GAPS = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: F.Column) -> F.Column:
    """The words of a text that is not null: runs of other than the six gaps."""
    inner = F.btrim(text, F.lit(WORD_GAP))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAPS))


def repeated_words(listed: F.Column, width: int = WINDOW) -> F.Column:
    """Words inside a width-word window that the list holds twice or more."""

    def covered(ranked: F.Column) -> F.Column:
        size = F.size(ranked)
        same = lambda i, j: F.get(ranked, i)["h"] == F.get(ranked, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda i: F.get(ranked, i)["p"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(width), p - acc["last"])).alias("sum"))
        return F.aggregate(places, start, step)["sum"]

    def counted(hashes: F.Column) -> F.Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ranked, covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(listed) - (width - 1)), lambda i: F.xxhash64(F.slice(listed, i, width)))
    return F.when(F.size(listed) < width, 0).otherwise(let(windows, counted))


def normalised(line: F.Column) -> F.Column:
    """A line without outer gaps, inner gaps as one space, A-Z folded."""
    return F.translate(F.regexp_replace(F.btrim(line, F.lit(WORD_GAP)), _GAPS, " "), _UPPER, _LOWER)


def measures(docs: DataFrame, host_column: str, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Per row a number, the base counts, the text's hash and its normalised lines as (hash, words)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    by_words = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    filled = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WORD_GAP)) != "")
    line = lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words(x)).alias("w"))
    by_lines = let(filled, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), F.transform(ls, line).alias("lines")))
    out = source.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n_chars"), *(["text"] if with_text else []),
        F.length(F.translate("text", WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        by_words.alias("of_words"), by_lines.alias("of_lines"),
    )
    return out.select(*out.columns[:-2], "of_words.*", "of_lines.*")


def quality_rules(docs: DataFrame, host_column: str = "source", id_column: str = "doc_id", text_column: str = "text", count: str = "documents", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_lost_words, kept.

    A text fails the base rules with fewer than LEAST_WORDS words or over
    MOST_REPEATED_PERCENT of them in repeated windows.  Of each host's documents those
    with a normalised line are counted; lines above both limits are removed, and a
    document that loses over LOST_PERCENT of its words so is not kept.  with_text adds
    kept_text, the text without the removed lines.  Documents are rows with words; rows
    that repeat an id with its text are one.  count "texts" counts equal texts of a host once.

    Null text has no words and fails; a null host is a host of its own, the
    empty name; one row comes out for each row, repeated ids and null ids included.
    """
    # the numbers of the rows are fixed by the checkpoint
    facts = cut(measures(docs, host_column, id_column, text_column, with_text))
    key = ["host", "text_hash", "n_chars"] + {"documents": ["doc_id"], "texts": []}[count]
    counted = facts.where("n_words > 0").groupBy(*key).agg(F.first("lines").alias("lines"))
    hosts = counted.groupBy("host").agg(F.count("*").alias("documents"))
    counts = counted.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    # only lines over the absolute limit meet the hosts' sizes
    removed = cut(counts.where(F.col("n") > LINE_DOCS).join(hosts, "host").where(F.col("n") * 100 > F.col("documents") * LINE_PERCENT).select("host", "h"))
    lines = facts.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    if removed.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        hit = lines.join(F.broadcast(removed), ["host", "h"])
    else:
        parts = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(parts, ["host", "h", "salt"])
    gone = [F.collect_set("h").alias("gone")] if with_text else []
    lost = hit.groupBy("row").agg(F.count("*").alias("n_removed_lines"), F.sum("w").alias("n_lost_words"), *gone)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = facts.drop("lines").join(lost, "row", "left").withColumn("base_failed", failed)
    for name in ("n_removed_lines", "n_lost_words"):
        judged = judged.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (100 * F.col("n_lost_words") <= LOST_PERCENT * F.col("n_words"))
    stays = lambda x: (F.btrim(x, F.lit(WORD_GAP)) == "") | ~F.array_contains("gone", F.xxhash64(normalised(x)))
    text = [F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n")).alias("kept_text")] if with_text else []
    return judged.select(F.col("doc_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_lost_words", kept.alias("kept"), *text)
