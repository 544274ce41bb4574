"""URL filters: a sort-merge range join of page keys with the intervals of nested rules."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_array, partitions

#: The production rules (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Keys that are looked at for each range's boundary.
SAMPLED = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z folded) and path of a URL; both empty if it is null or has no ://."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: F.Column) -> F.Column:
    """Labels in reverse, each ended by a dot: a host's subdomains are the keys that begin with its own."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (part, key, rules first): a stack holds the rules whose host interval is open."""
    part, stack = None, []
    for batch in batches:
        cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names) if n != "part"}
        parts = column_array(batch, "part")
        out = []
        for k in range(batch.num_rows):
            if parts[k] != part:
                part, stack = parts[k], []
            key = cols["key"][k]
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            path = cols["path"][k]
            if cols["is_page"][k]:
                # nearer hosts are longer and stand later; of one host the longest path wins
                best = None
                for own, named, rules in reversed(stack):
                    for where, verdict in rules:
                        if path.startswith(where):
                            length = len(named) + len(where)
                            if best is None or length > best[0]:
                                best = length, named + where, verdict
                out.append((cols["page_id"][k], cols["host"][k], path, best and best[1], best and best[2]))
            else:
                if not stack or stack[-1][0] != key:
                    stack.append((key, cols["host"][k], []))
                if (path, cols["verdict"][k]) not in stack[-1][2]:
                    bisect.insort(stack[-1][2], (path, cols["verdict"][k]), key=lambda r: (-len(r[0]), r[1] != "block"))
        if out:
            names = ("page_id", "host", "path", "rule", "verdict")
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(names))


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule (host + path, null if none fits), verdict (allow or block).

    rules has verdict, host and path; a rule fits its host and all subdomains if the
    URL's path starts with its own.  The longest rule wins, block before allow among
    equal ones; without a rule the verdict is `otherwise`.  Null URLs and such without
    :// have an empty host, which only a rule with an empty host fits.  Rules with a null host or path
    read them as empty.  Repeated pages and rules change nothing.

    Page keys are cut into ranges; a key that fills several ranges alone is dealt among
    them.  A rule goes to every range that its interval of keys meets, so each task
    sweeps its range once, with one stack.
    """
    host, path = host_and_path(F.col(url_column))
    source = pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    source = source.withColumn("key", host_key(F.col("host")))
    n = partitions(pages)
    cuts = _range_cuts(source, n)
    fixed = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("array()").cast("array<string>")
    low = F.size(F.filter(fixed, lambda c: c < F.col("key")))
    high = F.size(F.filter(fixed, lambda c: c <= F.col("key")))
    # a key that is a boundary several times over may be in any of the ranges between
    dealt = (low + F.pmod(F.xxhash64("page_id", "path"), (high - low + 1).cast("long"))).cast("int")
    keyed = rules.select("verdict", F.coalesce(F.translate("host", _UPPER, _LOWER), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    keyed = keyed.where("verdict in ('allow', 'block')").withColumn("key", host_key(F.col("host")))
    end = F.size(F.filter(fixed, lambda c: (c <= F.col("key")) | F.startswith(c, F.col("key"))))
    spread = keyed.withColumn("part", F.explode(F.sequence(low.cast("int"), end.cast("int"))))
    rows = source.select(dealt.alias("part"), "key", F.lit(True).alias("is_page"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        spread.select("part", "key", F.lit(False).alias("is_page"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    )
    ordered = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "key", "is_page")
    swept = ordered.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.select(F.col("page_id").alias(id_column), "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def _range_cuts(source: DataFrame, n: int) -> list[str]:
    """n - 1 keys that cut the rows into even ranges; a boundary repeats if its key fills more than one.

    They come from SAMPLED keys a range, as in Spark's own range partitioning; where the
    cuts lie decides who does the work, not the result.
    """
    keys = sorted(r["key"].encode() for r in source.orderBy(F.xxhash64("page_id", "host", "path")).limit(SAMPLED * n).select("key").collect())
    return [keys[k * len(keys) // n].decode() for k in range(1, n)] if keys else []
