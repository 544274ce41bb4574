"""Quartile bucket digests: locality-sensitive fingerprints of whole texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .kernels import mix

BUCKETS = 256
#: Differences from this on count as nothing in common.
FARTHEST = 512
#: Difference of two quartile codes that are 0, 1, 2, 3 apart.
_APART = np.array([0, 1, 2, 6])
_TABLES = [(mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (k + 1))) & np.uint64(BUCKETS - 1)).astype(np.uint8) for k in range(6)]
#: Byte places of the triplets in a window of WIDTH; wide ones tell texts of one language apart better.
_TRIPLETS, WIDTH = ((0, 4, 9), (0, 7, 13)), 14


def codes(raw: bytes) -> tuple[np.ndarray, int]:
    """Quartile code (0 to 3) of each bucket of hashed byte triplets, and the length code."""
    data = np.frombuffer(raw, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data) - WIDTH + 1
    if n > 0:
        for k, places in enumerate(_TRIPLETS):
            bucket = _TABLES[3 * k][data[places[0] : places[0] + n]] ^ _TABLES[3 * k + 1][data[places[1] : places[1] + n]] ^ _TABLES[3 * k + 2][data[places[2] : places[2] + n]]
            counts += np.bincount(bucket, minlength=BUCKETS)
    elif len(data):
        counts += np.bincount(_TABLES[0][data], minlength=BUCKETS)
    ranked = np.sort(counts)
    quartiles = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8), min(255, round(math.log(len(data) + 1, 1.1)))


def text_form(code: tuple[np.ndarray, int]) -> str:
    """The fingerprint as text: two hex digits of length, then two bits a bucket."""
    quads = code[0].reshape(-1, 4)
    return f"{code[1]:02x}" + (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8).tobytes().hex()


def parse(fingerprint: str) -> tuple[np.ndarray, int]:
    raw = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], 1).ravel(), int(fingerprint[:2], 16)


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """1 for equal codes, 0 from FARTHEST on; length steps of ten per cent count one, 32 at most."""
    apart = int(_APART[np.abs(a[0].astype(np.int8) - b[0].astype(np.int8))].sum()) + min(32, abs(a[1] - b[1]))
    return 1 - min(apart, FARTHEST) / FARTHEST


def edited(text: str, following: str) -> str:
    """The last half of text, rounded down, replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, halo, descending id); each is compared with the row after it in its part."""
    held = None
    for batch in batches:
        parts, halos, ids, texts = (batch.column(k).to_pylist() for k in range(4))
        out = []
        for part, halo, doc_id, text in zip(parts, halos, ids, texts):
            code = codes(text.encode())
            if held is not None and held[0] == part:
                _, doc, before, own = held
                changed = edited(before, text)
                raw = changed.encode()
                new = codes(raw)
                out.append((doc, len(before), hashlib.sha256(raw).hexdigest(), text_form(own), text_form(new), likeness(own, new), likeness(own, code)))
            # after a halo row comes nothing of its part
            held = None if halo else (part, doc_id, text, code)
        if out:
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=list(names))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.record_batch([batch.column(0), pa.array([text_form(codes((t or "").encode())) for t in texts], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null text counts as empty, equal texts get equal fingerprints."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def neighbour_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, with both likenesses.

    The next document is the one with the next smaller doc_id, after the smallest the
    largest; repeated ids follow each other in the order of their texts' hashes, rows
    without an id come last.  Ids are cut into ranges by percentiles; each range also
    gets the first row of the range below it, so the texts move once and no task
    needs more than two of them at a time.  A single row is its own next one.
    """
    source = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = partitions(docs)
    steps = [k / n for k in range(1, n)]
    cuts = sorted(set(source.agg(F.percentile_approx("key", steps or [0.5], 10000).alias("q")).first()["q"] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key"))).cast("int") if cuts else F.lit(0)
    parted = source.withColumn("part", part)
    tops = sorted((r["part"], r["top"]) for r in parted.select("part", "key").groupBy("part").agg(F.max("key").alias("top")).collect())
    if not tops:
        return parted.select("part", F.lit(False).alias("halo"), "doc_id", "text").mapInArrow(_compared, _SCHEMA)
    # the top of each range also goes to the range above; the largest of all to the lowest
    above = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    halo_of = docs.sparkSession.createDataFrame(above, "key long, onward int")
    placed = parted.join(F.broadcast(halo_of), "key", "left").withColumn(
        "place", F.explode(F.when(F.col("onward").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("halo")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("halo")), F.struct(F.col("onward").alias("part"), F.lit(True).alias("halo")))))
    )
    rows = placed.select(F.col("place.part").alias("part"), F.col("place.halo").alias("halo"), "key", "doc_id", "text")
    ordered = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "halo", F.desc("key"), F.xxhash64("text"))
    return ordered.select("part", "halo", "doc_id", "text").mapInArrow(_compared, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
