"""Session and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's bytes.split() and the contracts' word pattern agree on these six separators.
WORD_GAP = " \t\n\x0b\f\r"


#: Setting by which Spark drops a query's own shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; the result has no lineage to recompute.

    The shuffle files behind it are of no more use, so Spark is told to drop those of
    this one query; the session's setting is as before afterwards.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new frame, as a frame keeps the settings it was made with
    finally:
        spark.conf.set(_CLEANUP, before)


def unsized(df: DataFrame) -> DataFrame:
    """The checkpointed df without the size that Spark estimates for it.

    A checkpoint keeps the estimate of its plan, which is a product at every join: in a
    loop that joins its own result it is squared each round, to a number of many MB.
    """
    spark, rdd = df.sparkSession, df._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, df._jdf.schema(), False), spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the len+1 row offsets of a string column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends is not None and len(ends) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows with about limit bytes."""
    data, offsets = string_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def text_pieces(column: pa.Array, overlap: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, place in the row, bytes, offsets) as text_chunks; a row over limit comes in pieces.

    Each piece begins overlap bytes before the end of the one before it, so every run
    of overlap + 1 bytes lies in exactly one piece.
    """
    for a, b, data, offsets in text_chunks(column, limit):
        if len(data) <= 2 * limit:
            yield a, b, 0, data, offsets
            continue
        for place in range(0, max(1, len(data) - overlap), limit):
            piece = data[place : place + limit + overlap]
            yield a, b, place, piece, np.array([0, len(piece)], np.int64)


def column_array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Rows sorted by keys, re-cut so that a yielded piece ends where a group ends.

    Yields (columns, continues, unfinished).  A group over limit rows comes in
    pieces: all but its last are unfinished, all but its first continue; such a
    piece holds rows of that group alone.
    """
    held: list[dict[str, np.ndarray]] = []
    rows, continues = 0, False
    last: tuple | None = None

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        new = {n: column_array(batch, n) for n in batch.schema.names}
        differs = np.zeros(size, bool)
        for k in keys:
            differs[1:] |= new[k][1:] != new[k][:-1]
        differs[0] = last is not None and any(new[k][0] != v for k, v in zip(keys, last))
        last = tuple(new[k][-1] for k in keys)
        edges = np.flatnonzero(differs)
        at = 0
        if len(edges) and (continues or rows):
            at = int(edges[0]) if continues else int(edges[-1])
            if at:
                held.append({k: v[:at] for k, v in new.items()})
            if held:
                yield joined(), continues, False
            held, rows, continues = [], 0, False
            if at < (end := int(edges[-1])):
                yield {k: v[at:end] for k, v in new.items()}, False, False
                at = end
        elif len(edges):
            at = int(edges[-1])
            yield {k: v[:at] for k, v in new.items()}, False, False
        held.append({k: v[at:] for k, v in new.items()})
        rows += size - at
        if limit and rows > limit:
            yield joined(), continues, True
            held, rows, continues = [], 0, True
    if held:
        yield joined(), continues, False


def group_bounds(columns: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Start of each group of equal keys, and the number of rows at the end."""
    size = len(columns[keys[0]])
    differs = np.zeros(size, bool)
    for k in keys:
        differs[1:] |= columns[k][1:] != columns[k][:-1]
    return np.concatenate([[0], np.flatnonzero(differs), [size]]).astype(np.int64)


def let(value, body):
    """Bind value once inside a lambda, so that body may mention it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of the membership filter: 2 MB in 512 rows, whatever the number of members.
FILTER_BITS = 1 << 24
_BUCKET = 1 << 15


def probable_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among members; only rows that surely are not are left out.

    A bitmap of a fixed size is broadcast, so that a join that follows need not move
    the other rows.  With very many members it lets more through, never less.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bitmap = cut(
        members.select(place.alias("p"))
        .groupBy(F.floor(F.col("p") / _BUCKET).cast("int").alias("__bucket"))
        .agg(F.expr(f"bitmap_construct_agg(p % {_BUCKET})").alias("__bits"))
    )
    at = rows.withColumn("__p", place).withColumn("__bucket", F.floor(F.col("__p") / _BUCKET).cast("int"))
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast((__p % {_BUCKET}) / 8 as int) + 1, 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__p % 8 as int))")) != 0
    return at.join(F.broadcast(bitmap), "__bucket").where(hit).select(*rows.columns)
