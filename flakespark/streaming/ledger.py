"""Streaming forms of the ledger and the category counts: an extension, the batch operators' semantics on windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakespark.operators.ledger import priced


def windowed_costs(calls: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """calls, tokens and cost by window, model and component; rows later than `late` are dropped by the watermark."""
    timed = priced(calls.withWatermark(time, late)) if calls.isStreaming else priced(calls)
    return timed.groupBy(F.window(time, width).alias("w"), "model", "component").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model", "component", "calls", "tokens_in", "tokens_out", "cost")


def windowed_counts(rows: DataFrame, column: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(time, width).alias("w"), column).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), column, "n")
