"""Streaming: incremental term and event counts with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window of a stream (ts, event_type, value); state goes after `late`."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def term_totals(docs: DataFrame) -> DataFrame:
    """(term, n) over a stream of texts, for complete or update output."""
    return docs.select(F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
