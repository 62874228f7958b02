"""Streams of session events: counts in windows, what was shown already, savings.  An extension: the batch forms are in operators.stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no farther apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def fresh(shown: DataFrame, late: str = "1 day") -> DataFrame:
    """The first showing of each path, line and state of its file (mtime): a changed file is new again."""
    return shown.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "line", "mtime"])


def savings(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Baseline and saved tokens in windows."""
    saved = F.greatest(F.col("baseline") - F.col("shown"), F.lit(0))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.sum("baseline").alias("baseline"), F.sum(saved).alias("saved"))
