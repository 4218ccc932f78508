"""The windowed operators over an endless table of detections; `ts` must be a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timebin_counts(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(uid, start, n, value): sightings per individual and bin; rows later than `late` are left out."""
    bins = stream.withWatermark("ts", late).groupBy("uid", F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return bins.select("uid", F.col("window.start").alias("start"), "n", "value")


def stays(stream: DataFrame, gap: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """(uid, start, end, n): runs of sightings without a gap of `gap`; between two lies a trip."""
    runs = stream.withWatermark("ts", late).groupBy("uid", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return runs.select("uid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_detections(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One detection per individual and instant, the first to arrive."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["uid", "ts"])
