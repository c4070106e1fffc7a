"""Grading as it happens: a stream of spots joined with a stream of reports inside the window, and rollups by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_counts(spots: DataFrame, reports: DataFrame, window: str, late: str) -> DataFrame:
    """spots (spot_id, call, ts, band) against reports (call, r_ts, r_band): a row per spot with same-band and other-band counts.

    An outer interval join of two watermarked streams: a spot without reports comes out once its window has closed for good.
    """
    left = spots.withWatermark("ts", late)
    right = reports.withColumnRenamed("call", "r_call").withWatermark("r_ts", late)
    span = F.expr(f"call = r_call AND r_ts BETWEEN ts - INTERVAL {window} AND ts + INTERVAL {window}")
    pairs = left.join(right, span, "left_outer")
    same = F.col("band") == F.col("r_band")
    return pairs.groupBy(F.window("ts", window), "spot_id", "call").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("other"))


def activity(spots: DataFrame, every: str, late: str) -> DataFrame:
    """Spots and distinct calls (estimated, so that state stays small) per band and tumbling window."""
    rows = spots.withWatermark("ts", late).groupBy(F.window("ts", every), "band")
    return rows.agg(F.count("*").alias("spots"), F.approx_count_distinct("call").alias("calls")).select("window.start", "window.end", "band", "spots", "calls")


def sessions(spots: DataFrame, gap: str, late: str) -> DataFrame:
    """Activity sessions of each call: start, end, n."""
    rows = spots.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "call")
    return rows.agg(F.count("*").alias("n")).select("call", "session_window.start", "session_window.end", "n")
