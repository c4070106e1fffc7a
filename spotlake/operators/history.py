"""History of a stream of spots: newest, windows, retention, resumption, occurrence counts, and first failing checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, order: str, n: int, keep: Column | None = None) -> DataFrame:
    """The n newest rows that pass `keep`, oldest first. The filter comes before the limit, which Spark never does on its own."""
    rows = df if keep is None else df.where(keep)
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def within(df: DataFrame, at: str, now: int | Column, span: int) -> DataFrame:
    """Rows of the last `span` up to now; a span of 0 selects nothing."""
    return df.where(F.lit(span > 0) & (F.col(at) > now - span) & (F.col(at) <= now))


def occurrences(df: DataFrame, keys: list[str], order: str, out: str = "occurrence") -> DataFrame:
    """df with how often its key had occurred when the row came, itself included."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def retained(df: DataFrame, keys: list[str], order: str, at: str, now: int | Column, span: int, least: int, most: int) -> DataFrame:
    """Per key the `least` newest rows, and those of the last span, but never more than `most`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    ranked = df.withColumn("__rank", rank)
    return ranked.where((F.col("__rank") <= most) & ((F.col("__rank") <= least) | (F.col(at) >= now - span))).drop("__rank")


def resume_outcome(known_session: Column, since: Column, upto: Column, held_from: Column) -> Column:
    """no_request without a cursor, reset for another session or a cursor ahead, gap if rows after it are gone, else resumed."""
    return F.when(since.isNull(), "no_request").when(~known_session | (since > upto), "reset").when(since + 1 < held_from, "gap").otherwise("resumed")


def first_failing(checks: dict[str, Column]) -> Column:
    """Name of the first check that is true, in order; null if none is."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks.items()):
        reason = F.when(failed, name).otherwise(reason)
    return reason


def spot_filter(band: Column, snr: Column, kind: Column, bands: tuple[str, ...] = (), least_snr: float | None = None, only: str | None = None) -> Column:
    """A listener's filter: bands (any if none named), a least SNR, and a spot type."""
    keep = F.lit(True)
    if bands:
        keep = keep & band.isin(*bands)
    if least_snr is not None:
        keep = keep & (snr >= least_snr)
    if only is not None:
        keep = keep & (kind == only)
    return keep
