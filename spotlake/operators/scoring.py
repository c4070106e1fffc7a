"""Scores of runs against truth: stations, floors, builds, slots, segments, and what a text leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.numeric import quotient
from spotlake.operators.joins import band_join, overlap_join


def station_scores(stations: DataFrame, spots: DataFrame, match: float) -> tuple[DataFrame, DataFrame]:
    """stations (s_id, call, freq, cer) against spots (call, s_freq, trial, snr): a row per station, and the spots that match none (bogus)."""
    pairs = band_join(stations, spots, ["call"], "freq", "s_freq", match)
    heard = pairs.groupBy("s_id").agg(F.count("*").alias("spots"), F.avg("snr").alias("snr"))
    per_station = stations.join(heard, "s_id", "left").withColumn("spotted", F.col("spots").isNotNull())
    known = stations.select(F.col("call").alias("call"), F.col("freq").alias("freq"))
    bogus = band_join(spots, known.withColumnRenamed("freq", "k_freq"), ["call"], "s_freq", "k_freq", match, "left_anti")
    return per_station, bogus


def point_summary(per_station: DataFrame, bogus: DataFrame, point: str) -> DataFrame:
    """Per point: stations, spotted, mean character error rate (1 where none), good copies (under 0.1), mean SNR, bogus calls (distinct per trial, then summed)."""
    rate = F.coalesce(F.col("cer"), F.lit(1.0))
    scored = per_station.groupBy(point).agg(
        F.count("*").alias("stations"), F.count_if("spotted").alias("spotted"), F.round(F.avg(rate), 6).alias("cer_mean"), F.count_if(rate < 0.1).alias("good"), F.round(F.avg("snr"), 6).alias("spot_snr")
    )
    false = bogus.groupBy(point, "trial").agg(F.countDistinct("call").alias("n")).groupBy(point).agg(F.sum("n").alias("bogus"))
    return scored.join(false, point, "left").withColumn("bogus", F.coalesce("bogus", F.lit(0)))


def against_floors(metrics: DataFrame, floors: DataFrame, key: str, names: list[str]) -> DataFrame:
    """metrics beside their floors (min_<name>, null for none): failed (names in order) and passed."""
    failed = F.concat_ws(",", *[F.when(F.col(n) < F.col(f"min_{n}"), F.lit(n)) for n in names])
    return metrics.join(floors, key).withColumn("failed", failed).withColumn("passed", F.col("failed") == "")


def build_summary(runs: DataFrame, variant: str, value: str) -> DataFrame:
    """Per variant: min, median, spread (max over min; infinite where that is 0) of repeated runs, and its place by median."""
    out = runs.groupBy(variant).agg(F.min(value).alias("low"), F.round(F.median(value), 6).alias("median"), F.round(quotient(F.max(value), F.min(value)), 6).alias("spread"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("median", variant)))  # a row per variant


def segments(passbands: DataFrame, allocations: DataFrame, width: float) -> DataFrame:
    """(p_id, low, high) cut to the allocations (a_low, a_high) that it overlaps; one that overlaps none stays as it is. width: about a passband's."""
    cut = overlap_join(passbands, allocations, ("low", "high"), ("a_low", "a_high"), width).select("p_id", F.greatest("low", "a_low").alias("low"), F.least("high", "a_high").alias("high"))
    return cut.unionByName(passbands.join(cut.select("p_id").distinct(), "p_id", "left_anti").select("p_id", "low", "high"))


def slots(rows: DataFrame, at: str, slot_us: int, need: int) -> DataFrame:
    """Per aligned slot: rows and whether it is complete (at least `need` rows)."""
    grouped = rows.groupBy(F.floor(F.col(at) / slot_us).alias("slot"))
    return grouped.agg(F.count("*").alias("n")).withColumn("complete", F.col("n") >= need)


def text_tails(parts: DataFrame, keys: list[str], order: str, text: str, size: int) -> DataFrame:
    """Per key the last `size` characters of its parts in order. Only the newest parts that these can come from are gathered."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(text)).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__after", F.coalesce(F.sum(F.length(text) + 1).over(newest), F.lit(0))).where(F.col("__after") <= size)
    joined = F.array_join(F.sort_array(F.collect_list(F.struct(order, text)))[text], " ")
    return parts.groupBy(*keys).agg(joined.alias("__t")).select(*keys, F.when(F.length("__t") > size, F.substring("__t", -size, size)).otherwise(F.col("__t")).alias("tail"))


def best_references(candidates: DataFrame, key: str, distance: str, tie: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(distance, tie))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= n)
