"""A node beside a primary spotter and its corroborators: who confirms what, what was missed, and by how much readings differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.joins import band_join


def _near(left: DataFrame, right: DataFrame, time_tol: float, freq_tol: float, bin_width: float) -> DataFrame:
    """Pairs of one call within both tolerances whose frequencies round to the same bin or neighbouring ones."""
    pairs = band_join(left, right, ["call"], "t", "o_t", time_tol)
    bins = F.abs(F.bround(F.col("freq") / bin_width) - F.bround(F.col("o_freq") / bin_width))
    return pairs.where((F.abs(F.col("freq") - F.col("o_freq")) <= freq_tol) & (bins <= 1))


def _others(rows: DataFrame) -> DataFrame:
    return rows.select("call", F.col("id").alias("o_id"), F.col("t").alias("o_t"), F.col("freq").alias("o_freq"))


def outcomes(node: DataFrame, primary: DataFrame, corroborators: DataFrame, time_tol: float, freq_tol: float, bin_width: float) -> DataFrame:
    """(id, call, t, freq, and more) each -> node's columns with outcome (confirmed by the primary, corroborated by another, uncorroborated) and nearest_id of the primary, by time, then frequency, then id."""
    met = _near(node, _others(primary), time_tol, freq_tol, bin_width)
    place = F.struct(F.abs(F.col("t") - F.col("o_t")), F.abs(F.col("freq") - F.col("o_freq")), F.col("o_id"))
    nearest = met.groupBy("id").agg(F.min_by("o_id", place).alias("nearest_id"))
    others = _near(node, _others(corroborators), time_tol, freq_tol, bin_width).select("id", F.lit(True).alias("backed")).distinct()
    joined = node.join(nearest, "id", "left").join(others, "id", "left")
    outcome = F.when(F.col("nearest_id").isNotNull(), "confirmed").when(F.col("backed"), "corroborated").otherwise("uncorroborated")
    return joined.withColumn("outcome", outcome).drop("backed")


def heard(primary: DataFrame, node: DataFrame, time_tol: float, freq_tol: float, bin_width: float) -> DataFrame:
    """primary's columns with heard: whether the node has the spot too."""
    met = _near(primary, _others(node), time_tol, freq_tol, bin_width).select("id", F.lit(True).alias("heard")).distinct()
    return primary.join(met, "id", "left").withColumn("heard", F.coalesce("heard", F.lit(False)))


def table_by(outcomes_of_node: DataFrame, heard_of_primary: DataFrame, key: str) -> DataFrame:
    """Per key: node_spots, confirmed, corroborated, uncorroborated, primary_spots, primary_heard."""
    node = outcomes_of_node.groupBy(key).agg(F.count("*").alias("node_spots"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("confirmed", "corroborated", "uncorroborated")])
    primary = heard_of_primary.groupBy(key).agg(F.count("*").alias("primary_spots"), F.count_if("heard").alias("primary_heard"))
    return node.join(primary, key, "full").fillna(0, ["node_spots", "confirmed", "corroborated", "uncorroborated", "primary_spots", "primary_heard"])
