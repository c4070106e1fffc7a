"""Countries of calls: exact aliases, longest prefixes, entity numbers and the geography of a spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.text import is_portable

#: Entity number, continent and zone of an unknown place, and the number of a call outside every entity.
UNKNOWN_ENTITY, UNKNOWN_CONTINENT, UNKNOWN_ZONE, NO_ENTITY = -1, "", 0, 0


def tidy_aliases(aliases: DataFrame, order: str) -> DataFrame:
    """One row per prefix: of starred ones (sub-entities) the last by `order`, else the first."""
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("starred"), F.when(F.col("starred"), -F.col(order)).otherwise(F.col(order))))
    return aliases.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def base_length(call: Column) -> Column:
    """Characters before a valid portable suffix, else of the whole call."""
    size = F.length(F.substring_index(call, "/", 1))
    suffix = F.substring(call, size + 2, F.length(call))
    return F.when(F.contains(call, F.lit("/")) & is_portable(suffix), size).otherwise(F.length(call))


def country_of(calls: DataFrame, aliases: DataFrame, call: str, carried: list[str]) -> DataFrame:
    """calls with the carried columns of the longest alias (prefix, exact) that each starts with, null if none.

    An exact alias counts only for the whole call or for its part before a portable suffix. Distinct calls are exploded into their
    prefixes, a few rows each, and meet the aliases by an equi-join.
    """
    folded = F.upper(F.col(call))
    parts = calls.select(folded.alias("__call")).distinct().where(F.length("__call") > 0)
    parts = parts.withColumn("__n", F.explode(F.sequence(F.lit(1), F.length("__call")))).withColumn("prefix", F.substring("__call", F.lit(1), F.col("__n")))
    whole = F.col("__n").isin(F.length("__call"), base_length(F.col("__call")))
    met = parts.join(aliases.select("prefix", "exact", F.struct(*carried).alias("__value")), "prefix").where(~F.col("exact") | whole)
    best = met.groupBy("__call").agg(F.max_by("__value", "__n").alias("__value"))
    joined = calls.withColumn("__call", folded).join(best, "__call", "left")
    return joined.select(*[F.col(f"`{c}`") for c in calls.columns], *[F.col(f"__value.{c}").alias(c) for c in carried])


def geography(calls: DataFrame, aliases: DataFrame, call: str) -> DataFrame:
    """calls with dxcc, continent and zone. Calls at sea or in the air (/MM, /AM) are outside every entity; those without a country are unknown."""
    found = country_of(calls, aliases, call, ["dxcc", "continent", "zone"])
    outside = F.upper(F.substring_index(F.col(call), "/", -1)).isin("MM", "AM") & F.contains(F.col(call), F.lit("/"))
    return (
        found.withColumn("dxcc", F.when(outside, NO_ENTITY).otherwise(F.coalesce("dxcc", F.lit(UNKNOWN_ENTITY))).cast("long"))
        .withColumn("continent", F.when(outside, UNKNOWN_CONTINENT).otherwise(F.coalesce("continent", F.lit(UNKNOWN_CONTINENT))))
        .withColumn("zone", F.when(outside, UNKNOWN_ZONE).otherwise(F.coalesce("zone", F.lit(UNKNOWN_ZONE))).cast("int"))
    )
