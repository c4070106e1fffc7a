"""Operators over spectra: rows of (hop, channel, power), as windows and grouped aggregates.

A frame of rows along a channel is never taken over the whole channel: framed() cuts channels into parts of PART rows, each with the
rows before and after it that its frames reach into, so there are as many tasks as parts, and a part has a bounded size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.functions.numeric import parabolic_offset
from spotlake.operators.temporal import by

#: Pushes held, dB per bin, lowest bin, quantile, channels in a block, dB above the block floor.
RING, BIN_DB, LOWEST_DB, QUANTILE, BLOCK, ABOVE_BLOCK_DB = 250, 0.5, -140.0, 0.25, 32, 3.0


def long_form(df: DataFrame, hop: str, values: str) -> DataFrame:
    """One row per hop and channel."""
    return df.select(F.col(hop).alias("hop"), F.posexplode(values).alias("channel", "power"))


#: Rows of a channel in a part.
PART = 1024


def framed(rows: DataFrame, keys: list[str], order: str, before: int, after: int = 0, width: int = PART) -> DataFrame:
    """rows with part and own: each row in its part (own), and in the next or last one too if their frames reach it.

    Places along a key are counted per stretch of the order first and added up over stretches, so no task numbers a whole key.
    """
    width = max(width, before, after)
    stretched = rows.withColumn("__stretch", F.floor(F.col(order) / width))
    counts = stretched.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(by(keys, "__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "__stretch", base.alias("__base"))
    placed = stretched.join(counts, [*keys, "__stretch"])
    placed = placed.withColumn("__at", F.col("__base") + F.row_number().over(by([*keys, "__stretch"], order)) - 1)
    part, inside = F.floor(F.col("__at") / width), F.col("__at") % width
    copy = lambda p, own: F.struct(p.cast("long").alias("part"), F.lit(own).alias("own"))
    copies = F.array(copy(part, True), F.when(inside >= width - before, copy(part + 1, False)), F.when(inside < after, copy(part - 1, False)))
    spread = placed.withColumn("__c", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    return spread.select(*rows.columns, F.col("__c.part").alias("part"), F.col("__c.own").alias("own"))


def sliding_quantile(rows: DataFrame, keys: list[str], order: str, value: str, ring: int, q: float, out: str) -> DataFrame:
    """rows with the value (a long) at rank max(ceil(q n), 1) of the last `ring` rows of a key, itself included."""
    names = rows.columns

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.sort_by(order)
        values = table.column(value).to_numpy()
        # rows before the first are taken as larger than any, which leaves ranks of short frames as they are
        padded = np.concatenate([np.full(ring - 1, np.iinfo(np.int64).max), values])
        held = np.sort(np.lib.stride_tricks.sliding_window_view(padded, ring), axis=1)
        sizes = np.minimum(np.arange(1, len(values) + 1), ring)
        found = held[np.arange(len(values)), np.maximum(np.ceil(q * sizes).astype(int), 1) - 1]
        return table.append_column(out, pa.array(found)).filter(table.column("own")).select([*names, out])

    schema = T.StructType([*rows.schema.fields]).add(out, "long")
    return framed(rows, keys, order, ring - 1).groupBy(*keys, "part").applyInArrow(run, schema)


def channel_floor(rows: DataFrame, ring: int = RING) -> DataFrame:
    """rows (hop, channel, db) with floor_db: centre of the bin at the lower quartile of the last `ring` pushes of the channel."""
    bin_of = F.least(F.greatest(F.floor((F.col("db") - LOWEST_DB) / BIN_DB), F.lit(0)), F.lit(279)).cast("long")
    found = sliding_quantile(rows.withColumn("__bin", bin_of), ["channel"], "hop", "__bin", ring, QUANTILE, "__low")
    return found.withColumn("floor_db", LOWEST_DB + BIN_DB * (F.col("__low") + 0.5)).drop("__bin", "__low")


def block_floor(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per hop and block of channels the median of floor_db."""
    return rows.groupBy("hop", F.floor(F.col("channel") / block).alias("block")).agg(F.median("floor_db").alias("block_db"))


def effective_floor(rows: DataFrame, block: int = BLOCK, above: float = ABOVE_BLOCK_DB) -> DataFrame:
    """rows with effective_db: the channel's floor, but no more than `above` over its block's; one window, no join."""
    w = Window.partitionBy("hop", F.floor(F.col("channel") / block))
    return rows.withColumn("effective_db", F.least("floor_db", F.median("floor_db").over(w) + above))


def two_look_rise(rows: DataFrame, m: int, threshold: float) -> DataFrame:
    """rows with rise: both of two adjacent windows of m hops sum to m times the threshold at least; false until both are full."""
    order = by(["channel", "part"], "hop")
    recent, before = order.rowsBetween(-(m - 1), 0), order.rowsBetween(-(2 * m - 1), -m)
    full = F.count("power").over(before) == m
    return _own(framed(rows, ["channel"], "hop", 2 * m - 1), "rise", full & (F.sum("power").over(recent) >= m * threshold) & (F.sum("power").over(before) >= m * threshold))


def _own(parts: DataFrame, out: str, value) -> DataFrame:
    return parts.withColumn(out, value).where("own").drop("part", "own")


def local_peaks(rows: DataFrame, n_channels: int, reach: int = 2) -> DataFrame:
    """rows with peak (no larger channel within `reach`, around the circle) and offset (of the parabola through its neighbours)."""
    wrapped = rows.select("hop", "channel", "power", F.lit(True).alias("own"))
    low = rows.where(F.col("channel") < reach).select("hop", (F.col("channel") + n_channels).alias("channel"), "power", F.lit(False).alias("own"))
    high = rows.where(F.col("channel") >= n_channels - reach).select("hop", (F.col("channel") - n_channels).alias("channel"), "power", F.lit(False).alias("own"))
    order = by(["hop"], "channel")
    around = order.rowsBetween(-reach, reach)
    marked = wrapped.unionByName(low).unionByName(high)
    marked = marked.withColumn("peak", F.col("power") >= F.max("power").over(around))
    marked = marked.withColumn("offset", parabolic_offset(F.lag("power").over(order), F.col("power"), F.lead("power").over(order)))
    return marked.where("own").drop("own")


def running_minimum(rows: DataFrame, width: int) -> DataFrame:
    return _own(framed(rows, ["channel"], "hop", width - 1), "noise", F.min("power").over(by(["channel", "part"], "hop").rowsBetween(-(width - 1), 0)))


def centred_maximum(rows: DataFrame, reach: int) -> DataFrame:
    return _own(framed(rows, ["channel"], "hop", reach, reach), "mark", F.max("power").over(by(["channel", "part"], "hop").rowsBetween(-reach, reach)))


def pair_correlation(rows: DataFrame, lags: list[int], block: int) -> DataFrame:
    """Per block of hops, channel and lag the correlation of the channel with the one `lag` above, over whole blocks.

    Each row is listed once per partner instead of joining the spectrum with itself: (hop, pair) rows meet by grouping.
    """
    pairs = F.explode(F.flatten(F.array(*[F.array(F.struct(F.col("channel").alias("low"), F.lit(d).alias("lag"), F.lit(0).alias("side")), F.struct((F.col("channel") - d).alias("low"), F.lit(d).alias("lag"), F.lit(1).alias("side"))) for d in lags])))
    sides = rows.withColumn("p", pairs).groupBy("hop", "p.low", "p.lag")
    both = sides.agg(F.max(F.when(F.col("p.side") == 0, F.col("power"))).alias("x"), F.max(F.when(F.col("p.side") == 1, F.col("power"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy(F.floor(F.col("hop") / block).alias("block"), "low", "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))


def crash_lift(rows: DataFrame) -> DataFrame:
    """Per hop the power at rank floor(n / 4), ascending and without interpolation."""
    ordered = F.sort_array(F.collect_list("power"))
    return rows.groupBy("hop").agg(ordered.alias("p")).select("hop", F.get("p", F.floor(F.size("p") / 4).cast("int")).alias("lift"))


def band_rollup(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Per band of channels: channels, median power, share of rows at or above the threshold, peak."""
    return rows.groupBy(F.floor(F.col("channel") / width).alias("band")).agg(
        F.countDistinct("channel").alias("channels"), F.round(F.median("power"), 6).alias("median_power"), F.avg((F.col("power") >= threshold).cast("double")).alias("occupancy"), F.max("power").alias("peak")
    )
