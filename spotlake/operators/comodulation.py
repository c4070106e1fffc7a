"""Bands whose channels rise and fall together: spans of correlated channels, and regions whose envelope breathes at the rate of speech.

Correlations of pairs of channels some way apart are matrix products over a window of hops: hops are dealt once over parts of sixteen steps, with the hops before that
the part's first windows hold, and a part is one small array. All else is joins and aggregates over windows and hot channels: counts of partners, runs of channels with many
of them; and for each run of hot channels the magnitudes of its summed envelope at slow and at fast rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spotlake.operators.graph import cut
from spotlake.operators.temporal import merge_intervals

# Hops of a window and between windows, least hops of the first, level of a hot channel (dB), distances of partners, correlation and partners that count.
WINDOW, EVERY, FIRST, HOT, NEAREST, FARTHEST, RHO, PARTNERS = 375, 75, 188, 6.0, 3, 30, 0.5, 4
# Width of a span, strong channels in it and how near to the strongest (dB), channels around it and guarding it, hops it holds; step from one channel of a run to the next.
WIDTH, STRONG, STRONG_DB, CONTEXT, GUARD, HOLD, GAP = 8, 4, 10.0, 2, 1, 1875, 2
# Speech: least hot channels, ratio and width of a region, and how near a second region may be; rates in whole cycles a window.
LEAST_HOT, RATIO, SPEECH_WIDTH, SPEECH_GAP, SLOW, FAST = 3, 2.2, 9, 30, range(1, 6), range(8, 31)

#: Steps between windows that a part of the hops is taken in.
STEPS = 16


def windows(hops: DataFrame, window: int = WINDOW, every: int = EVERY, first: int = FIRST) -> DataFrame:
    """hops (input, hop, channel, snr) -> the same with `at`, the number of hops that a window ends after, a row for each window that a hop is in; place: in its window, from 0.

    Hops are counted from 0. Windows end after every `every` hops once there are `first`, and hold the last `window` of them.
    """
    begin = (F.floor(F.col("hop") / every).cast("long") + 1) * every
    ends = F.filter(F.transform(F.sequence(F.lit(0), F.lit((window - 1) // every)), lambda i: begin + i * every), lambda at: (at > F.col("hop")) & (at <= F.col("hop") + window) & (at >= first))
    out = hops.withColumn("at", F.explode(ends))
    return out.withColumn("place", F.col("hop") - F.greatest(F.col("at") - window, F.lit(0)))


def _complete(held: DataFrame) -> DataFrame:
    """held without windows that the recording ends in, which no evaluation follows."""
    last = held.groupBy("input").agg((F.max("hop") + 1).alias("hops"))
    return held.join(last, "input").where("at <= hops").drop("hops")


def hot_channels(held: DataFrame) -> DataFrame:
    """(input, at, channel, mean, peak) of the hot channels of each window."""
    return held.groupBy("input", "at", "channel").agg(F.avg("snr").alias("mean"), F.max("snr").alias("peak")).where(F.col("mean") >= HOT)


def _partners(x, there):
    """For each channel (column) of a window how many NEAREST to FARTHEST away it correlates with. there: 1 where a value is; x is 0 elsewhere."""
    import numpy as np

    x = (x - x.sum(axis=0) / np.maximum(there.sum(axis=0), 1)) * there
    n, sums, squares = there.T @ there, x.T @ there, (x * x).T @ there
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - sums * sums / n
        # what rounding leaves of a constant channel is no spread
        spread[spread <= n * (1e-12 * np.abs(x).max(initial=0.0)) ** 2] = np.nan
        rho = (x.T @ x - sums * sums.T / n) / np.sqrt(spread * spread.T)
    return np.nan_to_num(rho, nan=-1.0) >= RHO


def evaluated(hops: DataFrame) -> DataFrame:
    """hops (input, hop, channel, snr) -> (input, at, channel, peak, partners) of all channels of each window: partners are the hot channels NEAREST to FARTHEST away that a hot channel correlates with (0 of one that isn't hot)."""
    size, halo = STEPS * EVERY, WINDOW - EVERY
    part = F.explode(F.sequence(F.floor(F.col("hop") / size).cast("long"), F.floor((F.col("hop") + halo) / size).cast("long")))
    sound = hops.where(F.col("input").isNotNull() & F.col("hop").isNotNull() & F.col("channel").isNotNull() & F.col("snr").isNotNull())
    rows = sound.select("input", part.alias("part"), F.col("hop").cast("long").alias("hop"), F.col("channel").cast("long").alias("channel"), F.col("snr").cast("double").alias("snr"))
    rows = rows.repartition("input", "part").sortWithinPartitions("input", "part")
    schema = T.StructType([rows.schema["input"], *T.StructType.fromDDL("at bigint, channel bigint, peak double, partners bigint").fields])
    arrow = to_arrow_schema(schema)

    def told(key: tuple, parts: list[tuple]) -> pa.RecordBatch:
        import numpy as np

        hop, channel, snr = (np.concatenate(c) for c in zip(*parts, strict=True))
        names, column = np.unique(channel, return_inverse=True)
        least = key[1] * size - halo
        x, there = np.zeros((size + halo, len(names))), np.zeros((size + halo, len(names)))
        x[hop - least, column], there[hop - least, column] = snr, 1.0
        away = np.abs(names[:, None] - names[None, :])
        away = (away >= NEAREST) & (away <= FARTHEST)
        out = []
        for at in range(key[1] * size + EVERY, (key[1] + 1) * size + 1, EVERY):
            if at < FIRST:
                continue
            held = slice(max(at - WINDOW, 0) - least, at - least)
            n = there[held].sum(axis=0)
            shown = n > 0
            if not shown.any():
                continue
            hot = np.flatnonzero(shown & (x[held].sum(axis=0) >= HOT * n))
            partners = np.zeros(len(names), np.int64)
            if len(hot):
                partners[hot] = (_partners(x[held][:, hot], there[held][:, hot]) & away[np.ix_(hot, hot)]).sum(axis=1)
            peak = np.where(there[held] > 0, x[held], -np.inf).max(axis=0)
            out.append((np.full(shown.sum(), at), names[shown], peak[shown], partners[shown]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(columns[0]), arrow[0].type), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            inputs = batch.column(0).dictionary_encode()
            marks = np.stack([inputs.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            values = [batch.column(i).to_numpy() for i in (2, 3, 4)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                found = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py())
                if found != key and parts:
                    yield told(key, parts)
                    parts = []
                key = found
                parts.append(tuple(v[lo:hi].copy() for v in values))
        if parts:
            yield told(key, parts)

    last = hops.groupBy("input").agg((F.max("hop") + 1).alias("hops"))
    return rows.mapInArrow(run, schema).join(last, "input").where("at <= hops").drop("hops")


def spans(hops: DataFrame) -> DataFrame:
    """hops (input, hop, channel, snr) -> input, at, first, last (with guards), until: spans of channels that are modulated together, by window; held until that hop."""
    held = cut(evaluated(hops))
    members = held.where(F.col("partners") >= PARTNERS).select("input", "at", F.col("channel").alias("first"), F.col("channel").alias("last"))
    wide = merge_intervals(members, ["input", "at"], "first", "last", GAP).where(F.col("last") - F.col("first") + 1 >= WIDTH).select("input", "at", "first", "last")
    peaks = held.select("input", "at", "channel", "peak")
    inside = wide.withColumn("channel", F.explode(F.sequence(F.col("first") - CONTEXT, F.col("last") + CONTEXT))).join(peaks, ["input", "at", "channel"])
    top = F.max("peak").over(Window.partitionBy("input", "at", "first"))
    strong = inside.withColumn("top", top).groupBy("input", "at", "first", "last").agg(F.count_if(F.col("peak") >= F.col("top") - STRONG_DB).alias("strong")).where(F.col("strong") >= STRONG)
    return strong.select("input", "at", (F.col("first") - GUARD).alias("first"), (F.col("last") + GUARD).alias("last"), (F.col("at") + HOLD).alias("until"))


def regions(held: DataFrame) -> DataFrame:
    """windows() -> input, at, first, last, hot, slow, fast, of each run of hot channels (steps of up to GAP): magnitudes of its envelope, the sum of its hot channels, at slow and fast rates.

    Only whole windows have the rates' whole cycles; others have no regions.
    """
    hot = hot_channels(held).where(F.col("at") >= WINDOW)
    runs = merge_intervals(hot.select("input", "at", F.col("channel").alias("first"), F.col("channel").alias("last")), ["input", "at"], "first", "last", GAP).withColumnRenamed("n", "hot")
    member = runs.withColumn("channel", F.explode(F.sequence("first", "last"))).join(hot.select("input", "at", "channel"), ["input", "at", "channel"], "left_semi")
    sums = member.join(held.select("input", "at", "channel", "place", "snr"), ["input", "at", "channel"]).groupBy("input", "at", "first", "last", "hot", "place").agg(F.sum("snr").alias("x"))
    rates = F.array(*[F.lit(k) for k in (*SLOW, *FAST)])
    turned = sums.withColumn("k", F.explode(rates)).withColumn("w", F.col("k") * F.col("place") * (2 * 3.141592653589793 / WINDOW))
    bins = turned.groupBy("input", "at", "first", "last", "hot", "k").agg(F.sqrt(F.pow(F.sum(F.col("x") * F.cos("w")), F.lit(2)) + F.pow(F.sum(F.col("x") * F.sin("w")), F.lit(2))).alias("size"))
    part = lambda ks: F.sum(F.when(F.col("k").between(ks[0], ks[-1]), F.col("size")).otherwise(0.0))
    return bins.groupBy("input", "at", "first", "last", "hot").agg(part(SLOW).alias("slow"), part(FAST).alias("fast"))


def ratio() -> Column:
    return F.col("slow") / F.greatest(F.col("fast"), F.lit(1e-12))


def speech_bands(hops: DataFrame) -> DataFrame:
    """hops -> input, at, first, last (with guards), until: regions shaped like speech that are wide, or have another such region near that breathes with them."""
    held = _complete(windows(hops))
    shaped = regions(held).where((F.col("hot") >= LEAST_HOT) & (ratio() >= RATIO)).select("input", "at", "first", "last")
    channels = shaped.withColumn("channel", F.explode(F.sequence("first", "last"))).join(hot_channels(held).select("input", "at", "channel"), ["input", "at", "channel"], "left_semi")
    sums = channels.join(held.select("input", "at", "channel", "place", "snr"), ["input", "at", "channel"]).groupBy("input", "at", "first", "last", "place").agg(F.sum("snr").alias("x"))
    # another region begins within SPEECH_GAP of this one's end: found by the channels in between
    starts = shaped.select("input", "at", F.col("first").alias("other"))
    near = shaped.withColumn("other", F.explode(F.sequence(F.col("last") + 1, F.col("last") + SPEECH_GAP))).join(starts, ["input", "at", "other"]).select("input", "at", "first", "other")
    left = sums.select("input", "at", "first", "place", F.col("x").alias("a"))
    right = sums.select("input", "at", F.col("first").alias("other"), "place", F.col("x").alias("b"))
    pairs = near.join(left, ["input", "at", "first"]).join(right, ["input", "at", "other", "place"]).groupBy("input", "at", "first", "other").agg(F.corr("a", "b").alias("rho")).where((F.col("rho") >= RHO) & ~F.isnan("rho"))
    paired = pairs.select("input", "at", F.explode(F.array("first", "other")).alias("first")).distinct()
    wide = shaped.where(F.col("last") - F.col("first") + 1 >= SPEECH_WIDTH).select("input", "at", "first")
    kept = shaped.join(paired.unionByName(wide).distinct(), ["input", "at", "first"], "left_semi")
    return kept.select("input", "at", (F.col("first") - GUARD).alias("first"), (F.col("last") + GUARD).alias("last"), (F.col("at") + HOLD).alias("until"))
