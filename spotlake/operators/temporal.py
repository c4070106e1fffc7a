"""Ordered operators: islands, sessions, framed quantiles, smoothing, runs, trailing counts.

All take the order explicitly and break ties by a further column, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(keys: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str, slack: float = 0) -> DataFrame:
    """Unions of intervals that overlap, touch or lie at most `slack` apart: keys, start, stop, n. One without a start, or that stops before it starts and lies in no other, is by itself, also where it comes twice."""
    order = by(keys, F.asc_nulls_last(start), F.asc_nulls_last(stop))
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = df.withColumn("__new", F.when(F.col(start) <= reach + slack, 0).otherwise(1))
    # the same order, so one sort: of equal intervals the one that opens an island comes first in both windows
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = opens.withColumn("__island", island).groupBy(*keys, "__island")
    return grouped.agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n")).drop("__island")


def sessions(df: DataFrame, keys: list[str], at: str, tie: str, gap: float) -> DataFrame:
    """df with session (from 0): a gap of more than `gap` since the row before opens the next."""
    order = by(keys, at, tie)
    opens = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn("session", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def runs(df: DataFrame, keys: list[str], at: str, flag: str) -> DataFrame:
    """Runs of equal flag in consecutive rows: keys, flag, first, last, n."""
    order = by(keys, at)
    changes = F.when(F.col(flag) == F.lag(flag).over(order), 0).otherwise(1)
    numbered = df.withColumn("__c", changes).withColumn("__run", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, flag, "__run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__run")


def debounce(df: DataFrame, keys: list[str], at: str, flag: str, least: int) -> DataFrame:
    """df with flag where runs shorter than `least` rows take the value before them (the first run keeps its own)."""
    order = by(keys, at)
    numbered = df.withColumn("__c", F.when(F.col(flag) == F.lag(flag).over(order), 0).otherwise(1))
    numbered = numbered.withColumn("__run", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    firm = F.when((size >= least) | (F.col("__run") == 1), F.col(flag))
    kept = numbered.withColumn("__firm", firm)
    return kept.withColumn(flag, F.last("__firm", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__c", "__run", "__firm")


def framed_quantile(value: str, window: WindowSpec, q: float) -> Column:
    """The value at rank max(ceil(q n), 1) of a bounded frame."""
    held = F.sort_array(F.collect_list(value).over(window))
    return F.get(held, F.greatest(F.ceil(F.lit(q) * F.size(held)).cast("int"), F.lit(1)) - 1)


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an ordered array, seeded by its first value: the last smoothed value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: a + F.lit(alpha) * (x - a))


def trailing_count(df: DataFrame, keys: list[str], at: str, span: int, out: str = "n") -> DataFrame:
    """df with the rows of the same key in [at - span, at]."""
    return df.withColumn(out, F.count("*").over(by(keys, at).rangeBetween(-span, 0)))


def held_for(df: DataFrame, keys: list[str], at: str, flag: str, least: int) -> DataFrame:
    """Runs where flag holds from a first to a last row at least `least` apart: keys, first, last, n."""
    found = runs(df, keys, at, flag)
    return found.where(F.col(flag) & (F.col("last") - F.col("first") >= least)).drop(flag)


def counter_increase(df: DataFrame, keys: list[str], at: str, value: str, out: str = "increase") -> DataFrame:
    """df with the growth of a counter since the row before; a fall is a reset, after which the value itself counts."""
    last = F.lag(value).over(by(keys, at))
    return df.withColumn(out, F.when(last.isNull(), 0).when(F.col(value) < last, F.col(value)).otherwise(F.col(value) - last))


def sequence_gaps(df: DataFrame, keys: list[str], at: str, tie: str, seq: str, bits: int) -> DataFrame:
    """df with verdict (first, next, restart, repeat, lost, late) and lost (numbers skipped) of wrapping sequence numbers in order of arrival."""
    last = F.lag(seq).over(by(keys, at, tie))
    step = F.pmod(F.col(seq) - last, F.lit(1 << bits))
    verdict = F.when(last.isNull(), "first").when(step == 1, "next").when(F.col(seq) == 0, "restart").when(step == 0, "repeat").when(step < 1 << (bits - 1), "lost").otherwise("late")
    return df.withColumn("verdict", verdict).withColumn("lost", F.when(F.col("verdict") == "lost", step - 1).otherwise(0).cast("long"))


def loss_marks(df: DataFrame, keys: list[str], at: str, tie: str, lost: str, most: int) -> DataFrame:
    """df with clock (losses of fewer than `most` so far, which advance the clock) and segment (longer ones so far: discontinuities, each after which the clock starts anew)."""
    order = by(keys, at, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn("segment", F.count_if(F.col(lost) >= most).over(upto))
    inside = by([*keys, "segment"], at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("clock", F.sum(F.when(F.col(lost) < most, F.col(lost)).otherwise(0)).over(inside))


def hysteresis(df: DataFrame, keys: list[str], at: str, tie: str, value: str, rise: float, drop: float, out: str = "on") -> DataFrame:
    """df with a state that turns on at or above `rise`, off below `drop`, and else stays; off at first."""
    decisive = F.when(F.col(value) >= rise, True).when(F.col(value) < drop, False)
    held = F.last(decisive, ignorenulls=True).over(by(keys, at, tie).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(held, F.lit(False)))


def resequenced(df: DataFrame, keys: list[str], closing: str, at: str, tie: list[str], out: str = "place") -> DataFrame:
    """df with the place of a row within its batch (keys): by time and tie, closing rows last."""
    return df.withColumn(out, F.row_number().over(by(keys, closing, at, *tie)))


def unplanned(outages: DataFrame, planned: DataFrame, keys: list[str], width: float) -> DataFrame:
    """outages (keys, o_id, start, stop) with excused: how much of each lies in the planned windows (keys, p_start, p_stop) of its key, overlaps of those counted once."""
    merged = merge_intervals(planned, keys, "p_start", "p_stop").drop("n")
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    left = outages.where("start < stop").withColumn("__b", F.explode(F.sequence(bucket("start"), bucket("stop"))))
    right = merged.where("p_start < p_stop").withColumn("__b", F.explode(F.sequence(bucket("p_start"), bucket("p_stop"))))
    met = left.join(right, [*keys, "__b"]).where((F.col("start") < F.col("p_stop")) & (F.col("p_start") < F.col("stop")))
    met = met.where(F.col("__b") == F.greatest(bucket("start"), bucket("p_start")))
    share = F.sum(F.least("stop", "p_stop") - F.greatest("start", "p_start")).alias("excused")
    return outages.join(met.groupBy("o_id").agg(share), "o_id", "left").withColumn("excused", F.coalesce("excused", F.lit(0)))


def availability(samples: DataFrame, planned: DataFrame, keys: list[str], at: str, tie: str, up: str, patience: float, least_observed: float = 0.5, target: float = 0.99) -> DataFrame:
    """samples (keys, at, tie, up) -> per key: up, down, unobserved, excused, availability and verdict.

    A sample says the state until the next one; longer than `patience` until then is unobserved. Time down in the planned windows (keys, p_start, p_stop) is excused and counts
    neither way. availability: up by up and what is left of down, null without either. verdict: unknown if less than least_observed of the time that is not excused was observed, else pass or fail by the target.
    """
    after = F.lead(at).over(by(keys, at, tie))
    spans = samples.withColumn("stop", after).where("stop IS NOT NULL").withColumn("length", F.col("stop") - F.col(at))
    state = F.when(F.col("length") > patience, "unobserved").when(F.col(up), "up").otherwise("down")
    spans = spans.select(*keys, F.col(at).alias("start"), "stop", "length", state.alias("state"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("length"))), F.lit(0)).alias(s)
    totals = spans.groupBy(*keys).agg(part("up"), part("down"), part("unobserved"))
    # down spans of a key don't overlap, so each is an outage of its own, named by its start
    down = spans.where("state = 'down'").select(*keys, F.struct(*keys, "start").alias("o_id"), "start", "stop")
    excused = unplanned(down, planned, keys, max(patience, 1)).groupBy(*keys).agg(F.sum("excused").alias("excused"))
    told = totals.join(excused, keys, "left").withColumn("excused", F.coalesce("excused", F.lit(0)))
    charged = F.col("down") - F.col("excused")
    share = F.try_divide(F.col("up"), F.col("up") + charged)
    observed = F.try_divide(F.col("up") + charged, F.col("up") + charged + F.col("unobserved"))
    verdict = F.when(F.coalesce(observed, F.lit(0.0)) < least_observed, "unknown").when(share >= target, "pass").otherwise("fail")
    return told.select(*keys, "up", "down", "unobserved", "excused", F.round(share, 6).alias("availability"), verdict.alias("verdict"))


def counter_delta(df: DataFrame, keys: list[str], at: str, tie: str, value: str, out: str = "delta") -> DataFrame:
    """df with how much a counter grew since the row before of its key; 0 at the first row and where it fell."""
    last = F.lag(value).over(by(keys, at, tie))
    return df.withColumn(out, F.coalesce(F.greatest(F.col(value) - last, F.lit(0)), F.lit(0)))
