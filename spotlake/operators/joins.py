"""Joins by tolerance: interval, band, nearest, as-of and containment, as equi-joins on buckets with an exact residual.

Spark plans a bare |a - b| <= w as a nested loop, and one keyed by a busy call as one hot task. Here a row is listed under
every bucket that its range touches, and meets the other side's rows of the same bucket, so work is spread over time or
frequency as well as over keys. Nulls in a key or position match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in keys], F.lit(True))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: float, after: float, how: str = "inner") -> DataFrame:
    """Pairs of equal keys with left_at - before <= right_at <= left_at + after. Columns of the two sides have different names, but for keys.

    how: inner, left, left_semi or left_anti. Buckets are as wide as the window, so a left row has two as a rule. A window of equal sides is a bound on the distance, which
    rounds otherwise than its two ends do; so buckets reach a trifle beyond it.
    """
    width = max(before + after, 1e-9)
    slack = width * 1e-6
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    near = left.withColumn("__b", F.explode(F.sequence(bucket(F.col(left_at) - before - slack), bucket(F.col(left_at) + after + slack))))
    far = right.withColumn("__b2", bucket(F.col(right_at)))
    renamed = {k: f"__r_{k}" for k in keys}
    far = far.withColumnsRenamed(renamed)
    inside = F.abs(F.col(left_at) - F.col(right_at)) <= after if before == after else (F.col(right_at) >= F.col(left_at) - before) & (F.col(right_at) <= F.col(left_at) + after)
    on = _on(near, far, [("__b", "__b2"), *renamed.items()]) & inside
    drop = ["__b2", *renamed.values()]
    pairs = near.join(far, on).drop("__b", *drop)
    if how == "inner":
        return pairs
    ids = left.columns
    met = near.join(far, on, "left_semi").select(*[F.col(c).alias(f"__m_{c}") for c in ids]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in ids])
    if how == "left_semi":
        return left.join(met, same, "left_semi")
    lone = left.join(met, same, "left_anti")
    return lone if how == "left_anti" else pairs.unionByName(lone, allowMissingColumns=True)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance: float, how: str = "inner") -> DataFrame:
    """interval_join with the same tolerance on either side."""
    return interval_join(left, right, keys, left_at, right_at, tolerance, tolerance, how)


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_at: str, right_at: str, tolerance: float, ties: list[Column]) -> DataFrame:
    """Of the right rows within tolerance the nearest to each left row; equal distances go by `ties`."""
    pairs = band_join(left, right, keys, left_at, right_at, tolerance)
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(F.abs(F.col(left_at) - F.col(right_at)), *ties))
    return pairs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, carried: list[str], order: str) -> DataFrame:
    """left with the `carried` columns of the latest right row of its key at or before it (null if none).

    One sort of both sides together, in place of a join: right rows come first at equal times, by `order`.
    """
    side = left.withColumn("__side", F.lit(1)).withColumn("__at", F.col(at)).withColumn("__order", F.lit(None).cast(right.schema[order].dataType))
    value = F.struct(*[F.col(c) for c in carried]).alias("__value")
    other = right.select(F.col(key), F.lit(0).alias("__side"), F.col(right_at).alias("__at"), F.col(order).alias("__order"), value)
    window = Window.partitionBy(key).orderBy("__at", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    both = side.unionByName(other, allowMissingColumns=True).withColumn("__last", F.last("__value", ignorenulls=True).over(window))
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in carried])


def containment_join(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, width: float) -> DataFrame:
    """Pairs with start <= at <= stop. width: about an interval's length; longer ones are listed under more buckets."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = intervals.where(F.col(start) <= F.col(stop)).withColumn("__b", F.explode(F.sequence(bucket(start), bucket(stop))))
    dots = points.withColumn("__b", bucket(at))
    return dots.join(spread, "__b").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))).drop("__b")


def outside_windows(points: DataFrame, windows: DataFrame, key: str, at: str, low: str, high: str, width: float) -> DataFrame:
    """points that lie in no window [low, high); key identifies a point."""
    inside = containment_join(points, windows, at, low, high, width).where(F.col(at) < F.col(high)).select(key).distinct()
    return points.join(inside, key, "left_anti")


def overlap_join(left: DataFrame, right: DataFrame, l_span: tuple[str, str], r_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of intervals that share more than an end. width: about an interval's length. A pair counts in the first bucket that both touch."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = lambda df, span, name: df.where(F.col(span[0]) < F.col(span[1])).withColumn(name, F.explode(F.sequence(bucket(span[0]), bucket(span[1]))))
    pairs = spread(left, l_span, "__b").join(spread(right, r_span, "__b2"), F.col("__b") == F.col("__b2"))
    meets = (F.col(l_span[0]) < F.col(r_span[1])) & (F.col(r_span[0]) < F.col(l_span[1]))
    return pairs.where(meets & (F.col("__b") == F.greatest(bucket(l_span[0]), bucket(r_span[0])))).drop("__b", "__b2")


def longest_prefix(words: DataFrame, prefixes: DataFrame, word: str, prefix: str) -> DataFrame:
    """words with the longest entry of prefixes that it starts with (null if none): its prefixes are exploded and equi-joined."""
    longest = F.broadcast(prefixes.agg(F.greatest(F.coalesce(F.max(F.length(prefix)), F.lit(1)), F.lit(1)).alias("__longest")))
    parts = words.select(word).distinct().where(F.length(word) > 0).crossJoin(longest)  # by one row
    parts = parts.withColumn("__n", F.explode(F.sequence(F.lit(1), F.least(F.length(word), F.col("__longest"))))).drop("__longest")
    parts = parts.withColumn(prefix, F.col(word).substr(F.lit(1), F.col("__n")))
    best = parts.join(prefixes.select(prefix).distinct(), prefix).groupBy(word).agg(F.max_by(prefix, "__n").alias(prefix))
    return words.join(best, word, "left")
