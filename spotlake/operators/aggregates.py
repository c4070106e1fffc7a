"""Aggregates with pinned tie and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal_nearest(df: DataFrame, keys: list[str], value: Column, near: Column, out: str) -> DataFrame:
    """(keys) -> the commonest value; ties go to the value nearest to `near`, then to the lower."""
    counted = df.select(*keys, value.alias(out), near.alias("__near")).groupBy(*keys, out).agg(F.count("*").alias("__n"), F.min("__near").alias("__near"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), F.abs(F.col(out) - F.col("__near")), out))
    return counted.withColumn("__rank", rank).where("__rank = 1").select(*keys, out)


def histogram_le(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Counts per upper bound (inclusive), the last bucket open (bound null): bucket, bound, n. Empty buckets are listed."""
    bucket = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col(value) <= bound, i).otherwise(bucket)
    counted = df.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"), F.get(F.array(*[F.lit(float(b)) for b in bounds]), F.col("id").cast("int")).alias("bound"))
    return edges.join(counted, "bucket", "left").select("bucket", "bound", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_quantile(df: DataFrame, keys: list[str], value: str, bounds: list[float], q: float, out: str = "quantile") -> DataFrame:
    """Per key the q-quantile as a histogram of those upper bounds tells it: linear inside its bucket, the first of which begins at 0 or at its bound if that is lower.

    Every row counts: what lies below is in the first bucket, and beyond the last bound in an open one, for which the last bound stands. Nulls don't count.
    """
    place = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        place = F.when(F.col(value) <= bound, i).otherwise(place)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, place.alias("__i")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__i")
    counts = counts.withColumn("__c", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum("__n").over(Window.partitionBy(*keys)))
    reached = counts.where(F.col("__c") >= F.lit(q) * F.col("__t")).groupBy(*keys).agg(F.min_by(F.struct("__i", "__n", "__c", "__t"), "__i").alias("b"))
    i = F.col("b.__i")
    at = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), i)
    low, high = at([min(0.0, bounds[0]), *bounds]), at([*bounds, bounds[-1]])
    inside = low + (high - low) * (F.lit(q) * F.col("b.__t") - (F.col("b.__c") - F.col("b.__n"))) / F.col("b.__n")
    return reached.select(*keys, F.when(i == len(bounds), F.lit(float(bounds[-1]))).otherwise(inside).alias(out))


def pairing_tally(df: DataFrame, strata: str, a: Column, b: Column) -> DataFrame:
    """Per stratum and overall (stratum null): n, both, a_only, b_only, neither, union_rate."""
    rows = df.select(F.col(strata).alias("stratum"), a.alias("a"), b.alias("b"))
    count = lambda c: F.count_if(c)
    both, a_only, b_only = F.col("a") & F.col("b"), F.col("a") & ~F.col("b"), ~F.col("a") & F.col("b")
    tally = rows.rollup("stratum").agg(
        F.count("*").alias("n"), count(both).alias("both"), count(a_only).alias("a_only"), count(b_only).alias("b_only"), count(~F.col("a") & ~F.col("b")).alias("neither"), F.grouping("stratum").alias("overall")
    )
    return tally.withColumn("union_rate", F.round((F.col("both") + F.col("a_only") + F.col("b_only")) / F.col("n"), 6))


def pooled(df: DataFrame, value: str, error: str) -> DataFrame:
    """Inverse-variance mean and its error."""
    weight = 1 / (F.col(error) * F.col(error))
    return df.agg(F.round(F.sum(weight * F.col(value)) / F.sum(weight), 6).alias("pooled"), F.round(1 / F.sqrt(F.sum(weight)), 6).alias("pooled_error"))


def bootstrap_interval(clusters: DataFrame, id_col: str, hits: str, total: str, resamples: int = 200) -> DataFrame:
    """A 95 % interval of sum(hits) / sum(total) over resampled clusters: low, high, estimate.

    A cluster's weight in a resample is a Poisson(1) draw from the md5 of its id and the resample's number, which stands for
    drawing clusters with replacement without gathering them; so the work is one exploded aggregation, whatever the number
    of clusters. Bounds are order statistics int(0.025 R) and int(0.975 R) - 1.
    """
    drawn = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("r").cast("string")))
    draw = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    weight, cumulated, probability = F.lit(8), 0.0, 0.36787944117144233
    cuts = []
    for k in range(8):
        cumulated += probability
        cuts.append((k, cumulated))
        probability /= k + 1
    for k, cut in reversed(cuts):
        weight = F.when(draw < cut, k).otherwise(weight)
    spread = clusters.select(id_col, hits, total).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    rates = spread.groupBy("r").agg((F.sum(F.col("w") * F.col(hits)) / F.sum(F.col("w") * F.col(total))).alias("rate"))
    ordered = rates.agg(F.sort_array(F.collect_list("rate")).alias("rates"))  # `resamples` values
    whole = clusters.agg((F.sum(hits) / F.sum(total)).alias("estimate"))
    low, high = int(0.025 * resamples), max(int(0.025 * resamples), int(0.975 * resamples) - 1)
    return ordered.crossJoin(whole).select(F.get("rates", F.lit(low)).alias("low"), F.get("rates", F.lit(high)).alias("high"), "estimate")


def calibration(readings: DataFrame, keys: list[str], ppm: str, valid: Column, least: int) -> DataFrame:
    """Per key: n, median and spread of the valid readings, the median null below `least` of them."""
    kept = F.when(valid, F.col(ppm))
    grouped = readings.groupBy(*keys).agg(F.count(kept).alias("n"), F.median(kept).alias("median"), (F.max(kept) - F.min(kept)).alias("spread"))
    return grouped.withColumn("median", F.when(F.col("n") >= least, F.col("median")))


def separation(rows: DataFrame, keys: list[str], value: str, right: Column) -> DataFrame:
    """Per key the quartiles of a value over right and wrong rows, and gap: the right median less the wrong one."""
    of = lambda flag: F.percentile(F.when(flag, F.col(value)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(of(right).alias("r"), of(~right).alias("w"))
    cols = [F.get(F.col(side), F.lit(i)).alias(f"{name}_q{i + 1}") for side, name in (("r", "right"), ("w", "wrong")) for i in range(3)]
    return out.select(*keys, *cols, (F.get("r", F.lit(1)) - F.get("w", F.lit(1))).alias("gap"))


def capped(df: DataFrame, keys: list[str], rank_by: list[Column], most: int) -> DataFrame:
    """df with evicted: whether a row is beyond the `most` first of its key by `rank_by`."""
    return df.withColumn("evicted", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank_by)) > most)


def bin_lists(df: DataFrame, call: str, freq: str, width: float, kept: list[str]) -> DataFrame:
    """Per call and rounded frequency (half to even) the rows, as a sorted array of structs."""
    binned = F.bround(F.col(freq) / width).cast("long").alias("bin")
    return df.groupBy(call, binned).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("rows"))
