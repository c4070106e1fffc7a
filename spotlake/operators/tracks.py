"""Tracks out of spectra, and rules on their evidence: confirmation, hang, merging of neighbours, supports and rivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.temporal import by, merge_intervals, runs


def track_intervals(rows: DataFrame, confirm: int, hang: int) -> DataFrame:
    """(hop, channel, rise) -> channel, start, stop, n: runs of rise of at least `confirm` hops, prolonged by `hang`, those that meet joined."""
    found = runs(rows, ["channel"], "hop", "rise").where(F.col("rise") & (F.col("n") >= confirm))
    spans = found.select("channel", F.col("first").alias("start"), (F.col("last") + hang).alias("stop"))
    return merge_intervals(spans, ["channel"], "start", "stop")


def crash_spans(lifts: DataFrame, onset: float, release: float, least: int, block: int = 4096) -> DataFrame:
    """(input, hop, lift) -> input, first, last, n of spans that start at or over `onset` and last until below `release`.

    Between the two levels a hop keeps the state before it, which is the last hop that was decisive. Hops are taken in blocks: each block's last decisive state is handed on, a row a block, and
    spans that reach over the end of a block are put together, a row a span; so no task sorts a recording.
    """
    decisive = F.when(F.col("lift") >= onset, True).when(F.col("lift") < release, False)
    rows = lifts.select("input", "hop", F.floor(F.col("hop") / block).alias("block"), decisive.alias("d"))
    ends = rows.groupBy("input", "block").agg(F.max_by("d", F.when(F.col("d").isNotNull(), F.col("hop"))).alias("end"), F.min("hop").alias("head"), F.max("hop").alias("tail"))
    before = by(["input"], "block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("input", "block", "head", "tail", F.last("end", ignorenulls=True).over(before).alias("carry"))
    inside = by(["input", "block"], "hop").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("d", F.last("d", ignorenulls=True).over(inside)).join(carried, ["input", "block"])
    on = held.select("input", "block", "head", "tail", "hop", F.coalesce("d", "carry", F.lit(False)).alias("on"))
    parts = runs(on, ["input", "block", "head", "tail"], "hop", "on").where("on")
    order = by(["input"], "block", "first")
    # a span at the head of its block goes on from one at the tail of the block before it
    goes_on = (F.col("first") == F.col("head")) & (F.lag("last").over(order) == F.lag("tail").over(order)) & (F.lag("block").over(order) == F.col("block_before"))
    known = carried.select("input", "block", F.lag("block").over(by(["input"], "block")).alias("block_before"))
    parts = parts.join(known, ["input", "block"]).withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    whole = parts.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.groupBy("input", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).where(F.col("n") >= least).drop("span")


def support(words: DataFrame, keys: list[str], word: str, confidence: str) -> DataFrame:
    """Per word: reps and summed confidence."""
    return words.groupBy(*keys, F.col(word).alias("word")).agg(F.count("*").alias("reps"), F.round(F.sum(confidence), 6).alias("conf"))


def better_rivals(supports: DataFrame, keys: list[str], related: Column) -> DataFrame:
    """Per word the best supported related rival of the same key: more reps, then more confidence; a rival that extends the word wins at any support.

    A rival that the word extends never wins. `related` is over columns word and rival.
    """
    rivals = supports.select(*keys, F.col("word").alias("rival"), F.col("reps").alias("rival_reps"), F.col("conf").alias("rival_conf"))
    pairs = supports.join(rivals, keys).where((F.col("word") != F.col("rival")) & related & ~F.startswith("word", "rival"))
    extends = F.startswith("rival", "word")
    more = (F.col("rival_reps") > F.col("reps")) | ((F.col("rival_reps") == F.col("reps")) & (F.col("rival_conf") > F.col("conf")))
    best = F.max_by(F.col("rival"), F.struct("rival_reps", "rival_conf", "rival")).alias("rival")
    return pairs.where(extends | more).groupBy(*keys, "word").agg(best)


def top_candidates(supports: DataFrame, keys: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("reps"), F.desc("conf"), "word"))
    return supports.withColumn("rank", rank).where(F.col("rank") <= n)


def nearest_gap(df: DataFrame, keys: list[str], freq: str, tie: str) -> DataFrame:
    """df with gap: distance to the nearest other row of the key in frequency (null if alone)."""
    order = by(keys, freq, tie)
    return df.withColumn("gap", F.least(F.col(freq) - F.lag(freq).over(order), F.lead(freq).over(order) - F.col(freq)))


def silent_inputs(counts: DataFrame, window: str, source: str, n: str) -> DataFrame:
    """(window, source, n) -> rows where a source heard nothing while another heard something."""
    return counts.withColumn("most", F.max(n).over(Window.partitionBy(window))).where((F.col(n) == 0) & (F.col("most") > 0)).drop("most")


def bad_streaks(df: DataFrame, keys: list[str], at: str, ok: str) -> DataFrame:
    """Per key the bad samples at its end, and since when."""
    last_good = F.max(F.when(F.col(ok), F.col(at))).over(Window.partitionBy(*keys))
    bad = df.withColumn("__good", last_good).where(F.col("__good").isNull() | (F.col(at) > F.col("__good")))
    return bad.groupBy(*keys).agg(F.count("*").alias("streak"), F.min(at).alias("since"))


def in_band(at: Column, band: tuple[float, float] | None, guard: float = 0.0) -> Column:
    """Whether a place lies in a half-open band, by `guard` at least; in any place without a band. For trusted and spawn bands and the guard of an analytic signal."""
    return F.lit(True) if band is None else (at >= band[0] + guard) & (at < band[1] - guard)


def veto_census(rises: DataFrame, rules: dict[str, Column], hop: str, channel: str, per_second: int) -> DataFrame:
    """rises -> second, channel, veto, n: how often each rule was the first to refuse a rise. Rises that none refuses are left out."""
    veto = F.lit(None).cast("string")
    for name, refuses in reversed(rules.items()):
        veto = F.when(refuses, name).otherwise(veto)
    told = rises.select(F.floor(F.col(hop) / per_second).alias("second"), F.col(channel).alias("channel"), veto.alias("veto")).where("veto IS NOT NULL")
    return told.groupBy("second", "channel", "veto").agg(F.count("*").alias("n"))
