"""Grading of spots against reports of others: match, disagree, elsewhere, none or unknown, and the reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.numeric import BANDS, band_rank
from spotlake.functions.text import normal_spotter
from spotlake.operators.aggregates import modal_nearest
from spotlake.operators.joins import band_join, containment_join
from spotlake.operators.temporal import merge_intervals

#: Label of a frequency outside every band; spots there match by frequency alone.
NO_BAND = "unknown"


def coverage(reports: DataFrame, at: str, join_gap: float, width: float, archive: str = "archive") -> DataFrame:
    """Spans in which the archives report: start, stop. Gaps up to join_gap are bridged, archive by archive, then across archives.

    Islands are first made within (archive, stretch of time), then within the stretch, so that only what is left of a stretch
    meets the others in one task.
    """
    cells = reports.select(archive, F.col(at).alias("start"), F.col(at).alias("stop"), F.floor(F.col(at) / F.lit(width)).alias("cell"))
    local = merge_intervals(cells, [archive, "cell"], "start", "stop", join_gap)
    local = merge_intervals(local.select("cell", "start", "stop"), ["cell"], "start", "stop", join_gap)
    return merge_intervals(local.select(F.lit(0).alias("all"), "start", "stop"), ["all"], "start", "stop", join_gap).select("start", "stop")


def folded(call: Column) -> Column:
    """A call as it is compared: without blanks around it, in upper case."""
    return F.upper(F.trim(call.cast("string")))


def grade_spots(
    spots: DataFrame, reports: DataFrame, window: int, freq_tol: float, speed_tol: float, speed_share: float, freq_step: float, join_gap: int, spotters: tuple[str, ...] = (), excluded: tuple[str, ...] = (), bands: tuple = BANDS,
    spans: DataFrame | None = None,
) -> DataFrame:
    """A grade per spot.

    spots: spot_id, call, t, freq, wpm, band. reports: r_id, call, r_t, r_freq, r_wpm, r_band, archive, spotter. Windows are inclusive. Only
    reports of `spotters` count (all, if none is named), and none of `excluded`. A spot matches reports of its call in the window on its
    band (or within freq_tol where it is in no band); it disagrees if it is over freq_tol from their modal frequency, or over
    max(speed_tol, speed_share of the median) from their median speed. Without such reports it is elsewhere if another band has one,
    none if the window is covered, else unknown. Covered is what lies in one of `spans` (start, stop), by default in what the archives cover. freq_offset is the spot's frequency less the modal one; bands lists all bands with reports.
    """
    kept = spotter_kept(F.col("spotter"), spotters, excluded)
    near = band_join(spots.withColumn("__call", folded(F.col("call"))), reports.where(kept).withColumn("__call", folded(F.col("call"))).drop("call"), ["__call"], "t", "r_t", window)
    same = F.when(F.col("band") == NO_BAND, F.abs(F.col("freq") - F.col("r_freq")) <= freq_tol).otherwise(F.col("band") == F.col("r_band"))
    pairs = near.withColumn("same", same)
    ranked = F.array_sort(F.collect_set(F.struct(band_rank(F.col("r_band"), bands).alias("rank"), F.col("r_band").alias("b"))))
    summed = pairs.groupBy("spot_id").agg(
        F.count_if("same").alias("reports"),
        F.countDistinct(F.when(F.col("same"), normal_spotter(F.col("spotter")))).alias("skimmers"),
        F.median(F.when(F.col("same"), F.col("r_wpm"))).alias("median_wpm"),
        F.array_join(ranked["b"], ",").alias("bands"),
    )
    step = F.round(F.col("r_freq") / freq_step) * freq_step
    modal = modal_nearest(pairs.where("same"), ["spot_id"], step, F.col("freq"), "modal_freq")
    covered = _covered(spots, spans if spans is not None else coverage(reports, "r_t", join_gap, 64.0 * window), window)
    graded = spots.join(summed, "spot_id", "left").join(modal, "spot_id", "left").join(covered, "spot_id", "left")
    offset = F.col("freq") - F.col("modal_freq")
    off_freq = F.abs(offset) > freq_tol
    off_speed = F.abs(F.col("wpm") - F.col("median_wpm")) > F.greatest(F.lit(float(speed_tol)), F.col("median_wpm") * speed_share)
    found = F.coalesce(F.col("reports"), F.lit(0)) > 0
    grade = F.when(found & F.coalesce(off_freq | off_speed, F.lit(False)), "disagree").when(found, "match").when(F.col("covered").isNull(), "unknown").when(F.col("bands") != "", "elsewhere").otherwise("none")
    disagreements = F.concat_ws(",", F.when(off_freq, "frequency"), F.when(off_speed, "speed"))
    return graded.select(
        "spot_id",
        "call",
        "band",
        grade.alias("grade"),
        F.coalesce("reports", F.lit(0)).cast("long").alias("reports"),
        F.coalesce("skimmers", F.lit(0)).cast("long").alias("skimmers"),
        "modal_freq",
        "median_wpm",
        F.round(offset, 6).alias("freq_offset"),
        F.coalesce(disagreements, F.lit("")).alias("disagreements"),
        F.coalesce("bands", F.lit("")).alias("bands"),
    )


def spotter_kept(spotter: Column, spotters: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> Column:
    """Whether a spotter is among `spotters` (any, if none is named) and not among `excluded`, names compared in their normal form."""
    normal = lambda names: [n.strip().upper().removesuffix("-#") for n in names]
    who = F.coalesce(normal_spotter(spotter), F.lit(""))
    kept = ~who.isin(*normal(excluded)) if excluded else F.lit(True)
    return kept & who.isin(*normal(spotters)) if spotters else kept


def _covered(spots: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """spot_id, covered (true) of spots whose whole window lies in a span."""
    inside = containment_join(spots.select("spot_id", "t"), spans, "t", "start", "stop", 64.0 * window)
    whole = inside.where((F.col("start") <= F.col("t") - window) & (F.col("stop") >= F.col("t") + window))
    return whole.select("spot_id", F.lit(True).alias("covered")).distinct()


def grade_reports(reports: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """Per report: found if a spot of its call on its band lies in the window, elsewhere if one of another band does, else missed."""
    pairs = band_join(reports, spots, ["call"], "r_t", "t", window)
    best = pairs.groupBy("r_id").agg(F.max(F.when(F.col("band") == F.col("r_band"), 2).otherwise(1)).alias("best"))
    grade = F.when(F.col("best") == 2, "found").when(F.col("best") == 1, "elsewhere").otherwise("missed")
    return reports.join(best, "r_id", "left").select("r_id", "call", F.col("r_band").alias("band"), grade.alias("grade"))


def by_band(graded: DataFrame) -> DataFrame:
    """Counts of grades per band and in total (band null), with the median offset."""
    counts = [F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in ("match", "disagree", "elsewhere", "none", "unknown")]
    return graded.rollup("band").agg(F.grouping("band").cast("int").alias("total"), F.count("*").alias("spots"), *counts, F.round(F.median("freq_offset"), 6).alias("median_offset"))


def score(graded_spots: DataFrame, graded_reports: DataFrame) -> DataFrame:
    """One row: spots, reports, precision over spots, recall over reports (null without any)."""
    s = graded_spots.agg(F.count("*").alias("spots"), F.count_if(F.col("grade") == "match").alias("hits"))
    r = graded_reports.agg(F.count("*").alias("reports"), F.count_if(F.col("grade") == "found").alias("found"))
    both = s.crossJoin(r)  # one row by one row
    return both.select("spots", "reports", F.round(F.try_divide("hits", "spots"), 6).alias("precision"), F.round(F.try_divide("found", "reports"), 6).alias("recall"))


def within(df: DataFrame, at: str, freq: str, passbands: tuple[tuple[float, float], ...] = (), start: float | None = None, stop: float | None = None) -> DataFrame:
    """Rows in one of the passbands (inclusive; any, if none is named) and in the time from start on, before stop."""
    kept = F.lit(True)
    if passbands:
        kept = F.lit(False)
        for low, high in passbands:
            kept = kept | F.col(freq).between(low, high)
    if start is not None:
        kept = kept & (F.col(at) >= start)
    if stop is not None:
        kept = kept & (F.col(at) < stop)
    return df.where(F.coalesce(kept, F.lit(False)))


def paired(spots: DataFrame, reports: DataFrame, rules: dict, passbands: tuple[tuple[float, float], ...] = (), start: float | None = None, stop: float | None = None) -> DataFrame:
    """Per band and in total (band null): spots and how they are graded, reports and whether spots found them, recall, and the share of covered spots that no report backs.

    rules: the further arguments of grade_spots(). Only spots and reports within() the passbands and the time count, but any may confirm them.
    Reports of other spotters, or of calls that are none, don't count and cover nothing.
    """
    heard = reports.where(spotter_kept(F.col("spotter"), rules.get("spotters", ()), rules.get("excluded", ())))
    graded = grade_spots(within(spots, "t", "freq", passbands, start, stop), heard, **rules)
    backward = grade_reports(within(heard, "r_t", "r_freq", passbands, start, stop), spots, rules["window"])
    counts = [F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in ("match", "disagree", "elsewhere", "none", "unknown")]
    forward = graded.groupBy("band").agg(F.count("*").alias("spots"), *counts)
    back = backward.groupBy("band").agg(F.count("*").alias("reports"), F.count_if(F.col("grade") == "found").alias("found"), F.count_if(F.col("grade") == "elsewhere").alias("reports_elsewhere"))
    numbers = ["spots", *[f"n_{g}" for g in ("match", "disagree", "elsewhere", "none", "unknown")], "reports", "found", "reports_elsewhere"]
    both = forward.join(back, "band", "full").select("band", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    summed = both.rollup("band").agg(F.grouping("band").cast("int").alias("total"), *[F.sum(c).cast("long").alias(c) for c in numbers])
    judged = F.col("n_match") + F.col("n_disagree") + F.col("n_elsewhere") + F.col("n_none")
    return summed.select("*", F.round(F.try_divide("found", "reports"), 6).alias("recall"), F.round(F.try_divide(F.col("n_elsewhere") + F.col("n_none"), judged), 6).alias("candidate_false"))
