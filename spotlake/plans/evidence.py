"""Queries over tracks and their evidence, and over the projections of a spot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.functions import numeric, text
from spotlake.operators import joins, spectrum, temporal, tracks
from spotlake.plans.registry import DAY, EVENTS, HOUR, events, query, table
from spotlake.plans.spectra import _ROWS, _spectra


@query(f"""WITH {_ROWS}, c AS (SELECT hop, channel, power >= 0.01 AS rise FROM s), d AS (SELECT *, CASE WHEN rise = lag(rise) OVER (PARTITION BY channel ORDER BY hop) THEN 0 ELSE 1 END AS nw FROM c),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY hop ROWS UNBOUNDED PRECEDING) AS run FROM d),
  r AS (SELECT channel, min(hop) AS start, max(hop) + 6 AS stop FROM g WHERE rise GROUP BY channel, run HAVING count(*) >= 3),
  j AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY channel ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM r),
  k AS (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM j) SELECT channel, min(start) AS start, max(stop) AS stop, count(*) AS n FROM k GROUP BY channel, isl""")
def track_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_intervals(_spectra(spark, sf_dir).withColumn("rise", F.col("power") >= 0.01), 3, 6)


@query(f"""WITH {_ROWS}, l AS (SELECT hop, list_sort(list(power))[17] AS lift FROM s GROUP BY hop), d AS (SELECT hop, CASE WHEN lift >= 0.0018 THEN true WHEN lift < 0.0012 THEN false END AS dec FROM l),
  h AS (SELECT hop, coalesce(last_value(dec IGNORE NULLS) OVER (ORDER BY hop ROWS UNBOUNDED PRECEDING), false) AS lit FROM d), c AS (SELECT *, CASE WHEN lit = lag(lit) OVER (ORDER BY hop) THEN 0 ELSE 1 END AS nw FROM h),
  g AS (SELECT *, sum(nw) OVER (ORDER BY hop ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT CAST(0 AS INTEGER) AS input, min(hop) AS "first", max(hop) AS "last", count(*) AS n FROM g WHERE lit GROUP BY run HAVING count(*) >= 3""")
def crash_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifts = spectrum.crash_lift(_spectra(spark, sf_dir)).withColumn("input", F.lit(0))
    return tracks.crash_spans(lifts, 0.0018, 0.0012, 3, 64)


@query(f"""WITH {_ROWS}, p AS (SELECT a.hop, a.channel AS low, a.power AS x, b.power AS y FROM s a JOIN s b ON a.hop = b.hop AND b.channel = a.channel + 1),
  w AS (SELECT hop, low, corr(x, y) OVER (PARTITION BY low ORDER BY hop ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rho FROM p) SELECT hop, low, round(rho, 5) AS rho FROM w WHERE hop % 75 = 74""")
def sliding_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    beside = F.lead("power").over(temporal.by(["hop"], "channel"))
    pairs = _spectra(spark, sf_dir).withColumn("y", beside).where("y IS NOT NULL")
    rho = F.corr("power", "y").over(temporal.by(["channel", "part"], "hop").rowsBetween(-99, 0))
    parts = spectrum.framed(pairs, ["channel"], "hop", 99)
    return parts.withColumn("rho", rho).where("own AND hop % 75 = 74").select("hop", F.col("channel").alias("low"), F.round("rho", 5).alias("rho"))


@query(f"WITH {_ROWS} SELECT channel, CAST(hop // 60 AS BIGINT) AS interval, round(max(db) - 14.3, 6) AS snr FROM s GROUP BY ALL")
def peak_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).groupBy("channel", F.floor(F.col("hop") / 60).alias("interval")).agg(F.round(F.max("db") + numeric.TO_2500_DB, 6).alias("snr"))


_SUPPORT = f"{EVENTS}, w AS (SELECT user_id, event_type || CASE WHEN k % 3 = 0 THEN 'X' WHEN k % 3 = 1 THEN '' ELSE 'XY' END AS word, value FROM ev), s AS (SELECT user_id, word, count(*) AS reps, round(sum(value), 6) AS conf FROM w GROUP BY ALL)"


def _supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("k") % 3 == 0, "X").when(F.col("k") % 3 == 1, "").otherwise("XY")
    return tracks.support(events(spark, sf_dir).withColumn("w", F.concat("event_type", ending)), ["user_id"], "w", "value")


@query(f"WITH {_SUPPORT} SELECT user_id, word, reps, conf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reps DESC, conf DESC, word) AS rank FROM s) WHERE rank <= 8")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.top_candidates(_supports(spark, sf_dir), ["user_id"], 8)


@query(f"""WITH {_SUPPORT}, p AS (SELECT a.user_id, a.word, b.word AS rival, b.reps AS br, b.conf AS bc FROM s a JOIN s b ON a.user_id = b.user_id AND a.word <> b.word AND NOT starts_with(a.word, b.word)
    AND (contains(a.word, b.word) OR contains(b.word, a.word) OR (substr(a.word, 1, 3) = substr(b.word, 1, 3) AND levenshtein(a.word, b.word) <= 2))
    AND (starts_with(b.word, a.word) OR b.reps > a.reps OR (b.reps = a.reps AND b.conf > a.conf)))
  SELECT user_id, word, rival FROM (SELECT *, row_number() OVER (PARTITION BY user_id, word ORDER BY br DESC, bc DESC, rival DESC) AS rn FROM p) WHERE rn = 1""")
def rival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.better_rivals(_supports(spark, sf_dir), ["user_id"], text.variant_relation(F.col("word"), F.col("rival")).isNotNull())


@query(f"""WITH {EVENTS} SELECT event_id, round(least(value - lag(value) OVER w, lead(value) OVER w - value), 6) AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)""")
def nearest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.nearest_gap(events(spark, sf_dir), ["user_id"], "value", "event_id").select("event_id", F.round("gap", 6).alias("gap"))


@query(f"""WITH {EVENTS}, g AS (SELECT d, s FROM (SELECT DISTINCT t // {HOUR // 6} AS d FROM ev), (SELECT DISTINCT event_type AS s FROM ev)), c AS (SELECT d, s, count(ev.event_id) AS n FROM g LEFT JOIN ev ON ev.t // {HOUR // 6} = d AND event_type = s GROUP BY ALL)
  SELECT d AS slot, s AS source FROM (SELECT *, max(n) OVER (PARTITION BY d) AS most FROM c) WHERE n = 0 AND most > 0""")
def silent_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = events(spark, sf_dir).select(F.floor(F.col("t") / (HOUR // 6)).alias("slot"), F.col("event_type").alias("source"))
    kinds = slots.select("source").distinct().agg(F.collect_list("source").alias("all"))  # as many as there are inputs
    grid = slots.select("slot").distinct().crossJoin(F.broadcast(kinds)).select("slot", F.explode("all").alias("source"))
    counts = grid.join(slots.groupBy("slot", "source").agg(F.count("*").alias("n")), ["slot", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return tracks.silent_inputs(counts, "slot", "source", "n").select("slot", "source")


@query(f"""WITH {EVENTS}, g AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN t END) OVER (PARTITION BY user_id) AS good FROM ev) SELECT user_id, count(*) AS streak, min(t) AS since FROM g WHERE good IS NULL OR t > good GROUP BY user_id""")
def bad_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.bad_streaks(events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error"), ["user_id"], "t", "ok")


@query(f"""WITH {EVENTS} SELECT event_id, round(10 * log10(value + 1e-20), 6) AS db, CAST(round(value + 6.9897) AS INTEGER) AS wire_snr, round(1200 / (k + 1.0), 6) AS wpm, round(-pow(ln(value) - ln(35.0), 2) / (2 * 0.25 * 0.25), 6) AS likelihood,
  CAST(round(value * 375.0 / 1000) AS BIGINT) AS hops, round((35.0 / value - 1) * 1e6, 3) AS ppm, round(CASE WHEN abs(k - 50) <= 1000 THEN 1 + (k - 50) * 1e-6 END, 9) AS factor, least(k * 2, 60) AS backoff,
  round(7000000 + CASE WHEN k < 32 THEN k ELSE k - 64 END * 93.75, 6) AS channel_hz, printf('%.2f', value) AS khz FROM ev""")
def spot_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("value"), F.col("k")
    return events(spark, sf_dir).select(
        "event_id",
        numeric.rounded(numeric.power_db(v), 6).alias("db"),
        numeric.wire_snr(v).alias("wire_snr"),
        numeric.rounded(numeric.wpm_of(k + 1.0), 6).alias("wpm"),
        numeric.rounded(numeric.log_normal_likelihood(v, F.lit(35.0), 0.25), 6).alias("likelihood"),
        numeric.ms_to_hops(v).alias("hops"),
        numeric.rounded(numeric.correction_ppm(F.lit(35.0), v), 3).alias("ppm"),
        numeric.rounded(numeric.calibration_factor(k - 50), 9).alias("factor"),
        numeric.next_backoff(k).alias("backoff"),
        numeric.rounded(numeric.channel_freq_hz(F.lit(7_000_000), k, 64), 6).alias("channel_hz"),
        numeric.fixed(v).alias("khz"),
    )


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, list(value / 500 ORDER BY event_id) AS c, count(*) AS n FROM ev GROUP BY user_id)
  SELECT user_id, round(exp(list_sum(list_transform(c, lambda x: ln(greatest(x, 1e-6)))) / n), 6) AS mean, round(exp(list_sum(list_transform(c, lambda x: ln(greatest(x, 1e-6)))) / n) * (1 - pow(0.5, n % 4)), 6) AS confidence,
  round(CASE WHEN user_id % 2 = 0 THEN least(exp(list_sum(list_transform(c, lambda x: ln(greatest(x, 1e-6)))) / n) * 1.15, 1.0) ELSE exp(list_sum(list_transform(c, lambda x: ln(greatest(x, 1e-6)))) / n) END, 6) AS boosted FROM g""")
def call_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") / 500).alias("c"))))["c"]
    grouped = events(spark, sf_dir).groupBy("user_id").agg(held.alias("c"), F.count("*").alias("n"))
    mean = numeric.geometric_mean(F.col("c"))
    return grouped.select("user_id", F.round(mean, 6).alias("mean"), F.round(numeric.call_confidence(F.col("c"), F.col("n") % 4), 6).alias("confidence"), F.round(numeric.listed_boost(mean, F.col("user_id") % 2 == 0), 6).alias("boosted"))


@query(f"""WITH {EVENTS} SELECT user_id, event_type AS source, count(*) AS spots, count(DISTINCT k) AS calls, count(*) FILTER (dupe) AS dupes FROM (SELECT *, count(*) OVER (PARTITION BY user_id, k) > 1 AS dupe FROM ev) GROUP BY ALL""")
def input_hearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dupe = F.count("*").over(Window.partitionBy("user_id", "k")) > 1
    rows = events(spark, sf_dir).withColumn("dupe", dupe)
    return rows.groupBy("user_id", F.col("event_type").alias("source")).agg(F.count("*").alias("spots"), F.countDistinct("k").alias("calls"), F.count_if("dupe").alias("dupes"))


@query(f"""WITH {EVENTS} SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS deviation, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""")
def sender_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = temporal.by(["user_id", "event_type"], "t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.round(F.stddev_pop("value").over(w), 6).alias("deviation"), F.count("*").over(w).alias("n"))


@query("""WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, n_chars > 1000 AS long FROM documents), f AS (SELECT doc_id, toxic FROM labels)
  SELECT count(*) FILTER (f.toxic = 1 AND quality = 0) AS gains, count(*) FILTER (f.toxic = 0 AND quality = 1) AS losses, count(*) FILTER (long) AS held, count(*) AS n FROM a JOIN b USING (doc_id) JOIN f USING (doc_id)""")
def triple_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("long"))
    three = labels.select("doc_id", "quality").join(docs, "doc_id").join(labels.select("doc_id", "toxic"), "doc_id")
    return three.agg(F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("gains"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("losses"), F.count_if("long").alias("held"), F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, x AS (SELECT user_id, event_type, CAST(t // {DAY} AS BIGINT) AS day, k FROM ev) SELECT day, event_type, arg_max(k, (user_id, k)) AS newest, count(*) AS n FROM x GROUP BY ALL""")
def gauge_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    return rows.groupBy("day", "event_type").agg(F.max_by("k", F.struct("user_id", "k")).alias("newest"), F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, t, k FROM ev), o AS (SELECT a.user_id, a.t, a.k, (SELECT arg_max(b.k, b.t) FROM c b WHERE b.user_id = a.user_id AND b.t <= a.t - {DAY}) AS before FROM c a)
  SELECT user_id, t FROM o WHERE before IS NOT NULL AND k - before >= 50""")
def offset_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value as it stood a day before, as-of: both series in one sort, the older shifted forward."""
    rows = events(spark, sf_dir).select("user_id", "t", "k")
    older = rows.select("user_id", (F.col("t") + DAY).alias("at"), F.col("k").alias("before"), F.col("t").alias("o"))
    return joins.asof_backward(rows, older, "user_id", "t", "at", ["before"], "o").where("before IS NOT NULL AND k - before >= 50").select("user_id", "t")
