"""Queries over spots and reports: events as both, purchases being the spots and users the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.functions import numeric
from spotlake.operators import aggregates, grading, joins
from spotlake.plans.registry import DAY, EVENTS, HOUR, events, query, table

_WINDOW, _TOL, _STEP, _GAP = 12 * HOUR, 20.0, 5.0, HOUR
#: Values stand for frequencies; these bounds stand for bands.
BANDS = ((0.0, 20.0, "low"), (20.0, 60.0, "mid"), (60.0, 150.0, "high"))
_BAND = "CASE WHEN value >= 0 AND value <= 20 THEN 'low' WHEN value >= 20 AND value <= 60 THEN 'mid' WHEN value >= 60 AND value <= 150 THEN 'high' ELSE 'unknown' END"


def _spots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).withColumn("band", numeric.band_of(F.col("value"), BANDS))
    spots = e.where("event_type = 'purchase'").select(F.col("event_id").alias("spot_id"), F.col("user_id").alias("call"), "t", F.col("value").alias("freq"), F.col("k").alias("wpm"), "band")
    reports = e.where("event_type <> 'purchase'").select(
        F.col("event_id").alias("r_id"), F.col("user_id").alias("call"), F.col("t").alias("r_t"), F.col("value").alias("r_freq"), F.col("k").alias("r_wpm"), F.col("band").alias("r_band"), F.col("event_type").alias("archive"), F.col("event_type").alias("spotter")
    )
    return spots, reports


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, reports = _spots(spark, sf_dir)
    return grading.grade_spots(spots, reports, _WINDOW, _TOL, 3, 0.2, _STEP, _GAP, excluded=("Error-#",), bands=BANDS)


_GRADED = f"""
  {EVENTS},
  s AS (SELECT event_id AS spot_id, user_id AS call, t, value AS freq, k AS wpm, {_BAND} AS band FROM ev WHERE event_type = 'purchase'),
  r AS (SELECT event_id AS r_id, user_id AS call, t AS r_t, value AS r_freq, k AS r_wpm, {_BAND} AS r_band, event_type AS archive FROM ev WHERE event_type <> 'purchase'),
  p AS (SELECT s.*, r.r_freq, r.r_wpm, r.r_band, r.archive, CASE WHEN s.band = 'unknown' THEN abs(s.freq - r.r_freq) <= {_TOL} ELSE s.band = r.r_band END AS same
        FROM s JOIN r ON s.call = r.call AND r.archive <> 'error' AND r.r_t BETWEEN s.t - {_WINDOW} AND s.t + {_WINDOW}),
  agg AS (SELECT spot_id, count(*) FILTER (same) AS reports, median(r_wpm) FILTER (same) AS median_wpm, count(DISTINCT archive) FILTER (same) AS skimmers,
          array_to_string(list_transform(list_sort(list(DISTINCT CASE r_band WHEN 'low' THEN '0low' WHEN 'mid' THEN '1mid' WHEN 'high' THEN '2high' ELSE '3unknown' END)), lambda x: x[2:]), ',') AS bands FROM p GROUP BY spot_id),
  cnt AS (SELECT spot_id, round(r_freq / {_STEP}) * {_STEP} AS m, min(freq) AS freq, count(*) AS n FROM p WHERE same GROUP BY 1, 2),
  modal AS (SELECT spot_id, m AS modal_freq FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY n DESC, abs(m - freq), m) AS rn FROM cnt) WHERE rn = 1),
  per AS (SELECT archive, r_t, CASE WHEN r_t - lag(r_t) OVER (PARTITION BY archive ORDER BY r_t) <= {_GAP} THEN 0 ELSE 1 END AS nw FROM r),
  isl AS (SELECT archive, min(r_t) AS a, max(r_t) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY archive ORDER BY r_t ROWS UNBOUNDED PRECEDING) AS g FROM per) GROUP BY archive, g),
  joined AS (SELECT a, b, CASE WHEN a <= max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {_GAP} THEN 0 ELSE 1 END AS nw FROM isl),
  cov AS (SELECT min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM joined) GROUP BY g),
  graded AS (
    SELECT s.spot_id, s.call, s.band, CAST(coalesce(reports, 0) AS BIGINT) AS reports, modal_freq, median_wpm, CAST(coalesce(skimmers, 0) AS BIGINT) AS skimmers, round(freq - modal_freq, 6) AS freq_offset, coalesce(bands, '') AS bands,
      coalesce(concat_ws(',', CASE WHEN abs(modal_freq - freq) > {_TOL} THEN 'frequency' END, CASE WHEN abs(wpm - median_wpm) > greatest(3.0, median_wpm * 0.2) THEN 'speed' END), '') AS disagreements,
      CASE WHEN coalesce(reports, 0) > 0 AND (abs(modal_freq - freq) > {_TOL} OR abs(wpm - median_wpm) > greatest(3.0, median_wpm * 0.2)) THEN 'disagree'
           WHEN coalesce(reports, 0) > 0 THEN 'match'
           WHEN NOT EXISTS (SELECT 1 FROM cov WHERE cov.a <= s.t - {_WINDOW} AND cov.b >= s.t + {_WINDOW}) THEN 'unknown'
           WHEN coalesce(bands, '') <> '' THEN 'elsewhere' ELSE 'none' END AS grade
    FROM s LEFT JOIN agg USING (spot_id) LEFT JOIN modal USING (spot_id))"""


@query(f"WITH {_GRADED} SELECT spot_id, call, band, grade, reports, skimmers, modal_freq, median_wpm, freq_offset, disagreements, bands FROM graded")
def grade_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)


@query(f"""WITH {_GRADED} SELECT band, CAST(grouping(band) AS INTEGER) AS total, count(*) AS spots, count(*) FILTER (grade = 'match') AS n_match, count(*) FILTER (grade = 'disagree') AS n_disagree,
  count(*) FILTER (grade = 'elsewhere') AS n_elsewhere, count(*) FILTER (grade = 'none') AS n_none, count(*) FILTER (grade = 'unknown') AS n_unknown, round(median(freq_offset), 6) AS median_offset
  FROM graded GROUP BY ROLLUP (band)""")
def grade_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.by_band(_graded(spark, sf_dir))


_REVERSE = f"""rev AS (SELECT r.r_id, r.call, r.r_band AS band, CASE max(CASE WHEN s.spot_id IS NULL THEN 0 WHEN s.band = r.r_band THEN 2 ELSE 1 END) WHEN 2 THEN 'found' WHEN 1 THEN 'elsewhere' ELSE 'missed' END AS grade
  FROM r LEFT JOIN s ON s.call = r.call AND s.t BETWEEN r.r_t - {_WINDOW} AND r.r_t + {_WINDOW} GROUP BY ALL)"""


@query(f"WITH {_GRADED}, {_REVERSE} SELECT r_id, call, band, grade FROM rev")
def grade_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, reports = _spots(spark, sf_dir)
    return grading.grade_reports(reports, spots, _WINDOW)


@query(f"""WITH {_GRADED}, {_REVERSE}, n AS (SELECT (SELECT count(*) FROM graded) AS spots, (SELECT count(*) FROM rev) AS reports,
    (SELECT count(*) FROM graded WHERE grade = 'match') AS hits, (SELECT count(*) FROM rev WHERE grade = 'found') AS found)
  SELECT spots, reports, round(hits / nullif(spots, 0), 6) AS "precision", round(found / nullif(reports, 0), 6) AS recall FROM n""")
def paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, reports = _spots(spark, sf_dir)
    return grading.score(_graded(spark, sf_dir), grading.grade_reports(reports, spots, _WINDOW))


@query(f"""WITH {EVENTS}, r AS (SELECT event_type AS archive, t FROM ev WHERE event_type <> 'purchase'),
  per AS (SELECT archive, t, CASE WHEN t - lag(t) OVER (PARTITION BY archive ORDER BY t) <= {_GAP} THEN 0 ELSE 1 END AS nw FROM r),
  isl AS (SELECT min(t) AS a, max(t) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY archive ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM per) GROUP BY archive, g),
  j AS (SELECT a, b, CASE WHEN a <= max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {_GAP} THEN 0 ELSE 1 END AS nw FROM isl)
  SELECT min(a) AS start, max(b) AS stop FROM (SELECT *, sum(nw) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM j) GROUP BY g""")
def coverage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.coverage(_spots(spark, sf_dir)[1], "r_t", _GAP, 64.0 * _WINDOW)


@query(f"""WITH {EVENTS}, p AS (SELECT s.event_id AS spot_id, r.event_id AS nearest_id, abs(s.t - r.t) AS dt, round(abs(s.value - r.value), 6) AS df
    FROM ev s JOIN ev r ON s.event_type = 'purchase' AND r.event_type = 'view' AND s.user_id = r.user_id AND abs(s.t - r.t) <= {2 * DAY})
  SELECT spot_id, nearest_id, dt, df FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY dt, df, nearest_id) AS rn FROM p) WHERE rn = 1""")
def nearest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, reports = _spots(spark, sf_dir)
    near = joins.nearest_join(spots, reports.where("archive = 'view'"), ["call"], "spot_id", "t", "r_t", 2 * DAY, [F.round(F.abs(F.col("freq") - F.col("r_freq")), 6), F.col("r_id")])
    return near.select("spot_id", F.col("r_id").alias("nearest_id"), F.abs(F.col("t") - F.col("r_t")).alias("dt"), F.round(F.abs(F.col("freq") - F.col("r_freq")), 6).alias("df"))


@query(f"""WITH {EVENTS}, s AS (SELECT * FROM ev WHERE event_type = 'purchase'), v AS (SELECT * FROM ev WHERE event_type = 'click')
  SELECT s.event_id AS spot_id, (SELECT arg_max(v.value, (v.t, v.event_id)) FROM v WHERE v.user_id = s.user_id AND v.t <= s.t) AS last_value,
  (SELECT arg_max(v.event_id, (v.t, v.event_id)) FROM v WHERE v.user_id = s.user_id AND v.t <= s.t) AS last_id FROM s""")
def asof_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user_id", F.col("t").alias("m_t"), F.col("value").alias("last_value"), F.col("event_id").alias("last_id"))
    found = joins.asof_backward(e.where("event_type = 'purchase'"), clicks, "user_id", "t", "m_t", ["last_value", "last_id"], "last_id")
    return found.select(F.col("event_id").alias("spot_id"), "last_value", "last_id")


def _match_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spots, reports = _spots(spark, sf_dir)
    return spots, reports.where("archive = 'signup'")


_MATCH = f"""WITH {EVENTS}, s AS (SELECT event_id, user_id, t, value FROM ev WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id, t, value FROM ev WHERE event_type = 'signup'),
  tp AS (SELECT DISTINCT s.event_id AS sid, r.event_id AS rid FROM s JOIN r ON s.user_id = r.user_id AND abs(s.t - r.t) <= {DAY} AND abs(s.value - r.value) <= 10)"""


@query(f"""{_MATCH} SELECT 'tp' AS outcome, (SELECT count(DISTINCT sid) FROM tp) AS n UNION ALL SELECT 'fp', (SELECT count(*) FROM s WHERE event_id NOT IN (SELECT sid FROM tp))
  UNION ALL SELECT 'fn', (SELECT count(*) FROM r WHERE event_id NOT IN (SELECT rid FROM tp))""")
def score_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, reports = _match_sides(spark, sf_dir)
    pairs = joins.band_join(spots, reports, ["call"], "t", "r_t", DAY).where(F.abs(F.col("freq") - F.col("r_freq")) <= 10).select("spot_id", "r_id")
    hit, met = pairs.select("spot_id").distinct(), pairs.select("r_id").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count("*").alias("n"))
    return count(hit, "tp").unionAll(count(spots.join(hit, "spot_id", "left_anti"), "fp")).unionAll(count(reports.join(met, "r_id", "left_anti"), "fn"))


@query(f"{_MATCH} SELECT event_id AS spot_id FROM s WHERE event_id NOT IN (SELECT s.event_id FROM s JOIN r ON s.user_id = r.user_id AND abs(s.t - r.t) <= {DAY})")
def uncorroborated_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, reports = _match_sides(spark, sf_dir)
    return joins.band_join(spots, reports, ["call"], "t", "r_t", DAY, "left_anti").select("spot_id")


@query(f"""WITH {EVENTS}, n AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS bin, count(DISTINCT event_type) AS archives FROM ev GROUP BY ALL HAVING count(DISTINCT event_type) >= 2)
  SELECT ev.event_id FROM ev JOIN n ON ev.user_id = n.user_id AND CAST(floor(ev.value) AS BIGINT) = n.bin""")
def corroborated_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("bin", F.floor("value"))
    bins = e.groupBy("user_id", "bin").agg(F.countDistinct("event_type").alias("archives")).where("archives >= 2")
    return e.join(bins, ["user_id", "bin"], "left_semi").select("event_id")


@query("""WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, n_chars FROM documents)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def full_outer_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("a"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("b"))
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return a.join(b, "doc_id", "full").select("doc_id", side.alias("side"))


@query("""SELECT lang AS stratum, count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (NOT a AND b) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither,
  CAST(grouping(lang) AS INTEGER) AS overall, round((count(*) FILTER (a OR b)) / count(*), 6) AS union_rate FROM (SELECT lang, quality = 1 AS a, toxic = 1 AS b FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang)""")
def pairing_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return aggregates.pairing_tally(rows, "lang", F.col("quality") == 1, F.col("toxic") == 1).withColumn("overall", F.col("overall").cast("int"))


def _poisson(draw: str) -> str:
    cuts, total, share = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += share
        cuts.append(f"WHEN {draw} < {total!r} THEN {k}")
        share /= k + 1
    return f"CASE {' '.join(cuts)} ELSE 8 END"


@query(f"""WITH c AS (SELECT doc_id % 200 AS cluster, sum(quality) AS hits, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY 1),
  d AS (SELECT *, CAST('0x' || substr(md5(CAST(cluster AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM c, (SELECT unnest(range(0, 200)) AS r)),
  q AS (SELECT list(rate ORDER BY rate) AS rates FROM (SELECT r, sum({_poisson("u")} * hits) / sum({_poisson("u")} * total) AS rate FROM d GROUP BY r))
  SELECT round(rates[6], 9) AS low, round(rates[195], 9) AS high, round((SELECT sum(hits) / sum(total) FROM c), 9) AS estimate FROM q""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    clusters = rows.groupBy(F.pmod("doc_id", F.lit(200)).alias("cluster")).agg(F.sum("quality").alias("hits"), F.count("*").alias("total"))
    found = aggregates.bootstrap_interval(clusters, "cluster", "hits", "total")
    return found.select(*[F.round(c, 9).alias(c) for c in ("low", "high", "estimate")])


@query("""WITH b AS (SELECT unnest([0, 1, 2, 3, 4]) AS bucket, unnest([5.0, 20.0, 60.0, 150.0, NULL]) AS bound), h AS (SELECT CASE WHEN value <= 5 THEN 0 WHEN value <= 20 THEN 1 WHEN value <= 60 THEN 2 WHEN value <= 150 THEN 3 ELSE 4 END AS bucket, count(*) AS n
  FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT CAST(b.bucket AS INTEGER) AS bucket, CAST(b.bound AS DOUBLE) AS bound, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bucket)""")
def histogram_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram_le(events(spark, sf_dir), "value", [5.0, 20.0, 60.0, 150.0])


_SKEW = f"""WITH {EVENTS}, per AS (SELECT user_id, count(*) AS n, median(value) AS med FROM ev GROUP BY user_id), g AS (SELECT user_id, n, med, CASE WHEN n >= 20 THEN 50 / sqrt(n) END AS err FROM per)"""


@query(f"{_SKEW} SELECT user_id, n, round(med, 6) AS median_value, round(err, 6) AS error FROM g")
def band_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skew(spark, sf_dir).select("user_id", "n", F.round("med", 6).alias("median_value"), F.round("err", 6).alias("error"))


def _skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.median("value").alias("med"))
    return per.withColumn("err", F.when(F.col("n") >= 20, 50 / F.sqrt("n")))


@query(f"{_SKEW} SELECT round(sum(med / (err * err)) / sum(1 / (err * err)), 6) AS pooled, round(1 / sqrt(sum(1 / (err * err))), 6) AS pooled_error FROM g WHERE err IS NOT NULL")
def skew_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.pooled(_skew(spark, sf_dir).where("err IS NOT NULL"), "med", "err")


@query(f"""WITH {EVENTS} SELECT event_type, count(*) AS n, round(median(value - 35), 6) AS median_off, round(median(abs(value - 35)), 6) AS median_abs, round(quantile_disc(abs(value - 35), 0.9), 6) AS p90_abs,
  round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM ev GROUP BY event_type""")
def offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.col("value") - 35
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.median(off), 6).alias("median_off"),
        F.round(F.median(F.abs(off)), 6).alias("median_abs"),
        F.round(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY abs(value - 35))"), 6).alias("p90_abs"),
        F.round(F.percentile("value", 0.25), 6).alias("q1"),
        F.round(F.percentile("value", 0.75), 6).alias("q3"),
    )


_STAGES = ("O", "P", "F")


@query("""WITH o AS (SELECT o_orderpriority AS spot_type, CASE WHEN o_totalprice < 100000 THEN 'lt15' WHEN o_totalprice < 300000 THEN '15to25' ELSE 'ge25' END AS bucket, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS reached FROM orders),
  c AS (SELECT spot_type, bucket, reached, count(*) AS lost FROM o GROUP BY ALL)
  SELECT spot_type, bucket, CAST(reached AS INTEGER) AS stage, lost AS lost_at, CAST(sum(lost) OVER (PARTITION BY spot_type, bucket ORDER BY reached DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passed FROM c""")
def loss_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    bucket = F.when(price < 100000, "lt15").when(price < 300000, "15to25").otherwise("ge25")
    stage = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    lost = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("spot_type"), bucket.alias("bucket"), stage.alias("stage")).agg(F.count("*").alias("lost_at"))
    later = Window.partitionBy("spot_type", "bucket").orderBy(F.desc("stage")).rowsBetween(Window.unboundedPreceding, 0)
    return lost.withColumn("passed", F.sum("lost_at").over(later))


@query(f"""WITH {EVENTS} SELECT user_id AS call, count(*) AS missed, string_agg(DISTINCT CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) AS bins
  FROM ev WHERE event_type = 'error' GROUP BY user_id""")
def missed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = F.array_join(F.array_sort(F.collect_set(F.floor(F.col("value") / 10).cast("string"))), ",")
    return events(spark, sf_dir).where("event_type = 'error'").groupBy(F.col("user_id").alias("call")).agg(F.count("*").alias("missed"), bins.alias("bins"))


