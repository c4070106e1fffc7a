"""Queries that score runs against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators import scoring
from spotlake.plans.registry import DAY, EVENTS, HOUR, events, query, table
from spotlake.sources import sinks

_POINT = f"""{EVENTS}, st AS (SELECT event_id AS s_id, user_id AS call, value AS freq, CASE WHEN k % 4 = 0 THEN NULL ELSE k / 300.0 END AS cer, user_id % 10 AS point FROM ev WHERE event_type = 'signup'),
  sp AS (SELECT user_id AS call, value AS s_freq, event_id % 3 AS trial, k AS snr, user_id % 10 AS point FROM ev WHERE event_type = 'view'),
  h AS (SELECT s_id, count(*) AS spots, avg(snr) AS snr FROM st JOIN sp ON st.call = sp.call AND abs(freq - s_freq) <= 5.005 GROUP BY s_id),
  bog AS (SELECT point, trial, call FROM sp WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.call = sp.call AND abs(freq - s_freq) <= 5.005))"""


@query(f"""WITH {_POINT}, sc AS (SELECT point, count(*) AS stations, count(*) FILTER (spots IS NOT NULL) AS spotted, round(avg(coalesce(cer, 1.0)), 6) AS cer_mean, count(*) FILTER (coalesce(cer, 1.0) < 0.1) AS good, round(avg(snr), 6) AS spot_snr FROM st LEFT JOIN h USING (s_id) GROUP BY point),
  bg AS (SELECT point, CAST(sum(n) AS BIGINT) AS bogus FROM (SELECT point, trial, count(DISTINCT call) AS n FROM bog GROUP BY ALL) GROUP BY point)
  SELECT sc.*, coalesce(bogus, 0) AS bogus FROM sc LEFT JOIN bg USING (point)""")
def sensitivity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("point", F.col("user_id") % 10)
    stations = e.where("event_type = 'signup'").select(F.col("event_id").alias("s_id"), F.col("user_id").alias("call"), F.col("value").alias("freq"), F.when(F.col("k") % 4 != 0, F.col("k") / 300.0).alias("cer"), "point")
    spots = e.where("event_type = 'view'").select(F.col("user_id").alias("call"), F.col("value").alias("s_freq"), (F.col("event_id") % 3).alias("trial"), F.col("k").alias("snr"), F.col("point").alias("s_point"))
    per_station, bogus = scoring.station_scores(stations, spots, 5.005)
    return scoring.point_summary(per_station, bogus.withColumnRenamed("s_point", "point"), "point")


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, count(*) AS spots, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS precision_, count(DISTINCT k) AS recall FROM ev GROUP BY user_id)
  SELECT user_id, concat_ws(',', CASE WHEN spots < 60 THEN 'spots' END, CASE WHEN precision_ < 0.8 THEN 'accuracy' END, CASE WHEN recall < 45 THEN 'recall' END) AS failed, spots >= 60 AND precision_ >= 0.8 AND recall >= 45 AS passed FROM m""")
def floor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    metrics = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("spots"), F.round(F.avg(right), 6).alias("accuracy"), F.countDistinct("k").alias("recall"))
    floors = metrics.select("user_id", F.lit(60).alias("min_spots"), F.lit(0.8).alias("min_accuracy"), F.lit(45).alias("min_recall"))
    return scoring.against_floors(metrics, floors, "user_id", ["spots", "accuracy", "recall"]).select("user_id", "failed", "passed")


@query(f"""WITH {EVENTS}, s AS (SELECT event_type AS variant, min(value) AS low, round(median(value), 6) AS median, round(max(value) / min(value), 6) AS spread FROM ev GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY median, variant) AS INTEGER) AS place FROM s""")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.build_summary(events(spark, sf_dir).withColumnRenamed("event_type", "variant"), "variant", "value")


@query("""WITH p AS (SELECT c_custkey AS p_id, c_acctbal AS low, c_acctbal + 500 AS high FROM customer), a AS (SELECT n_nationkey * 400.0 - 1000 AS a_low, n_nationkey * 400.0 - 800 AS a_high FROM nation)
  SELECT p_id, CAST(greatest(low, coalesce(a_low, low)) AS DOUBLE) AS low, CAST(least(high, coalesce(a_high, high)) AS DOUBLE) AS high FROM p LEFT JOIN a ON a_low < high AND a_high > low""")
def decodable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    passbands = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("p_id"), F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + 500).alias("high"))
    allocations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * F.lit(400.0) - 1000).alias("a_low"), (F.col("n_nationkey") * F.lit(400.0) - 800).alias("a_high"))
    return scoring.segments(passbands, allocations, 500.0)


@query(f"WITH {EVENTS} SELECT CAST(t // {6 * HOUR} AS BIGINT) AS slot, count(*) AS n, count(*) >= 8 AS complete FROM ev GROUP BY 1")
def cycle_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.slots(events(spark, sf_dir), "t", 6 * HOUR, 8)


@query("SELECT conv_id, right(string_agg(text, ' ' ORDER BY turn), 128) AS tail FROM conversations GROUP BY conv_id")
def text_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.text_tails(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 128)


@query(f"WITH {EVENTS} SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(value - 35), 6), event_id) AS rank FROM ev WHERE k BETWEEN 20 AND 80) WHERE rank <= 3")
def calibration_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = events(spark, sf_dir).where("k BETWEEN 20 AND 80").withColumn("distance", F.round(F.abs(F.col("value") - 35), 6))
    return scoring.best_references(usable, "user_id", "distance", "event_id", 3).select("user_id", "event_id", "rank")


@query(f"""WITH {EVENTS} SELECT event_type, count(*) AS n, count(DISTINCT k) AS glyphs, min(value) AS low, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS high, CAST(count(*) FILTER (k >= 50) AS BIGINT) AS strong FROM ev GROUP BY event_type""")
def event_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "value"
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("k").alias("glyphs"), F.min(v).alias("low"), F.round(F.median(v), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("high"), F.count_if(F.col("k") >= 50).alias("strong")
    )


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, CAST(t // {DAY} AS BIGINT) AS day, count(*) AS n FROM ev GROUP BY ALL) SELECT 'spots_total{{day="' || CAST(day AS VARCHAR) || '",type="' || event_type || '"}} ' || CAST(n AS VARCHAR) AS value FROM m""")
def metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy(F.col("event_type").alias("type"), F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
    return sinks.metric_text(counts, "spots_total", F.col("n"), ["day", "type"])
