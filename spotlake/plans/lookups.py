"""Queries against reference lists: longest prefixes, memberships, ranges, and the ladder of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import numeric
from spotlake.operators import history, joins
from spotlake.plans.registry import EVENTS, events, query, table

_W = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {})"


def _lower_words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@query(f"""WITH d AS {_W.format('documents')}, p AS (SELECT word AS prefix FROM {_W.format('benchmark')} WHERE length(word) >= 2),
  parts AS (SELECT word, substr(word, 1, n) AS prefix, n FROM d, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS n)),
  best AS (SELECT word, arg_max(prefix, n) AS prefix FROM parts JOIN p USING (prefix) GROUP BY word)
  SELECT d.word, best.prefix FROM d LEFT JOIN best USING (word)""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _lower_words(spark, sf_dir, "benchmark").where(F.length("word") >= 2).withColumnRenamed("word", "prefix")
    return joins.longest_prefix(_lower_words(spark, sf_dir, "documents"), listed, "word", "prefix").select("word", "prefix")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)")
def listed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(listed, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey, upper(c_name) AS call FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)")
def blocklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(blocked, "c_nationkey", "left_anti").select("c_custkey", F.upper("c_name").alias("call"))


_NOTCH = "n AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 5 AS hi FROM supplier)"


@query(f"WITH {_NOTCH} SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM n WHERE c_acctbal BETWEEN lo AND hi)")
def notch_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.join(_in_notch(spark, sf_dir).select("c_custkey").distinct(), "c_custkey", "left_anti").select("c_custkey")


def _in_notch(spark: SparkSession, sf_dir: str) -> DataFrame:
    notches = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 5).alias("hi"))
    return joins.containment_join(table(spark, sf_dir, "customer"), notches, "c_acctbal", "lo", "hi", 5.0)


@query(f"WITH {_NOTCH} SELECT c_custkey, s_suppkey FROM customer JOIN n ON c_acctbal BETWEEN lo AND hi")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_notch(spark, sf_dir).select("c_custkey", "s_suppkey")


_BANDS = ((0.0, 100_000.0, "160m"), (100_000.0, 200_000.0, "80m"), (200_000.0, 300_000.0, "40m"))


@query("SELECT o_orderkey, band, CAST(CASE band WHEN '160m' THEN 0 WHEN '80m' THEN 1 WHEN '40m' THEN 2 ELSE 3 END AS INTEGER) AS rank FROM (SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 0 AND 100000 THEN '160m' WHEN o_totalprice BETWEEN 100000 AND 200000 THEN '80m' WHEN o_totalprice BETWEEN 200000 AND 300000 THEN '40m' ELSE 'unknown' END AS band FROM orders)")
def band_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = numeric.band_of(F.col("o_totalprice"), _BANDS)
    return table(spark, sf_dir, "orders").select("o_orderkey", band.alias("band"), numeric.band_rank(band, _BANDS).cast("int").alias("rank"))


@query(f"""WITH {EVENTS}, b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'error' AND value > 200)
  SELECT event_id, CASE WHEN b.user_id IS NOT NULL THEN 'blocklist' WHEN value BETWEEN 40 AND 45 THEN 'notch' WHEN k % 10 = 0 THEN 'grammar' WHEN ev.user_id % 11 = 0 THEN 'country' WHEN value < 1 THEN 'evidence' WHEN k < 30 AND event_type <> 'purchase' THEN 'repetitions' END AS reason,
  b.user_id IS NULL AND NOT (value BETWEEN 40 AND 45) AND k % 10 <> 0 AND ev.user_id % 11 <> 0 AND value >= 1 AND NOT (k < 30 AND event_type <> 'purchase') AS spotted FROM ev LEFT JOIN b ON ev.user_id = b.user_id""")
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    blocked = e.where("event_type = 'error' AND value > 200").select("user_id", F.lit(True).alias("blocked")).distinct()
    ladder = {
        "blocklist": F.coalesce("blocked", F.lit(False)),
        "notch": F.col("value").between(40, 45),
        "grammar": F.col("k") % 10 == 0,
        "country": F.col("user_id") % 11 == 0,
        "evidence": F.col("value") < 1,
        "repetitions": (F.col("k") < 30) & (F.col("event_type") != "purchase"),
    }
    return e.join(blocked, "user_id", "left").select("event_id", history.first_failing(ladder).alias("reason")).withColumn("spotted", F.col("reason").isNull())


@query(f"""WITH {EVENTS}, b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'error' AND value > 200)
  SELECT reason, count(*) AS n FROM (SELECT CASE WHEN b.user_id IS NOT NULL THEN 'blocklist' WHEN value BETWEEN 40 AND 45 THEN 'notch' WHEN k % 10 = 0 THEN 'grammar' WHEN ev.user_id % 11 = 0 THEN 'country' WHEN value < 1 THEN 'evidence' WHEN k < 30 AND event_type <> 'purchase' THEN 'repetitions' END AS reason
  FROM ev LEFT JOIN b ON ev.user_id = b.user_id) GROUP BY reason""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_ladder(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))
