"""Queries of schedules, summaries and small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import schedules
from spotlake.operators import summaries
from spotlake.plans.registry import EVENTS, HOUR, ORACLES, events, query, table
from spotlake.plans.spectra import _ROWS, _spectra
from spotlake.plans.timeline import respot_dedupe

_DAILY, _BASE = ((360, "day"), (1080, "night")), 1_704_067_200
_OVERRIDES = ((_BASE + 5 * 86_400, _BASE + 7 * 86_400 + 7200, "contest"), (_BASE + 40 * 86_400, _BASE + 41 * 86_400, "field"))
_CHANGES = ", ".join([f"u + CASE WHEN ({m * 60} - u % 86400 + 86400) % 86400 = 0 THEN 86400 ELSE ({m * 60} - u % 86400 + 86400) % 86400 END" for m, _ in _DAILY] + [f"CASE WHEN u < {t} THEN {t} ELSE {schedules.NEVER} END" for a, b, _ in _OVERRIDES for t in (a, b)])


@query(f"""WITH {EVENTS}, s AS (SELECT event_id, t // 1000000 AS u, k, value FROM ev) SELECT event_id, CASE {" ".join(f"WHEN u >= {a} AND u < {b} THEN '{n}'" for a, b, n in _OVERRIDES)} WHEN (u % 86400) // 60 >= 1080 THEN 'night' WHEN (u % 86400) // 60 >= 360 THEN 'day' ELSE 'night' END AS segments, CAST(least({_CHANGES}) AS BIGINT) AS changes,
  CASE WHEN k % 7 = 0 THEN 'no_reference' WHEN k % 5 = 0 THEN 'unsupported_rate' WHEN value >= 20 - 15 AND value + 3 <= 20 + 30 THEN 'inside' WHEN value + 3 > 20 - 15 AND value < 20 + 30 THEN 'partial' ELSE 'outside' END AS covered FROM s""")
def scheduled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k, v = F.floor(F.col("t") / 1_000_000), F.col("k"), F.col("value")
    covered = schedules.cycle_coverage(v, v + 3, F.when(k % 7 == 0, 0).otherwise(20), F.when(k % 5 == 0, 44_100).otherwise(96_000), (F.lit(-15), F.lit(40)), (F.lit(-20), F.lit(30)))
    return events(spark, sf_dir).select("event_id", schedules.active_segments(u, "base", _DAILY, _OVERRIDES).alias("segments"), schedules.next_change(u, _DAILY, _OVERRIDES).alias("changes"), covered.alias("covered"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND k < 5) AS spots, count(*) FILTER (event_type = 'view' AND k < 9) AS promoted, count(*) FILTER (event_type = 'click' AND k < 30) AS confirmed, max(CASE WHEN event_type = 'view' AND k < 9 AND value < 50 THEN value / 10 END) AS snr FROM ev GROUP BY user_id)
  SELECT user_id, CASE WHEN spots > 0 THEN 'decoding' WHEN promoted = 0 AND confirmed > 0 THEN 'not_cw' WHEN promoted = 0 THEN 'no_signal' WHEN snr > {summaries.NOISE_SNR_DB} THEN 'weak_no_decode' WHEN snr IS NOT NULL THEN 'noisy_no_decode' ELSE 'activity_no_snr' END AS verdict FROM g""")
def receiver_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    told = events(spark, sf_dir).groupBy("user_id").agg(F.count_if((kind == "purchase") & (k < 5)).alias("spots"), F.count_if((kind == "view") & (k < 9)).alias("promoted"), F.count_if((kind == "click") & (k < 30)).alias("confirmed"), F.max(F.when((kind == "view") & (k < 9) & (F.col("value") < 50), F.col("value") / 10)).alias("snr"))
    return told.select("user_id", summaries.receiver_verdict(F.col("spots"), F.col("promoted"), F.col("confirmed"), F.col("snr")).alias("verdict"))


@query(f"""WITH {EVENTS}, s AS (SELECT event_type AS stage, 'forced' AS reason, count(*) AS n, count(*) FILTER (value > 20) AS hits, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ev GROUP BY event_type),
  c AS (SELECT unnest([{", ".join(f"'{c}'" for c in summaries.CLOSINGS)}]) AS reason), e AS (SELECT [{", ".join(f"'{c}'" for c in summaries.CLOSINGS[:7])}][CAST(k % 7 AS INTEGER) + 1] AS reason FROM ev WHERE event_type = 'error')
  SELECT stage, reason, n, hits, rate FROM s UNION ALL SELECT 'closing', c.reason, count(e.reason), 0, 0 FROM c LEFT JOIN e ON e.reason = c.reason GROUP BY c.reason""")
def recovery_and_closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    forced = summaries.bypass_summary(e, "event_type", F.col("value") > 20).select(F.col("event_type").alias("stage"), F.lit("forced").alias("reason"), "n", F.col("recovered").alias("hits"), "rate")
    reason = F.get(F.array(*[F.lit(c) for c in summaries.CLOSINGS[:7]]), (F.col("k") % 7).cast("int"))
    closed = summaries.closing_counts(e.where("event_type = 'error'").withColumn("r", reason), "r")
    return forced.unionByName(closed.select(F.lit("closing").alias("stage"), "reason", "n", F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("rate")))


@query("""WITH s AS (SELECT s_suppkey AS station_id, s_acctbal AS freq, 'CQ ' || CAST(s_nationkey AS VARCHAR) || ' DE' AS expected FROM supplier), t AS (SELECT c_custkey AS start, c_acctbal AS t_freq, CASE WHEN c_custkey % 3 = 0 THEN 'CQ' ELSE CAST(c_nationkey AS VARCHAR) || ' DE' END AS text FROM customer),
  j AS (SELECT station_id, string_agg(text, ' ' ORDER BY start, text) AS text FROM s JOIN t ON abs(freq - t_freq) <= 150 GROUP BY station_id)
  SELECT s.station_id, coalesce(text, '') AS text, round(levenshtein(expected, trim(coalesce(text, ''))) / length(expected), 6) AS cer FROM s LEFT JOIN j USING (station_id)""")
def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_acctbal").alias("freq"), F.concat(F.lit("CQ "), F.col("s_nationkey").cast("string"), F.lit(" DE")).alias("expected"))
    text = F.when(F.col("c_custkey") % 3 == 0, "CQ").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(" DE")))
    tracks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("start"), F.col("c_acctbal").alias("t_freq"), text.alias("text"))
    return summaries.joined_text(stations, tracks, 150.0).withColumn("cer", F.round("cer", 6))


@query(f"""WITH {_ROWS}, t AS (SELECT hop, channel AS track, channel + (power * 100) % 1 - 0.5 AS c FROM s WHERE power > 0.02), p AS (SELECT hop, track, CASE WHEN c < 0 THEN c + 64 WHEN c >= 64 THEN c - 64 ELSE c END AS at FROM t)
  SELECT a.hop, a.track AS low, b.track AS high, round(least(abs(a.at - b.at), 64 - abs(a.at - b.at)), 6) AS apart FROM p a JOIN p b ON a.hop = b.hop AND a.track < b.track AND least(abs(a.at - b.at), 64 - abs(a.at - b.at)) <= 2.5""")
def track_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = F.col("channel") + (F.col("power") * 100) % 1 - 0.5
    tracks = _spectra(spark, sf_dir).where("power > 0.02").select("hop", F.col("channel").alias("track"), centre.alias("centre"))
    return summaries.neighbours(tracks, ["hop"], 64, 2.5).withColumn("apart", F.round("apart", 6))


_HEARD = "w AS (SELECT DISTINCT unnest(regexp_extract_all(upper(regexp_replace(text, '[^ -~]', ' ', 'g')), '[A-Z0-9]+')) AS word FROM benchmark UNION SELECT unnest(['CQ', 'TU', '73']))"


@query(f"""WITH {_HEARD}, h AS (SELECT word AS entry, count(*) AS n FROM (SELECT unnest(regexp_extract_all(upper(regexp_replace(text, '[^ -~]', ' ', 'g')), '[A-Z0-9]+')) AS word FROM documents) GROUP BY 1), m AS (SELECT DISTINCT word AS entry FROM (SELECT unnest(regexp_extract_all(upper(regexp_replace(text, '[^ -~]', ' ', 'g')), '[A-Z0-9]+')) AS word FROM conversations))
  SELECT word, round(least(greatest((CASE WHEN m.entry IS NOT NULL THEN 0.35 ELSE 0 END + coalesce(least(ln(1 + h.n) / ln(1001), 1) * 0.45, 0) + CASE WHEN a.p IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN word IN ({", ".join(f"'{x}'" for x in summaries.WORDS)}) THEN 0.1 ELSE 0 END) * 2, 0), 2), 6) AS bonus
  FROM w LEFT JOIN h ON h.entry = word LEFT JOIN m ON m.entry = word LEFT JOIN (SELECT DISTINCT chr(CAST(65 + n_nationkey % 26 AS INTEGER)) AS p FROM nation WHERE n_nationkey % 2 = 0) a ON a.p = word[1]""")
def word_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.upper(F.regexp_replace("text", "[^ -~]", " ")), F.lit("[A-Z0-9]+"), F.lit(0))).alias("entry"))
    words = said("benchmark").unionByName(spark.createDataFrame([("CQ",), ("TU",), ("73",)], "entry string")).distinct().withColumnRenamed("entry", "word")
    letters = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.char((65 + F.col("n_nationkey") % 26).cast("int")).alias("p")).distinct()
    allocated = words.join(letters, F.substring("word", 1, 1) == F.col("p")).select(F.col("word").alias("entry"))
    found = summaries.word_bonus(words, "word", said("conversations").distinct(), said("documents").groupBy("entry").count(), allocated, 2.0)
    return found.select("word", F.round("bonus", 6).alias("bonus"))


@query(f"""WITH {EVENTS}, m AS (SELECT event_id AS m_id, t // {15_000_000} * 15 AS slot, user_id % 4 AS input, CASE WHEN k % 2 = 0 THEN 'FT8' ELSE 'FT4' END AS mode, event_type AS band, k AS place, 'K' || CAST(user_id % 10 AS VARCHAR) || 'AB' AS caller, k % 4 AS form FROM ev),
  c AS (SELECT *, CASE WHEN form = 1 THEN 'FN42' END AS grid FROM m WHERE form <> 0), z AS (SELECT *, row_number() OVER (PARTITION BY caller, mode, band ORDER BY slot, input, place, m_id) AS rn FROM c),
  w AS (SELECT caller, mode, band, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS m_id, CAST(-1000000000000 AS BIGINT) AS held, false AS sent FROM (SELECT DISTINCT caller, mode, band FROM z)
    UNION ALL SELECT z.caller, z.mode, z.band, z.rn, z.m_id, CASE WHEN slot - held >= 86400 THEN slot ELSE held END, slot - held >= 86400 FROM w JOIN z ON z.caller = w.caller AND z.mode = w.mode AND z.band = w.band AND z.rn = w.rn + 1)
  SELECT z.m_id, z.slot, z.caller, z.grid, CAST(row_number() OVER (PARTITION BY z.slot ORDER BY input, z.mode, place, z.m_id) AS INTEGER) AS n FROM w JOIN z ON z.m_id = w.m_id AND sent""".replace("WITH", "WITH RECURSIVE", 1))
def cycle_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decoded messages, a quarter of them no call to all, a quarter with a square; held for a day."""
    k = F.col("k")
    call = F.concat(F.lit("K"), (F.col("user_id") % 10).cast("string"), F.lit("AB"))
    text = F.when(k % 4 == 0, F.concat(F.lit("K1ABC "), call, F.lit(" R-09"))).when(k % 4 == 1, F.concat(F.lit("CQ "), call, F.lit(" FN42"))).when(k % 4 == 2, F.concat(F.lit("CQ DX "), call)).otherwise(F.concat(F.lit("CQ "), call))
    messages = events(spark, sf_dir).select(F.col("event_id").alias("m_id"), (F.floor(F.col("t") / 15_000_000) * 15).alias("slot"), (F.col("user_id") % 4).alias("input"), F.when(k % 2 == 0, "FT8").otherwise("FT4").alias("mode"), F.col("event_type").alias("band"), text.alias("text"), k.alias("place"))
    return summaries.cycle_spots(messages, 86_400)


@query(f"""WITH {EVENTS} SELECT user_id, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t // {6 * HOUR} ORDER BY t DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1""")
def live_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.live_text(events(spark, sf_dir), ["user_id"], "t", "event_id", 6 * HOUR).select("user_id", "event_id", "k")


@query("""WITH f AS (SELECT DISTINCT substr(p_brand, 7, 1) || CAST(p_size AS VARCHAR) AS p FROM part), h AS (SELECT DISTINCT substr(p_brand, 7, 2) || CAST(p_size AS VARCHAR) AS p FROM part), c AS (SELECT DISTINCT '1' || CAST(n_nationkey AS VARCHAR) AS call FROM nation),
  x AS (SELECT min(call) AS missing FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE starts_with(call, p)))
  SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM h) AS n_held, missing, CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'empty' WHEN missing IS NOT NULL THEN 'canary' WHEN (SELECT count(*) FROM f) < (SELECT count(*) FROM h) * 0.9 THEN 'short' ELSE 'accepted' END AS verdict FROM x""")
def list_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    prefix = lambda n: F.concat(F.substring("p_brand", 7, n), F.col("p_size").cast("string")).alias("prefix")
    canaries = table(spark, sf_dir, "nation").select(F.concat(F.lit("1"), F.col("n_nationkey").cast("string")).alias("call")).distinct()
    return summaries.list_verdict(part.select(prefix(1)), part.select(prefix(2)), canaries)


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 5 < 2 THEN 'CW' END WHEN k % 5 >= 2 OR (CASE k % 5 WHEN 0 THEN 'CW' ELSE 'CW' END) = CASE k % 3 WHEN 1 THEN 'CW' ELSE 'RTTY' END THEN CASE k % 3 WHEN 1 THEN 'CW' ELSE 'RTTY' END ELSE 'none' END AS mode FROM ev""")
def modes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    listener = F.when(k % 3 == 1, "CW").when(k % 3 == 2, "RTTY")
    return events(spark, sf_dir).select("event_id", summaries.mode_shown(listener, F.when(k % 5 < 2, "CW")).alias("mode"))


@query(f"SELECT input, count(*) FILTER (outcome = 'other_input') AS withheld FROM (SELECT event_id % 2 AS input, outcome FROM ({ORACLES['respot_dedupe']})) GROUP BY input")
def withheld_by_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots of two inputs withheld because the other had sent them."""
    outcomes = respot_dedupe(spark, sf_dir).withColumn("input", F.col("event_id") % 2)
    return summaries.withheld_by_input(outcomes, "input")
