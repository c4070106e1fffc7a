"""Queries of messages on the wire, of noise levels and of crashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import text as T
from spotlake.operators import gates, noise
from spotlake.plans.registry import EVENTS, HOUR, events, query
from spotlake.plans.rules import _ALIASES, _aliases
from spotlake.plans.spectra import _ROWS, _spectra
from spotlake.plans.texts import _CALLS, _calls
from spotlake.sources import sinks


@query(f"""WITH {_CALLS}, {_ALIASES}, parts AS (SELECT call, unnest(range(1, length(call) + 1)) AS n FROM (SELECT DISTINCT call FROM c)),
  best AS (SELECT call, arg_max(dxcc, n) AS dxcc, arg_max(continent, n) AS continent, arg_max(zone, n) AS zone FROM parts JOIN ta ON prefix = substr(call, 1, n)
    AND (NOT exact OR n = length(call) OR n = CASE WHEN regexp_matches(call, '/(P|QRP|MM|AM|M|[0-9])$') THEN length(split_part(call, '/', 1)) ELSE length(call) END) GROUP BY call)
  SELECT c.event_id, 'W3XYZ-1:7:' || CAST(user_id AS VARCHAR) || ':' || CAST(t AS VARCHAR) || ':' || c.call AS id, CAST(7000000 + k * 1000 AS BIGINT) AS frequency, coalesce(dxcc, -1) AS dxcc, coalesce(continent, '') AS continent, CAST(round(value) AS INTEGER) AS snr, CAST(k AS INTEGER) AS wpm, c.event_id AS seq, 30 AS keys
  FROM c LEFT JOIN best ON c.call = best.call""")
def spot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, read back: every event as a spot."""
    spots = _calls(spark, sf_dir).select(
        F.col("call").alias("callsign"), (7_000_000 + F.col("k") * 1000).cast("double").alias("freq_hz"), F.col("value").alias("snr_db"), F.col("k").alias("wpm"), F.lit(None).cast("double").alias("baud"), F.lit("599").alias("rst"), F.lit(False).alias("qrl"),
        F.col("user_id").alias("track_id"), F.col("t").alias("sample_ts"), F.lit(0.9).alias("confidence"), F.floor(F.col("t") / 1_000_000).alias("time"), F.col("event_id").alias("seq"),
    )
    value = F.col("value")
    said = sinks.spot_messages(spots, _aliases(spark, sf_dir), "W3XYZ-1", "7", "1", "FN20xr")
    get = lambda path, kind: F.get_json_object(value, f"$.{path}").cast(kind)
    return said.select(
        get("seq", "long").alias("event_id"), get("id", "string").alias("id"), get("frequency", "long").alias("frequency"), get("dxDxcc", "long").alias("dxcc"), get("dxContinent", "string").alias("continent"),
        get("snr", "int").alias("snr"), get("wpm", "int").alias("wpm"), get("seq", "long").alias("seq"), F.json_object_keys(value).alias("k"),
    ).withColumn("keys", F.size("k")).drop("k")


@query(f"""WITH RECURSIVE {EVENTS}, g AS (SELECT event_id, user_id, t, 20 + length(event_type) + k % 50 AS size, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev),
  w AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(-1 AS BIGINT) AS datagram, CAST(401 AS BIGINT) AS used FROM (SELECT DISTINCT user_id FROM g)
    UNION ALL SELECT w.user_id, g.rn, g.event_id, CASE WHEN used + size > 400 THEN datagram + 1 ELSE datagram END, CASE WHEN used + size > 400 THEN 16 + CASE WHEN datagram + 1 < 3 THEN 100 ELSE 0 END ELSE used END + size FROM w JOIN g ON g.user_id = w.user_id AND g.rn = w.rn + 1)
  SELECT user_id, event_id, datagram FROM w WHERE rn > 0""")
def packed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = 20 + F.length("event_type") + F.col("k") % 50
    return sinks.packed(events(spark, sf_dir), ["user_id"], "t", "event_id", size, 400, 16, 100).select("user_id", "event_id", "datagram")


@query(f"""WITH {EVENTS}, g AS (SELECT event_id, t // {HOUR} AS h, row_number() OVER (PARTITION BY t // {HOUR} ORDER BY t, event_id) AS rn FROM ev WHERE event_type IN ('click', 'signup')) SELECT event_id, CAST(h AS BIGINT) AS hour FROM g WHERE rn <= 3""")
def uplinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forwarded types under a ceiling of three an hour."""
    kept = gates.rate_limit(events(spark, sf_dir).where(F.col("event_type").isin("click", "signup")), [], "t", "event_id", HOUR, 3).where("allowed")
    return kept.select("event_id", F.floor(F.col("t") / HOUR).alias("hour"))


@query(f"""WITH RECURSIVE {_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY hop) AS rn FROM s), w AS (SELECT channel, rn, hop, power AS x FROM o WHERE rn = 1
    UNION ALL SELECT o.channel, o.rn, o.hop, x + {noise.ALPHA!r}::DOUBLE * (power - x) FROM w JOIN o ON o.channel = w.channel AND o.rn = w.rn + 1)
  SELECT channel, hop, round({10 ** (noise.LEAST_DB / 10)!r}::DOUBLE * min(x) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS noise FROM w""")
def noise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.noise_levels(_spectra(spark, sf_dir), 100).select("channel", "hop", F.round("noise", 9).alias("noise"))


@query()
def crash_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra as levels, lifted for ten hops of every hundred."""
    lifted = F.col("db") + F.when(F.col("hop") % 100 >= 90, 40).otherwise(0)
    levels = _spectra(spark, sf_dir).groupBy("hop").agg(F.sort_array(F.collect_list(F.struct("channel", lifted.alias("x"))))["x"].alias("levels"))
    found = noise.crash_hops(levels.select(F.lit("a").alias("input"), "hop", "levels"), 5)
    return found.select("hop", F.round("lift", 6).alias("lift"), "crash", "run", "crashes")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 18000) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lon FROM customer), q AS (SELECT a.c_custkey, a.lat, a.lon, b.lat AS blat, b.lon AS blon FROM p a JOIN p b ON b.c_custkey = a.c_custkey + a.c_custkey % 2)
  SELECT c_custkey, floor(lat) = floor(blat) AND floor(lon / 2) = floor(blon / 2) AS held FROM q""")
def locator_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the square of their own, or of the next one's place."""
    place = lambda key: ((key * 7919 % 18000) / F.lit(100.0) - 90, (key * 104729 % 36000) / F.lit(100.0) - 180)
    key = F.col("c_custkey")
    other = key + key % 2
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    rows = rows.join(rows.select(key.alias("o")), F.col("o") == other)
    grid = F.substring(T.locator(*place(other)), 1, 4)
    return rows.select("c_custkey", T.in_locator(grid, *place(key)).alias("held"))
