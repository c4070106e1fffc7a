"""Queries of the rules beside grading: countries, shadow comparison, sequence and loss marks, planned outages, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import numeric
from spotlake.functions import text as T
from spotlake.operators import aggregates, country, joins, shadow, temporal, tracks, transcript
from spotlake.plans.registry import DAY, EVENTS, HOUR, events, query, table
from spotlake.plans.spectra import _ROWS, _spectra
from spotlake.plans.texts import _CALLS, _calls


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by one letter, suppliers' nations by two (starred where they owe), and some customers' whole calls."""
    letter = lambda n: F.char(F.lit(65) + (n % 26).cast("int"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select("n_nationkey", F.col("n_nationkey").cast("long").alias("dxcc"), F.col("r_name").alias("continent"), F.col("n_regionkey").cast("int").alias("zone"))
    first = place.select(letter(F.col("n_nationkey")).alias("prefix"), F.lit(False).alias("exact"), F.lit(False).alias("starred"), F.col("n_nationkey").cast("long").alias("o"), "dxcc", "continent", "zone")
    s = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    two = F.concat(letter(F.col("s_suppkey")), letter(F.floor(F.col("s_suppkey") / 26)))
    second = s.select(two.alias("prefix"), F.lit(False).alias("exact"), (F.col("s_acctbal") < 0).alias("starred"), (F.col("s_suppkey") + 1000).cast("long").alias("o"), "dxcc", "continent", "zone")
    c = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    whole = F.concat(letter(F.col("c_custkey")), letter(F.floor(F.col("c_custkey") / 26)), (F.col("c_custkey") % 10).cast("string"), F.lit("VIE"))
    third = c.select(whole.alias("prefix"), F.lit(True).alias("exact"), F.lit(False).alias("starred"), (F.col("c_custkey") + 1_000_000_000).cast("long").alias("o"), "dxcc", "continent", "zone")
    return country.tidy_aliases(first.unionByName(second).unionByName(third), "o")


_ALIASES = """
  pl AS (SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS dxcc, r_name AS continent, CAST(n_regionkey AS INTEGER) AS zone FROM nation JOIN region ON n_regionkey = r_regionkey),
  al AS (SELECT chr(65 + CAST(n_nationkey % 26 AS INTEGER)) AS prefix, false AS exact, false AS starred, CAST(n_nationkey AS BIGINT) AS o, dxcc, continent, zone FROM pl
    UNION ALL SELECT chr(65 + CAST(s_suppkey % 26 AS INTEGER)) || chr(65 + CAST((s_suppkey // 26) % 26 AS INTEGER)), false, s_acctbal < 0, s_suppkey + 1000, dxcc, continent, zone FROM supplier JOIN pl ON s_nationkey = n_nationkey
    UNION ALL SELECT chr(65 + CAST(c_custkey % 26 AS INTEGER)) || chr(65 + CAST((c_custkey // 26) % 26 AS INTEGER)) || CAST(c_custkey % 10 AS VARCHAR) || 'VIE', true, false, c_custkey + 1000000000, dxcc, continent, zone FROM customer JOIN pl ON c_nationkey = n_nationkey),
  ta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY starred DESC, CASE WHEN starred THEN -o ELSE o END) AS rn FROM al) WHERE rn = 1)"""


@query(f"""WITH {_CALLS}, {_ALIASES}, mc AS (SELECT event_id, CASE WHEN k % 13 = 0 THEN split_part(call, '/', 1) || '/MM' ELSE call END AS call FROM c),
  parts AS (SELECT call, unnest(range(1, length(call) + 1)) AS n FROM (SELECT DISTINCT call FROM mc)),
  best AS (SELECT call, arg_max(dxcc, n) AS dxcc, arg_max(continent, n) AS continent, arg_max(zone, n) AS zone FROM parts JOIN ta ON prefix = substr(call, 1, n)
    AND (NOT exact OR n = length(call) OR n = CASE WHEN regexp_matches(call, '/(P|QRP|MM|AM|M|[0-9])$') THEN length(split_part(call, '/', 1)) ELSE length(call) END) GROUP BY call)
  SELECT event_id, mc.call, CASE WHEN ends_with(mc.call, '/MM') THEN 0 ELSE coalesce(dxcc, -1) END AS dxcc, CASE WHEN ends_with(mc.call, '/MM') THEN '' ELSE coalesce(continent, '') END AS continent,
  CAST(CASE WHEN ends_with(mc.call, '/MM') THEN 0 ELSE coalesce(zone, 0) END AS INTEGER) AS zone FROM mc LEFT JOIN best ON mc.call = best.call""")
def call_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_sea = F.when(F.col("k") % 13 == 0, F.concat(F.substring_index("call", "/", 1), F.lit("/MM"))).otherwise(F.col("call"))
    return country.geography(_calls(spark, sf_dir).select("event_id", at_sea.alias("call")), _aliases(spark, sf_dir), "call")


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = events(spark, sf_dir).select("event_type", F.col("event_id").alias("id"), F.col("user_id").alias("call"), "t", F.col("value").alias("freq"), F.floor(F.col("t") / DAY).alias("day"))
    return [e.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view", "click")]


_SHADOW = f"""{EVENTS}, e AS (SELECT event_type, event_id AS id, user_id AS call, t, value AS freq, CAST(t // {DAY} AS BIGINT) AS day FROM ev),
  nd AS (SELECT * FROM e WHERE event_type = 'purchase'), pr AS (SELECT * FROM e WHERE event_type = 'view'), co AS (SELECT * FROM e WHERE event_type = 'click'),
  mp AS (SELECT nd.id, pr.id AS o_id, abs(nd.t - pr.t) AS dt, abs(nd.freq - pr.freq) AS df FROM nd JOIN pr ON nd.call = pr.call AND abs(nd.t - pr.t) <= {2 * DAY} AND abs(nd.freq - pr.freq) <= 15 AND abs(round_even(nd.freq / 10, 0) - round_even(pr.freq / 10, 0)) <= 1),
  mc AS (SELECT DISTINCT nd.id FROM nd JOIN co ON nd.call = co.call AND abs(nd.t - co.t) <= {2 * DAY} AND abs(nd.freq - co.freq) <= 15 AND abs(round_even(nd.freq / 10, 0) - round_even(co.freq / 10, 0)) <= 1),
  ou AS (SELECT nd.*, n.o_id AS nearest_id, CASE WHEN n.id IS NOT NULL THEN 'confirmed' WHEN mc.id IS NOT NULL THEN 'corroborated' ELSE 'uncorroborated' END AS outcome
    FROM nd LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dt, df, o_id) AS rn FROM mp) WHERE rn = 1) n ON nd.id = n.id LEFT JOIN mc ON nd.id = mc.id),
  he AS (SELECT pr.*, pr.id IN (SELECT o_id FROM mp) AS heard FROM pr)"""


@query(f"WITH {_SHADOW} SELECT id, outcome, nearest_id FROM ou")
def shadow_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadow.outcomes(*_sides(spark, sf_dir), 2 * DAY, 15.0, 10.0).select("id", "outcome", "nearest_id")


@query(f"""WITH {_SHADOW}, a AS (SELECT day, count(*) AS node_spots, count(*) FILTER (outcome = 'confirmed') AS confirmed, count(*) FILTER (outcome = 'corroborated') AS corroborated, count(*) FILTER (outcome = 'uncorroborated') AS uncorroborated FROM ou GROUP BY day),
  b AS (SELECT day, count(*) AS primary_spots, count(*) FILTER (heard) AS primary_heard FROM he GROUP BY day)
  SELECT day, coalesce(node_spots, 0) AS node_spots, coalesce(confirmed, 0) AS confirmed, coalesce(corroborated, 0) AS corroborated, coalesce(uncorroborated, 0) AS uncorroborated, coalesce(primary_spots, 0) AS primary_spots, coalesce(primary_heard, 0) AS primary_heard
  FROM a FULL JOIN b USING (day)""")
def shadow_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, primary, others = _sides(spark, sf_dir)
    return shadow.table_by(shadow.outcomes(node, primary, others, 2 * DAY, 15.0, 10.0), shadow.heard(primary, node, 2 * DAY, 15.0, 10.0), "day")


_SEQ = f"{EVENTS}, q AS (SELECT event_id, user_id, t, (k * 37) % 64 AS seq FROM ev), st AS (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM q), df AS (SELECT *, (seq - prev + 64) % 64 AS step FROM st)"


@query(f"""WITH {_SEQ} SELECT event_id, CASE WHEN prev IS NULL THEN 'first' WHEN step = 1 THEN 'next' WHEN seq = 0 THEN 'restart' WHEN step = 0 THEN 'repeat' WHEN step < 32 THEN 'lost' ELSE 'late' END AS verdict,
  CAST(CASE WHEN prev IS NOT NULL AND step > 1 AND step < 32 AND seq <> 0 THEN step - 1 ELSE 0 END AS BIGINT) AS lost FROM df""")
def sequence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = events(spark, sf_dir).withColumn("seq", F.col("k") * 37 % 64)
    return temporal.sequence_gaps(numbered, ["user_id"], "t", "event_id", "seq", 6).select("event_id", "verdict", "lost")


@query(f"""WITH {EVENTS}, s AS (SELECT event_id, user_id, t, k, CAST(count(*) FILTER (k >= 90) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM ev)
  SELECT event_id, segment, CAST(sum(CASE WHEN k < 90 THEN k ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock FROM s""")
def loss_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.loss_marks(events(spark, sf_dir), ["user_id"], "t", "event_id", "k", 90).select("event_id", "segment", "clock")


@query(f"""WITH {EVENTS}, d AS (SELECT *, CASE WHEN value >= 40 THEN true WHEN value < 15 THEN false END AS x FROM ev)
  SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), false) AS "on" FROM d""")
def rise_drop_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.hysteresis(events(spark, sf_dir), ["user_id"], "t", "event_id", "value", 40, 15).select("event_id", "on")


@query(f"WITH {EVENTS} SELECT event_id, CAST(row_number() OVER (PARTITION BY t // {HOUR} ORDER BY event_type = 'error', t, user_id, event_id) AS INTEGER) AS place FROM ev")
def resequenced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("batch", F.floor(F.col("t") / HOUR)).withColumn("closing", F.col("event_type") == "error")
    return temporal.resequenced(rows, ["batch"], "closing", "t", ["user_id", "event_id"]).select("event_id", "place")


_OUTAGES = f"""{EVENTS}, o AS (SELECT event_id AS o_id, user_id, t AS start, t + k * 600000000 AS stop FROM ev WHERE event_type = 'error'),
  p AS (SELECT user_id, t - {HOUR} AS a, t + {2 * HOUR} AS b FROM ev WHERE event_type = 'signup'),
  j AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM p),
  m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM j) GROUP BY user_id, isl)"""


@query(f"WITH {_OUTAGES} SELECT o_id, stop - start AS length, CAST(coalesce((SELECT sum(least(o.stop, m.b) - greatest(o.start, m.a)) FROM m WHERE m.user_id = o.user_id AND o.start < m.b AND m.a < o.stop), 0) AS BIGINT) AS excused FROM o")
def planned_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    outages = e.where("event_type = 'error'").select(F.col("event_id").alias("o_id"), "user_id", F.col("t").alias("start"), (F.col("t") + F.col("k") * 600_000_000).alias("stop"))
    planned = e.where("event_type = 'signup'").select("user_id", (F.col("t") - HOUR).alias("p_start"), (F.col("t") + 2 * HOUR).alias("p_stop"))
    return temporal.unplanned(outages, planned, ["user_id"], 6 * HOUR).select("o_id", (F.col("stop") - F.col("start")).alias("length"), "excused")


_AVAILABLE = f"""{EVENTS}, sp AS (SELECT user_id, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS stop, event_type <> 'error' AS up FROM ev),
  st AS (SELECT *, stop - start AS length, CASE WHEN stop - start > {3 * DAY} THEN 'unobserved' WHEN up THEN 'up' ELSE 'down' END AS state FROM sp WHERE stop IS NOT NULL),
  pw AS (SELECT user_id, t - {6 * HOUR} AS a, t + {12 * HOUR} AS b FROM ev WHERE event_type = 'signup'), pj AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM pw),
  pm AS (SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM pj) GROUP BY user_id, g),
  ex AS (SELECT st.user_id, sum(least(stop, b) - greatest(start, a)) AS excused FROM st JOIN pm ON st.user_id = pm.user_id AND state = 'down' AND start < b AND a < stop GROUP BY st.user_id),
  tt AS (SELECT st.user_id, coalesce(sum(length) FILTER (state = 'up'), 0) AS up, coalesce(sum(length) FILTER (state = 'down'), 0) AS down, coalesce(sum(length) FILTER (state = 'unobserved'), 0) AS unobserved, coalesce(any_value(excused), 0) AS excused FROM st LEFT JOIN ex ON ex.user_id = st.user_id GROUP BY st.user_id)"""


@query(f"""WITH {_AVAILABLE} SELECT user_id, CAST(up AS BIGINT) AS up, CAST(down AS BIGINT) AS down, CAST(unobserved AS BIGINT) AS unobserved, CAST(excused AS BIGINT) AS excused, round(up / nullif(up + down - excused, 0), 6) AS availability,
  CASE WHEN coalesce((up + down - excused) / nullif(up + down - excused + unobserved, 0), 0) < 0.5 THEN 'unknown' WHEN up / nullif(up + down - excused, 0) >= 0.9 THEN 'pass' ELSE 'fail' END AS verdict FROM tt""")
def availability_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("up", F.col("event_type") != "error")
    planned = e.where("event_type = 'signup'").select("user_id", (F.col("t") - 6 * HOUR).alias("p_start"), (F.col("t") + 12 * HOUR).alias("p_stop"))
    return temporal.availability(e.select("user_id", "t", "event_id", "up"), planned, ["user_id"], "t", "event_id", "up", 3 * DAY, 0.5, 0.9)


@query(f"""WITH {EVENTS} SELECT user_id, count(*) FILTER (event_type <> 'error') AS n, CASE WHEN count(*) FILTER (event_type <> 'error') >= 5 THEN round(median(value) FILTER (event_type <> 'error'), 6) END AS median,
  round(max(value) FILTER (event_type <> 'error') - min(value) FILTER (event_type <> 'error'), 6) AS spread FROM ev GROUP BY user_id""")
def calibration_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.calibration(events(spark, sf_dir), ["user_id"], "value", F.col("event_type") != "error", 5)
    return found.select("user_id", "n", F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"))


@query(f"""WITH {EVENTS}, g AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (k >= 50) AS r, quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (k < 50) AS w FROM ev GROUP BY event_type)
  SELECT event_type, round(r[1], 6) AS right_q1, round(r[2], 6) AS right_q2, round(r[3], 6) AS right_q3, round(w[1], 6) AS wrong_q1, round(w[2], 6) AS wrong_q2, round(w[3], 6) AS wrong_q3, round(r[2] - w[2], 6) AS gap FROM g""")
def confidence_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.separation(events(spark, sf_dir), ["event_type"], "value", F.col("k") >= 50)
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in found.columns if c != "event_type"])


@query(f"WITH {_ROWS} SELECT hop, channel FROM (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY power DESC, channel) AS rn FROM s) WHERE rn > 48")
def evicted_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.capped(_spectra(spark, sf_dir), ["hop"], [F.desc("power"), F.col("channel")], 48).where("evicted").select("hop", "channel")


@query(f"""WITH {EVENTS} SELECT user_id, CAST(round_even(value / 10, 0) AS BIGINT) AS bin, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS ids FROM ev GROUP BY ALL""")
def truth_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = aggregates.bin_lists(events(spark, sf_dir), "user_id", "value", 10.0, ["t", "event_id"])
    return held.select("user_id", "bin", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 3)")
def outside_digital_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 3).alias("high"))
    return joins.outside_windows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), windows, "c_custkey", "c_acctbal", "low", "high", 3.0).select("c_custkey")


@query(f"WITH {_ROWS} SELECT CAST(hop // 60 AS BIGINT) AS second, channel, CASE WHEN power < 0.001 THEN 'floor' WHEN power > 0.05 THEN 'crash' ELSE 'guard' END AS veto, count(*) AS n FROM s WHERE power < 0.001 OR power > 0.05 OR channel >= 60 GROUP BY ALL")
def spawn_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"floor": F.col("power") < 0.001, "crash": F.col("power") > 0.05, "guard": ~tracks.in_band(F.col("channel"), (0, 60))}
    return tracks.veto_census(_spectra(spark, sf_dir), rules, "hop", "channel", 60)


@query("""SELECT conv_id, turn, contains(' ' || w || ' ', ' ' || c || ' ') AS as_word, contains(' ' || w || ' ', ' CQ ' || c || ' ') OR contains(' ' || w || ' ', ' DE ' || c || ' ') OR contains(' ' || w || ' ', ' TEST ' || c || ' ') AS framed, contains(replace(text, ' ', ''), c) AS inside
  FROM (SELECT conv_id, turn, text, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS w, chr(CAST(97 + conv_id % 26 AS INTEGER)) AS c FROM conversations)""")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.char((F.lit(97) + F.col("conv_id") % 26).cast("int"))
    as_word, framed, inside = T.text_score(call, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", as_word.alias("as_word"), framed.alias("framed"), inside.alias("inside"))


@query("""WITH p AS (SELECT c_custkey, CAST((c_custkey * 7919 % 18000) / 100.0 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 104729 % 36000) / 100.0 - 180 AS DOUBLE) AS lon FROM customer)
  SELECT c_custkey, round(floor((lat + 90) / 10) * 10 - 90 + floor((lat + 90) % 10.0) + (floor(((lat + 90) % 1.0) * 24) + 0.5) / 24, 6) AS lat,
  round(floor((lon + 180) / 20) * 20 - 180 + floor(((lon + 180) % 20.0) / 2) * 2 + (floor(((lon + 180) % 2.0) * 12) + 0.5) / 12, 6) AS lon FROM p""")
def locator_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat, lon = T.locator_centre(T.locator((key * 7919 % 18000) / F.lit(100.0) - 90, (key * 104729 % 36000) / F.lit(100.0) - 180))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN k < 10 OR value <= 0 THEN 0.3 ELSE round(greatest(sqrt(k) / value, 0.02), 9) END AS sigma, CAST(1000 + round(event_id * (1 + k * 1e-6)) AS BIGINT) AS common, CAST(floor(1700000000 + event_id / 375.0) AS BIGINT) AS unix,
  CASE WHEN k >= 1 THEN (k - 1) % 4 END AS input, CAST(value > 10 AS INTEGER) + CAST(value > 50 AS INTEGER) + CAST(k > 50 AS INTEGER) AS status,
  coalesce(regexp_extract(event_type || ' ur 5' || CAST(1 + k % 9 AS VARCHAR) || 'n tu', '5[1-9]n', 0), '') AS raw, '5' || CAST(1 + k % 9 AS VARCHAR) || '9' AS report FROM ev""")
def clock_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k, i = F.col("value"), F.col("k"), F.col("event_id")
    said = F.concat(F.col("event_type"), F.lit(" ur 5"), (1 + k % 9).cast("string"), F.lit("n tu"))
    return events(spark, sf_dir).select(
        "event_id",
        F.round(numeric.class_sigma(k, k, v, 10, F.lit(0.3)), 9).alias("sigma"),
        numeric.common_time(F.lit(1000), i, 1 + k * 1e-6).alias("common"),
        numeric.unix_of(F.lit(1_700_000_000), i, F.lit(375.0)).alias("unix"),
        numeric.input_of_track(k, 4).alias("input"),
        numeric.status_code([v > 10, v > 50, k > 50]).alias("status"),
        F.regexp_extract(said, "5[1-9]n", 0).alias("raw"),
        T.last_report(said).alias("report"),
    )


def _transcript(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Purchases and views as transcript words of six hours, clicks as words of a run, signups as spots; words are calls of users."""
    said = F.concat(F.lit("K"), (F.col("user_id") % 10).cast("string"), F.char((65 + F.col("user_id") % 26).cast("int")), F.char((65 + F.col("k") % 2).cast("int")))
    e = events(spark, sf_dir).withColumn("word", said)
    pitch = F.when(F.col("k") % 5 != 0, F.col("value"))
    rows = e.where("event_type IN ('purchase', 'view')").select(F.col("event_id").alias("row_id"), F.lit(0).alias("n"), F.col("t").alias("start"), (F.col("t") + 6 * HOUR).alias("stop"), pitch.alias("row_pitch"), "word")
    run = e.where("event_type = 'click'").select(F.col("event_id").alias("w_id"), "t", pitch.alias("pitch"), "word")
    spots = e.where("event_type = 'signup'").select(F.col("event_id").alias("s_id"), F.col("word").alias("call"), F.col("t").alias("s_t"), pitch.alias("pitch"))
    return rows, run, spots


_TRANSCRIPT = f"""{EVENTS}, e AS (SELECT *, 'K' || CAST(user_id % 10 AS VARCHAR) || chr(65 + CAST(user_id % 26 AS INTEGER)) || chr(65 + CAST(k % 2 AS INTEGER)) AS word, CASE WHEN k % 5 <> 0 THEN value END AS pitch FROM ev),
  tr AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY event_id) AS rn FROM e WHERE event_type IN ('purchase', 'view')),
  cs AS (SELECT word, list({{'id': event_id, 't': t, 'p': pitch}} ORDER BY t, event_id) AS cands FROM e WHERE event_type = 'click' GROUP BY word),
  w AS (SELECT word, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS w_id FROM (SELECT DISTINCT word FROM tr)
    UNION ALL SELECT word, rn, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, event_id, got FROM (
      SELECT tr.word, tr.rn, tr.event_id, w.used, list_filter(coalesce(cs.cands, []), lambda c: c.t >= tr.t - {HOUR} AND c.t <= tr.t + {7 * HOUR} AND (tr.pitch IS NULL OR coalesce(abs(c.p - tr.pitch) <= 30, false)) AND NOT list_contains(w.used, c.id))[1].id AS got
      FROM w JOIN tr ON tr.word = w.word AND tr.rn = w.rn + 1 LEFT JOIN cs ON cs.word = tr.word)),
  sm AS (SELECT DISTINCT s.event_id, s.word FROM e s JOIN tr ON s.event_type = 'signup' AND s.word = tr.word AND s.t >= tr.t - {HOUR} AND s.t <= tr.t + {7 * HOUR} AND (tr.pitch IS NULL OR coalesce(abs(s.pitch - tr.pitch) <= 30, false)))"""


@query(f"WITH RECURSIVE {_TRANSCRIPT} SELECT row_id, w_id FROM w WHERE w_id IS NOT NULL")
def transcript_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, run, _ = _transcript(spark, sf_dir)
    return transcript.word_matches(rows, run, HOUR, 30.0).select("row_id", "w_id")


@query(f"""WITH RECURSIVE {_TRANSCRIPT}, n AS (SELECT (SELECT count(*) FROM e WHERE event_type = 'signup') AS spots, (SELECT count(DISTINCT event_id) FROM sm) AS spots_matched, (SELECT count(DISTINCT word) FROM tr) AS transcript_calls,
    (SELECT count(DISTINCT word) FROM sm) AS calls_found, (SELECT count(*) FROM tr) AS transcript_words, (SELECT count(*) FROM w WHERE w_id IS NOT NULL) AS words_found)
  SELECT *, round(spots_matched / spots, 6) AS spot_precision, round(calls_found / transcript_calls, 6) AS call_recall, round(words_found / transcript_words, 6) AS word_recall FROM n""")
def transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.scores(*_transcript(spark, sf_dir), HOUR, 30.0, 8 * HOUR)
