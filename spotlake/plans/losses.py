"""Queries of the loss funnel and the windowed paired report: events as opportunities and as every kind of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators import funnel, grading
from spotlake.plans.registry import DAY, EVENTS, events, query
from spotlake.plans.reports import _BAND, _GAP, _STEP, _TOL, _WINDOW, BANDS, _spots

_TOLERANCES = funnel.Tolerances(track=0.5, spot=1.5, window=86_400.0, spot_window=86_400.0, half_channel=0.25)
_PASSBAND, _DURATION = (1.0, 140.0), 28 * 86_400.0
_REASONS = ("grammar", "blocklist", "repetition", "variant", "dedupe", "lookup_pending", None)


def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Purchases as opportunities, views as tracks with two speeds and a word each, errors as decisions and as vetoes, sign-ups as spots; ten users a call, seconds from the first event."""
    e = events(spark, sf_dir)
    first = F.broadcast(e.agg(F.min("t").alias("t0")))
    e = e.crossJoin(first).withColumn("s", (F.col("t") - F.col("t0")) / 1e6).withColumn("call", F.concat(F.lit("K"), (F.col("user_id") % 10).cast("string"), F.lit("AB"))).withColumn("freq", F.col("value"))
    kind = lambda k: e.where(F.col("event_type") == k)
    k, s = F.col("k"), F.col("s")
    view = kind("view")
    reason = F.get(F.array(*[F.lit(r) for r in _REASONS]), (k % 7).cast("int"))
    return {
        "ops": kind("purchase").select(F.col("event_id").alias("op_id"), "call", "freq", s.alias("first"), (s + k * 60).alias("last"), F.when(k % 5 != 0, k.cast("double")).alias("wpm")),
        "tracks": view.select(F.col("event_id").alias("track_id"), (F.col("freq") + k % 3).alias("spawn_freq"), "freq", s.alias("born"), F.when(k % 9 != 0, s + k * 600).alias("ended"), (k % 2 == 0).alias("confirmed"), (k % 3 > 0).alias("leased"), F.when(k % 9 != 0, F.when(k % 4 == 0, "merged").otherwise("hang_expired")).alias("closed")),
        "speeds": view.where("k % 8 <> 0").select(F.col("event_id").alias("track_id"), F.explode(F.array(F.struct(s.alias("s_t"), k.cast("double").alias("s_wpm")), F.struct((s + 90_000).alias("s_t"), (k * 0.5).alias("s_wpm")))).alias("x")).select("track_id", "x.*"),
        "words": view.select(F.col("event_id").alias("track_id"), s.alias("start"), (s + 60).alias("stop"), F.when(k % 2 == 0, F.col("call")).otherwise(F.concat(F.lit("X"), F.col("call"))).alias("word")),
        "decisions": kind("error").select(F.col("event_id").alias("d_id"), F.col("call").alias("d_call"), F.col("freq").alias("d_freq"), s.alias("d_t"), reason.alias("reason")),
        "spots": kind("signup").select(F.col("call").alias("sp_call"), F.col("freq").alias("sp_freq"), s.alias("sp_t")),
        "vetoes": kind("error").select(F.col("freq").alias("v_freq"), s.alias("v_t"), F.when(k % 3 == 0, "passband").when(k % 3 == 1, "crash").otherwise("owned").alias("veto"), (k % 3 == 0).alias("mask"), k.alias("n")),
    }


_W, _SW, _R, _S, _H = _TOLERANCES.window, _TOLERANCES.spot_window, _TOLERANCES.track + _TOLERANCES.half_channel, _TOLERANCES.spot, _TOLERANCES.half_channel
_EVIDENCE = f"""{EVENTS}, e AS (SELECT *, (t - (SELECT min(t) FROM ev)) / 1e6::DOUBLE AS s, 'K' || CAST(user_id % 10 AS VARCHAR) || 'AB' AS call, value AS freq FROM ev),
  op AS (SELECT event_id AS op_id, call, freq, CASE WHEN k % 5 <> 0 THEN k::DOUBLE END AS wpm, s - {_W / 2} AS lo, s + k * 60 + {_W / 2} AS hi, s - {_SW} AS slo, s + k * 60 + {_SW} AS shi FROM e WHERE event_type = 'purchase'),
  tr AS (SELECT event_id AS track_id, freq + k % 3 AS spawn_freq, freq AS t_freq, s AS born, CASE WHEN k % 9 <> 0 THEN s + k * 600 ELSE 'infinity'::DOUBLE END AS ended, k % 2 = 0 AS confirmed, k % 3 > 0 AS leased, CASE WHEN k % 9 <> 0 THEN CASE WHEN k % 4 = 0 THEN 'merged' ELSE 'hang_expired' END END AS closed, k, s,
    CASE WHEN k % 2 = 0 THEN call ELSE 'X' || call END AS word FROM e WHERE event_type = 'view'),
  hl AS (SELECT op.*, tr.* EXCLUDE (k) , tr.k AS tk FROM op JOIN tr ON (abs(spawn_freq - freq) <= {_R} OR abs(t_freq - freq) <= {_R}) AND born <= hi AND ended >= lo),
  sn AS (SELECT op_id, count(*) AS candidates, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (leased) AS leased, arg_max_null(closed, {{'c': confirmed, 'b': born, 'i': track_id}}) AS closed FROM hl GROUP BY op_id),
  tm AS (SELECT op_id, wpm, track_id, unnest([{{'t': s, 'w': tk::DOUBLE}}, {{'t': s + 90000, 'w': tk * 0.5}}]) AS x, lo, hi FROM hl WHERE leased AND tk % 8 <> 0),
  ti AS (SELECT *, bool_or(x.t BETWEEN lo AND hi) OVER (PARTITION BY op_id, track_id) AS near_some FROM tm),
  sp AS (SELECT op_id, coalesce(bool_or(wpm IS NULL OR abs(x.w - wpm) <= greatest(3.0, 0.2 * wpm)), false) AS timing FROM ti WHERE x.t BETWEEN lo AND hi OR NOT near_some GROUP BY op_id),
  tx AS (SELECT op_id, bool_or(word = call) AS text, bool_or(contains(word, call)) AS inside FROM op JOIN tr ON leased AND (abs(spawn_freq - freq) <= {_S} OR abs(t_freq - freq) <= {_S}) AND born <= shi AND ended >= slo AND s <= shi AND s + 60 >= slo GROUP BY op_id),
  dc AS (SELECT op_id, e.event_id, e.s, [{", ".join("NULL" if r is None else f"'{r}'" for r in _REASONS)}][e.k % 7 + 1] AS reason FROM op JOIN e ON event_type = 'error' AND e.call = op.call AND abs(e.freq - op.freq) <= {_S} AND e.s BETWEEN slo AND shi),
  dj AS (SELECT op_id, bool_or(reason IS NULL OR reason NOT IN ('grammar', 'blocklist')) AS self_id, bool_or(reason IS NULL OR reason IN ('dedupe', 'lookup_pending')) AS enough, arg_max(coalesce(reason, 'spotted'), {{'s': s, 'i': event_id}}) AS last_reason,
    arg_max(reason, {{'s': s, 'i': event_id}}) FILTER (reason IN ('repetition', 'variant')) AS lacking, arg_max(reason, {{'s': s, 'i': event_id}}) FILTER (reason IN ('blocklist', 'dedupe', 'lookup_pending')) AS withheld FROM dc GROUP BY op_id),
  em AS (SELECT op_id, count(*) AS n_spots FROM op JOIN e ON event_type = 'signup' AND e.call = op.call AND abs(e.freq - op.freq) <= {_S} AND e.s BETWEEN slo AND shi GROUP BY op_id),
  vt AS (SELECT op_id, CASE WHEN e.k % 3 = 0 THEN 'passband' WHEN e.k % 3 = 1 THEN 'crash' ELSE 'owned' END AS veto, sum(e.k) AS n FROM op JOIN e ON event_type = 'error' AND abs(e.freq - op.freq) <= {_R} AND e.s + 1 > lo AND e.s <= hi GROUP BY ALL),
  vj AS (SELECT op_id, bool_and(veto = 'passband') AS masked, arg_max(veto, {{'n': n, 'v': veto}}) FILTER (veto = 'passband') AS top_mask, arg_max(veto, {{'n': n, 'v': veto}}) FILTER (veto <> 'passband') AS top_veto FROM vt GROUP BY op_id),
  al AS (SELECT op.*, coalesce(candidates, 0) AS candidates, coalesce(confirmed, 0) AS confirmed, coalesce(leased, 0) AS leased, closed, sp.op_id IS NOT NULL AS has_speed, inside, last_reason, lacking, withheld, coalesce(n_spots, 0) AS n_spots, coalesce(masked, false) AS masked, top_mask, top_veto,
    CASE WHEN greatest(lo, 0) >= least(hi, {_DURATION}) THEN 'outside_recording' WHEN freq < {_PASSBAND[0] + _H} OR freq > {_PASSBAND[1] - _H} THEN 'outside_passband' END AS outside,
    CASE WHEN n_spots > 0 THEN 8 WHEN enough THEN 6 WHEN self_id THEN 5 WHEN text THEN 4 WHEN timing THEN 3 WHEN leased > 0 THEN 2 WHEN candidates > 0 THEN 1 ELSE 0 END AS place
    FROM op LEFT JOIN sn USING (op_id) LEFT JOIN sp USING (op_id) LEFT JOIN tx USING (op_id) LEFT JOIN dj USING (op_id) LEFT JOIN em USING (op_id) LEFT JOIN vj USING (op_id)),
  lo AS (SELECT *, CASE WHEN outside IS NOT NULL OR (place = 0 AND masked) THEN 0 ELSE place + 1 END AS lost FROM al)"""
_NAMES = "[" + ", ".join(f"'{s}'" for s in funnel.STAGES) + "]"


@query(f"""WITH {_EVIDENCE} SELECT op_id, CASE WHEN lost > 0 THEN {_NAMES}[place + 1] END AS reached, {_NAMES}[lost + 1] AS lost_at, CASE WHEN outside IS NOT NULL THEN outside WHEN lost = 0 THEN 'source_mask:' || top_mask
    WHEN lost = 1 THEN coalesce('refused_rise:' || top_veto, 'no_rise') WHEN lost = 2 THEN coalesce('closed:' || closed, 'open_at_end') WHEN lost = 3 THEN CASE WHEN has_speed THEN 'speed_off' ELSE 'no_speed' END
    WHEN lost = 4 THEN CASE WHEN inside THEN 'substring_only' ELSE 'no_call' END WHEN lost = 5 THEN CASE WHEN last_reason = 'blocklist' THEN 'policy:blocklist' WHEN last_reason <> 'spotted' THEN 'rejected:' || last_reason ELSE 'no_decision' END
    WHEN lost = 6 THEN coalesce(lacking, 'no_decision') WHEN lost = 7 THEN CASE WHEN withheld = 'blocklist' THEN 'policy:blocklist' ELSE coalesce(withheld, 'not_emitted') END END AS detail, candidates, confirmed, leased, n_spots FROM lo""")
def funnel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.attribute(**_evidence(spark, sf_dir), passband=_PASSBAND, duration=_DURATION, tol=_TOLERANCES)


_FROM = "(SELECT min(t) FROM ev)"
_LATER, _UNTIL = 5 * DAY, 20 * DAY


def _windowed(kept: str) -> str:
    """Spots and reports of the window only, graded as in _GRADED."""
    return f"""{EVENTS}, b AS (SELECT {_FROM} + {_LATER} AS a, {_FROM} + {_UNTIL} AS z), s AS (SELECT event_id AS spot_id, user_id AS call, t, value AS freq, k AS wpm, {_BAND} AS band FROM ev WHERE event_type = 'purchase'),
  r AS (SELECT event_id AS r_id, user_id AS call, t AS r_t, value AS r_freq, k AS r_wpm, {_BAND} AS r_band, event_type AS archive FROM ev WHERE event_type NOT IN ('purchase', 'error')),
  sw AS (SELECT s.* FROM s, b WHERE {kept.format("freq")} AND t >= a AND t < z), rw AS (SELECT r.* FROM r, b WHERE {kept.format("r_freq")} AND r_t >= a AND r_t < z)"""


@query(f"""WITH {_windowed("({0} BETWEEN 0 AND 40 OR {0} BETWEEN 70 AND 120)")},
  p AS (SELECT sw.*, r_freq, r_wpm, r_band, CASE WHEN band = 'unknown' THEN abs(freq - r_freq) <= {_TOL} ELSE band = r_band END AS same FROM sw JOIN r ON sw.call = r.call AND r_t BETWEEN t - {_WINDOW} AND t + {_WINDOW}),
  ag AS (SELECT spot_id, count(*) FILTER (same) AS n, count(*) AS every, median(r_wpm) FILTER (same) AS speed FROM p GROUP BY spot_id), ct AS (SELECT spot_id, round(r_freq / {_STEP}) * {_STEP} AS m, min(freq) AS freq, count(*) AS n FROM p WHERE same GROUP BY 1, 2),
  md AS (SELECT spot_id, m FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY n DESC, abs(m - freq), m) AS rn FROM ct) WHERE rn = 1),
  pe AS (SELECT archive, r_t, CASE WHEN r_t - lag(r_t) OVER (PARTITION BY archive ORDER BY r_t) <= {_GAP} THEN 0 ELSE 1 END AS nw FROM r), il AS (SELECT min(r_t) AS a, max(r_t) AS z FROM (SELECT *, sum(nw) OVER (PARTITION BY archive ORDER BY r_t ROWS UNBOUNDED PRECEDING) AS g FROM pe) GROUP BY archive, g),
  jn AS (SELECT a, z, CASE WHEN a <= max(z) OVER (ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {_GAP} THEN 0 ELSE 1 END AS nw FROM il), cv AS (SELECT min(a) AS a, max(z) AS z FROM (SELECT *, sum(nw) OVER (ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM jn) GROUP BY g),
  gr AS (SELECT band, CASE WHEN n > 0 AND coalesce(abs(freq - m) > {_TOL} OR abs(wpm - speed) > greatest(3.0, speed * 0.2), false) THEN 'disagree' WHEN n > 0 THEN 'match' WHEN NOT EXISTS (SELECT 1 FROM cv WHERE cv.a <= t - {_WINDOW} AND cv.z >= t + {_WINDOW}) THEN 'unknown' WHEN every > 0 THEN 'elsewhere' ELSE 'none' END AS grade
    FROM sw LEFT JOIN ag USING (spot_id) LEFT JOIN md USING (spot_id)),
  rv AS (SELECT rw.r_id, r_band AS band, max(CASE WHEN s.spot_id IS NULL THEN 0 WHEN s.band = r_band THEN 2 ELSE 1 END) AS best FROM rw LEFT JOIN s ON s.call = rw.call AND s.t BETWEEN r_t - {_WINDOW} AND r_t + {_WINDOW} GROUP BY ALL),
  al AS (SELECT band, 1 AS spots, grade, NULL AS best FROM gr UNION ALL SELECT band, 0, NULL, best FROM rv)
  SELECT band, CAST(grouping(band) AS INTEGER) AS total, CAST(sum(spots) AS BIGINT) AS spots, {", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g}" for g in ("match", "disagree", "elsewhere", "none", "unknown"))}, count(best) AS reports, count(*) FILTER (best = 2) AS found, count(*) FILTER (best = 1) AS reports_elsewhere,
    round(count(*) FILTER (best = 2) / nullif(count(best), 0), 6) AS recall, round(count(*) FILTER (grade IN ('elsewhere', 'none')) / nullif(count(*) FILTER (grade <> 'unknown'), 0), 6) AS candidate_false FROM al GROUP BY ROLLUP (band)""")
def paired_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passbands and fifteen days of the paired report; errors are reports of an excluded spotter."""
    spots, reports = _spots(spark, sf_dir)
    first = events(spark, sf_dir).agg(F.min("t")).first()[0]
    rules = {"window": _WINDOW, "freq_tol": _TOL, "speed_tol": 3, "speed_share": 0.2, "freq_step": _STEP, "join_gap": _GAP, "excluded": ("error",), "bands": BANDS}
    return grading.paired(spots, reports, rules, ((0.0, 40.0), (70.0, 120.0)), first + _LATER, first + _UNTIL)


