"""Queries over time: sessions, gates, history, counters and metric rules, with events as the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.operators import aggregates, gates, history, temporal
from spotlake.plans.registry import DAY, EVENTS, HOUR, events, query, table


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {12 * HOUR} THEN 1 ELSE 0 END AS nw FROM ev)
  SELECT event_id, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sessions(events(spark, sf_dir), ["user_id"], "t", "event_id", 12 * HOUR).select("event_id", F.col("session").cast("long").alias("session"))


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) > {2 * DAY} THEN 1 ELSE 0 END AS nw FROM ev),
  s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, event_type, min(t) AS start, max(t) AS stop, count(*) AS n, round(median(value), 6) AS median_value FROM s GROUP BY user_id, event_type, session""")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = temporal.sessions(events(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", 2 * DAY)
    grouped = split.groupBy("user_id", "event_type", "session")
    return grouped.agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median_value")).drop("session")


@query(f"WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW) AS reps FROM ev")
def trailing_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.trailing_count(events(spark, sf_dir), ["user_id"], "t", 2 * DAY, "reps").select("event_id", "reps")


@query(f"""WITH {EVENTS}, a AS (SELECT event_type, user_id, list(value ORDER BY t, event_id) AS v FROM ev GROUP BY ALL)
  SELECT event_type, user_id, round(list_reduce(v, lambda a, x: a + 0.0645 * (x - a)), 6) AS ema FROM a""")
def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("t", "event_id", "value")))["value"]
    grouped = events(spark, sf_dir).groupBy("event_type", "user_id").agg(ordered.alias("v"))
    return grouped.select("event_type", "user_id", F.round(temporal.smoothed(F.col("v"), 0.0645), 6).alias("ema"))


@query(f"""WITH {EVENTS}, f AS (SELECT user_id, t, value > 20 AS over FROM ev), c AS (SELECT *, CASE WHEN over = lag(over) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS nw FROM f),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT user_id, min(t) AS "first", max(t) AS "last", count(*) AS n FROM g WHERE over GROUP BY user_id, run HAVING max(t) - min(t) >= {2 * DAY}""")
def held_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = events(spark, sf_dir).select("user_id", "t", (F.col("value") > 20).alias("over"))
    return temporal.held_for(flagged, ["user_id"], "t", "over", 2 * DAY)


@query("""WITH i AS (SELECT o_orderpriority AS k, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 3600000000 * (o_orderkey % 5) AS b FROM orders),
  j AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM i),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM j) SELECT k, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY k, isl""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), a.alias("a"), (a + HOUR * (F.col("o_orderkey") % 5)).alias("b"))
    return temporal.merge_intervals(rows, ["k"], "a", "b")


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev),
  w AS (SELECT user_id, rn, event_id, t AS last, true AS admitted FROM r WHERE rn = 1
    UNION ALL SELECT r.user_id, r.rn, r.event_id, CASE WHEN r.t - w.last >= {DAY} THEN r.t ELSE w.last END, r.t - w.last >= {DAY} FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
  SELECT event_id, admitted FROM w""")
def greedy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.greedy_gate(events(spark, sf_dir), ["user_id"], "t", "event_id", DAY).select("event_id", "admitted")


_ROW_BY_ROW = f"""WITH RECURSIVE {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn, event_id % 2 AS src, round_even(value / 30, 0) AS own,
  round_even(value / 30, 0) + CASE WHEN value / 30 > round_even(value / 30, 0) THEN 1 ELSE -1 END AS beside FROM ev)"""


@query(f"""{_ROW_BY_ROW}, w AS (
    SELECT user_id, rn, event_id, 'new' AS outcome, [{{'b': own, 't': t, 'f': value, 'snr': k, 'kind': event_type, 'src': src}}] AS c FROM r WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, outcome, CASE WHEN outcome IN ('new', 'changed') THEN list_append(list_filter(c, lambda e: e.b <> own), {{'b': own, 't': t, 'f': value, 'snr': k, 'kind': event_type, 'src': src}}) ELSE c END AS c FROM (
      SELECT *, CASE WHEN o.src <> src OR g.src <> src THEN 'other_input' WHEN l IS NULL THEN 'new' WHEN k - l.snr < 6 AND event_type = l.kind THEN 'duplicate' ELSE 'changed' END AS outcome FROM (
        SELECT *, CASE WHEN o IS NULL OR g.t > o.t THEN g ELSE o END AS l FROM (
          SELECT r.*, w.c, list_filter(w.c, lambda e: e.b = r.own AND r.t - e.t < {2 * DAY})[1] AS o, list_filter(w.c, lambda e: e.b = r.beside AND r.t - e.t < {2 * DAY} AND abs(e.f - r.value) < 9.4)[1] AS g
          FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1))))
  SELECT event_id, outcome FROM w""")
def respot_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("input", F.col("event_id") % 2)
    return gates.respot_dedupe(e, "user_id", "t", "event_id", "value", "k", "event_type", "input", 2 * DAY, 30.0, 9.4).select("event_id", "outcome")


@query(f"""{_ROW_BY_ROW}, w AS (
    SELECT user_id, rn, event_id, [{{'t': t, 'k': k}}] AS c FROM r WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, CASE WHEN len(f) = 0 OR abs(k - f[-1].k) >= 3 OR t - f[-1].t >= {2 * DAY} THEN list_append(f, {{'t': t, 'k': k}}) ELSE f END AS c FROM (
      SELECT r.*, list_filter(w.c, lambda x: r.t - x.t <= {3 * DAY}) AS f FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1))
  SELECT event_id, CAST(len(c) AS INTEGER) AS repetitions FROM w""")
def repetition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.message_repetitions(events(spark, sf_dir), ["user_id"], "t", "event_id", "k", 3 * DAY, 3, 2 * DAY).select("event_id", "repetitions")


@query(f"WITH {EVENTS} SELECT event_id, row_number() OVER (PARTITION BY user_id, t // {DAY} ORDER BY t, event_id) <= 2 AS allowed FROM ev")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.rate_limit(events(spark, sf_dir), ["user_id"], "t", "event_id", DAY, 2).select("event_id", "allowed")


@query(f"WITH {EVENTS} SELECT event_id, t, value FROM ev WHERE event_type IN ('purchase', 'view') AND value >= 30 ORDER BY event_id DESC LIMIT 10")
def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = history.spot_filter(F.col("event_type"), F.col("value"), F.col("event_type"), ("purchase", "view"), 30)
    return history.newest(events(spark, sf_dir), "event_id", 10, keep).select("event_id", "t", "value")


def _with_now(e: DataFrame) -> DataFrame:
    """events with now: the latest time, a one-row aggregate inside the plan."""
    return e.crossJoin(F.broadcast(e.agg(F.max("t").alias("now"))))


@query(f"WITH {EVENTS} SELECT event_id FROM ev WHERE t > (SELECT max(t) FROM ev) - {DAY} AND t <= (SELECT max(t) FROM ev)")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.within(_with_now(events(spark, sf_dir)), "t", F.col("now"), DAY).select("event_id")


@query(f"""WITH {EVENTS} SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev)
  WHERE rn <= 40 AND (rn <= 5 OR t >= (SELECT max(t) FROM ev) - {5 * DAY})""")
def history_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retained(_with_now(events(spark, sf_dir)), ["user_id"], "event_id", "t", F.col("now"), 5 * DAY, 5, 40).select("event_id")


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, CASE WHEN k % 5 = 0 THEN NULL ELSE event_id - k END AS since, event_type <> 'error' AS known, event_id AS upto, event_id - 50 AS held FROM ev)
  SELECT upto AS event_id, CASE WHEN since IS NULL THEN 'no_request' WHEN NOT known OR since > upto THEN 'reset' WHEN since + 1 < held THEN 'gap' ELSE 'resumed' END AS outcome FROM c""")
def resume_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.when(F.col("k") % 5 != 0, F.col("event_id") - F.col("k"))
    outcome = history.resume_outcome(F.col("event_type") != "error", since, F.col("event_id"), F.col("event_id") - 50)
    return events(spark, sf_dir).select("event_id", outcome.alias("outcome"))


@query(f"WITH {EVENTS} SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM ev) WHERE n > 5")
def unique_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.occurrences(events(spark, sf_dir), ["user_id", "event_type"], "event_id").where("occurrence > 5").select("event_id")


@query(f"WITH {EVENTS} SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS rn FROM ev) WHERE rn = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.struct("event_id", "value"), F.struct("t", "event_id")).alias("f")
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", "f.event_id", "f.value")


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN prev IS NULL THEN 0 ELSE l_linenumber - prev - 1 END AS INTEGER) AS lost FROM
  (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    last = F.lag("l_linenumber").over(temporal.by(["l_orderkey"], "l_linenumber"))
    return rows.withColumn("lost", F.coalesce(F.col("l_linenumber") - last - 1, F.lit(0)))


_COUNTER = f"{EVENTS}, c AS (SELECT user_id, t, event_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev)"


@query(f"WITH {_COUNTER} SELECT event_id, CAST(CASE WHEN p IS NULL THEN 0 ELSE greatest(k - p, 0) END AS BIGINT) AS delta FROM c")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.counter_delta(events(spark, sf_dir), ["user_id"], "t", "event_id", "k").select("event_id", "delta")


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, t, k, lag(k) OVER (PARTITION BY user_id ORDER BY t) AS p FROM ev)
  SELECT user_id, CAST(t // {DAY} AS BIGINT) AS day, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END) AS BIGINT) AS increase, round(sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END) / 86400.0 * 60, 6) AS per_minute FROM c GROUP BY ALL""")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = temporal.counter_increase(events(spark, sf_dir), ["user_id"], "t", "k")
    grouped = grown.groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum("increase").alias("increase"))
    return grouped.withColumn("per_minute", F.round(F.col("increase") / 86400.0 * 60, 6))


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS changed FROM ev) SELECT user_id, CAST(count(*) FILTER (changed) AS BIGINT) AS changes FROM c GROUP BY user_id""")
def gauge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.col("event_type") != F.lag("event_type").over(temporal.by(["user_id"], "t", "event_id"))
    return events(spark, sf_dir).withColumn("c", changed).groupBy("user_id").agg(F.count_if("c").alias("changes"))


@query(f"""WITH {EVENTS}, b AS (SELECT event_type, unnest([0, 10, 25, 50, 100]) AS lo, unnest([10, 25, 50, 100, 'infinity'::DOUBLE]) AS hi FROM (SELECT DISTINCT event_type FROM ev)),
  h AS (SELECT b.event_type, lo, hi, count(ev.event_id) AS n FROM b LEFT JOIN ev ON ev.event_type = b.event_type AND (value > lo OR lo = 0) AND value <= hi GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY hi) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
  SELECT event_type, round(CASE WHEN isinf(hi) THEN lo ELSE lo + (hi - lo) * (0.9 * total - (cum - n)) / n END, 6) AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hi) AS rn FROM c WHERE cum >= 0.9 * total AND n > 0) WHERE rn = 1""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram_quantile(events(spark, sf_dir), ["event_type"], "value", [10.0, 25.0, 50.0, 100.0], 0.9, "p90").withColumn("p90", F.round("p90", 6))


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 5), b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'signup' AND value > 100), c AS (SELECT user_id FROM ev GROUP BY user_id HAVING max(k) < 99)
  SELECT user_id, n FROM a WHERE user_id NOT IN (SELECT user_id FROM b WHERE user_id IN (SELECT user_id FROM c))""")
def alert_unless(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    firing = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5")
    quiet = e.where("event_type = 'signup' AND value > 100").select("user_id").distinct().join(e.groupBy("user_id").agg(F.max("k").alias("m")).where("m < 99"), "user_id", "left_semi")
    return firing.join(quiet, "user_id", "left_anti")


@query(f"""WITH {EVENTS}, g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM ev)
  SELECT user_id, CAST(sum(CASE WHEN nx - t > {3 * DAY} THEN 0 WHEN event_type <> 'error' THEN nx - t ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN nx - t > {3 * DAY} THEN 0 WHEN event_type = 'error' THEN nx - t ELSE 0 END) AS BIGINT) AS down,
  CAST(sum(CASE WHEN nx - t > {3 * DAY} THEN nx - t ELSE 0 END) AS BIGINT) AS unobserved FROM g WHERE nx IS NOT NULL GROUP BY user_id""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("t").over(temporal.by(["user_id"], "t", "event_id"))
    spans = events(spark, sf_dir).withColumn("span", after - F.col("t")).where("span IS NOT NULL")
    state = F.when(F.col("span") > 3 * DAY, "unobserved").when(F.col("event_type") == "error", "down").otherwise("up")
    part = lambda s: F.sum(F.when(F.col("state") == s, F.col("span")).otherwise(0)).alias(s)
    return spans.withColumn("state", state).groupBy("user_id").agg(part("up"), part("down"), part("unobserved"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev) SELECT user_id, min(t) AS start, max(t) AS stop, max(gap) AS longest_silence FROM g GROUP BY user_id""")
def reference_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("t") - F.lag("t").over(temporal.by(["user_id"], "t", "event_id"))
    return events(spark, sf_dir).withColumn("gap", gap).groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.max("gap").alias("longest_silence"))


@query(f"""WITH {EVENTS}, m AS (SELECT 'e' AS source, event_id AS id, user_id AS key, t FROM ev UNION ALL SELECT 'o', o_orderkey, o_custkey, epoch_us(o_orderdate) FROM orders)
  SELECT source, id, row_number() OVER (PARTITION BY key ORDER BY t, source, id) AS seq FROM m""")
def merged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.lit("e").alias("source"), F.col("event_id").alias("id"), F.col("user_id").alias("key"), "t")
    o = table(spark, sf_dir, "orders").select(F.lit("o").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return e.unionByName(o).withColumn("seq", F.row_number().over(temporal.by(["key"], "t", "source", "id")).cast("long")).select("source", "id", "seq")


@query(f"WITH {EVENTS}, p AS (SELECT event_type, user_id, t // {DAY} AS day FROM ev) SELECT user_id, day FROM p WHERE event_type = 'view' INTERSECT SELECT user_id, day FROM p WHERE event_type = 'click' EXCEPT SELECT user_id, day FROM p WHERE event_type = 'error'")
def shared_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).select("event_type", "user_id", F.floor(F.col("t") / DAY).alias("day"))
    of = lambda kind: days.where(F.col("event_type") == kind).select("user_id", "day")
    return of("view").intersect(of("click")).subtract(of("error"))
