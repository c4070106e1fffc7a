"""Queries of the adaptive decoders: texts of the benchmark as keyed lengths and evidence, events as marks of a sender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators import beam, morse, segments, speed
from spotlake.operators.carried import running
from spotlake.plans.radio import _CLEAN
from spotlake.plans.registry import DAY, EVENTS, events, query, table

_PATTERNS = ", ".join(f"('{glyph}', '{pattern}')" for pattern, glyph in beam.PATTERNS.items())
_PREFIXES = "[" + ", ".join(f"'{p}'" for p in beam.PREFIXES) + "]"
_MARKS = f"""pt AS (SELECT * FROM (VALUES {_PATTERNS}) AS v(glyph, pattern)),
  ch AS (SELECT item_id, CAST(unnest(range(0, length(t))) AS BIGINT) AS pos, unnest(string_split(t, '')) AS glyph FROM (SELECT item_id, {_CLEAN} AS t FROM benchmark) WHERE t <> ''),
  mk AS (SELECT item_id, pos, list_transform(range(0, length(pattern)), lambda i: CASE WHEN pattern[i + 1] = '0' THEN 60 ELSE 180 END * (1 + ((item_id * 7 + pos * 3 + i * 5) % 31 - 15) / 30.0::DOUBLE)) AS marks FROM ch JOIN pt USING (glyph))"""


@query(f"""WITH RECURSIVE {_MARKS}, b AS (SELECT item_id, pos, marks, CAST(0 AS BIGINT) AS n, [{{'worse': 0.0::DOUBLE, 'path': ''}}] AS beam FROM mk
    UNION ALL SELECT item_id, pos, marks, n + 1, list_slice(list_sort(list_filter(flatten(list_transform(beam, lambda h: [
      {{'worse': h.worse + pow(ln(marks[n + 1]) - ln(60.0), 2) / 0.125, 'path': h.path || '0'}}, {{'worse': h.worse + pow(ln(marks[n + 1]) - ln(180.0), 2) / 0.125, 'path': h.path || '1'}}])),
      lambda h: list_contains({_PREFIXES}, h.path))), 1, 4) FROM b WHERE n < len(marks)),
  r AS (SELECT item_id, pos, marks, unnest(beam) AS h, len(beam) AS kept FROM b WHERE n = len(marks)),
  g AS (SELECT item_id, pos, -h.worse AS score, glyph, row_number() OVER (PARTITION BY item_id, pos ORDER BY h.worse, h.path) AS place, max(-h.worse) OVER (PARTITION BY item_id, pos) AS top FROM r JOIN pt ON pattern = h.path),
  s AS (SELECT item_id, pos, string_agg(glyph, ' ' ORDER BY place) AS readings, max(score) AS score, 1 / sum(exp(score - top)) AS confidence FROM g GROUP BY ALL)
  SELECT mk.item_id, mk.pos, CASE WHEN len(marks) >= 6 AND list_max(marks) < sqrt(60.0 * 180.0) THEN '<err>' ELSE coalesce(readings, '?') END AS readings,
    round(coalesce(CASE WHEN len(marks) >= 6 AND list_max(marks) < sqrt(60.0 * 180.0) THEN 0 ELSE score END, 0), 6) + 0.0 AS score,
    round(coalesce(CASE WHEN len(marks) >= 6 AND list_max(marks) < sqrt(60.0 * 180.0) THEN 1 ELSE confidence END, 0), 6) AS confidence FROM mk LEFT JOIN s USING (item_id, pos)""")
def beam_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of a benchmark text keyed with marks of up to half their length too long or short, read back by the beam."""
    said = table(spark, sf_dir, "benchmark").select("item_id", _clean().alias("t")).where("t <> ''")
    chars = said.select("item_id", F.posexplode(F.split("t", "")).alias("pos", "glyph"))
    pattern = F.element_at(F.create_map(*[F.lit(x) for p, g in beam.PATTERNS.items() for x in (g, p)]), F.col("glyph"))
    off = lambda i: 1 + ((F.col("item_id") * 7 + F.col("pos") * 3 + i * 5) % 31 - 15) / 30.0
    marks = F.transform(F.sequence(F.lit(0), F.length("p") - 1), lambda i: F.when(F.substr(F.col("p"), i + 1, F.lit(1)) == "0", 60).otherwise(180) * off(i))
    read = chars.withColumn("p", pattern).where("p IS NOT NULL").select("item_id", F.col("pos").cast("long").alias("pos"), beam.char_readings(marks, F.lit(60.0), F.lit(180.0)).alias("r"))
    best = F.col("r")[0]
    return read.select("item_id", "pos", F.array_join("r.glyph", " ").alias("readings"), F.round(best["score"], 6).alias("score"), F.round(best["confidence"], 6).alias("confidence"))


def _clean():
    """A text in the letters of the code, as _CLEAN in SQL."""
    kept = F.regexp_replace(F.upper(F.regexp_replace("text", "[^ -~]", " ")), "[^A-Z0-9/?.,= ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def _bounded(pair: str) -> str:
    """bounded() of a list of two."""
    low = f"least(greatest({pair}[1], {speed.SHORTEST}), {speed.LONGEST})"
    return f"[{low}, CASE WHEN {pair}[2] / {low} BETWEEN {speed.LEAST_RATIO} AND {speed.MOST_RATIO} THEN {pair}[2] ELSE 3 * {low} END]"


def _clusters(marks: str) -> str:
    """clusters() of a list of five."""
    split = "list_position(r, list_max(r))"
    pair = f"CASE WHEN list_max(r) >= {speed.SPLIT_RATIO} THEN [list_avg(s[1:{split}]), list_avg(s[{split} + 1:5])] WHEN list_avg(s) <= {speed.LONGEST} THEN [list_avg(s), 3 * list_avg(s)] ELSE [list_avg(s) / 3, list_avg(s)] END"
    pair = f"list_transform([list_sort({marks})], lambda s: list_transform([list_transform(range(1, 5), lambda i: s[i + 1] / s[i])], lambda r: {pair})[1])"
    return f"list_transform({pair}, lambda p: {_bounded('p')})[1]"


#: Senders of both kinds of marks, but for every other ten days of slow dots only.
_SENT = f"""{EVENTS}, sl AS (SELECT *, (t // {10 * DAY}) % 2 = 1 AS slow FROM ev),
  mk AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn, CASE WHEN slow THEN 140 WHEN k % 2 = 0 THEN 30 ELSE 90 END * (1 + (event_id * 13 % 21 - 10) / 100.0::DOUBLE) AS d FROM sl)"""


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    usual = F.when(F.floor(F.col("t") / (10 * DAY)) % 2 == 1, 140).when(F.col("k") % 2 == 0, 30).otherwise(90)
    return events(spark, sf_dir).withColumn("d", usual * (1 + (F.col("event_id") * 13 % 21 - 10) / 100.0))


@query(f"""WITH RECURSIVE {_SENT}, f AS (SELECT user_id, {_clusters("list(d ORDER BY rn)")} AS c FROM mk WHERE rn <= 5 GROUP BY user_id HAVING count(*) = 5),
  w AS (SELECT user_id, CAST(5 AS BIGINT) AS rn, c[1] AS low, c[2] AS high, CAST(0 AS INTEGER) AS regime, CAST(NULL AS BOOLEAN) AS dot, CAST([] AS STRUCT(d DOUBLE, dot BOOLEAN, low DOUBLE, high DOUBLE)[]) AS ring FROM f
    UNION ALL SELECT user_id, rn, CASE WHEN turned THEN n[1] ELSE c[1] END, CASE WHEN turned THEN n[2] ELSE c[2] END, regime + CASE WHEN turned THEN 1 ELSE 0 END, dot, CASE WHEN turned THEN [] ELSE ring END FROM (
      SELECT *, len(ring) = 12 AND len(list_distinct(list_transform(ring, lambda x: x.dot))) = 1 AND m > 0 AND sqrt(list_avg(list_transform(ring, lambda x: pow(x.d - m, 2)))) / m < 0.35
        AND abs(m - CASE WHEN ring[1].dot THEN ring[1].low ELSE ring[1].high END) / CASE WHEN ring[1].dot THEN ring[1].low ELSE ring[1].high END > 0.4 AS turned,
        CASE WHEN len(ring) = 12 THEN {_clusters("list_transform(ring[8:12], lambda x: x.d)")} END AS n FROM (
        SELECT *, {_bounded("p")} AS c, list_avg(list_transform(ring, lambda x: x.d)) AS m FROM (
          SELECT w.user_id, mk.rn, regime, d < sqrt(low * high) AS dot, CASE WHEN d < sqrt(low * high) THEN [low + 0.15 * (d - low), high] ELSE [low, high + 0.15 * (d - high)] END AS p,
            list_append(CASE WHEN len(ring) = 12 THEN ring[2:12] ELSE ring END, {{'d': d, 'dot': d < sqrt(low * high), 'low': low, 'high': high}}) AS ring
          FROM w JOIN mk ON mk.user_id = w.user_id AND mk.rn = w.rn + 1))))
  SELECT mk.user_id, event_id, CASE WHEN dot THEN 'dot' WHEN NOT dot THEN 'dash' END AS kind, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high, coalesce(regime, 0) AS regime FROM mk LEFT JOIN w ON w.user_id = mk.user_id AND w.rn = mk.rn""")
def speed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = speed.track_speed(_sent(spark, sf_dir), ["user_id"], ["t", "event_id"], "d")
    kind = F.when(F.col("dot"), "dot").when(~F.col("dot"), "dash")
    return told.select("user_id", "event_id", kind.alias("kind"), *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("low", "high")], "regime")


@query()
def speed_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in turn as marks and gaps; gaps of the views are a third."""
    runs = _sent(spark, sf_dir).withColumn("mark", F.col("event_type") != "view")
    return speed.bank_speed(runs, ["user_id"], ["t", "event_id"], "mark", "d")


@query(f"SELECT item_id AS track, {_CLEAN} AS text FROM benchmark WHERE {_CLEAN} <> ''")
def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts keyed at a speed of their own, lengths up to a tenth off, as evidence at the ends of marks and gaps; decoded without being told the speed."""
    said = table(spark, sf_dir, "benchmark").select("item_id", _clean().alias("text")).where("text <> ''")
    runs = morse.keyed_runs(said, "item_id", "text", (9 + F.col("item_id") % 5 * 6).cast("double"))
    hops = F.greatest(F.round(F.col("length") * (1 + ((F.col("seq") * 37 + F.col("track") * 11) % 9 - 4) / 40.0)), F.lit(1)).cast("long")
    told = runs.select("track", "seq", hops.alias("hops"), (hops * F.when(F.col("mark"), 0.8).otherwise(-0.8)).alias("e"))
    ends = told.select("track", running(F.col("hops"), ["track"], "seq").alias("hop"), running(F.col("e"), ["track"], "seq").alias("total"))
    first = said.select(F.col("item_id").alias("track"), F.lit(0).cast("long").alias("hop"), F.lit(0.0).alias("total"))
    return segments.texts(segments.decode(first.unionByName(ends), segments.Settings(silence=20.0))).select("track", "text")
