"""Queries of the signal plane: embeddings as sample blocks, words of documents as keyed texts and exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.operators import exchange, morse, signal
from spotlake.plans.registry import EVENTS, events, query, table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks of 64 real samples of a recording per label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("input"), F.col("vec_id").alias("block"), F.col("embedding").alias("re"))
    start = F.row_number().over(Window.partitionBy("input").orderBy("block")) - 1
    return rows.withColumn("start_ts", (start * 64).cast("long")).withColumn("im", F.transform("re", lambda x: F.lit(0.0).cast("float")))


#: Samples of a recording by their place, and a list of coefficients by theirs.
_SAMPLES = """s AS (SELECT label AS input, (rn - 1) * 64 + unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)),
  z AS (SELECT input, count(*) AS total FROM s GROUP BY input)"""


def _coefficients(name: str, values) -> str:
    listed = ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in values)
    return f"{name} AS (SELECT unnest(range(0, {len(values)})) AS n, unnest([{listed}]) AS w)"


@query(f"""WITH {_SAMPLES}, {_coefficients("c", signal.prototype(16, 4))}, p AS (SELECT input, (i - n) // 4 AS hop, n, x * w AS y FROM s, c WHERE (i - n) % 4 = 0 AND i >= n),
  f AS (SELECT input, hop, channel, sum(y * cos(2 * pi() * channel * n / 16)) AS re, sum(y * sin(2 * pi() * channel * n / 16)) AS im FROM p, (SELECT unnest(range(0, 16)) AS channel) GROUP BY input, hop, channel)
  SELECT CAST(f.input AS VARCHAR) AS input, hop, hop * 4 AS sample_ts, CAST(channel AS INTEGER) AS channel, round(re * re + im * im, 9) AS power FROM f JOIN z ON f.input = z.input AND hop * 4 + 64 <= total""")
def channelize_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = signal.channelize(_blocks(spark, sf_dir), 16, 4)
    return hops.select("input", "hop", "sample_ts", F.posexplode("power").alias("channel", "power")).withColumn("power", F.round("power", 9))


@query(f"""WITH {_SAMPLES}, g AS (SELECT s.input, i // 16 - d AS m, i - 16 * (i // 16 - d) AS n, x FROM s JOIN z USING (input), (VALUES (0), (1)) AS v(d) WHERE i // 16 - d >= 0 AND 16 * (i // 16 - d) + 32 <= total),
  h AS (SELECT input, m, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 31)) AS y FROM g), k AS (SELECT unnest(range(0, 32)) AS bin), e AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * bin / 31), 2)) AS scale FROM k),
  f AS (SELECT input, m, bin, sum(y * cos(2 * pi() * bin * n / 32)) AS re, sum(y * sin(2 * pi() * bin * n / 32)) AS im FROM h, k GROUP BY input, m, bin)
  SELECT CAST(input AS VARCHAR) AS input, bin, round(avg(re * re + im * im) / (SELECT scale FROM e), 9) AS power FROM f GROUP BY input, bin""")
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.power_spectrum(_blocks(spark, sf_dir), 32).withColumn("power", F.round("power", 9))


@query(f"""WITH {_SAMPLES}, {_coefficients("c", signal.half_band(31))}, p AS (SELECT input, i - n AS at_sample, sum(x * w) AS y, count(*) AS held FROM s, c WHERE i >= n AND (i - n) % 2 = 0 GROUP BY ALL)
  SELECT CAST(input AS VARCHAR) AS input, at_sample // 64 * 32 AS start_ts, round(sum(y * y), 9) AS energy FROM p WHERE held = 31 GROUP BY 1, 2""")
def decimated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = signal.fir(_blocks(spark, sf_dir), signal.half_band(31), 2)
    return halved.select("input", "start_ts", F.round(F.aggregate("re", F.lit(0.0), lambda a, x: a + x * x), 9).alias("energy"))


_CLEAN = "trim(regexp_replace(regexp_replace(upper(regexp_replace(text, '[^ -~]', ' ', 'g')), '[^A-Z0-9/?.,= ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT item_id AS track, {_CLEAN} AS text FROM benchmark WHERE {_CLEAN} <> ''")
def morse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", " ").alias("text"), (60.0 / (F.col("item_id") % 5 + 1)).alias("dit"))
    return morse.decode_runs(morse.keyed_runs(texts, "item_id", "text", F.col("dit")))


_STREAM = f"""{EVENTS}, w AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'CQ' WHEN 'view' THEN 'DE' WHEN 'error' THEN '5NN' ELSE 'K' || CAST(k % 3 AS VARCHAR) || 'AB' END AS word FROM ev),
  kd AS (SELECT *, CASE WHEN word IN ('CQ', 'DE') THEN word WHEN word = '5NN' THEN 'report' ELSE 'call' END AS kind, word NOT IN ('CQ', 'DE', '5NN') AND coalesce(lag(word) OVER (PARTITION BY user_id ORDER BY event_id) = word, false) AS again FROM w),
  o AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM kd WHERE NOT again),
  c AS (SELECT *, CASE WHEN after = 'DE' THEN 'called' WHEN before IN ('DE', 'CQ') THEN 'framed' WHEN after = 'report' THEN 'exchange' END AS basis FROM o WHERE kind = 'call'),
  e AS (SELECT *, coalesce(max(CASE WHEN basis = 'framed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM c)"""


@query(f"""WITH {_STREAM} SELECT user_id, event_id, word AS call, CASE WHEN basis = 'framed' THEN 'self' WHEN basis IN ('called', 'exchange') THEN 'addressee' WHEN earlier = 1 THEN 'mention' ELSE 'uncertain' END AS role, coalesce(basis, 'none') AS basis FROM e""")
def call_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    word = F.when(kind == "click", "CQ").when(kind == "view", "DE").when(kind == "error", "5NN").otherwise(F.concat(F.lit("K"), (F.col("k") % 3).cast("string"), F.lit("AB")))
    return exchange.call_roles(events(spark, sf_dir).select("user_id", "event_id", word.alias("word")), ["user_id"], "event_id")
