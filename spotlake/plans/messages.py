"""Queries of repetitions, fused copies, word boundaries and truth slices: events as touches and copies of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.operators import alignment, lattice, lifecycle, repetition
from spotlake.plans.registry import DAY, EVENTS, HOUR, events, query, table
from spotlake.plans.spectra import _ROWS, _spectra

_LIMITS = repetition.Limits(second=HOUR // 10, between=1)


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decoded words: ten users a call, a track per user, a day per hour."""
    e = events(spark, sf_dir)
    call = F.concat(F.lit("K"), (F.col("user_id") % 15).cast("string"), F.lit("AB"), F.char((65 + F.col("k") % 2).cast("int")))
    closes = F.max("t").over(Window.partitionBy("user_id", F.floor(F.col("t") / (3 * DAY)))) + DAY
    return e.select(F.col("event_id").alias("row_id"), call.alias("call"), F.col("user_id").alias("track"), "t", (7_010_000 + F.col("value")).alias("freq"), (F.col("t") - F.col("k") * 1_000_000).alias("start"), (F.col("event_id") % 10_000).alias("word"), closes.alias("closes"), "event_type", "k")


@query()
def message_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as touches; each sign-up also moves its touch to the other call of its pair, an hour later."""
    heard = _heard(spark, sf_dir)
    moves = heard.where("event_type = 'signup'").select((F.col("row_id") + 10**12).alias("row_id"), "call", F.expr("concat(left(call, length(call) - 1), translate(right(call, 1), 'AB', 'BA'))").alias("to"), "track", "t", "start", (F.col("t") + HOUR).alias("at"))
    return repetition.repetitions(heard, moves, _LIMITS).select("row_id", "repetitions")


@query()
def lattice_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a copy of its call, a letter of which is damaged in every third."""
    heard = _heard(spark, sf_dir)
    at = (F.col("row_id") % F.length("call")).cast("int")
    damaged = F.concat(F.expr("left(call, cast(row_id % length(call) as int))"), F.when(F.col("k") % 2 == 0, "X").otherwise(""), F.substring(F.col("call"), at + 2, F.length("call")))
    text = F.when(F.col("k") % 3 == 0, damaged).otherwise(F.col("call"))
    none = F.lit(None).cast("array<double>")
    copies = heard.select(F.col("row_id").alias("copy_id"), (F.col("track") % 5).cast("int").alias("input"), text.alias("text"), none.alias("scores"), F.lit(None).cast("array<array<struct<glyph:string,score:double>>>").alias("others"), "start", F.col("t").alias("stop"), "track", "word", (F.col("track") % 15 * 1000).cast("double").alias("freq"), "closes")
    return lattice.evaluate(copies, 2, _LIMITS).select("copy_id", "verdict", "call", "repetitions", "copies", F.round("lead", 6).alias("lead"))


@query()
def boundary_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items against the whole documents dealt to them."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"))
    count = F.broadcast(items.agg(F.count("*").alias("items")))
    read = table(spark, sf_dir, "documents").crossJoin(count).select("doc_id", (F.col("doc_id") % F.col("items")).alias("item_id"), F.col("text").alias("given"))
    return alignment.with_boundaries(read.join(items, "item_id"), "expected", "given").select("doc_id", "item_id", F.round("boundary_fraction", 6).alias("fraction"))


@query(f"""WITH {EVENTS}, {_ROWS}, tr AS (SELECT event_id AS truth_id, greatest(event_id % (SELECT count(*) FROM embeddings) - 10.0, 0) AS a, CAST(round(k * 0.6) AS BIGINT) AS middle FROM ev WHERE event_type = 'purchase'),
  mt AS (SELECT truth_id, middle, s.channel, hop, power FROM tr JOIN s ON s.channel BETWEEN middle - 1 AND middle + 1 AND hop >= a AND hop < a + 20),
  mn AS (SELECT truth_id, channel, row_number() OVER (PARTITION BY truth_id ORDER BY avg(power) DESC, abs(channel - any_value(middle)), channel DESC) AS rn FROM mt GROUP BY truth_id, channel)
  SELECT mt.truth_id, CAST(mt.channel AS BIGINT) AS channel, count(*) AS hops, round(avg(power), 9) AS power FROM mt JOIN mn ON mn.truth_id = mt.truth_id AND mn.channel = mt.channel AND rn = 1 GROUP BY ALL""")
def truth_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("hops")))
    truth = events(spark, sf_dir).where("event_type = 'purchase'").crossJoin(count).select(F.col("event_id").alias("truth_id"), F.lit(0).alias("input"), (F.col("event_id") % F.col("hops")).cast("double").alias("t"), (F.col("k") * 0.6).alias("offset"))
    hops = _spectra(spark, sf_dir).select(F.lit(0).alias("input"), F.col("hop").alias("t"), "channel", "power")
    return alignment.truth_slices(truth, hops, 1.0, 20.0).groupBy("truth_id", "channel").agg(F.count("*").alias("hops"), F.round(F.avg("power"), 9).alias("power"))


@query()
def track_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of the spectra that rise and hold, with a character now and then."""
    power, hop, channel = F.col("power"), F.col("hop"), F.col("channel")
    rows = _spectra(spark, sf_dir).select(
        F.lit("a").alias("input"), "hop", "channel", (power > 0.01).alias("rise"), (power > 0.005).alias("level"), ((power > 0.005) & ((hop + channel) % 9 == 0)).alias("decoded"), (channel + (power - 0.02)).alias("position")
    )
    return lifecycle.lives(rows, lifecycle.Timers(confirm=2, hang=20, sleep=40, mute=120, suppress=60)).withColumn("centre", F.round("centre", 6))
