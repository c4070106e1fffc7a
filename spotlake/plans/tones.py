"""Queries of two-tone signals and of bands modulated together: embeddings as levels of channels, benchmark texts as framed tones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions.numeric import CHANNEL_HZ, sign_correction
from spotlake.operators import comodulation as cm
from spotlake.operators import two_tone
from spotlake.plans.decoders import _clean
from spotlake.plans.radio import _CLEAN
from spotlake.plans.registry import ORACLES, query, table

_BLOCK = 25


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector a hop: each of its first 16 components keys a pair of channels by its sign, its last ones are noise on both; every fourth pair is not keyed in turns but together."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hop"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = e.select("hop", "e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("c"))
    on = F.get("e", F.col("c")) > 0
    level = lambda up, noise: F.when(up, 30.0).otherwise(2.0) + 8 * noise
    tone = F.array(
        F.struct((F.col("c") * 12).alias("channel"), level(on, F.get("e", 16 + F.col("c"))).alias("snr")),
        F.struct((F.col("c") * 12 + 2).alias("channel"), level(F.when(F.col("c") % 4 == 3, on).otherwise(~on), F.get("e", 32 + F.col("c"))).alias("snr")),
    )
    out = rows.select(F.lit("a").alias("input"), "hop", F.explode(tone).alias("t")).select("input", "hop", F.col("t.channel").cast("long").alias("channel"), "t.snr")
    return out.withColumn("re", sign_correction(F.col("hop"), F.col("channel"))).withColumn("im", F.lit(0.0))


_TONES = """x AS (SELECT vec_id AS hop, list_transform(embedding, lambda v: v::DOUBLE) AS e, CAST(unnest(range(0, 16)) AS BIGINT) AS c FROM embeddings),
  tn AS (SELECT hop, c * 12 AS channel, CASE WHEN e[c + 1] > 0 THEN 30.0 ELSE 2.0 END + 8 * e[c + 17] AS snr FROM x
    UNION ALL SELECT hop, c * 12 + 2, CASE WHEN (c % 4 = 3) = (e[c + 1] > 0) THEN 30.0 ELSE 2.0 END + 8 * e[c + 33] FROM x)"""


@query(f"""WITH {_TONES}, h AS (SELECT hop // {_BLOCK} AS block, channel FROM tn GROUP BY ALL HAVING avg(snr) >= 6 AND count(*) = {_BLOCK}),
  w AS (SELECT tn.*, block FROM tn JOIN h ON tn.channel = h.channel AND tn.hop // {_BLOCK} = h.block),
  p AS (SELECT a.block, a.channel AS low, b.channel AS high, coalesce(corr(a.snr, b.snr), 0) AS rho, avg(greatest(a.snr, b.snr)) AS level, count(*) FILTER (greatest(a.snr, b.snr) >= 10) / {_BLOCK} AS fill,
    count(*) FILTER (a.snr - b.snr >= 6) / {_BLOCK} AS al, count(*) FILTER (b.snr - a.snr >= 6) / {_BLOCK} AS bl FROM w a JOIN w b ON a.hop = b.hop AND b.channel - a.channel IN {two_tone.LAGS} GROUP BY ALL)
  SELECT CAST(block AS BIGINT) AS block, low, high, round(rho, 6) AS rho, round(level, 6) AS level, CASE WHEN rho > 0 THEN 'contra' WHEN rho <= -0.5 AND fill >= 0.8 AND al >= 0.1 AND bl >= 0.1 AND (high - low) * {CHANNEL_HZ} BETWEEN 130 AND 230 THEN 'pass' ELSE 'neutral' END AS verdict FROM p""")
def two_tone_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = two_tone.judged_blocks(_tones(spark, sf_dir), _BLOCK)
    return told.select("block", "low", "high", F.round("rho", 6).alias("rho"), F.round("level", 6).alias("level"), "verdict")


@query(f"""WITH RECURSIVE j AS ({ORACLES["two_tone_blocks"]}), t AS (SELECT *, row_number() OVER (PARTITION BY low, high ORDER BY block) AS rn FROM j WHERE verdict IN ('pass', 'contra')),
  w AS (SELECT low, high, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS block, 0 AS evidence, 0 AS passes, false AS marked, CAST(NULL AS BIGINT) AS since FROM (SELECT DISTINCT low, high FROM t)
    UNION ALL SELECT low, high, rn, block, e, p, m OR e >= 3, CASE WHEN verdict = 'pass' THEN block WHEN stale THEN NULL ELSE since END FROM (
      SELECT *, CASE WHEN verdict = 'pass' THEN CASE WHEN stale THEN 1 ELSE evidence + 1 END ELSE greatest(evidence - 2, 0) END AS e, CASE WHEN verdict = 'pass' THEN CASE WHEN stale THEN 1 ELSE passes + 1 END ELSE passes END AS p, marked AND NOT stale AS m FROM (
        SELECT t.low, t.high, t.rn, t.block, verdict, evidence, passes, marked, since, since IS NULL OR t.block - since >= {two_tone.HOLD} AS stale FROM w JOIN t ON t.low = w.low AND t.high = w.high AND t.rn = w.rn + 1)))
  SELECT low, high, block, evidence, marked, passes, CASE WHEN marked THEN list_sort(list_transform({list(two_tone.STANDARD)}, lambda s: {{'off': abs(s - (high - low) * {CHANNEL_HZ}), 'shift': s}}))[1].shift::DOUBLE END AS shift FROM w WHERE since IS NOT NULL""")
def two_tone_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as their evidence grows, with the nominal shift of those marked."""
    told = two_tone.evidence(two_tone.judged_blocks(_tones(spark, sf_dir), _BLOCK), 3)
    shift = F.when(F.col("marked"), two_tone.nominal_shift((F.col("high_at") - F.col("low_at")) * CHANNEL_HZ))
    return told.select("low", "high", "block", "evidence", "marked", "passes", shift.alias("shift"))


_PLAIN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '[^A-Z ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT item_id, {_PLAIN} AS text FROM benchmark WHERE {_PLAIN} <> ''")
def framed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in letters, framed at 45.45 baud over two tones, of every other item upside down, and read back."""
    said = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace(F.regexp_replace(_clean(), "[^A-Z ]", ""), " +", " ")).alias("text")).where("text <> ''")
    halves = {c: "00" + "".join(str(n >> i & 1) * 2 for i in range(5)) + "111" for n, c in enumerate(two_tone.LETTERS) if c == " " or c.isalpha()}
    keyed = F.array_join(F.transform(F.split("text", ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for item in halves.items() for x in item]), c)), "")
    half = two_tone.HOPS / 45.45 / 2
    bits = said.select("item_id", F.concat(F.lit("1" * 6), keyed, F.lit("1" * 6)).alias("bits"))
    hops = bits.select("item_id", "bits", F.explode(F.sequence(F.lit(0), F.floor(F.length("bits") * half).cast("int") - 1)).alias("hop"))
    mark = (F.substr(F.col("bits"), F.floor(F.col("hop") / half).cast("int") + 1, F.lit(1)) == "1") != (F.col("item_id") % 2 == 1)
    tones = hops.select("item_id", "hop", F.when(mark, 0.01).otherwise(1.0).alias("low"), F.when(mark, 1.0).otherwise(0.01).alias("high"))
    read = two_tone.framed(tones, ["item_id"], "hop", "low", "high")
    return read.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("hop", "n", "glyph")))["glyph"], "").alias("text"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector a hop: channels 0 to 19 follow its first component, 24 to 43 its second by half as much, the others themselves."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hop"), F.posexplode("embedding").alias("channel", "x"), F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))
    x, c = F.col("x").cast("double"), F.col("channel")
    snr = F.when(c < 20, 12 + 30 * F.col("a").cast("double") + 5 * x).when(c.between(24, 43), 10 + 15 * F.col("b").cast("double") + 5 * x).otherwise(4 + 30 * x)
    return e.select(F.lit("a").alias("input"), "hop", c.cast("long").alias("channel"), snr.alias("snr"))


_BANDS = f"""x AS (SELECT vec_id AS hop, CAST(unnest(range(0, 64)) AS BIGINT) AS channel, unnest(embedding)::DOUBLE AS x, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
  sn AS (SELECT hop, channel, CASE WHEN channel < 20 THEN 12 + 30 * a + 5 * x WHEN channel BETWEEN 24 AND 43 THEN 10 + 15 * b + 5 * x ELSE 4 + 30 * x END AS snr FROM x),
  ev AS (SELECT CAST(unnest(range({cm.EVERY}, (SELECT max(hop) + 2 FROM sn), {cm.EVERY})) AS BIGINT) AS wat), hd AS (SELECT wat, hop, channel, snr, hop - greatest(wat - {cm.WINDOW}, 0) AS place FROM ev JOIN sn ON hop >= wat - {cm.WINDOW} AND hop < wat AND wat >= {cm.FIRST}),
  ht AS (SELECT wat, channel FROM hd GROUP BY ALL HAVING avg(snr) >= {cm.HOT})"""


def _runs(source: str, name: str, slack: int) -> str:
    return f"""{name} AS (SELECT wat, min(channel) AS first, max(channel) AS last, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY wat ORDER BY channel ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN channel <= lag(channel) OVER (PARTITION BY wat ORDER BY channel) + {slack} THEN 0 ELSE 1 END AS opens FROM {source})) GROUP BY wat, run)"""


@query(f"""WITH {_BANDS}, w AS (SELECT hd.* FROM hd JOIN ht USING (wat, channel)), pr AS (SELECT a.wat, a.channel AS low, b.channel AS high FROM w a JOIN w b ON a.wat = b.wat AND a.hop = b.hop AND b.channel - a.channel BETWEEN {cm.NEAREST} AND {cm.FARTHEST} GROUP BY ALL HAVING corr(a.snr, b.snr) >= {cm.RHO}),
  mb AS (SELECT wat, channel FROM (SELECT wat, low AS channel FROM pr UNION ALL SELECT wat, high FROM pr) GROUP BY ALL HAVING count(*) >= {cm.PARTNERS}), {_runs("mb", "rn", cm.GAP)},
  pk AS (SELECT wat, channel, max(snr) AS peak FROM hd GROUP BY ALL), st AS (SELECT rn.wat, first, last, peak, max(peak) OVER (PARTITION BY rn.wat, first) AS top FROM rn JOIN pk ON pk.wat = rn.wat AND channel BETWEEN first - {cm.CONTEXT} AND last + {cm.CONTEXT} WHERE last - first + 1 >= {cm.WIDTH})
  SELECT wat AS "at", first - 1 AS first, last + 1 AS last, wat + {cm.HOLD} AS until FROM st GROUP BY wat, first, last HAVING count(*) FILTER (peak >= top - {cm.STRONG_DB}) >= {cm.STRONG}""")
def comodulated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.spans(_bands(spark, sf_dir)).select("at", "first", "last", "until")


@query(f"""WITH {_BANDS}, hw AS (SELECT * FROM ht WHERE wat >= {cm.WINDOW}), {_runs("hw", "rn", cm.GAP)}, su AS (SELECT rn.wat, first, last, n, place, sum(snr) AS x FROM rn JOIN hw ON hw.wat = rn.wat AND hw.channel BETWEEN first AND last JOIN hd ON hd.wat = rn.wat AND hd.channel = hw.channel GROUP BY ALL),
  k AS (SELECT unnest(range(1, 31)) AS k), b AS (SELECT wat, first, last, n, k, sqrt(pow(sum(x * cos(2 * pi() * k * place / {cm.WINDOW})), 2) + pow(sum(x * sin(2 * pi() * k * place / {cm.WINDOW})), 2)) AS size FROM su, k WHERE k <= 5 OR k >= 8 GROUP BY ALL)
  SELECT wat AS "at", first, last, CAST(n AS BIGINT) AS hot, round(sum(size) FILTER (k <= 5), 4) AS slow, round(sum(size) FILTER (k >= 8), 4) AS fast FROM b GROUP BY wat, first, last, n""")
def speech_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cm.regions(cm._complete(cm.windows(_bands(spark, sf_dir))))
    return found.select("at", "first", "last", "hot", F.round("slow", 4).alias("slow"), F.round("fast", 4).alias("fast"))
