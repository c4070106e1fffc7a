"""Queries over spectra: embeddings as power spectra, vec_id being the hop and the position the channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import numeric
from spotlake.operators import spectrum, temporal
from spotlake.plans.registry import query, table

_N = 64
_ROWS = "x AS (SELECT vec_id AS hop, unnest(range(0, 64)) AS channel, unnest(embedding)::DOUBLE AS raw FROM embeddings), s AS (SELECT hop, channel, raw * raw AS power, 10 * log10(raw * raw + 1e-20) AS db FROM x)"


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectrum.long_form(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id", "e")
    power = F.col("power") * F.col("power")
    return rows.select("hop", F.col("channel").cast("long").alias("channel"), power.alias("power"), numeric.power_db(power).alias("db"))


_FLOOR = f"""{_ROWS}, b AS (SELECT *, least(greatest(CAST(floor((db + 140) / 0.5) AS BIGINT), 0), 279) AS bin FROM s),
  f AS (SELECT hop, channel, -140 + 0.5 * (quantile_disc(bin, 0.25) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) + 0.5) AS floor_db FROM b)"""


@query(f"WITH {_FLOOR} SELECT hop, channel, CAST(floor_db AS DOUBLE) AS floor_db FROM f")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.channel_floor(_spectra(spark, sf_dir)).select("hop", "channel", F.col("floor_db").cast("double").alias("floor_db"))


@query(f"WITH {_FLOOR} SELECT hop, CAST(channel // 32 AS BIGINT) AS block, CAST(median(floor_db) AS DOUBLE) AS block_db FROM f GROUP BY ALL")
def block_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.block_floor(spectrum.channel_floor(_spectra(spark, sf_dir)))


@query(f"WITH {_FLOOR}, m AS (SELECT hop, channel // 32 AS block, median(floor_db) AS med FROM f GROUP BY ALL) SELECT f.hop, channel, CAST(least(floor_db, med + 3) AS DOUBLE) AS effective_db FROM f JOIN m ON f.hop = m.hop AND f.channel // 32 = m.block")
def effective_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.effective_floor(spectrum.channel_floor(_spectra(spark, sf_dir))).select("hop", "channel", "effective_db")


@query(f"""WITH {_ROWS}, w AS (SELECT hop, channel, sum(power) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, sum(power) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS b,
  count(*) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS n FROM s) SELECT hop, channel FROM w WHERE n = 5 AND a >= 0.125 AND b >= 0.125""")
def two_look_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.two_look_rise(_spectra(spark, sf_dir), 5, 0.025).where("rise").select("hop", "channel")


@query(f"""WITH {_ROWS}, w AS (SELECT hop, channel, power, true AS own FROM s UNION ALL SELECT hop, channel + 64, power, false FROM s WHERE channel < 2 UNION ALL SELECT hop, channel - 64, power, false FROM s WHERE channel >= 62),
  m AS (SELECT *, max(power) OVER (PARTITION BY hop ORDER BY channel ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, lag(power) OVER (PARTITION BY hop ORDER BY channel) AS l, lead(power) OVER (PARTITION BY hop ORDER BY channel) AS r FROM w)
  SELECT hop, channel, round(CASE WHEN l - 2 * power + r < 0 AND power >= l AND power >= r THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * power + r))) END, 6) AS shift FROM m WHERE own AND power >= top""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.local_peaks(_spectra(spark, sf_dir), _N).where("peak").select("hop", "channel", F.round("offset", 6).alias("shift"))


@query(f"WITH {_ROWS} SELECT hop, channel, round(min(power) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 9) AS noise FROM s")
def running_min_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.running_minimum(_spectra(spark, sf_dir), 30).select("hop", "channel", F.round("noise", 9).alias("noise"))


@query(f"WITH {_ROWS} SELECT hop, channel, round(max(power) OVER (PARTITION BY channel ORDER BY hop ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS mark FROM s")
def centred_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.centred_maximum(_spectra(spark, sf_dir), 3).select("hop", "channel", F.round("mark", 9).alias("mark"))


@query(f"""WITH {_ROWS}, p AS (SELECT a.hop, a.channel AS low, b.channel - a.channel AS lag, a.power AS x, b.power AS y FROM s a JOIN s b ON a.hop = b.hop AND b.channel - a.channel IN (1, 2, 5))
  SELECT CAST(hop // 125 AS BIGINT) AS block, low, CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(x, y), 6) AS rho FROM p GROUP BY ALL""")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.pair_correlation(_spectra(spark, sf_dir), [1, 2, 5], 125).withColumn("rho", F.round("rho", 6))


@query(f"WITH {_ROWS} SELECT hop, round(list_sort(list(power))[CAST(floor(count(*) / 4) AS BIGINT) + 1], 9) AS lift FROM s GROUP BY hop")
def crash_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.crash_lift(_spectra(spark, sf_dir)).select("hop", F.round("lift", 9).alias("lift"))


@query(f"WITH {_ROWS} SELECT CAST(channel // 16 AS BIGINT) AS band, count(DISTINCT channel) AS channels, round(median(power), 6) AS median_power, avg(CASE WHEN power >= 0.02 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS occupancy, max(power) AS peak FROM s GROUP BY 1")
def band_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.band_rollup(_spectra(spark, sf_dir), 16, 0.02)


@query(f"WITH {_ROWS} SELECT CAST(hop // 125 AS BIGINT) AS frame, channel, round(avg(power), 9) AS mean_power FROM s GROUP BY ALL")
def spectrum_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).groupBy(F.floor(F.col("hop") / 125).alias("frame"), "channel").agg(F.round(F.avg("power"), 9).alias("mean_power"))


@query(f"""WITH {_ROWS}, r AS (SELECT hop, channel, power >= 0.02 AS up FROM s), c AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY channel ORDER BY hop) THEN 0 ELSE 1 END AS nw FROM r),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY hop ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT channel, min(hop) AS "first", max(hop) AS "last", count(*) AS n FROM g WHERE up GROUP BY channel, run HAVING count(*) >= 4""")
def rise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _spectra(spark, sf_dir).withColumn("up", F.col("power") >= 0.02)
    return temporal.runs(flagged, ["channel"], "hop", "up").where("up AND n >= 4").drop("up")


@query(f"""WITH {_ROWS}, r AS (SELECT hop, channel, power >= 0.02 AS up FROM s), c AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY channel ORDER BY hop) THEN 0 ELSE 1 END AS nw FROM r),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY hop ROWS UNBOUNDED PRECEDING) AS run FROM c), z AS (SELECT *, count(*) OVER (PARTITION BY channel, run) AS size FROM g),
  k AS (SELECT hop, channel, CASE WHEN size >= 2 OR run = 1 THEN up END AS firm FROM z)
  SELECT hop, channel, last_value(firm IGNORE NULLS) OVER (PARTITION BY channel ORDER BY hop ROWS UNBOUNDED PRECEDING) AS up FROM k""")
def debounced_keying(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _spectra(spark, sf_dir).select("hop", "channel", (F.col("power") >= 0.02).alias("up"))
    return temporal.debounce(flagged, ["channel"], "hop", "up", 2)
