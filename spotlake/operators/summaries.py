"""Summaries, verdicts and small joins over what a run left: recovery, closings, verdicts of a receiver, neighbours, words' bonuses, cycle spots, live text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.text import character_error_rate
from spotlake.operators import gathered
from spotlake.operators.gates import greedy_gate
from spotlake.operators.joins import band_join
from spotlake.operators.temporal import by

#: Why a track closes; SNR at which a track is above the noise (dB).
CLOSINGS = ("hang_expired", "silent", "evicted", "merged", "rtty", "not_cw", "unkeyed", "crash", "comodulated", "discontinuity", "end_of_stream")
NOISE_SNR_DB = 3.0
#: Shares of a word's bonus, the count at which it is full, and common words.
MEMBER, HEARD, PREFIX, COMMON, FULL = 0.35, 0.45, 0.10, 0.10, 1000.0
WORDS = ("CQ", "DE", "5NN", "599", "TNX", "PSE", "TU", "QRZ", "GL", "GE", "GM", "GA", "AGN", "QTH", "NAME", "RST", "73", "BK", "TEST", "QRL", "QRS", "QRO", "QRP", "ES", "FER", "UR", "HR", "WX", "ANT", "RIG")


def oracle_summary(results: DataFrame) -> DataFrame:
    """results (as_word, framed, inside, wpm_ratio) -> one row: n, as_word, framed, inside, median_ratio."""
    return results.agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("as_word", "framed", "inside")], F.median("wpm_ratio").alias("median_ratio"))


def receiver_verdict(spots: Column, promoted: Column, confirmed: Column, best_snr: Column) -> Column:
    """decoding, no_signal, not_cw, weak_no_decode, noisy_no_decode or activity_no_snr: by spots, tracks promoted, signals confirmed, and the strongest track."""
    heard = F.when(best_snr > NOISE_SNR_DB, "weak_no_decode").when(best_snr.isNotNull(), "noisy_no_decode").otherwise("activity_no_snr")
    return F.when(spots > 0, "decoding").when((promoted == 0) & (confirmed > 0), "not_cw").when(promoted == 0, "no_signal").otherwise(heard)


def bypass_summary(records: DataFrame, stage: str, recovered: Column, by_stage: tuple[str, ...] = ()) -> DataFrame:
    """Per forced stage: n, recovered, rate."""
    return records.groupBy(stage, *by_stage).agg(F.count("*").alias("n"), F.count_if(recovered).alias("recovered"), F.round(F.avg(recovered.cast("double")), 6).alias("rate"))


def closing_counts(events: DataFrame, reason: str) -> DataFrame:
    """(reason, n) for every reason in CLOSINGS, zeros included, and for others that occur."""
    listed = events.sparkSession.createDataFrame([(c,) for c in CLOSINGS], "reason string")
    counted = events.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return listed.join(counted, "reason", "full").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def withheld_by_input(outcomes: DataFrame, source: str) -> DataFrame:
    """respot_dedupe() -> per input: spots that another input had already sent."""
    return outcomes.groupBy(source).agg(F.count_if(F.col("outcome") == "other_input").alias("withheld"))


def joined_text(stations: DataFrame, tracks: DataFrame, reach: float) -> DataFrame:
    """stations (station_id, freq, expected) and tracks (start, t_freq, text) -> station_id, text, cer: the texts of all tracks within reach, in order of start then text, parted by blanks; no track: an empty text.

    An id with several rows has in each of them the texts near any of these; as ids are few that have, their pairs are joined as rows.
    """
    told = stations.withColumn("__rows", F.count("*").over(Window.partitionBy("station_id")))
    several = (F.col("__rows") > 1) & F.col("station_id").isNotNull()
    shared = told.where(several).drop("__rows")
    met = band_join(shared.select("station_id", "freq"), tracks, [], "freq", "t_freq", reach)
    said = met.groupBy("station_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.isnull("start").alias("last"), "start", "text")))["text"], " ").alias("text"))
    whole = shared.join(said, "station_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    whole = whole.select("station_id", "text", character_error_rate(F.col("expected"), F.col("text")).alias("cer"))
    return gathered.texts(told.where(~several), tracks, reach).unionByName(whole)


def neighbours(tracks: DataFrame, keys: list[str], n_channels: int, reach: float) -> DataFrame:
    """tracks (keys, track, centre) -> keys, low, high, apart: pairs of tracks whose centres are within reach around the circle of channels, the smaller track first. Centres that are not finite have no neighbours.

    A track is listed under the cells around its own, wrapped at the end of the circle, and meets others by equality.
    """
    cells = max(int(n_channels // max(reach, 1e-9)), 1)
    width = n_channels / cells
    place = F.pmod(F.col("centre"), F.lit(float(n_channels)))
    sound = tracks.where(F.col("centre").isNotNull() & ~F.isnan("centre") & (F.abs("centre") < float("inf"))).withColumn("at", place)
    cell = F.least(F.floor(F.col("at") / width).cast("long"), F.lit(cells - 1))
    around = F.array_distinct(F.array(*[F.pmod(cell + d, F.lit(cells)) for d in (-1, 0, 1)]))
    left = sound.select(*keys, F.col("track").alias("low"), F.col("at").alias("a"), F.explode(around).alias("cell"))
    right = sound.select(*keys, F.col("track").alias("high"), F.col("at").alias("b"), cell.alias("cell"))
    apart = F.least(F.abs(F.col("a") - F.col("b")), n_channels - F.abs(F.col("a") - F.col("b")))
    return left.join(right, [*keys, "cell"]).where((F.col("low") < F.col("high")) & (apart <= reach)).select(*keys, "low", "high", apart.alias("apart"))


def word_bonus(words: DataFrame, word: str, members: DataFrame, heard: DataFrame, allocated: DataFrame, cap: float) -> DataFrame:
    """words with bonus, from 0 to cap: shares for a listed call (members: entry), for how often it was heard (heard: entry, count; by logarithm), for an allocated one (allocated: entry) and for a common word. Entries are distinct."""
    sides = words.join(members.select(F.col("entry").alias(word), F.lit(True).alias("__m")), word, "left")
    sides = sides.join(heard.select(F.col("entry").alias(word), F.col("count").alias("__n")), word, "left").join(allocated.select(F.col("entry").alias(word), F.lit(True).alias("__a")), word, "left")
    often = F.coalesce(F.least(F.log1p(F.col("__n").cast("double")) / F.log1p(F.lit(FULL)), F.lit(1.0)) * HEARD, F.lit(0.0))
    share = F.when(F.col("__m"), MEMBER).otherwise(0.0) + often + F.when(F.col("__a"), PREFIX).otherwise(0.0) + F.when(F.col(word).isin(*WORDS), COMMON).otherwise(0.0)
    return sides.select(*words.columns, F.least(F.greatest(share * cap, F.lit(0.0)), F.lit(float(cap))).alias("bonus"))


def list_verdict(fetched: DataFrame, held: DataFrame, canaries: DataFrame, least_share: float = 0.9) -> DataFrame:
    """One row: n, n_held, missing (the first canary call that no fetched prefix begins), verdict: empty, canary, short or accepted. fetched, held: prefix; canaries: call."""
    prefixes = fetched.select("prefix").distinct()
    calls = canaries.select("call", F.explode(F.sequence(F.lit(1), F.length("call"))).alias("n")).select("call", F.substring("call", F.lit(1), F.col("n")).alias("prefix"))
    found = calls.join(prefixes, "prefix", "left_semi").select("call").distinct()
    missing = canaries.join(found, "call", "left_anti").agg(F.min("call").alias("missing"))
    one = prefixes.agg(F.count("*").alias("n")).crossJoin(held.select("prefix").distinct().agg(F.count("*").alias("n_held"))).crossJoin(missing)  # one row each
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("missing").isNotNull(), "canary").when(F.col("n") < F.col("n_held") * least_share, "short").otherwise("accepted")
    return one.withColumn("verdict", verdict)


def cycle_spots(messages: DataFrame, hold: int) -> DataFrame:
    """messages (m_id, slot, input, mode, band, text, place) of decoded cycles -> m_id, caller, grid, n: calls to all that were not heard in the same mode and band for `hold`, numbered in the order of slot, input, mode and place.

    A call to all is `CQ [MODIFIER] CALL [GRID]`; slots in the unit of hold. A message that isn't admitted renews no hold.
    """
    form = r"^CQ (?:[A-Z0-9]{1,4} )?([A-Z0-9/]*[0-9][A-Z0-9/]*[A-Z][A-Z0-9/]*)(?: ([A-R]{2}[0-9]{2}))?$"
    calls = messages.withColumn("caller", F.regexp_extract("text", form, 1)).withColumn("grid", F.nullif(F.regexp_extract("text", form, 2), F.lit(""))).where("caller <> ''")
    calls = calls.withColumn("grid", F.when(F.col("grid") != "RR73", F.col("grid"))).withColumn("order", F.struct("input", "mode", "place", "m_id"))
    sent = greedy_gate(calls.withColumn("tie", F.concat_ws("-", F.lpad(F.col("input").cast("string"), 12, "0"), F.col("mode"), F.lpad(F.col("place").cast("string"), 12, "0"), F.lpad(F.col("m_id").cast("string"), 20, "0"))), ["caller", "mode", "band"], "slot", "tie", hold).where("admitted")
    # numbered within a slot: a running number over all slots would be one sort of everything
    return sent.select("m_id", "slot", "caller", "grid", F.row_number().over(by(["slot"], "tie")).alias("n"))


def live_text(parts: DataFrame, keys: list[str], at: str, tie: str, every: int) -> DataFrame:
    """The last row of a key in each tumbling stretch of `every`."""
    rank = F.row_number().over(by([*keys, "__w"], F.desc(at), F.desc(tie)))
    return parts.withColumn("__w", F.floor(F.col(at) / every)).withColumn("__r", rank).where("__r = 1").drop("__w", "__r")


def mode_shown(listener: Column, asked: Column) -> Column:
    """The mode of which spots are shown: what was asked for if the listener takes it (null: any), `none` if it doesn't."""
    return F.when(listener.isNull(), asked).when(asked.isNull() | (asked == listener), listener).otherwise("none")


def in_closing_order(grades: DataFrame, close: str, spot_id: str) -> DataFrame:
    return grades.orderBy(close, spot_id)
