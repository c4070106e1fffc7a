"""A run's words and spots against a transcript of who sent what, when and at which pitch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.text import is_plausible
from spotlake.operators.joins import containment_join


#: Islands of a text in a group.
ISLANDS = 64


def _at_pitch(pitch: Column, row_pitch: Column, tol: float) -> Column:
    """A row without a pitch takes any; else the pitch has to be known and near."""
    return row_pitch.isNull() | F.coalesce(F.abs(pitch - row_pitch) <= tol, F.lit(False))


def word_matches(rows: DataFrame, run: DataFrame, time_tol: float, pitch_tol: float) -> DataFrame:
    """Transcript words (row_id, n, start, stop, row_pitch, word) against run words (w_id, t, pitch, word): row_id, n, w_id.

    In the order of row_id and n each transcript word takes the earliest unused run word of its text that lies in its row's time, widened
    by time_tol, and at its pitch. Who takes what hangs only on words whose times overlap, directly or through others, so each text is cut into
    islands of overlapping times; a group is some ISLANDS of them, which its times keep apart.
    """
    wanted = rows.select("word", (F.col("start") - time_tol).alias("lo"), (F.col("stop") + time_tol).alias("hi"), "row_id", "n", F.col("row_pitch").alias("p"), F.lit(None).cast(run.schema["w_id"].dataType).alias("w_id"))
    said = run.select("word", F.col("t").alias("lo"), F.col("t").alias("hi"), F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"), F.lit(None).cast(rows.schema["n"].dataType).alias("n"), F.col("pitch").alias("p"), "w_id")
    order = Window.partitionBy("word").orderBy("lo", "hi")
    both = wanted.unionByName(said).withColumn("__opens", F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    both = both.withColumn("island", F.count_if("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # an island of one side only has nothing to match
    whole = Window.partitionBy("word", "island")
    both = both.withColumn("__both", (F.count("w_id").over(whole) > 0) & (F.count("row_id").over(whole) > 0)).where("__both").drop("__both", "__opens")

    def take(group: pd.DataFrame) -> pd.DataFrame:
        words, heard = group[group["w_id"].isna()].sort_values(["row_id", "n"]), group[group["w_id"].notna()].sort_values(["lo", "w_id"])
        at, pitch, free = heard["lo"].to_numpy(float), heard["p"].to_numpy(float), np.ones(len(heard), bool)
        first, last = np.searchsorted(at, words["lo"].to_numpy(float)), np.searchsorted(at, words["hi"].to_numpy(float), side="right")
        taken = np.full(len(words), -1)
        for n, (a, b, p) in enumerate(zip(first, last, words["p"].to_numpy(float), strict=True)):
            fits = free[a:b] if np.isnan(p) else free[a:b] & (np.abs(pitch[a:b] - p) <= pitch_tol)
            if fits.any():
                taken[n] = a + int(fits.argmax())
                free[taken[n]] = False
        hit = taken >= 0
        return pd.DataFrame({"row_id": words["row_id"].to_numpy()[hit], "n": words["n"].to_numpy()[hit], "w_id": heard["w_id"].to_numpy()[taken[hit]]})

    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("row_id", "n", "w_id"))
    return both.groupBy("word", F.floor(F.col("island") / ISLANDS).alias("batch")).applyInPandas(take, kinds)


def spot_matches(rows: DataFrame, spots: DataFrame, time_tol: float, pitch_tol: float, width: float) -> DataFrame:
    """Spots (s_id, call, s_t, pitch) that a transcript row names at their time and pitch: s_id, call. width: about a row's length."""
    named = rows.select(F.col("word").alias("named"), (F.col("start") - time_tol).alias("lo"), (F.col("stop") + time_tol).alias("hi"), "row_pitch")
    met = containment_join(spots, named, "s_t", "lo", "hi", width).where((F.col("call") == F.col("named")) & _at_pitch(F.col("pitch"), F.col("row_pitch"), pitch_tol))
    return met.select("s_id", "call").distinct()


def scores(rows: DataFrame, run: DataFrame, spots: DataFrame, time_tol: float, pitch_tol: float, width: float) -> DataFrame:
    """One row: spots, spots_matched, transcript_calls, calls_found, transcript_words, words_found, and their ratios (null without any)."""
    matched = spot_matches(rows, spots, time_tol, pitch_tol, width)
    calls = rows.select(F.col("word").alias("call")).distinct().where(is_plausible(F.col("call")))
    found = calls.join(matched.select("call").distinct(), "call", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(spots, "spots").crossJoin(count(matched.select("s_id").distinct(), "spots_matched")).crossJoin(count(calls, "transcript_calls")).crossJoin(count(found, "calls_found"))
    one = one.crossJoin(count(rows, "transcript_words")).crossJoin(count(word_matches(rows, run, time_tol, pitch_tol), "words_found"))  # rows of one each
    ratio = lambda a, b, name: F.round(F.try_divide(F.col(a), F.col(b)), 6).alias(name)
    return one.select("*", ratio("spots_matched", "spots", "spot_precision"), ratio("calls_found", "transcript_calls", "call_recall"), ratio("words_found", "transcript_words", "word_recall"))
