"""Word boundaries of a decoded text against what was sent, by alignment; slices of hops around truth rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.functions import edits
from spotlake.operators.joins import band_join


def plain(text: str | None) -> str:
    return " ".join((text or "").split())


def matched(expected: str, given: str):
    """For each character of `expected` whether a cheapest alignment pairs it with an equal one, and whether it drops it. Of equal alignments the last step is an equal pair, then an unequal one, then a drop.

    Rows of the table are whole numbers of a bit a column (edits.rows), and the way back jumps over what was read beside: so a row costs a few operations on whole
    numbers, whatever the length of `given`. Two bits a cell are held, so texts of 10,000 characters take 27 MB.
    """
    import numpy as np

    same_up, steps = [], []
    for equal, up, more, _, _, full in edits.rows(expected, given):
        same_up.append(up)
        steps.append((up ^ full) | more | equal)  # columns whose step isn't to the left
    hit, dropped = np.zeros(len(expected), bool), np.zeros(len(expected), bool)
    j = len(given)
    for i in range(len(expected) - 1, -1, -1):
        j = (steps[i] & ((1 << j) - 1)).bit_length()
        if j and expected[i] == given[j - 1]:
            hit[i], j = True, j - 1
        elif j and not same_up[i] >> (j - 1) & 1:
            j -= 1
        else:
            dropped[i] = True
    return hit, dropped


def boundary_fraction(expected: str | None, given: str | None) -> float:
    """Share of the word boundaries sent that were read, less those read beside them, at least 0; 1 or 0 where none was sent. The first counts too if all up to it was lost."""
    e, g = plain(expected), plain(given)
    sent, read = [i for i, c in enumerate(e) if c == " "], g.count(" ")
    if not sent:
        return float(not read)
    hit, dropped = matched(e, g)
    found = int(hit[sent].sum())
    return max(found + int(dropped[: sent[0] + 1].all()) - (read - found), 0) / len(sent)


def with_boundaries(df: DataFrame, expected: str, given: str, out: str = "boundary_fraction") -> DataFrame:
    """df with out (double): boundary_fraction() of two of its columns, texts whole."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)]
    told = df.select(*kept, F.col(f"`{expected}`").cast("string").alias("e"), F.col(f"`{given}`").cast("string").alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            values = pa.array([boundary_fraction(e, g) for e, g in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], values], names=[*batch.schema.names[:-2], "out"])

    done = told.mapInArrow(run, T.StructType([*told.schema.fields[:-2]]).add("out", "double"))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)], F.col("out").alias(out))


def truth_slices(truth: DataFrame, hops: DataFrame, spacing: float, window: float) -> DataFrame:
    """truth (truth_id, input, t, offset) and hops (input, t, channel, power) -> the strongest of the three channels around each truth row, as its hops in the window.

    Columns: truth_id, channel, h_t, power. The window is of that length, begins half of it before the row's time, but not before 0, and ends open. Channels
    are counted from 0 at the centre; offset: from the centre, in the unit of spacing. A row without hops in its window gives none.
    """
    at = truth.select("truth_id", "input", F.greatest(F.col("t") - window / 2, F.lit(0.0)).alias("from"), F.round(F.col("offset") / spacing).cast("long").alias("middle"))
    near = at.withColumn("channel", F.explode(F.array(F.col("middle") - 1, F.col("middle"), F.col("middle") + 1)))
    heard = hops.select("input", F.col("t").cast("double").alias("h_t"), F.col("channel").cast("long").alias("channel"), "power")
    met = band_join(near.withColumn("centre", F.col("from") + window / 2), heard, ["input", "channel"], "centre", "h_t", window / 2)
    met = met.where((F.col("h_t") >= F.col("from")) & (F.col("h_t") < F.col("from") + window)).select("truth_id", "middle", "channel", "h_t", "power")
    means = met.groupBy("truth_id", "middle", "channel").agg(F.avg("power").alias("mean"))
    best = means.groupBy("truth_id").agg(F.max_by("channel", F.struct("mean", -F.abs(F.col("channel") - F.col("middle")), "channel")).alias("channel"))
    return met.join(best, ["truth_id", "channel"]).select("truth_id", "channel", "h_t", "power")
