"""Texts of all tracks near a station's frequency, put together where they meet, with no row for a pair.

Stations are dealt by cells of frequency, those of a crowded cell over several parts, and each part gets the tracks within reach of its cell, sorted by time. A station's
tracks are then one comparison of arrays and its text one gathering of strings, so what is shuffled grows with the rows, and only the texts themselves with the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.functions.edits import distance
from spotlake.functions.text import plain

# Stations of a part, about; tracks of a batch of texts, but for a text with more.
STATIONS, TOKENS = 256, 500_000


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def texts(stations: DataFrame, tracks: DataFrame, reach: float) -> DataFrame:
    """stations (station_id, freq, expected; a row an id) and tracks (start, t_freq, text) -> station_id, text, cer: as summaries.joined_text(). A station without id or finite frequency has no tracks."""
    width = max(reach / 4, 1e-9)
    slack = width * 1e-6
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    sound = F.col("station_id").isNotNull() & _finite("freq")
    asked = stations.select("station_id", F.when(sound, F.col("freq").cast("double")).alias("freq"), plain(F.col("expected")).alias("text"), F.when(sound, cell(F.col("freq"))).otherwise(F.lit(-(2**63))).alias("cell"))
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / STATIONS).alias("parts"))
    asked = asked.join(parts, "cell").select("cell", F.pmod(F.xxhash64("station_id", "freq"), F.col("parts")).alias("part"), F.lit(1).alias("side"), "freq", "text", "station_id")
    near = tracks.where(_finite("t_freq") & F.col("text").isNotNull()).select(F.col("t_freq").cast("double").alias("freq"), "start", "text", F.when(plain(F.col("text")) != F.col("text"), plain(F.col("text"))).alias("plain"))
    near = near.withColumn("cell", F.explode(F.sequence(cell(F.col("freq") - reach - slack), cell(F.col("freq") + reach + slack)))).join(parts, "cell")
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").withColumn("side", F.lit(0))
    both = near.unionByName(asked, allowMissingColumns=True).repartition("cell", "part")
    both = both.sortWithinPartitions("cell", "part", "side", F.asc_nulls_last("start"), "text").select("cell", "part", "side", "freq", "text", "plain", "station_id")
    schema = T.StructType([stations.schema["station_id"], T.StructField("text", T.StringType()), T.StructField("cer", T.DoubleType())])
    return both.mapInArrow(lambda batches: _run(batches, reach), schema)


def _run(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    import numpy as np

    key, held, tracks = None, [], None
    for batch in batches:
        place = [batch.column(c).to_numpy() for c in ("cell", "part", "side")]
        turns = np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], axis=0)) + 1 if batch.num_rows else []
        for low, high in pairwise([0, *turns, batch.num_rows]):
            piece = batch.slice(low, high - low)
            if piece.num_rows == 0:
                continue
            if key != (place[0][low], place[1][low]):
                key, held, tracks = (place[0][low], place[1][low]), [], None
            if place[2][low] == 0:
                held.append(piece)
            else:
                tracks = tracks or _tracks(held)
                yield from _told(piece, *tracks, reach)


def _tracks(held: list[pa.RecordBatch]) -> tuple:
    """Frequencies, texts, and texts for comparison (null if all are as they stand) of the tracks of a part."""
    import numpy as np

    column = lambda c, kind: pa.concat_arrays([h.column(c).cast(kind) for h in held]) if held else pa.array([], kind)
    said, other = column("text", pa.large_string()), column("plain", pa.large_string())
    return np.asarray(column("freq", pa.float64())), said, None if other.null_count == len(other) else pc.coalesce(other, said)


def _told(stations: pa.RecordBatch, freqs, said: pa.Array, other: pa.Array | None, reach: float) -> Iterator[pa.RecordBatch]:
    import numpy as np

    met, first, total = [], 0, 0
    for n, freq in enumerate(stations.column("freq").to_pylist()):
        met.append(np.flatnonzero(np.abs((np.nan if freq is None else freq) - freqs) <= reach))
        total += len(met[-1])
        if total >= TOKENS or n + 1 == stations.num_rows:
            at, ends = pa.array(np.concatenate(met)), pa.array(np.cumsum([0, *map(len, met)]), pa.int64())
            whole = lambda tokens: pc.binary_join(pa.LargeListArray.from_arrays(ends, tokens.take(at)), pa.scalar(" ", pa.large_string()))  # noqa: E731, B023
            text, rows = whole(said), stations.slice(first, n + 1 - first)
            heard = text if other is None else whole(other)
            rates = [None if e is None else distance(e, _single(h)) / max(len(e), 1) for e, h in zip(rows.column("text").to_pylist(), heard.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("station_id"), text.cast(pa.string()), pa.array(rates, pa.float64())], names=["station_id", "text", "cer"])
            met, first, total = [], n + 1, 0


def _single(text: str) -> str:
    """A text of plain parts with single blanks."""
    return re.sub("  +", " ", text).strip(" ") if "  " in text else text.strip(" ")
