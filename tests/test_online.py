"""Online grading: the same rows in any micro-batches give the batch grades."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spotlake.operators import grading
from spotlake.streaming import online

T0 = datetime(2026, 1, 1)
RULES = online.Rules(window=180, freq_tol=500.0, freq_step=100.0, retained=60)
BANDS = ["40m", "20m", "unknown"]


def traffic(seed, n):
    rng = random.Random(seed)
    calls = ["K1ABC", " w1aw", "DL1XX", "G4ZZ", "JA1A", "BUSY"]
    pick = lambda: "busy " if rng.random() < 0.4 else rng.choice(calls)
    freq = {"40m": 7_010_000, "20m": 14_020_000, "unknown": 5_000_000}
    spots, reports = [], []
    for i in range(n):
        band = rng.choice(BANDS)
        row = (pick(), T0 + timedelta(seconds=rng.randrange(7200), microseconds=rng.choice([0, 1])), freq[band] + rng.choice([0, 0, 0, 100, 400, 1400]) + 0.5, rng.choice([None, 20.0, 21.0, 25.0, 40.0]), band)
        if rng.random() < 0.4:
            spots.append((f"s{i}", *row))
        else:
            reports.append((*row, rng.choice(["K5TR-#", "k5tr", "DL8LAS", "ME-#"])))
    feed = [(T0 + timedelta(seconds=s), up) for s, up in ((0, True), (2000, False), (2600, True), (2600, True), (5000, False), (5000, True))]
    return spots, reports, feed


SPOTS, REPORTS, FEED = "spot_id string, call string, ts timestamp, freq double, wpm double, band string", "call string, ts timestamp, freq double, wpm double, band string, spotter string", "ts timestamp, up boolean"


def batch(spark, spots, reports, spans):
    micros = F.unix_micros("ts")
    s = spark.createDataFrame(spots, SPOTS).withColumn("t", micros)
    r = spark.createDataFrame(reports, REPORTS).select(F.monotonically_increasing_id().alias("r_id"), "call", micros.alias("r_t"), F.col("freq").alias("r_freq"), F.col("wpm").alias("r_wpm"), F.col("band").alias("r_band"), F.lit("a").alias("archive"), "spotter")
    spans = spark.createDataFrame(spans, "start timestamp, stop timestamp").select(F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"))
    out = grading.grade_spots(s, r, 180_000_000, 500.0, 3, 0.2, 100.0, 0, excluded=("ME",), spans=spans)
    return {r.spot_id: (r.grade, r.reports, r.skimmers, r.modal_freq, r.median_wpm, r.freq_offset, r.disagreements, r.bands) for r in out.collect()}


def stream(spark, path, spots, reports, feed, parts, per_trigger, seed):
    """The rows as files in order of time, some of a micro-batch shuffled."""
    end = T0 + timedelta(days=1)
    rng = random.Random(seed)
    sources = []
    for name, rows, at, schema in (("s", spots, 2, SPOTS), ("r", reports, 1, REPORTS), ("f", [*feed, (end, True)], 0, FEED)):
        rows = sorted(rows, key=lambda r: r[at])
        # files of equal stretches of time, so that the streams go on together; the far end is in the last
        edges = [T0 + timedelta(seconds=7200 * (i + 1) / parts) for i in range(parts)]
        cut = [[] for _ in range(parts)]
        for r in rows:
            cut[next((i for i, e in enumerate(edges) if r[at] < e), parts - 1)].append(r)
        if name != "f":
            cut[-1] += [("end", "NOBODY", end, 1.0, None, "20m")] if name == "s" else [("NOBODY", end, 1.0, None, "20m", "x")]
        for i, part in enumerate(cut):
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
        sources.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}/{name}"))
    graded = online.grade_online(*sources, RULES, "10 minutes", shards=3, excluded=("ME",))
    query = graded.writeStream.format("memory").queryName(f"graded_{seed}").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(f"graded_{seed}").collect()


@pytest.fixture()
def rocks(spark):
    keys = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize(("parts", "per_trigger"), [(1, 10), (6, 1)])
def test_any_micro_batches_give_the_batch_grades(spark, tmp_path, rocks, parts, per_trigger):
    spots, reports, feed = traffic(1, 400)
    spans = [(T0, T0 + timedelta(seconds=2000)), (T0 + timedelta(seconds=2600), T0 + timedelta(seconds=5000)), (T0 + timedelta(seconds=5000), T0 + timedelta(days=2))]
    want = batch(spark, spots, reports, spans)
    got = stream(spark, tmp_path, spots, reports, feed, parts, per_trigger, parts)
    assert len(got) == len({r.spot_id for r in got}) == len(spots)
    assert {r.spot_id: (r.grade, r.reports, r.skimmers, r.modal_freq, r.median_wpm, r.freq_offset, r.disagreements, r.bands) for r in got} == want
    assert {g[0] for g in want.values()} == {"match", "disagree", "elsewhere", "none", "unknown"}
    assert {r.call for r in got} == {"K1ABC", "W1AW", "DL1XX", "G4ZZ", "JA1A", "BUSY"}


def test_covers():
    feed = [(10, True), (30, False), (30, True), (50, False), (60, True)]
    assert online.covers(feed, 10, 30) and online.covers(feed[::-1], 12, 30) and online.covers(feed, 60, 10**9)
    assert not online.covers(feed, 29, 31) and not online.covers(feed, 9, 20) and not online.covers(feed, 45, 55) and not online.covers([], 0, 1)


def test_grade_one():
    spot = {"id": "a", "call": "K1ABC", "freq": 14_026_400.0, "wpm": 30.0, "band": "20m"}
    heard = [{"freq": 14_025_000.0, "wpm": 20.0, "band": "20m", "spotter": s} for s in ("K5TR", "DL8LAS")]
    got = online.grade_one(spot, heard, True, RULES)
    assert (got["grade"], got["disagreements"], got["freq_offset"], got["skimmers"]) == ("disagree", "frequency,speed", 1400.0, 2)
    assert online.grade_one(spot, [], True, RULES)["grade"] == "none" and online.grade_one(spot, [], False, RULES)["grade"] == "unknown"
    assert online.grade_one(spot, [{**heard[0], "band": "40m"}], True, RULES)["grade"] == "elsewhere"
