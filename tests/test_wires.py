"""Messages, relays, uplinks and packing; noise and crashes; decimation in stages."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.functions import text as T
from spotlake.operators import noise, signal
from spotlake.sources import files, sinks

SPOTS = "callsign string, freq_hz double, snr_db double, wpm double, baud double, rst string, qrl boolean, track_id long, sample_ts long, confidence double, time long, seq long, dx_grid string, spotter string, spot_type string, mode string"
ROW = ("W1AW", 14_025_100.4, 20.6, 25.4, None, "599", True, 7, 960, 0.9, 1_791_720_000, 3, "FN31", "K5TR", "cq", "CW")
ALIASES = "prefix string, exact boolean, dxcc long, continent string, zone int"


def test_messages_have_all_keys(spark):
    spots = spark.createDataFrame([ROW, ("QQ0X", *ROW[1:]), ("W1AW/MM", *ROW[1:])], SPOTS)
    aliases = spark.createDataFrame([("W", False, 291, "NA", 5), ("W3XYZ", True, 1, "EU", 14)], ALIASES)
    got = [json.loads(r.value) for r in sinks.spot_messages(spots, aliases, "W3XYZ-1", "n", "v1", "FN20xr").collect()]
    names = [c.split(" ")[0] for c in files.SPOT.split(", ")]
    assert all(list(d) == names and len(d) == 30 for d in got)
    one = next(d for d in got if d["dxCall"] == "W1AW")
    assert (one["id"], one["frequency"], one["band"], one["snr"], one["wpm"], one["seq"], one["snrRefHz"], one["rst"], one["qrlQuery"]) == ("W3XYZ-1:n:7:960:W1AW", 14_025_100, "20m", 21, 25, 3, 2500, "599", True)
    assert (one["dxDxcc"], one["dxContinent"], one["dxCqZone"], one["deDxcc"], one["deContinent"]) == (291, "NA", 5, 1, "EU")
    assert one["deLat"] == pytest.approx(40.729, abs=0.01) and one["dxLat"] is None and one["baud"] is None
    assert {d["dxCall"]: d["dxDxcc"] for d in got} == {"W1AW": 291, "QQ0X": -1, "W1AW/MM": 0}
    cycle = json.loads(sinks.spot_messages(spots, aliases, "W3XYZ", "n", "v1", mode="FT8").first().value)
    assert (cycle["mode"], cycle["wpm"], cycle["decodeConfidence"], cycle["rst"], cycle["dxGrid"], cycle["deGrid"], cycle["deLat"]) == ("FT8", None, None, None, "FN31", None, None)


def test_relayed_lines_keep_their_columns(spark):
    spots = spark.createDataFrame([ROW, (*ROW[:-1], "FT8")], SPOTS)
    cw, ft8 = (r.line for r in sinks.relay_lines(spots).collect())
    assert cw.startswith("DX de K5TR-#:") and cw[:24].endswith("14025.10") and " 20 dB  25 WPM CQ" in cw
    assert len(cw) == len(ft8) and "WPM" not in ft8 and ft8.index("CQ") == cw.index("CQ") and ft8[-5:] == cw[-5:]


def test_uplink_filters_then_limits(spark):
    rows = [(f"K{i}AB", *ROW[1:10], 1000 + i, i, None, "K5TR", "cq" if i % 3 else "beacon", "CW") for i in range(30)]
    got = [r.time for r in sinks.uplink_lines(spark.createDataFrame(rows, SPOTS), "W3XYZ", ("cq", "de"), 10, 4).collect()]
    assert sorted(got) == [1001, 1002, 1004, 1005, 1010, 1011, 1013, 1014, 1020, 1022, 1023, 1025]


def test_packing_fills_datagrams(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([40, 60, 300, 2000])) for k in "ab" for i in range(200)]
    got = sinks.packed(spark.createDataFrame(rows, "k string, i long, size long").withColumn("t", F.col("i")).repartition(3), ["k"], "t", "i", F.col("size"), 1400, 16, 120).collect()
    for key in "ab":
        place = {r.i: r.datagram for r in got if r.k == key}
        n, used = -1, 10**9
        for k, i, size in rows:
            if k == key:
                if used + size > 1400:
                    n, used = n + 1, 16 + (120 if n + 1 < 3 else 0)
                used += size
                assert place[i] == n


def test_squares_hold_their_places(spark):
    rows = [("FN31", 41.0, -74.0, True), ("FN31", 42.0, -74.0, False), ("FN31", 41.99, -72.01, True), ("FN31pr", 41.729, -72.71, True), ("FN31pr", 41.76, -72.71, False), ("XX", 0.0, 0.0, None)]
    got = spark.createDataFrame(rows, "g string, lat double, lon double, want boolean").select("want", T.in_locator(F.col("g"), F.col("lat"), F.col("lon")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_noise_is_unbiased(spark):
    rng = np.random.default_rng(2)
    power = rng.exponential(1.0, (3, 6000))
    rows = spark.createDataFrame([(c, h, float(power[c, h])) for c in range(3) for h in range(6000)] + [(0, 6000, None)], "channel int, hop long, power double")
    got = noise.noise_levels(rows).where("hop >= 600").groupBy().agg(F.avg("noise").alias("x")).first().x
    assert abs(10 * np.log10(got)) < 0.5
    raised = noise.noise_levels(rows.where("channel = 0"), neighbours=rows.where("channel = 0").select("channel", "hop", F.lit(100.0).alias("level"))).first().noise
    assert raised == pytest.approx(50 * 10**0.15)


def test_crashes_enter_leave_and_give_way(spark):
    rng = np.random.default_rng(3)
    levels = rng.normal(-100, 1, (1600, 40))
    levels[200:260] += 20  # a crash
    levels[300:302] += 20  # too short
    levels[600:] += 15  # a change of level
    hops = spark.createDataFrame([("a", h, levels[h].tolist()) for h in range(1600)] + [("few", 0, [0.0] * 5)], "input string, hop long, levels array<double>")
    got = {r.hop: r for r in noise.crash_hops(hops, 50).where("input = 'a'").collect()}
    inside = [h for h in range(1600) if got[h].crash]
    assert inside[0] == 202 and not got[280].crash and not any(got[h].crash for h in range(290, 600))
    assert got[258].crash and 260 <= max(h for h in inside if h < 500) < 270
    assert got[700].crash and not got[1599].crash and got[1599].crashes == 2
    assert got[10].lift is None and noise.crash_hops(hops, 0).where("input = 'few'").first().lift is None


def test_decimation_in_stages(spark):
    t = np.arange(8192)
    low, high = np.exp(2j * np.pi * 0.01 * t), np.exp(2j * np.pi * 0.2 * t)
    x = (low + high).astype("c16")
    blocks = spark.createDataFrame([("a", i, i * 1024, x[i * 1024 : (i + 1) * 1024].real.tolist(), x[i * 1024 : (i + 1) * 1024].imag.tolist()) for i in range(8)], "input string, block long, start_ts long, re array<double>, im array<double>")
    rows = sorted(signal.decimate(blocks, 4).collect(), key=lambda r: r.start_ts)
    got = np.concatenate([np.array(r.re) + 1j * np.array(r.im) for r in rows])
    assert [r.start_ts for r in rows] == [i * 256 for i in range(8)] and 1900 < len(got) < 2048
    spectrum = np.abs(np.fft.fft(got[:1024])) / 1024
    assert spectrum.argmax() == round(0.04 * 1024) and spectrum.max() > 0.8 and np.sort(spectrum)[-8:-7] < 0.2  # the high tone is gone
    assert signal.trusted_bandwidth(48_000, 1) == 48_000 and 10_000 < signal.trusted_bandwidth(48_000, 4) < 12_000
    with pytest.raises(ValueError):
        signal.decimate(blocks, 3)
