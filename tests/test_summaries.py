"""Schedules, verdicts, neighbours and cycle spots on cases that the tables don't hold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spotlake.functions import schedules
from spotlake.operators import summaries


def test_schedules(spark):
    daily, overrides = ((1080, "night"), (360, "day")), ((22_000, 70_000, "contest"), (100_000, 100_060, "b"))
    rows = [(0, "night", 21_600), (21_599, "night", 21_600), (21_600, "day", 22_000), (22_000, "contest", 64_800), (69_999, "contest", 70_000), (70_000, "night", 100_000), (-1, "night", 21_600)]
    got = spark.createDataFrame(rows, "u long, name string, change long").select("name", "change", schedules.active_segments(F.col("u"), "base", daily, overrides).alias("n"), schedules.next_change(F.col("u"), daily, overrides).alias("c")).collect()
    assert [(r.n, r.c) for r in got] == [(r.name, r.change) for r in got]
    one = spark.range(1).select(schedules.active_segments(F.col("id"), "base").alias("a"), schedules.active_segments(F.col("id"), None).alias("b"), schedules.next_change(F.col("id")).alias("c")).first()
    assert (one.a, one.b, one.c) == ("base", None, schedules.NEVER)


def test_cycle_coverage(spark):
    low, high = F.lit(7_074_000), F.lit(7_077_000)
    held = lambda centre, rate, band, trusted=None: spark.range(1).select(schedules.cycle_coverage(low, high, F.lit(centre), F.lit(rate), tuple(map(F.lit, band)), tuple(map(F.lit, trusted)) if trusted else None).alias("x")).first().x
    assert held(7_070_000, 96_000, (-48_000, 48_000)) == "inside"
    assert held(7_070_000, 96_000, (-48_000, 48_000), (-5000, 5000)) == "partial"
    assert held(7_070_000, 96_000, (-48_000, 4000)) == "outside"
    assert held(0, 96_000, (-48_000, 48_000)) == "no_reference" and held(7_070_000, 44_100, (-1, 1)) == "unsupported_rate"


def test_verdicts(spark):
    rows = [(1, 0, 0, None, "decoding"), (0, 0, 0, None, "no_signal"), (0, 0, 5, None, "not_cw"), (0, 2, 5, 9.0, "weak_no_decode"), (0, 2, 5, 1.0, "noisy_no_decode"), (0, 2, 0, None, "activity_no_snr")]
    got = spark.createDataFrame(rows, "s int, p int, c int, snr double, want string").select("want", summaries.receiver_verdict(F.col("s"), F.col("p"), F.col("c"), F.col("snr")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    heard = spark.createDataFrame([("CW", None, "CW"), ("CW", "CW", "CW"), ("CW", "RTTY", "none"), (None, "RTTY", "RTTY"), (None, None, None)], "a string, b string, want string")
    assert all(r.want == r.got for r in heard.select("want", summaries.mode_shown(F.col("a"), F.col("b")).alias("got")).collect())


def test_neighbours_around_the_circle(spark):
    rng = random.Random(1)
    for reach, n in ((2.5, 64), (40.0, 64), (1.0, 5)):
        rows = [(k, i, rng.uniform(-2, n + 2)) for k in range(2) for i in range(25)] + [(0, 99, None), (0, 98, float("nan"))]
        got = summaries.neighbours(spark.createDataFrame(rows, "k int, track int, centre double"), ["k"], n, reach).collect()
        want = set()
        for k, i, a in rows:
            for k2, j, b in rows:
                if k == k2 and i < j < 90:
                    d = abs(a % n - b % n)
                    if min(d, n - d) <= reach:
                        want.add((k, i, j))
        assert {(r.k, r.low, r.high) for r in got} == want and len(got) == len(want)


def test_cycle_calls(spark):
    texts = ["CQ K1ABC FN42", "CQ DX K1ABC", "CQ POTA W1AW/P EM10", "K1ABC W1AW -05", "CQ K1ABC RR73", "CQ", "CQ TEST", None]
    rows = [(i, 15 * i, 0, "FT8", "40m", t, 0) for i, t in enumerate(texts)]
    got = summaries.cycle_spots(spark.createDataFrame(rows, "m_id long, slot long, input int, mode string, band string, text string, place int"), 60)
    assert sorted((r.m_id, r.caller, r.grid) for r in got.collect()) == [(0, "K1ABC", "FN42"), (2, "W1AW/P", "EM10"), (4, "K1ABC", None)]


def test_lists_are_refused(spark):
    prefix = lambda *p: spark.createDataFrame([(x,) for x in p], "prefix string")
    calls = spark.createDataFrame([("K1ABC",), ("G4AB",)], "call string")
    held = prefix("K", "G", "F", "EA")
    told = lambda fetched: summaries.list_verdict(fetched, held, calls).first()
    assert told(prefix("K1", "G", "F", "I"))["verdict"] == "accepted" and told(prefix("K", "G"))["verdict"] == "short"
    assert (told(prefix("K", "F", "I", "O"))["verdict"], told(prefix("K", "F"))["missing"]) == ("canary", "G4AB") and told(prefix())["verdict"] == "empty"
