"""Operators on small fixtures, against rules written out row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spotlake.functions import numeric, text
from spotlake.operators import aggregates, exchange, gates, grading, history, joins, morse, temporal


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_interval_join(spark, how):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.randrange(-30, 60)) for i in range(40)] + [(40, None, 5)]
    right = [(100 + i, rng.choice("abc"), rng.randrange(-30, 60)) for i in range(40)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "j int, k string, u int")
    got = joins.interval_join(a, b, ["k"], "t", "u", 3, 5, how)
    pairs = [(i, j) for i, k, t in left for j, kk, u in right if k is not None and k == kk and t - 3 <= u <= t + 5]
    met = {i for i, _ in pairs}
    want = {"inner": pairs, "left": pairs + [(i, None) for i, _, _ in left if i not in met], "left_semi": [(i,) for i in met], "left_anti": [(i,) for i, _, _ in left if i not in met]}[how]
    assert rows(got.select(*(["i", "j"] if how in ("inner", "left") else ["i"]))) == sorted(want, key=repr)


def test_nearest_and_containment(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 50.0)], "i int, x double")
    b = spark.createDataFrame([(7, 12.0), (8, 8.0), (9, 90.0)], "j int, y double")
    near = joins.nearest_join(a.withColumn("k", F.lit(1)), b.withColumn("k", F.lit(1)), ["k"], "i", "x", "y", 5, [F.col("j")])
    assert rows(near.select("i", "j")) == [(1, 7)]
    spans = spark.createDataFrame([(1, 0.0, 12.0), (2, 11.0, 100.0), (3, 5.0, 4.0)], "s int, lo double, hi double")
    assert rows(joins.containment_join(b, spans, "y", "lo", "hi", 10).select("j", "s")) == [(7, 1), (7, 2), (8, 1), (9, 2)]


def test_longest_prefix(spark):
    words = spark.createDataFrame([("abc",), ("abd",), ("x",), ("",), (None,)], "w string")
    listed = spark.createDataFrame([("a",), ("ab",), ("abcd",)], "p string")
    assert rows(joins.longest_prefix(words, listed, "w", "p").select("w", "p")) == sorted([("abc", "ab"), ("abd", "ab"), ("x", None), ("", None), (None, None)], key=repr)


def test_merge_and_sessions(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 10), ("k", 1, 2)], "k string, a int, b int")
    assert rows(temporal.merge_intervals(df, ["k"], "a", "b")) == [("k", 0, 7, 3), ("k", 9, 10, 1)]
    assert rows(temporal.merge_intervals(df, ["k"], "a", "b", 2)) == [("k", 0, 10, 4)]
    s = temporal.sessions(df, ["k"], "a", "b", 4)
    assert [r.session for r in s.orderBy("a").collect()] == [0, 0, 0, 0]
    assert [r.session for r in temporal.sessions(df, ["k"], "a", "b", 3).orderBy("a").collect()] == [0, 0, 1, 2]


def test_modal_ties(spark):
    df = spark.createDataFrame([(1, 10.0, 21.0), (1, 20.0, 21.0), (1, 30.0, 21.0)], "k int, v double, near double")
    assert rows(aggregates.modal_nearest(df, ["k"], F.col("v"), F.col("near"), "m")) == [(1, 20.0)]


def test_grades(spark):
    """One spot each of match, disagree, elsewhere, none and unknown."""
    spots = spark.createDataFrame(
        [("m", "A", 1000, 14_025_000.0, 25, "20m"), ("d", "B", 1000, 14_030_000.0, 25, "20m"), ("e", "C", 1000, 14_035_000.0, 25, "20m"), ("n", "D", 1000, 7_001_000.0, 25, "40m"), ("u", "E", 9000, 7_001_000.0, 25, "40m")],
        "spot_id string, call string, t long, freq double, wpm int, band string",
    )
    reports = spark.createDataFrame(
        [(1, " a", 1100, 14_025_100.0, 26, "20m", "x", "S1-#"), (2, "A", 900, 14_025_100.0, 26, "20m", "x", "s1"), (3, "B", 1000, 14_031_000.0, 25, "20m", "x", "S2"), (4, "C", 1180, 7_035_000.0, 25, "40m", "x", "S2"), *[(10 + i, "Z", 700 + 60 * i, 1.0, 1, "20m", "x", None) for i in range(12)]],
        "r_id int, call string, r_t long, r_freq double, r_wpm int, r_band string, archive string, spotter string",
    )
    graded = {r.spot_id: r for r in grading.grade_spots(spots, reports, 180, 500.0, 3, 0.2, 100.0, 60).collect()}
    assert {k: r.grade for k, r in graded.items()} == {"m": "match", "d": "disagree", "e": "elsewhere", "n": "none", "u": "unknown"}
    assert graded["m"].modal_freq == 14_025_100.0 and graded["m"].freq_offset == -100.0
    assert (graded["m"].reports, graded["m"].skimmers, graded["m"].bands) == (2, 1, "20m")
    assert graded["d"].disagreements == "frequency" and graded["e"].bands == "40m"


def test_grades_of_a_day(spark):
    """Four spots of a morning against three archives' reports: a match 100 Hz up, none, a disagreement 1,400 Hz up and 10 WPM off, elsewhere; the median offset is 750 Hz up."""
    spots = [("7", "W1AW", 1000, 14_025_100.0, 25), ("9", "K5XYZ", 1600, 7_012_300.0, 22), ("12", "W1AW", 2800, 14_026_400.0, 30), ("15", "DL1ABC", 3700, 14_030_000.0, 28)]
    heard = [("N4RV", 0, 7021.0, 24, "K5TR"), ("W1AW", 1020, 14025.0, 22, "K5TR"), ("W1AW", 1035, 14025.0, 24, "DL8LAS"), ("W1AW", 1050, 14024.9, 25, "W3LPL"), ("K5XYZ", 1630, 7012.3, 22, "W3XYZ-1"),
             ("W1AW", 2815, 14025.0, 20, "K5TR"), ("W1AW", 2840, 14025.0, 20, "W3LPL"), ("DL1ABC", 3640, 7030.0, 28, "DL8LAS"), ("N4RV", 4600, 7021.0, 24, "K5TR")]
    s = spark.createDataFrame(spots, "spot_id string, call string, t long, freq double, wpm int").withColumn("band", numeric.band_of(F.col("freq")))
    r = spark.createDataFrame([(i, c, t, khz * 1000, w, "day", who) for i, (c, t, khz, w, who) in enumerate(heard)], "r_id int, call string, r_t long, r_freq double, r_wpm int, archive string, spotter string").withColumn("r_band", numeric.band_of(F.col("r_freq")))
    grades = grading.grade_spots(s, r, 180, 500.0, 3, 0.2, 100.0, 5000, excluded=("w3xyz-1", "W3XYZ"))
    got = {g.spot_id: (g.grade, g.reports, g.skimmers, g.modal_freq, g.median_wpm, g.freq_offset, g.disagreements, g.bands) for g in grades.collect()}
    assert got == {
        "7": ("match", 3, 3, 14_025_000.0, 24.0, 100.0, "", "20m"),
        "9": ("none", 0, 0, None, None, None, "", ""),
        "12": ("disagree", 2, 2, 14_025_000.0, 20.0, 1400.0, "frequency,speed", "20m"),
        "15": ("elsewhere", 0, 0, None, None, None, "", "40m"),
    }
    table = {g.band: (g.spots, g.n_match, g.n_disagree, g.n_elsewhere, g.n_none, g.median_offset) for g in grading.by_band(grades).collect()}
    assert table == {"20m": (3, 1, 1, 1, 0, 750.0), "40m": (1, 0, 0, 0, 1, None), None: (4, 1, 1, 1, 1, 750.0)}
    only = grading.grade_spots(s, r, 180, 500.0, 3, 0.2, 100.0, 5000, spotters=("k5tr-#",)).collect()
    assert {g.spot_id: (g.grade, g.reports) for g in only} == {"7": ("match", 1), "9": ("none", 0), "12": ("disagree", 1), "15": ("none", 0)}


def _naive_respots(data, window, bucket, near, gain):
    state, out = {}, []
    for i, t, f, snr, kind, source in data:
        b = round(f / bucket)
        beside = b + (1 if f / bucket > b else -1)
        seen = [state[x] for x in (beside, b) if x in state and t - state[x][0] < window and (x == b or abs(state[x][1] - f) < near)]
        if any(e[4] != source for e in seen):
            out.append((i, "other_input"))
            continue
        last = sorted(seen, key=lambda e: e[0])[-1] if seen else None  # of two as new the own bucket's, which stands last
        if last and snr - last[2] < gain and kind == last[3]:
            out.append((i, "duplicate"))
            continue
        out.append((i, "changed" if last else "new"))
        state[b] = (max(t, state.get(b, (t,))[0]), f, snr, kind, source)
    return out


def test_gates(spark):
    rng = random.Random(2)
    data, t = [], 0
    for i in range(300):
        t += rng.choice([1, 3, 40, 900])
        data.append((i, t, rng.uniform(0, 900), rng.uniform(0, 20), rng.choice(["cq", "de"]), rng.randrange(2)))
    df = spark.createDataFrame([("K1A", *r) for r in data], "call string, id int, t long, f double, snr double, kind string, source int")
    got = gates.respot_dedupe(df, "call", "t", "id", "f", "snr", "kind", "source", 600)
    assert rows(got.select("id", "outcome")) == sorted(_naive_respots(data, 600, 300.0, 93.75, 6.0), key=repr)
    last, want = None, []
    for i, t, *_ in data:
        ok = last is None or t - last >= 100
        last = t if ok else last
        want.append((i, ok))
    assert rows(gates.greedy_gate(df, ["call"], "t", "id", 100).select("id", "admitted")) == sorted(want, key=repr)


def test_respot_ties_go_to_the_own_bucket(spark):
    """Two spots of one time on either side of a bucket's edge: the next is judged by the one in its own bucket, here of its own kind."""
    data = [("K1A", 1, 100, 149.0, 10.0, "cq", 0), ("K1A", 2, 100, 151.0, 20.0, "de", 0), ("K1A", 3, 160, 149.0, 11.0, "cq", 0), ("K1A", 4, 160, 151.0, 21.0, "de", 0)]
    df = spark.createDataFrame(data, "call string, id int, t long, f double, snr double, kind string, source int")
    assert rows(gates.respot_dedupe(df, "call", "t", "id", "f", "snr", "kind", "source", 600).select("id", "outcome")) == [(1, "new"), (2, "changed"), (3, "duplicate"), (4, "duplicate")]


def test_gates_carry_state_over_batches(spark):
    """A key without a silence, longer than an Arrow batch, beside lone rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        data = [("hot", i, i * 7) for i in range(500)] + [("lone", 1000 + i, i * 5000) for i in range(20)]
        got = rows(gates.greedy_gate(spark.createDataFrame(data, "k string, id int, t long"), ["k"], "t", "id", 100).select("id", "admitted"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([(i, i % 15 == 0) for i in range(500)] + [(1000 + i, True) for i in range(20)], key=repr)


def test_streaming_gate_equals_batch(spark, tmp_path):
    from spotlake.streaming import gates as streamed

    rng = random.Random(3)
    data = sorted((f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.choice("ab"), i) for i in range(120))
    df = spark.createDataFrame(data, "ts string, call string, id int").select("id", "call", F.col("ts").cast("timestamp").alias("ts"))
    for n in range(3):
        df.where(f"int((hour(ts)) / 8) = {n}").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = streamed.greedy_gate(source.withWatermark("ts", "12 hours"), ["call"], "ts", "id", 3_600_000)
    query = out.writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = gates.greedy_gate(df.withColumn("t", F.unix_micros("ts")), ["call"], "t", "id", 3_600_000_000)
    assert rows(spark.table("gated").select("id", "admitted")) == rows(batch.select("id", "admitted"))


def test_streaming_respots_equal_batch(spark, tmp_path):
    from spotlake.streaming import gates as streamed

    rng = random.Random(4)
    data = [(i, rng.choice("ab"), 1_700_000_000 + i * 37, rng.uniform(0, 500), rng.uniform(0, 20), rng.choice(["cq", "de"]), rng.randrange(2)) for i in range(150)]
    df = spark.createDataFrame(data, "id int, call string, s long, f double, snr double, kind string, source long").withColumn("ts", F.timestamp_seconds("s"))
    for n in range(3):
        df.where(f"id >= {n * 50} AND id < {n * 50 + 50}").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = streamed.respot_dedupe(source.withWatermark("ts", "1 hour"), "call", "ts", "id", "f", "snr", "kind", "source", 600_000)
    query = out.writeStream.format("memory").queryName("respots").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = gates.respot_dedupe(df.withColumn("t", F.unix_micros("ts")), "call", "t", "id", "f", "snr", "kind", "source", 600_000_000)
    assert rows(spark.table("respots").select("id", "outcome")) == rows(batch.select("id", "outcome"))


def test_overlap_join(spark):
    rng = random.Random(11)
    span = lambda n: [(i, a := rng.uniform(0, 100), a + rng.uniform(0, 30)) for i in range(n)]
    left, right = span(30), span(30)
    got = joins.overlap_join(spark.createDataFrame(left, "i int, a double, b double"), spark.createDataFrame(right, "j int, c double, d double"), ("a", "b"), ("c", "d"), 7.0)
    assert rows(got.select("i", "j")) == sorted(((i, j) for i, a, b in left for j, c, d in right if a < d and c < b), key=repr)


def test_streaming_activity(spark, tmp_path):
    from spotlake.streaming import grading as streamed

    df = spark.createDataFrame([("a", "20m", 0), ("b", "20m", 30), ("a", "40m", 4000)], "call string, band string, s long").select("call", "band", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streamed.activity(source, "10 minutes", "1 minute").writeStream.format("memory").queryName("activity").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.table("activity").select("band", "spots", "calls")) == [("20m", 2, 2)]


def test_streaming_report_counts_and_sessions(spark, tmp_path):
    from spotlake.streaming import grading as streamed

    base = 1_700_000_000
    spots = spark.createDataFrame([("s1", "A", 100, "20m"), ("s2", "B", 200, "20m"), ("s3", "Z", 90_000, "20m")], "spot_id string, call string, s long, band string").select("spot_id", "call", "band", F.timestamp_seconds(F.col("s") + base).alias("ts"))
    reports = spark.createDataFrame([("A", 130, "20m"), ("A", 90, "40m"), ("A", 9_000, "20m"), ("Z", 90_000, "20m")], "call string, s long, r_band string").select("call", "r_band", F.timestamp_seconds(F.col("s") + base).alias("r_ts"))
    spots.coalesce(1).write.parquet(str(tmp_path / "spots"))
    reports.coalesce(1).write.parquet(str(tmp_path / "reports"))
    live = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    counted = streamed.report_counts(live(spots, "spots"), live(reports, "reports"), "3 minutes", "1 minute")
    activity = streamed.sessions(live(spots, "spots"), "10 minutes", "1 minute")
    queries = [df.writeStream.format("memory").queryName(name).outputMode("append").start() for df, name in ((counted, "counted"), (activity, "spans"))]
    try:
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    assert rows(spark.table("counted").select("spot_id", "same", "other")) == [("s1", 1, 1), ("s2", 0, 0)]
    assert rows(spark.table("spans").select("call", "n")) == [("A", 1), ("B", 1)]


def test_morse_round_trip_and_roles(spark):
    texts = spark.createDataFrame([(1, "CQ CQ DE K1ABC", 60.0), (2, "E", 50.0), (3, "paris /?", 20.0)], "id int, text string, dit double")
    decoded = morse.decode_runs(morse.keyed_runs(texts, "id", "text", F.col("dit")))
    assert rows(decoded) == [(1, "CQ CQ DE K1ABC"), (2, "E"), (3, "PARIS /?")]
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("CQ DX K1ABC K1ABC W2XYZ DE K1ABC W2XYZ 5NN".split())], "turn int, n int, word string")
    found = exchange.call_roles(words, ["turn"], "n").orderBy("n").collect()
    assert [(r.call, r.role) for r in found] == [("K1ABC", "self"), ("W2XYZ", "addressee"), ("K1ABC", "self"), ("W2XYZ", "addressee")]


def test_signal_tone_lands_in_its_channel(spark):
    import numpy as np

    from spotlake.operators import signal

    n, channels = 4096, 64
    tone = np.exp(2j * np.pi * 5 / channels * np.arange(n))
    data = [("a", b, b * 512, tone.real[b * 512 : b * 512 + 512].tolist(), tone.imag[b * 512 : b * 512 + 512].tolist()) for b in range(n // 512)]
    blocks = spark.createDataFrame(data, "input string, block long, start_ts long, re array<double>, im array<double>")
    hops = signal.channelize(blocks, channels).orderBy("hop").collect()
    assert [h.sample_ts for h in hops] == [16 * h.hop for h in hops]
    assert {int(np.argmax(h.power)) for h in hops} == {5}
    bigger = [("a", b, b * 1024, tone.real[b * 1024 : b * 1024 + 1024].tolist(), tone.imag[b * 1024 : b * 1024 + 1024].tolist()) for b in range(n // 1024)]
    again = signal.channelize(spark.createDataFrame(bigger, blocks.schema), channels).orderBy("hop").collect()
    shared = {h.hop: h.power for h in again}
    assert all(np.allclose(h.power, shared[h.hop]) for h in hops if h.hop in shared)


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(numeric.band_of(F.lit(14_000_000.0))) == "20m" and value(numeric.band_of(F.lit(1.0))) == "unknown"
    assert value(numeric.parabolic_offset(F.lit(0.0), F.lit(1.0), F.lit(0.0))) == 0.0
    assert value(numeric.parabolic_offset(F.lit(2.0), F.lit(1.0), F.lit(0.0))) is None
    assert value(numeric.wire_snr(F.lit(10.0))) == 17
    assert [value(text.is_plausible(F.lit(c))) for c in ("K1ABC", "ABC", "123", "K1ABC/P", "K1ABC/XX", "5NN")] == [True, False, False, True, False, False]
    assert value(text.common_prefix_length(F.lit("K1ABC"), F.lit("K1AXX"))) == 3
    assert value(text.variant_relation(F.lit("K1ABC"), F.lit("K1ABD"))) == "similar"
    assert value(text.last_report(F.lit("UR 579 5NN"))) == "599"
    assert value(text.cq_caller(F.lit("CQ DX K1ABC FN42"))) == "K1ABC" and value(text.cq_caller(F.lit("CQ K1ABC FN42"))) == "K1ABC"
    assert value(text.locator(F.lit(41.714775), F.lit(-72.727260))) == "FN31pr"
    assert value(text.dx_line(F.lit("W1AW"), F.lit(14025.1), F.lit("K1ABC"), F.lit("CW"), F.lit(17), F.lit(25), F.lit("CQ"), F.lit("1234"))).index("K1ABC") == 26


def test_history(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "seq int, t int")
    assert [r.seq for r in history.newest(df, "seq", 3, F.col("seq") % 2 == 0).collect()] == [4, 6, 8]
    assert history.within(df, "t", 90, 0).count() == 0 and history.within(df, "t", 90, 20).count() == 2


def test_sources(spark, tmp_path):
    from spotlake.sources import files, sinks

    (tmp_path / "s.jsonl").write_text('{"id":"x","timestamp":5,"frequency":14025000,"dxCall":"K1ABC"}\n{"kind":"grade"}\n{"id":"torn\n')
    assert [r.dxCall for r in files.read_spots(spark, str(tmp_path / "s.jsonl")).collect()] == ["K1ABC"]
    assert files.bad_spot_lines(spark, str(tmp_path / "s.jsonl")) == 1
    (tmp_path / "r.csv").write_text("callsign,freq,dx,mode,db,date,speed\nw1aw-#,14025.1,k1abc,CW,20,2026-10-11 00:00:10,25\nbad,row,x,CW,1,never,\n")
    report = files.read_reports(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.spotter, r.call, round(r.freq_hz), r.time) for r in report] == [("W1AW", "K1ABC", 14025100, 1791676810)]
    assert [r.value for r in files.bad_reports(spark, str(tmp_path / "r.csv")).collect()] == ["bad,row,x,CW,1,never"]
    spot = spark.createDataFrame([("K1ABC", 14025100.0, 10.0, 25.0, "cq", "CW", 1_791_676_810)], "callsign string, freq_hz double, snr_db double, wpm double, spot_type string, mode string, time long")
    line = sinks.cluster_lines(spot, "W1AW").collect()[0].line
    parsed = files.parse_dx_lines(spark.createDataFrame([(line,), ("hello",)], "value string")).collect()
    assert [(p.spotter, p.khz, p.call, p.snr, p.wpm, p.kind, p.hhmm) for p in parsed] == [("W1AW", 14025.1, "K1ABC", 17, 25, "CQ", "0000")]
    (tmp_path / "n.txt").write_text("# c\n100-200\nx\n")
    assert rows(files.read_ranges(spark, str(tmp_path / "n.txt"))) == [(100.0, 200.0)]
    assert [r.value for r in files.bad_ranges(spark, str(tmp_path / "n.txt")).collect()] == ["x"]
    assert [r.value for r in files.bad_dx_lines(spark.createDataFrame([(line,), ("hello",), (None,)], "value string")).collect()] == ["hello", None]
    import numpy as np

    np.arange(10, dtype="<f4").tofile(tmp_path / "a.cf32")
    blocks = files.read_samples(spark, str(tmp_path / "a.cf32"), block=2).orderBy("block").collect()
    assert [b.re for b in blocks] == [[0.0, 2.0], [4.0, 6.0], [8.0]] and [b.start_ts for b in blocks] == [0, 2, 4]


def test_skimmer_lines(spark):
    from spotlake.sources import files

    lines = {
        "DX de W1AW-#:    14025.1  K1ABC          CW    17 dB  25 WPM  CQ      1234Z": ("spot", "W1AW", 14025.1, "K1ABC", 17, 25, "CQ"),
        "DX de w3xyz-1-#: 7012.3 DL1ABC 9 dB 22 WPM NCDXF B 0000Z": ("spot", "W3XYZ-1", 7012.3, "DL1ABC", 9, 22, "BEACON"),
        "DX de W1AW:  14080.0  K1ABC  RTTY  12 dB  45 BPS  CQ 1234Z": ("other_mode", None, None, None, None, None, None),
        "DX de W1AW:  14025.1  K1ABCDEFGHIJKLMN 12 dB 25 WPM 1234Z": ("spot", "W1AW", 14025.1, "K1ABCDEFGHIJKLMN", 12, 25, "unknown"),
        "DX de W1AW:  14025.1  K1ABCDEFGHIJK/PCW 12 dB 25 WPM 1234Z": ("spot", "W1AW", 14025.1, "K1ABCDEFGHIJK/P", 12, 25, "unknown"),
        "To ALL de W1AW: hello": ("none", None, None, None, None, None, None),
        "DX de W1AW:  -1 K1ABC CW 1 dB 20 WPM 1234Z": ("none", None, None, None, None, None, None),
    }
    got = {r.value: (r.kind, r.spotter, r.khz, r.call, r.snr, r.wpm, r.type) for r in files.parse_skimmer_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == lines


def test_ledger_and_metrics(spark, tmp_path):
    from spotlake.sources import files

    (tmp_path / "l.jsonl").write_text('{"kind":"sample","ts":5.0,"reachable":true,"counters":{"a":3}}\n{"kind":"note","start":1,"end":2,"planned":true}\n{"kind":"other"}\n{"kind":"sam\n')
    assert rows(files.read_ledger(spark, str(tmp_path / "l.jsonl")).select("kind", "ts", "planned")) == sorted([("sample", 5.0, None), ("note", None, True)], key=repr)
    text = ["# HELP x", 'spots_total{source="a b",type="CQ"} 12', "up 1", "broken{", 'lag{le="+Inf"} NaN 1700']
    got = files.parse_metrics(spark.createDataFrame([(x,) for x in text], "value string")).collect()
    assert [(r.family, r.labels) for r in got] == [("spots_total", {"source": "a b", "type": "CQ"}), ("up", {}), ("lag", {"le": "+Inf"})] and got[0].number == 12.0


def test_country_rules(spark):
    from spotlake.operators import country

    aliases = spark.createDataFrame([("K", False, False, 1, 291, "NA", 5), ("KH6", False, False, 2, 110, "OC", 31), ("KH6", False, True, 3, 999, "OC", 31), ("K1ABC", True, False, 4, 1, "EU", 14)], "prefix string, exact boolean, starred boolean, o long, dxcc long, continent string, zone int")
    calls = spark.createDataFrame([(c,) for c in ("k9aa", "KH6X", "K1ABC", "K1ABC/P", "K1ABCD", "K1ABC/XX", "K9AA/MM", "Q1A", "")], "call string")
    got = {r.call: (r.dxcc, r.continent, r.zone) for r in country.geography(calls, country.tidy_aliases(aliases, "o"), "call").collect()}
    home = (291, "NA", 5)
    assert got == {"k9aa": home, "KH6X": (999, "OC", 31), "K1ABC": (1, "EU", 14), "K1ABC/P": (1, "EU", 14), "K1ABCD": home, "K1ABC/XX": home, "K9AA/MM": (0, "", 0), "Q1A": (-1, "", 0), "": (-1, "", 0)}


def test_text_budget_and_locators(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(text.fitting(F.lit("a\u00e9\U0001f389b"), n)) for n in (0, 1, 2, 3, 6, 7, 99)] == ["", "a", "a", "a\u00e9", "a\u00e9", "a\u00e9\U0001f389", "a\u00e9\U0001f389b"]
    lat, lon = text.locator_centre(F.lit("FN31pr"))
    assert round(value(lat), 6) == 41.729167 and round(value(lon), 6) == -72.708333
    lat, lon = text.locator_centre(F.lit("FN31"))
    assert (value(lat), value(lon)) == (41.5, -73.0) and value(text.locator_centre(F.lit("ZZ99"))[0]) is None
