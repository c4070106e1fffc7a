"""Adaptive decoders against exhaustive search, plain loops and round trips."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spotlake.operators import beam, carried, morse, segments, speed


# -- characters by beam


def all_readings(marks, dot, dash, sigma):
    """Every character with as many marks, by its score."""
    out = []
    for pattern, glyph in beam.PATTERNS.items():
        if len(pattern) == len(marks):
            score = -sum(math.log(d / (dot if c == "0" else dash)) ** 2 / (2 * sigma * sigma) for c, d in zip(pattern, marks, strict=True))
            out.append((-score, pattern, glyph))
    out.sort()
    total = sum(math.exp(out[0][0] - w) for w, _, _ in out) if out else 1
    return [(g, -w, math.exp(out[0][0] - w) / total) for w, _, g in out]


def test_full_beam_is_exhaustive(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(20, 300) for _ in range(rng.randrange(1, 8))]) for i in range(400)] + [(400, []), (401, None), (402, [50.0] * 6), (403, [50.0] * 9)]
    df = spark.createDataFrame(rows, "id int, marks array<double>")
    got = {r.id: r.readings for r in df.select("id", beam.char_readings(F.col("marks"), F.lit(60.0), F.lit(180.0), width=200).alias("readings")).collect()}
    for i, marks in rows:
        if not marks or (len(marks) > 6 and not all(d < 60 * 3**0.5 for d in marks)):
            assert got[i] is None
        elif len(marks) >= 6 and all(d < 60 * 3**0.5 for d in marks):
            assert [r.glyph for r in got[i]] == ["<err>"]
        else:
            want = all_readings(marks, 60, 180, beam.SIGMA)
            assert [(r.glyph, pytest.approx(r.score), pytest.approx(r.confidence)) for r in got[i]] == want
    assert sum(r is not None and len(r) > 3 for r in got.values()) > 100


def test_narrow_beam_keeps_the_best_nodes(spark):
    """Against the same pruning in a plain loop; a beam may lose every character, which gives `?`."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(40, 200) for _ in range(rng.randrange(1, 7))]) for i in range(300)]
    got = {r.id: r.readings for r in spark.createDataFrame(rows, "id int, marks array<double>").select("id", beam.char_readings(F.col("marks"), F.lit(60.0), F.lit(180.0), F.lit(0.5), 2).alias("readings")).collect()}
    lost = 0
    for i, marks in rows:
        kept = [(0.0, "")]
        for d in marks:
            kept = sorted((w + math.log(d / u) ** 2 / (2 * beam.SIGMA**2), p + c) for w, p in kept for c, u in (("0", 60), ("1", 180)) if p + c in beam.PREFIXES)[:2]
        named = [beam.PATTERNS[p] for _, p in kept if p in beam.PATTERNS]
        if got[i] is not None and [r.glyph for r in got[i]] != ["<err>"]:
            assert [r.glyph for r in got[i]] == (named or (["?"] if kept else None))
            assert sum(r.confidence for r in got[i]) == pytest.approx(0.5 if named else 0)
            lost += not named
    assert lost


# -- speed


def marks_of(text, dit, rng, spread=0.08):
    pattern = "".join(morse.CODE.get(c, "") for c in text)
    return [dit * (1 if e == "." else 3) * math.exp(rng.gauss(0, spread)) for e in pattern]


def test_tracker_follows_a_change_of_speed(spark):
    rng = random.Random(3)
    lengths = marks_of("PARIS CQ DE K1ABC PARIS", 60, rng) + marks_of("PARIS TEST K1ABC CQ PARIS " * 3, 28, rng) + marks_of("EEEEEEEEEEEEEEEE PARIS" * 2, 140, rng)
    rows = [(key, i, x) for key in ("a", "b") for i, x in enumerate(lengths if key == "a" else lengths[:70])]
    df = spark.createDataFrame(rows, "key string, i int, d double").repartition(3)
    got = speed.track_speed(df, ["key"], ["i"], "d").collect()
    plain = speed.Tracker()
    want = [("a", i, plain.mark(x), plain.low, plain.high, plain.regime) for i, x in enumerate(lengths)]
    assert sorted(map(tuple, (r for r in got if r.key == "a")), key=lambda r: r[1]) == want
    assert len(got) == len(rows) and want[3][2] is None and want[50][3] == pytest.approx(60, rel=0.2) and want[-1][3] == pytest.approx(140, rel=0.2) and want[-1][5] == 1


def test_bank_switches_and_is_vetoed_by_gaps():
    """A dash-heavy start is read as dots of three times the length; the bank finds the true speed from the gaps, one tracker alone does not."""
    rng = random.Random(4)
    bank, alone = speed.Bank(3), speed.Bank(1)
    text = [c for c in "TTTTT MOM TOM MOTTO OTTO MOM TOM" if c != " "]
    for c in text:
        for e in morse.CODE[c]:
            length = 45 * (3 if e == "-" else 1) * math.exp(rng.gauss(0, 0.05))
            for b in (bank, alone):
                b.mark(length)
                b.gap(45 * math.exp(rng.gauss(0, 0.05)))
        for b in (bank, alone):
            b.gap(90.0)
    assert bank.switches >= 1 and bank.held[0].tracker.low == pytest.approx(45, rel=0.3)
    assert alone.switches == 0 and len(alone.held) == 1
    # the same marks without gaps never switch: nothing speaks against the first reading
    mute = speed.Bank(3)
    for c in text:
        for e in morse.CODE[c]:
            mute.mark(45 * (3 if e == "-" else 1))
    assert mute.switches == 0 and len(mute.held) <= 3


def test_bank_in_tasks(spark):
    rng = random.Random(5)
    rows = []
    for key in range(4):
        for i in range(120):
            rows.append((key, i, i % 2 == 0, rng.choice([1, 3] if i % 2 == 0 else [1, 1, 3, 7]) * 45.0 * math.exp(rng.gauss(0, 0.2)) * (1 if i < 60 else 1.8)))
    rows.append((0, 500, True, None))
    got = speed.bank_speed(spark.createDataFrame(rows, "key int, i int, mark boolean, d double").repartition(3), ["key"], ["i"], "mark", "d").collect()
    for key in range(4):
        bank, want = speed.Bank(3), []
        for k, i, mark, d in rows:
            if k == key and d is not None:
                if mark:
                    dot = bank.mark(d)
                    want.append((key, i, dot, bank.held[0].tracker.low, bank.held[0].tracker.high, len(bank.held), bank.switches))
                else:
                    bank.gap(d)
        assert sorted(tuple(r) for r in got if r.key == key) == want


# -- segments


def evidence_of(text, dit, rng, noise=0.15, strength=0.8):
    """Hops of evidence for a keyed text, lengths spread by noise."""
    hops = []
    words = text.split(" ")
    for w, word in enumerate(words):
        for c, char in enumerate(word):
            for e, element in enumerate(morse.CODE[char]):
                hops += [strength] * max(1, round(dit * (1 if element == "." else 3) * (1 + rng.uniform(-noise, noise))))
                gap = 1 if e < len(morse.CODE[char]) - 1 else 3 if c < len(word) - 1 else 7 if w < len(words) - 1 else 1
                hops += [-strength] * max(1, round(dit * gap * (1 + rng.uniform(-noise, noise))))
    return hops


def anchors_of(hops):
    out, total = [], 0.0
    for i, e in enumerate(hops):
        if i == 0 or (e > 0) != (hops[i - 1] > 0):
            out.append((i, total))
        total += e
    return [*out, (len(hops), total)]


def exhaustive(anchored, cfg):
    """The best text over all ways to cut at any of the anchors, by plain recursion without any merging or pruning."""
    best = {}

    def go(i, r):
        if i == len(anchored) - 1:
            if r.node in segments.GLYPHS:
                text = "".join(e[0] for e in r.pending) + segments.GLYPHS[r.node]
            elif not r.node:
                text = "".join(e[0] for e in r.pending)
            else:
                return
            best[text] = max(best.get(text, -math.inf), r.score)
            return
        for j in range(i + 1, len(anchored)):
            for nxt in segments.followed(r, anchored[j][0] - anchored[i][0], anchored[j][1] - anchored[i][1], anchored[i][0], cfg):
                go(j, nxt)

    for u in cfg.speeds:
        go(0, segments.Reading(0.0, "", False, u, 0, ()))
    return best


def test_wide_beam_equals_exhaustive_search():
    """With fixed speeds merging is exact: a wide beam without early output finds the best of all readings."""
    cfg = segments.Settings(alpha=0.0, beam=10_000, lookahead=math.inf, agree=False, speeds=(9.0, 13.0, 18.0))
    rng, compared = random.Random(6), 0
    for trial in range(40):
        hops = evidence_of(rng.choice(["A", "K1", "E T", "SO", "N A"]), rng.choice([9, 12, 17]), rng, 0.3)
        hops = [e + rng.gauss(0, 0.9) for e in hops] if trial % 4 == 0 else hops
        anchored = anchors_of(hops)
        if len(anchored) > 16:
            anchored = anchored[:15] + [anchored[-1]]
        want = exhaustive(anchored, cfg)
        decoder = segments.Decoder(cfg)
        got = [o for hop, total in anchored for o in decoder.push(hop, total)]
        assert not got
        if decoder.anchors[-1][0] == anchored[-1][0]:
            text = "".join(o[0] for o in decoder.finish())
            if want:
                assert want[text] == pytest.approx(max(want.values()))
                compared += 1
    assert compared > 20


def test_decodes_keyed_texts_at_several_speeds(spark):
    rng = random.Random(7)
    sent = {i: (text, dit) for i, (text, dit) in enumerate(itertools.product(["CQ CQ DE K1ABC K1ABC", "TU 599 001", "PARIS PARIS / QRZ?"], [8, 13, 20, 37]))}
    rows = [(i, hop, e) for i, (text, dit) in sent.items() for hop, e in enumerate(evidence_of(text, dit, rng))]
    hops = spark.createDataFrame(rows, "track int, hop long, e double").repartition(4)
    anchored = segments.anchors(hops, "track", "hop", "e")
    assert sorted((r.hop, round(r.total, 6)) for r in anchored.where("track = 3").collect()) == [(h, round(t, 6)) for h, t in anchors_of([e for i, _, e in rows if i == 3])]
    got = {r.track: r for r in segments.texts(segments.decode(anchored)).collect()}
    assert {i: r.text for i, r in got.items()} == {i: text for i, (text, _) in sent.items()}
    assert all(0.5 < r.confidence <= 1 for r in got.values())


def test_forced_output_holds_the_readings_to_it():
    """Output within a short lookahead is a prefix that the rest follows, the same however the state is carried, and no more anchors are held than a silence spans."""
    rng = random.Random(8)
    cfg = segments.Settings(lookahead=6.0, silence=20.0)
    decoder, given, most = segments.Decoder(cfg), [], 0
    for hop, total in anchors_of(evidence_of("PARIS " * 30 + "K", 13, rng)):
        given += decoder.push(hop, total)
        most = max(most, len(decoder.anchors))
        assert len(decoder.said) < 80
    assert len(given) > 150 and most < 200
    assert "".join(g for g, _, _ in given + decoder.finish()) == "PARIS " * 30 + "K"
    assert [h for _, h, _ in given] == sorted(h for _, h, _ in given)


def test_stretches_and_odd_rows(spark):
    rng = random.Random(9)
    first = anchors_of(evidence_of("CQ", 13, rng))
    later = [(h + 100_000, t) for h, t in anchors_of(evidence_of("DE", 13, rng))]
    rows = [(1, h, t) for h, t in first + later] + [(2, None, 1.0), (2, 5, None), (3, 7, 0.0), (None, 3, 0.0)]
    got = segments.decode(spark.createDataFrame([*rows, rows[0]], "track int, hop long, total double"))
    assert [(r.track, r.stretch, r.glyph) for r in got.orderBy("track", "stretch", "n").collect()] == [(1, 0, "C"), (1, 0, "Q"), (1, 1, "D"), (1, 1, "E")]
    assert segments.texts(got).first().text == "CQDE"
    assert segments.decode(got.select("track", "hop", F.lit(0.0).alias("total")).limit(0)).count() == 0


def test_carried_hands_on_its_state(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, i, float(i)) for k in "abc" for i in range(10)]
        got = carried.carried(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], ["i"], ["x"], "total double, last boolean", lambda: [0.0], lambda s, x: (s.__setitem__(0, s[0] + x), [(s[0], False)])[1], lambda s: [(s[0], True)])
        out = sorted(map(tuple, got.collect()))
        assert [r for r in out if r[2]] == [(k, 45.0, True) for k in "abc"] and len(out) == 33
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
