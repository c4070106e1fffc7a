"""Two-tone detection, framing, and bands modulated together, on keyed tables of known content."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from spotlake.operators import comodulation as cm
from spotlake.operators import two_tone

HOPS = "input string, hop long, channel long, snr double, re double, im double"


def tone_rows(seed, blocks, low, high, block=60, together=False, noise=0.5):
    """A keyed pair at fractional channels, with the phases of its frequencies, and quiet channels around it."""
    rng, rows, on = random.Random(seed), [], True
    for hop in range(blocks * block):
        if hop % 8 == 0:
            on = rng.random() < 0.5
        for c in range(round(low) - 2, round(high) + 3):
            snr, at = rng.gauss(0, noise), None
            for tone, up in ((low, on), (high, on if together else not on)):
                if up and abs(c - tone) <= 1.2:
                    snr, at = 30 - 20 * abs(c - tone) ** 2 + rng.gauss(0, noise), tone
            turn = 2 * math.pi * ((at if at is not None else c) - c) * hop / 4
            sign = -1 if hop % 2 and c % 2 else 1
            rows.append(("a", hop, c, snr, sign * math.cos(turn), sign * math.sin(turn)))
    return rows


@pytest.mark.parametrize(("low", "high", "shift"), [(20.0, 21.8, 170.0), (20.3, 22.2, 170.0), (30.0, 34.6, 425.0), (10.2, 19.3, 850.0)])
def test_pairs_are_found_and_placed(spark, low, high, shift):
    judged = two_tone.judged_blocks(spark.createDataFrame(tone_rows(1, 4, low, high), HOPS).repartition(3), 60)
    passed = judged.where("verdict = 'pass'").collect()
    assert len({r.block for r in passed}) >= 2
    assert all(abs(r.low_at - low) < 0.3 and abs(r.high_at - high) < 0.3 for r in passed)
    marked = two_tone.evidence(judged, 2).where("marked").withColumn("shift", two_tone.nominal_shift((two_tone.F.col("high_at") - two_tone.F.col("low_at")) * 93.75)).collect()
    assert marked and all(r.shift in (shift, 200.0, 450.0) and r.block >= 1 for r in marked)


def test_what_is_no_pair(spark):
    together = two_tone.judged_blocks(spark.createDataFrame(tone_rows(2, 2, 20.0, 21.8, together=True), HOPS), 60).collect()
    assert {r.verdict for r in together if (r.low, r.high) == (20, 22)} == {"contra"} and not any(r.verdict == "pass" for r in together)
    odd = two_tone.judged_blocks(spark.createDataFrame(tone_rows(3, 2, 20.0, 23.0), HOPS), 60).collect()  # 281 Hz is no standard shift
    assert not any(r.verdict == "pass" for r in odd) and any(r.rho < -0.5 for r in odd)
    assert two_tone.judged_blocks(spark.createDataFrame([], HOPS), 60).count() == 0


def test_evidence_grows_shrinks_and_is_forgotten(spark):
    verdicts = [(0, "pass"), (1, "pass"), (2, "contra"), (3, "pass"), (4, "neutral"), (5, "pass"), (6, "pass"), (20, "contra"), (35, "pass"), (66, "pass"), (100, "contra")]
    rows = [("a", b, 5, 7, v, 5.0, 7.0, 30.0) for b, v in verdicts]
    got = two_tone.evidence(spark.createDataFrame(rows, "input string, block long, low long, high long, verdict string, low_at double, high_at double, level double"), 3).orderBy("block").collect()
    assert [(r.block, r.evidence, r.marked, r.passes) for r in got] == [(0, 1, False, 1), (1, 2, False, 2), (2, 0, False, 2), (3, 1, False, 3), (5, 2, False, 4), (6, 3, True, 5), (20, 1, True, 5), (35, 2, True, 6), (66, 1, False, 1)]


def keyed(text, upside_down=False, per_bit=375 / 45.45, noise=None):
    """Powers of both tones for a text, letters and figures shifted as needed, one and a half stop bits."""
    halves, figures = "1" * 6, False
    for c in text:
        if c not in two_tone.LETTERS or (figures and c == " "):
            wanted = True
        else:
            wanted = False
        if wanted != figures and c != " ":
            figures = wanted
            code = two_tone.TO_FIGURES if figures else two_tone.TO_LETTERS
            halves += "00" + "".join(str(code >> i & 1) * 2 for i in range(5)) + "111"
        code = (two_tone.FIGURES if figures else two_tone.LETTERS).index(c)
        halves += "00" + "".join(str(code >> i & 1) * 2 for i in range(5)) + "111"
    halves += "1" * 8
    out = []
    for hop in range(math.floor(len(halves) * per_bit / 2)):
        mark = (halves[int(hop / (per_bit / 2))] == "1") != upside_down
        low, high = (0.05, 1.0) if mark else (1.0, 0.05)
        out.append((hop, low + (noise.uniform(0, 0.5) if noise else 0), high + (noise.uniform(0, 0.5) if noise else 0)))
    return out


def test_framing_round_trip(spark):
    texts = ["CQ CQ DE W1AW W1AW K", "TEST 599 001, UR 14.5 (OK)?", "THE QUICK BROWN FOX 1234567890"]
    sent = {i: (t, i % 2 == 1, random.Random(i) if i >= 3 else None) for i, t in enumerate([*texts, *texts])}
    rows = [(i, *r) for i, (t, flip, noise) in sent.items() for r in keyed(t, flip, noise=noise)]
    got = two_tone.framed(spark.createDataFrame(rows, "s int, hop long, x double, y double").repartition(4), ["s"], "hop", "x", "y").orderBy("s", "hop", "n").collect()
    read = {i: "".join(r.glyph for r in got if r.s == i) for i in sent}
    assert read == {i: t for i, (t, _, _) in sent.items()}


def test_noise_frames_nothing(spark):
    rows = [(0, i, abs(math.sin(i * 1.71)), abs(math.sin(i * 2.13))) for i in range(8000)] + [(1, i, None, None) for i in range(300)]
    assert two_tone.framed(spark.createDataFrame(rows, "s int, hop long, x double, y double"), ["s"], "hop", "x", "y").count() == 0


def comodulated(seed, hops=600):
    """Channels 5 to 20 share a slow envelope, 40 to 60 are keyed each alone, the rest is quiet."""
    rng = np.random.default_rng(seed)
    t = np.arange(hops)
    snr = rng.normal(0, 1, (hops, 70))
    voice = 15 + 8 * np.sin(2 * np.pi * 3 * t / 375) + 4 * np.sin(2 * np.pi * 2 * t / 375 + 1)
    snr[:, 5:21] += voice[:, None]
    for c in range(40, 61, 4):
        key = rng.integers(0, 2, hops // 18 + 1).repeat(18)[:hops]
        snr[:, c] += 25 * key
    return snr


def plain_spans(snr):
    out = []
    for at in range(cm.EVERY, len(snr) + 1, cm.EVERY):
        if at < cm.FIRST:
            continue
        x = snr[max(at - cm.WINDOW, 0) : at]
        hot = [c for c in range(x.shape[1]) if x[:, c].mean() >= cm.HOT]
        count = dict.fromkeys(hot, 0)
        for a in hot:
            for b in hot:
                if cm.NEAREST <= b - a <= cm.FARTHEST and np.corrcoef(x[:, a], x[:, b])[0, 1] >= cm.RHO:
                    count[a] += 1
                    count[b] += 1
        member = [c for c in hot if count[c] >= cm.PARTNERS]
        runs = []
        for c in member:
            if runs and c - runs[-1][1] <= 2:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        for first, last in runs:
            peaks = x[:, max(first - 2, 0) : last + 3].max(axis=0)
            if last - first + 1 >= cm.WIDTH and (peaks >= peaks.max() - cm.STRONG_DB).sum() >= cm.STRONG:
                out.append((at, first - 1, last + 1, at + cm.HOLD))
    return out


def plain_regions(snr):
    out = []
    for at in range(cm.EVERY, len(snr) + 1, cm.EVERY):
        if at < cm.WINDOW:
            continue
        x = snr[at - cm.WINDOW : at]
        runs = []
        for c in range(x.shape[1]):
            if x[:, c].mean() >= cm.HOT:
                if runs and c - runs[-1][-1] <= 2:
                    runs[-1].append(c)
                else:
                    runs.append([c])
        for run in runs:
            size = np.abs(np.fft.fft(x[:, run].sum(axis=1)))
            out.append((at, run[0], run[-1], len(run), size[1:6].sum(), size[8:31].sum()))
    return out


def test_bands_against_plain_loops(spark):
    snr = comodulated(1)
    hops = spark.createDataFrame([("a", h, c, float(snr[h, c])) for h in range(len(snr)) for c in range(snr.shape[1])], "input string, hop long, channel long, snr double").repartition(4)
    assert sorted((r.at, r.first, r.last, r.until) for r in cm.spans(hops).collect()) == plain_spans(snr) != []
    got = sorted((r.at, r.first, r.last, r.hot, r.slow, r.fast) for r in cm.regions(cm._complete(cm.windows(hops))).collect())
    want = plain_regions(snr)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4:] for g in got], [w[4:] for w in want])
    bands = cm.speech_bands(hops).collect()
    assert {(r.first, r.last) for r in bands} == {(4, 21)} and {r.at for r in bands} == {375, 450, 525, 600}
    assert cm.spans(hops.limit(0)).count() == 0


def test_split_voice_is_one_by_its_envelope(spark):
    """Two narrow regions that breathe together are speech; alone they are not."""
    rng = np.random.default_rng(2)
    t = np.arange(375)
    voice = 15 + 8 * np.sin(2 * np.pi * 3 * t / 375)
    snr = rng.normal(0, 0.5, (375, 40))
    snr[:, 5:9] += voice[:, None]
    alone = [("alone", h, c, float(snr[h, c])) for h in range(375) for c in range(40)]
    snr = snr.copy()
    snr[:, 20:24] += voice[:, None]
    both = [("both", h, c, float(snr[h, c])) for h in range(375) for c in range(40)]
    got = cm.speech_bands(spark.createDataFrame(alone + both, "input string, hop long, channel long, snr double")).collect()
    assert sorted((r.input, r.first, r.last) for r in got) == [("both", 4, 9), ("both", 19, 24)]
