"""One test per finding of the fourth round: each holds a case that the query got wrong, left out, or worked out in a way that grows too fast."""

from __future__ import annotations

import math
import random
import time

from pyspark.sql import functions as F

from spotlake.functions.edits import distance
from spotlake.operators import gathered, lattice, repetition, summaries, temporal
from spotlake.plans import catalog
from tests.test_findings_r03 import events


def test_spot_projections_round_as_the_sql(spark, tmp_path):
    """Halves by their exact value, signs of zero, a logarithm below zero and a quotient by zero, as DuckDB has them."""
    values = [(0.125, 1), (1.005, 1), (0.015, 1), (-2.5, -1), (35.0001, 1), (None, 1)]
    rows = [(i, i, 0, "a", v, k) for i, (v, k) in enumerate(values)]
    got = catalog.QUERIES["spot_projections"](spark, events(spark, tmp_path, rows)).orderBy("event_id").collect()
    assert [r.khz for r in got] == ["0.12", "1.00", "0.01", "-2.50", "35.00", None]
    assert math.isnan(got[3].db) and got[3].wpm == math.inf and got[0].wpm == 600.0
    assert got[4].likelihood == 0 and math.copysign(1, got[4].likelihood) == -1 and got[5].db is None


def test_joined_text_gathers_no_pairs(spark, monkeypatch):
    """Crowded cells over several parts, blanks, ids that come twice, and rows without id, frequency, time or text, against every pair; tracks without a time come last; stations and tracks are sent, not their pairs."""
    monkeypatch.setattr(gathered, "STATIONS", 7)
    monkeypatch.setattr(gathered, "TOKENS", 50)
    rng = random.Random(8)
    at = lambda: rng.choice([None, math.nan, math.inf, 5.0, 5.0, 20.0, round(rng.uniform(-40, 40), 1)])
    stations = [(i if i % 11 else None, at(), rng.choice([None, "CQ 1 DE", "cq  tu"])) for i in range(90)] + [(3, 9.0, "DE"), (4, 5.0, "CQ")]
    tracks = [(rng.choice([None, i, i // 2]), at(), rng.choice([None, "CQ", " de  ", "1 DE", ""])) for i in range(300)]
    left, right = spark.createDataFrame(stations, "station_id long, freq double, expected string"), spark.createDataFrame(tracks, "start long, t_freq double, text string")
    got = summaries.joined_text(left.repartition(3), right.repartition(3), 15.0)
    flat = lambda x: " ".join(x.upper().split())
    want = []
    for i, _, expected in stations:
        near = [t for j, f, _ in stations if i is not None and j == i and f is not None for t in tracks if t[1] is not None and abs(f - t[1]) <= 15 and t[2] is not None]
        text = " ".join(t[2] for t in sorted(near, key=lambda t: (t[0] is None, t[0] or 0, t[2])))
        want.append((i, text, None if expected is None else distance(flat(expected), flat(text)) / len(flat(expected))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    plan = got.where(F.col("station_id") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_distance_of_a_text_within_another():
    """One that stands in the other in order is as far as the other is longer; all others as by the plain table."""
    rng = random.Random(9)
    for _ in range(500):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(2))
        assert distance(a, b) == lattice.distance(a, b)


def test_merged_intervals_without_ends(spark):
    """Equal intervals without a start, or that stop before they start, are as many islands as in the SQL; one without a stop comes after those with one. Both windows go by one sort."""
    rows = [("k", None, None)] * 3 + [("k", 9, 5)] * 2 + [("k", 20, None), ("k", 20, 25), ("k", 30, 30), ("k", 30, 30), ("k", None, 4)]
    got = temporal.merge_intervals(spark.createDataFrame(rows, "k string, a long, b long").repartition(4), ["k"], "a", "b")
    want = [("k", 9, 5, 1)] * 2 + [("k", 20, 25, 2), ("k", 30, 30, 2), ("k", None, 4, 1)] + [("k", None, None, 1)] * 3
    assert sorted(map(str, got.select("k", "a", "b", "n").collect())) == sorted(map(str, spark.createDataFrame(want, "k string, a long, b long, n long").collect()))
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") == 2
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def votes_anew(copies):
    """The call and its smallest lead by lining up all copies from the first, place by place."""
    rank = lambda v: (-v[1], v[0] == "?", v[0] == "", v[0])
    places = []
    for n, copy in enumerate(sorted(copies, key=lambda c: (c.start, c.track, c.word))):
        tops, grown = [min(votes.items(), key=rank)[0] for votes in places], []
        for i, j in lattice.traceback(len(tops), len(copy.text), lambda i, j: int(copy.text[j] not in ("?", tops[i]))):  # noqa: B023
            votes = places[i] if i is not None else {"": float(n)}
            for glyph, score in ({"": 1.0} if j is None else copy.votes(j)).items():
                votes[glyph] = votes.get(glyph, 0.0) + score
            grown.append(votes)
        places = grown
    call, least = "", None
    for votes in places:
        (glyph, top), (_, second) = sorted([*votes.items(), ("?", 0.0), ("", 0.0)], key=rank)[:2]
        if top <= len(copies) / 2 or top - second < lattice.LEAD or glyph == "?":
            return None, None
        call, least = call + glyph, top - second if least is None else min(least, top - second)
    return call, least


def test_lattice_keeps_all_copies(spark):
    """Twenty-four copies of which the first seven say another letter: all vote, so the smallest lead is 17 - 7."""
    rows = [(i, 0, "K1ABD" if i < 7 else "K1ABC", None, None, i * 3_000_000, i * 3_000_000 + 1, 1, i * 4, 7e6, None) for i in range(24)]
    schema = "copy_id long, input int, text string, scores array<double>, others array<array<struct<glyph:string,score:double>>>, start long, stop long, track long, word long, freq double, closes long"
    last = lattice.evaluate(spark.createDataFrame(rows, schema)).orderBy("copy_id").collect()[-1]
    assert (last.verdict, last.call, last.repetitions, last.copies, last.lead) == ("confirmed", "K1ABC", 24, 24, 10.0)


def test_lattice_lines_up_as_anew():
    """Copies that come, in any order, and go, with alternatives, gaps and unknown letters: the votes are those of a new start each time."""
    for seed in range(40):
        rng, held, whole = random.Random(seed), [], lattice.Aligned()
        for i in range(120):
            text = "".join(rng.choice([*[c] * 12, "X", "?", "", c + "E"]) for c in rng.choice(["W1AW", "W1AV", "K9XYZ"][: seed % 3 + 1])) or "W"
            others = [[(rng.choice("WXA1?"), rng.random())] if seed % 2 and rng.random() < 0.3 else [] for _ in text]
            copy = lattice.Copy(text, [rng.choice([1.0, 0.7, 0.0]) for _ in text], others, i if rng.random() < 0.9 else rng.randrange(120), 0, rng.randrange(3), i)
            held.append(copy)
            whole.add(copy)
            for gone in [c for c in held[:-1] if rng.random() < 0.02] + held[: len(held) > 40]:
                if gone in held:
                    held.remove(gone)
                    whole.remove(gone)
            if rng.random() < 0.8:
                assert whole.fused() == votes_anew(held)


def test_lattice_cost_grows_slowly_with_copies():
    """Eight times as many copies in the window cost a copy less than eight times as much."""

    def cost(every):
        rng, one = random.Random(10), lattice.Lattice(repetition.Limits(), 2)
        begin = time.process_time()
        for i in range(2_000):
            text = "".join(rng.choice([c] * 12 + ["X", ""]) for c in "K1ABC")
            one.add(lattice.Copy(text, [1.0] * 5, [[] for _ in text], i * every, i * every + 1, 1, i * 4), 7e6, None)
        return time.process_time() - begin

    few, many = (min(cost(every) for _ in range(2)) for every in (1_600_000, 200_000))
    assert many < 6 * few
