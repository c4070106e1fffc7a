"""The whole repetition gate and the evidence lattice: rules one by one, and tasks against a plain loop."""

from __future__ import annotations

import itertools
import random

import pytest
from spotlake.operators import lattice, repetition
from spotlake.operators.graph import families

S = 1_000_000
L = repetition.Limits()


def counts(rows):
    """Repetitions after each touch (call, track, seconds, freq, word, closes seconds, start seconds)."""
    gate = repetition.Gate(L)
    return [gate.touch(call, track, int(t * S), freq, None if start is None else int(start * S), word, None if closes is None else int(closes * S)) for call, track, t, freq, word, closes, start in rows]


def touch(t, word, track=1, freq=7_010_000.0, call="K1ABC", closes=None, start=None):
    return call, track, t, freq, word, closes, start


def test_messages_of_one_track():
    assert counts([touch(0, 1), touch(2, 2), touch(5, 4), touch(6, 5), touch(9, 7)]) == [1, 1, 2, 2, 3]  # three words apart from the message's first
    assert counts([touch(0, 1), touch(61, 2)]) == [1, 2]  # a minute
    assert counts([touch(0, 1), touch(91, 9)]) == [1, 1]  # out of the window
    assert counts([touch(0, 1, freq=None), touch(0, 2, freq=float("nan")), touch(1, 3)]) == [0, 0, 1]


def test_messages_of_several_tracks():
    assert counts([touch(0, 1), touch(5, 1, track=2)]) == [1, 1]  # both open: one transmission
    assert counts([touch(0, 1, closes=3), touch(5, 1, track=2)]) == [1, 2]  # the first had closed
    assert counts([touch(0, 1), touch(61, 1, track=2)]) == [1, 2]
    assert counts([touch(0, 1, closes=0.2), touch(0.5, 1, track=2)]) == [1, 1]  # within a second of another track
    assert counts([touch(0, 1), touch(5, 1, track=2), touch(10, 5, track=2)]) == [1, 1, 2]  # it has said a whole message since
    assert counts([touch(0, 1), touch(0.3, 1), touch(0.6, 4)]) == [1, 1, 2]  # a track's own quick repeats pass


def test_spans_count_once():
    assert counts([touch(5, 1, start=3), touch(6, 9, start=4, track=2, closes=None)]) == [1, 1]
    assert counts([touch(5, 1, start=3, closes=5), touch(6, 9, start=5.5, track=2)]) == [1, 2]


def test_buckets_and_drift():
    near, edge, far = 7_010_040.0, 7_010_060.0, 7_010_140.0
    assert counts([touch(0, 1, freq=near), touch(5, 5, freq=edge), touch(9, 9, freq=near)]) == [1, 2, 3]  # the entry moves over the edge, and back
    assert counts([touch(0, 1, freq=near), touch(5, 5, freq=far)]) == [1, 1]  # a neighbour over a channel away is another signal
    assert counts([touch(0, 1, freq=7_010_000.0), touch(1, 1, freq=7_010_100.0), touch(5, 5, freq=7_010_052.0)]) == [1, 1, 2]  # home first, however near the other
    late = [touch(0, 1, freq=near), touch(20, 5, freq=near), touch(10, 9, freq=edge), touch(30, 13, freq=near)]
    assert counts(late) == [1, 2, 3, 4]  # an older touch joins the neighbour where it is


def test_orphans_are_promoted():
    rows = [touch(0, 1), touch(2, 2), touch(80, 90), touch(91, 120)]
    assert counts(rows) == [1, 1, 2, 3]  # the message at 0 has gone, its second word leads it now
    touches = [repetition.Touch(5, 2, 1, False, 0), repetition.Touch(7, 3, 1, False, 0), repetition.Touch(9, 9, 1, True, 9)]
    repetition.promote(touches)
    assert [(t.counts, t.leader) for t in touches] == [(True, 5), (False, 5), (True, 9)]


def test_moves():
    gate = repetition.Gate(L)
    assert gate.touch("K1ABD", 1, 5 * S, 7e6, 3 * S, 1, None) == 1
    assert gate.touch("K1ABC", 1, 15 * S, 7e6, 13 * S, 9, None) == 1
    assert gate.move("K1ABD", "K1ABC", 1, 5 * S, 3 * S, 16 * S)
    assert gate.touch("K1ABC", 1, 25 * S, 7e6, 23 * S, 15, None) == 3
    assert gate.touch("K1ABD", 1, 26 * S, 7e6, 25 * S, 16, None) == 1  # it lost its touch
    assert not gate.move("K1ABD", "K1ABC", 1, 5 * S, 3 * S, 27 * S)  # no longer there
    # into a message that is there already it moves uncounted
    gate = repetition.Gate(L)
    gate.touch("K1ABD", 1, 5 * S, 7e6, 3 * S, 1, None)
    gate.touch("K1ABC", 1, 7 * S, 7e6, 6 * S, 2, None)
    assert gate.move("K1ABD", "K1ABC", 1, 5 * S, 3 * S, 8 * S)
    assert gate.touch("K1ABC", 1, 15 * S, 7e6, 14 * S, 8, None) == 2


def traffic(seed, n):
    rng = random.Random(seed)
    calls = ["K1ABC", "K1ABD", "W1AW", "DL1XX"]
    touches, moves, t, word = [], [], 0, dict.fromkeys(range(6), 0)
    closes = {k: rng.choice([None, rng.randrange(600) * S]) for k in range(6)}
    for i in range(n):
        t += rng.choice([S // 5, S, 2 * S, 9 * S])
        track = rng.randrange(6)
        word[track] += rng.choice([1, 1, 2, 4])
        call = rng.choice(calls)
        start = rng.choice([None, t - S // 3, t - S])
        touches.append((i, call, track, t, rng.choice([None, 7_010_000.0, 7_010_049.0, 7_010_055.0, 7_010_130.0]), start, word[track], closes[track]))
        if start is not None and rng.random() < 0.3:
            to = {"K1ABD": "K1ABC", "K1ABC": "K1ABD"}.get(call)
            if to:
                moves.append((10_000 + i, call, to, track, t, start, t + rng.randrange(3) * S))
    return touches, moves


TOUCHES, MOVES = "row_id long, call string, track long, t long, freq double, start long, word long, closes long", "row_id long, call string, to string, track long, t long, start long, at long"


def test_tasks_equal_one_loop(spark):
    touches, moves = traffic(1, 1500)
    got = repetition.repetitions(spark.createDataFrame(touches, TOUCHES).repartition(4), spark.createDataFrame(moves, MOVES).repartition(3))
    gate, want = repetition.Gate(L), {}
    rows = [(r[3], 0, r[0], ("touch", r[0], r[1], None, *r[2:7], r[3], r[7])) for r in touches] + [(m[6], 1, m[0], ("move", m[0], m[1], m[2], m[3], m[4], None, m[5], None, m[6], None)) for m in moves]
    for _, _, _, row in sorted(rows, key=lambda r: r[:3]):
        want |= dict(repetition.step(gate, *row))
    assert {r.row_id: r.repetitions for r in got.collect()} == want
    assert {r.family for r in got.select("family").distinct().collect()} == {"K1ABC", "W1AW", "DL1XX"}
    assert max(want.values()) > 4 and sum(want[m[0]] for m in moves) > 30
    # without moves every call stands alone
    alone = {r.row_id: r.repetitions for r in repetition.repetitions(spark.createDataFrame(touches, TOUCHES)).collect()}
    gate = repetition.Gate(L)
    assert alone == {r[0]: gate.touch(r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in touches}


def test_families(spark):
    pairs = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), ("d", "c"), ("e", "d"), ("f", "e")]
    got = families(spark.createDataFrame(pairs, "p string, q string"), "p", "q")
    assert {tuple(r) for r in got.collect()} == {*[(c, "a") for c in "abcdef"], ("x", "x"), ("y", "x")}
    assert families(spark.createDataFrame([], "p string, q string"), "p", "q").count() == 0


# -- lattice


def copy(text, at, word=None, track=1, scores=None, others=None):
    return lattice.Copy(text, scores or [1.0] * len(text), others or [[] for _ in text], at * S, at * S + S // 2, track, at if word is None else word)


def test_damaged_copies_are_voted_on():
    assert lattice.fused([copy(t, i) for i, t in enumerate(["W1AV", "W1EW", "M1AW"])]) == ("W1AW", 1.0)
    assert lattice.fused([copy(t, i) for i, t in enumerate(["W1AW", "W1W", "W1AW"])]) == ("W1AW", 1.0)
    assert lattice.fused([copy(t, i) for i, t in enumerate(["W1W", "W1AW", "W1AW"])]) == ("W1AW", 1.0)
    assert lattice.fused([copy(t, i) for i, t in enumerate(["W1AW", "W1EW"])]) == (None, None)  # a tie
    assert lattice.fused([copy(t, i) for i, t in enumerate(["W?AW", "W?AW", "W1AW"])]) == (None, None)  # unknown wins
    both = [copy("W1AV", 0, scores=[1, 1, 1, 0.45], others=[[], [], [], [("W", 0.4)]]), copy("W1AQ", 9, scores=[1, 1, 1, 0.45], others=[[], [], [], [("W", 0.4)]])]
    assert lattice.fused(both)[0] == "W1AW"  # what both list as an alternative


def test_alignment_is_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        steps = lattice.traceback(len(a), len(b), lambda i, j: int(a[i] != b[j]))  # noqa: B023
        assert [i for i, _ in steps if i is not None] == list(range(len(a))) and [j for _, j in steps if j is not None] == list(range(len(b)))
        assert sum(i is None or j is None or a[i] != b[j] for i, j in steps) == lattice.distance(a, b)


def test_votes_of_equal_length_copies_are_plain_majorities():
    """Where no copy lost or gained a letter, the lattice is the majority of each column."""
    rng = random.Random(3)
    for _ in range(300):
        texts = ["".join(c if rng.random() < 0.8 else rng.choice("XYZ") for c in "W1AW") for _ in range(rng.randrange(1, 8))]
        columns = [sorted(((column.count(c), c) for c in set(column)), reverse=True) for column in zip(*texts, strict=True)]
        clear = all(c[0][0] * 2 > len(texts) and (len(c) == 1 or c[0][0] > c[1][0]) for c in columns)
        if all(len(c) == 1 or lattice.distance(a, b) <= 2 for c in columns for a, b in itertools.pairwise(texts)):
            call, _ = lattice.fused([copy(t, i) for i, t in enumerate(texts)])
            assert call == ("".join(c[0][1] for c in columns) if clear else None)


COPIES = "copy_id long, input int, text string, scores array<double>, others array<array<struct<glyph:string,score:double>>>, start long, stop long, track long, word long, freq double, closes long"


def test_lattice_in_tasks_equals_one_loop(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([S, 3 * S, 8 * S, 120 * S] if i % 50 == 0 else [S, 3 * S, 8 * S])
        call = rng.choice(["W1AW", "K9XYZ"])
        text = "".join(rng.choice([*[c] * 16, "X", "?", "", c + "E"]) for c in call)
        rows.append((i, rng.randrange(2), text, None, None, t - S, t, rng.randrange(2), i, rng.choice([7_000_000.0, 7_000_050.0, 7_000_300.0, 7_000_340.0]), None))
    df = spark.createDataFrame([*rows, (9001, 0, None, None, None, 0, 1, 1, 1, 7e6, None), (9002, 0, "AA", None, None, 0, 1, 1, 1, None, None)], COPIES)
    got = {r.copy_id: (r.verdict, r.call, r.repetitions, r.copies, r.lead) for r in lattice.evaluate(df.repartition(4)).collect()}
    held, want = {}, {}
    for i, source, text, _, _, start, stop, track, word, freq, closes in rows:
        if text:
            one = held.setdefault((source, freq > 7_000_200), lattice.Lattice(L, 2))
            want[i] = one.add(lattice.Copy(text, [1.0] * len(text), [[] for _ in text], start, stop, track, word), freq, closes)[1:]
    assert got == want
    assert {v[0] for v in want.values()} == {"duplicate", "unknown", "insufficient", "confirmed"}
    right = [v[1] for v in want.values() if v[0] == "confirmed"]
    assert sum(c in ("W1AW", "K9XYZ") for c in right) > 0.8 * len(right) > 5


def test_channels(spark):
    df = spark.createDataFrame([(1, f) for f in (0.0, 90.0, 180.0, 280.0, 373.0, 500.0, 593.7)] + [(2, 5.0)], "k int, f double")
    got = lattice.channels(df, ["k"], "f", 93.75)
    assert sorted((r.k, r.f, r.channel) for r in got.collect()) == [(1, 0.0, 0), (1, 90.0, 0), (1, 180.0, 0), (1, 280.0, 1), (1, 373.0, 1), (1, 500.0, 2), (1, 593.7, 2), (2, 5.0, 0)]
    assert lattice.evaluate(spark.createDataFrame([], COPIES)).count() == 0
