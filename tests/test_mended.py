"""Blocks of crash spans, histogram quantiles with open ends, newest parts, and the lines that readers leave out."""

from __future__ import annotations

import random

import pytest

from spotlake.operators import aggregates, scoring, tracks
from spotlake.sources import files


def plain_spans(lifts, onset, release, least):
    out, on, run = [], False, []
    for hop, lift in lifts:
        on = True if lift >= onset else False if lift < release else on
        if on:
            run.append(hop)
        elif run:
            out.append((run[0], run[-1], len(run)))
            run = []
    if run:
        out.append((run[0], run[-1], len(run)))
    return [s for s in out if s[2] >= least]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_crash_spans_in_blocks(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for name in "ab":
        hops = sorted(rng.sample(range(400), 250)) if name == "b" else range(300)
        lifts, level = [], 0.0
        for h in hops:
            level = rng.choice([level, level, 0.0, 1.0, 2.0, 3.0])
            lifts.append((h, level))
        rows += [(name, h, x) for h, x in lifts]
        want[name] = plain_spans(lifts, 3.0, 1.0, 2)
    got = tracks.crash_spans(spark.createDataFrame(rows, "input string, hop long, lift double"), 3.0, 1.0, 2, block).collect()
    assert {name: sorted((r.first, r.last, r.n) for r in got if r.input == name) for name in "ab"} == want


def test_quantiles_count_every_row(spark):
    rows = [("a", float(x)) for x in range(-5, 95)] + [("b", 1e6)] * 9 + [("b", -1.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.quantile for r in aggregates.histogram_quantile(df, ["k"], "x", [10.0, 50.0, 100.0], 0.5).collect()}
    assert got == {"a": pytest.approx(10 + 40 * (50 - 16) / 40), "b": 100.0}
    assert {r.k: r.quantile for r in aggregates.histogram_quantile(df, ["k"], "x", [10.0, 50.0, 100.0], 0.1).collect()}["b"] == 10.0


def test_tails_gather_the_newest_parts(spark):
    rng = random.Random(1)
    rows = [(k, i, "x" * rng.randrange(0, 9) + str(i)) for k in range(3) for i in range(40)]
    got = {r.k: r.tail for r in scoring.text_tails(spark.createDataFrame(rows, "k int, i int, t string").repartition(3), ["k"], "i", "t", 50).collect()}
    assert got == {k: " ".join(t for n, _, t in rows if n == k)[-50:] for k in range(3)}


def test_lines_left_out(spark, tmp_path):
    (tmp_path / "ledger").write_text('{"kind": "sample", "ts": 1}\n{"kind": "other"}\n{torn\n{"kind": "note"}\n{}\n')
    assert files.bad_ledger_lines(spark, str(tmp_path / "ledger")) == 3 and files.read_ledger(spark, str(tmp_path / "ledger")).count() == 2
    lines = spark.createDataFrame([("a 1",), ('b{x="1"} 2 3',), ("# note",), ("",), ("c x",), ("9 1",), ("d",)], "value string")
    assert sorted(r.value for r in files.bad_metrics(lines).collect()) == ["9 1", "c x", "d"] and files.parse_metrics(lines).count() == 2
    (tmp_path / "cty").write_text("A: 1: 2: EU: 1: 2: 3: P:\n AA,=AB1C;\nB: 1:\n torn;\n\n")
    assert [r.value.strip() for r in files.bad_countries(spark, str(tmp_path / "cty")).collect()] == ["B: 1:\n torn"]
    assert files.read_countries(spark, str(tmp_path / "cty")).count() == 2
