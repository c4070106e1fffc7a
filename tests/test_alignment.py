"""Word boundaries by alignment, against a plain table; slices around truth rows."""

from __future__ import annotations

import random

import pytest

from spotlake.operators import alignment, lattice


def plain_fraction(expected, given):
    """The same rule over a full table of costs, followed back cell by cell."""
    e, g = " ".join(expected.split()), " ".join(given.split())
    cost = [[max(i, j) if not (i and j) else 0 for j in range(len(g) + 1)] for i in range(len(e) + 1)]
    for i in range(1, len(e) + 1):
        for j in range(1, len(g) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (e[i - 1] != g[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    how, i, j = {}, len(e), len(g)
    while i or j:
        if i and j and e[i - 1] == g[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
            how[i] = "="
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            how[i] = "x"
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            how[i] = "-"
        else:
            j -= 1
    sent = [i for i, c in enumerate(e) if c == " "]
    if not sent:
        return 0.0 if " " in g else 1.0
    found = sum(how[i] == "=" for i in sent)
    first = all(how[i] == "-" for i in range(sent[0] + 1))
    return max(found + first - (g.count(" ") - found), 0) / len(sent)


def test_fractions_equal_the_plain_table():
    rng = random.Random(1)
    for _ in range(400):
        e = "".join(rng.choice("ab  c") for _ in range(rng.randrange(25)))
        g = "".join(rng.choice([c, c, c, c, "", " ", c + "a"]) for c in e)
        assert alignment.boundary_fraction(e, g) == plain_fraction(e, g)
        hit, dropped = alignment.matched(e, g)
        assert len(hit) == len(e) and not (hit & dropped).any()
    for a, b in (("", ""), ("a", ""), ("", "a"), ("kitten", "sitting")):
        assert sum(~alignment.matched(a, b)[0]) <= lattice.distance(a, b) <= max(len(a), len(b))


@pytest.mark.parametrize(("expected", "given", "want"), [("CQ TEST W5AU", "CQ TEST W5AU", 1.0), ("CQ TEST", "CQ TAST", 1.0), ("CQ TEST W5AU", "CQT EST W5AU", 0.0), ("CQ TEST W5AU", "TEST W5AU", 1.0), ("CQ TEST", "C Q T E S T", 0.0), ("CQ", "CQ", 1.0), ("CQ", "C Q", 0.0), (None, None, 1.0)])
def test_known_fractions(expected, given, want):
    assert alignment.boundary_fraction(expected, given) == pytest.approx(want)


def test_in_tasks(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["CQ", "DE", "TEST"]) for _ in range(200)), None) for i in range(6)]
    rows = [(i, e, "".join(c for c in e if rng.random() > 0.05)) for i, e, _ in rows] + [(7, None, "a b"), (8, "a b", None), (8, "a b", None)]
    got = alignment.with_boundaries(spark.createDataFrame(rows, "k0 int, e string, out string"), "e", "out").collect()
    assert sorted((r.k0, r.boundary_fraction) for r in got) == sorted((i, plain_fraction(e or "", g or "")) for i, e, g in rows)
