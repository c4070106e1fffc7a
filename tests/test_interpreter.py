"""The exchange grammar on spoken lines, and its power steps."""

from __future__ import annotations

import pytest

from spotlake.operators import interpreter

U = ("uncertain", None, "no_frame")
#: Lines, and role, frame and basis of each call in them with the words that decided.
LINES = {
    "CQ CQ DE K5ARH K5ARH K": [("K5ARH", "self", "cq", "after_de", 0, 5)] * 2,
    "W1AW W1AW DE K1ABC": [("W1AW", "addressee", None, "before_de", 0, 3)] * 2 + [("K1ABC", "self", "de", "after_de", 2, 4)],
    "cq wpx w1aw": [("W1AW", "self", "cq", "after_cq", 0, 3)],
    "WPX W1AW": [("W1AW", *U, 0, 2)],
    "TU TEST W1AW": [("W1AW", "uncertain", None, "parting_test", 1, 3)],
    "TEST W1AW": [("W1AW", "self", "cq", "after_test", 0, 2)],
    "W1AW TEST K1ABC": [("W1AW", *U, 0, 1), ("K1ABC", "uncertain", None, "parting_test", 1, 3)],
    "K1ABC TEST K1ABC": [("K1ABC", *U, 0, 1), ("K1ABC", "self", "cq", "after_test", 1, 3)],
    "V V V V W1AW": [("W1AW", "self", "beacon", "preamble", 1, 5)],
    "V V W1AW": [("W1AW", *U, 2, 3)],
    "W1AW UP": [("W1AW", "self", "up", "before_up", 0, 2)],
    "W1AW 5NN": [("W1AW", "addressee", None, "before_report", 0, 2)],
    "W1AW 0T1": [("W1AW", "addressee", None, "before_report", 0, 2)],
    "W1AW AGN?": [("W1AW", "addressee", None, "before_query", 0, 2)],
    "TU W1AW": [("W1AW", "self", "signoff", "after_signoff", 0, 2)],
    "DE K1ABC OP W1AW": [("K1ABC", "self", "de", "after_de", 0, 2), ("W1AW", "mention", None, "mention_in_turn", 3, 4)],
    "DE K1ABC K W1AW": [("K1ABC", "self", "de", "after_de", 0, 2), ("W1AW", *U, 3, 4)],
    "DE K1ABC OP K1ABC": [("K1ABC", "self", "de", "after_de", 0, 2), ("K1ABC", *U, 3, 4)],
    "CQ DE W1AW EEEEE W1AB": [("W1AW", "uncertain", None, "corrected", 0, 4), ("W1AB", "self", "cq", "after_de", 0, 5)],
    "DE HH HH W1AB": [("W1AB", *U, 3, 4)],
    "DE K1ABC CQ": [("K1ABC", "self", "cq", "after_de", 0, 3)],
    "CQ W1AW W1AW DE K1ABC": [("W1AW", "self", "cq", "after_cq", 0, 3), ("W1AW", "addressee", None, "before_de", 0, 4), ("K1ABC", "self", "de", "after_de", 3, 5)],
    "TU W1AW W1AW DE K1ABC": [("W1AW", "self", "signoff", "after_signoff", 0, 3), ("W1AW", "addressee", None, "before_de", 0, 4), ("K1ABC", "self", "de", "after_de", 3, 5)],
    "TU TEST DE W1AW": [("W1AW", "self", "de", "after_de", 2, 4)],
    "QRZ? 5NN TEST 599/P hi": [],
    "QRZ W1AW ßAB1": [("W1AW", *U, 1, 2)],
}


def spoken(spark, lines, flags=None):
    rows = [(i, n, w, *(flags or {}).get((i, n), (None, None))) for i, line in enumerate(lines) for n, w in enumerate(line.split(" "))]
    return spark.createDataFrame(rows, "line int, n int, word string, ends boolean, bad boolean").repartition(3)


def test_roles_of_lines(spark):
    got = interpreter.interpret(spoken(spark, LINES), ["line"], "n", "word", "ends", "bad")
    by_line = {}
    for r in got.orderBy("line", "place").collect():
        by_line.setdefault(r.line, []).append((r.call, r.role, r.frame, r.basis, r.span_start, r.span_end))
    assert {line: by_line.get(i, []) for i, line in enumerate(LINES)} == LINES


def test_ends_corrections_and_settling(spark):
    lines = ["DE K1ABC K1ABC", "CQ W1AW W1AW DE", "DE W1AW W1AB", "W1AW", "CQ W1AW"]
    flags = {(0, 1): (True, None), (2, 1): (None, True), (4, 1): (True, None)}
    got = interpreter.interpret(spoken(spark, lines, flags), ["line"], "n", "word", "ends", "bad", complete=False)
    assert [(r.line, r.place, r.role, r.basis, r.settled) for r in got.orderBy("line", "place").collect()] == [
        (0, 1, "self", "after_de", True),
        (0, 2, "uncertain", "no_frame", False),
        (1, 1, "self", "after_cq", True),
        (1, 2, "addressee", "before_de", True),
        (2, 1, "uncertain", "corrected", True),
        (2, 2, "self", "after_de", False),
        (3, 0, "uncertain", "no_frame", False),
        (4, 1, "self", "after_cq", True),
    ]
    assert interpreter.interpret(spoken(spark, lines).limit(0), ["line"], "n", "word").count() == 0


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("W1AW T", [("W1AW", "beacon", 0, 2)]),
        ("w1aw T W1AB T K5ARH T/QRP", [("W1AW", "beacon", 0, 2), ("W1AB", "beacon", 2, 4)]),
        ("CQ EE W1AW T", []),
        ("NOISE/DE -CQ-W1AW T", [("W1AW", "beacon", 1, 3)]),
        ("V V V W1AW T", [("W1AW", "beacon", 0, 4), ("W1AW", "beacon", 3, 5)]),
        ("TU W1AW", []),
        ("DE W1AW UP", [("W1AW", "de", 0, 2)]),
    ],
)
def test_context_matches(spark, line, want):
    got = interpreter.context_matches(spoken(spark, [line]), ["line"], "n", "word").orderBy("place", "span_start").collect()
    assert [(r.call, r.spot_type, r.span_start, r.span_end) for r in got] == want
