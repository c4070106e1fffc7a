"""Registered queries on fixtures that a cut of rows, items or characters would change, against rules written out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spotlake.plans import catalog


def run(spark, path, name, **tables):
    """The rows of a query over small tables."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{table}.parquet"))
    return catalog.QUERIES[name](spark, str(path))


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_error_rates(spark, tmp_path):
    items = [(i, f"Item {i} " + "abcdefg " * 9 + f"end {i * 7}") for i in range(45)]
    docs = [(i, items[i % 45][1] + ("" if i < 45 else " more" * (i - 44))) for i in range(90)]
    got = run(spark, tmp_path, "error_rates", benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    want = {}
    for i, e in items:
        rates = [distance(e.upper(), d.upper()) / len(e) for n, d in docs if n % 45 == i]
        want[i] = (len(rates), round(sum(rates) / len(rates), 6), sum(r < 0.1 for r in rates))
    assert {r.item_id: (r.n, r.cer_mean, r.good) for r in got.collect()} == want


def test_variant_pairs(spark, tmp_path):
    words = "RESTART START STARTS STARE ART A AR TABLE ABLE ABLER B12 12 BANANA ANA NAN TABLET CABLE STAR".split()
    got = run(spark, tmp_path, "variant_pairs", benchmark=([(0, " ".join(words)), (1, "start, a")], "item_id long, text string"))
    want = []
    for a in words:
        for b in words:
            if a < b and (a in b or b in a):
                want.append((a, b, "contains"))
            elif a < b and a[:3] == b[:3] and min(len(a), len(b)) >= 3 and distance(a, b) <= 2:
                want.append((a, b, "similar"))
    assert sorted(map(tuple, got.select("a", "b", "relation").collect())) == sorted(want)


def test_morse_round_trip(spark, tmp_path):
    texts = [(0, "CQ de K1ABC, " * 30 + "last word?"), (1, "short\u00e9 one"), (2, "!!")]
    got = run(spark, tmp_path, "morse_round_trip", benchmark=(texts, "item_id long, text string"))
    clean = {i: re.sub(" +", " ", re.sub("[^A-Z0-9/?.,= ]", "", re.sub("[^ -~]", " ", t).upper())).strip() for i, t in texts}
    assert {r.track: r.text for r in got.collect()} == {i: t for i, t in clean.items() if t}


def test_merged_intervals(spark, tmp_path):
    hour = 3_600_000_000
    orders = [(4, "a", 500_000.0, 0), (3, "a", 1.0, 3), (5, "a", 1.0, 10), (1, "b", 2.0, 1)]
    frame = spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_totalprice double, h int")
    frame.withColumn("o_orderdate", F.timestamp_micros(F.col("h") * hour)).drop("h").write.parquet(str(tmp_path / "orders.parquet"))
    got = run(spark, tmp_path, "merged_intervals").select("k", "a", "b", "n")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 6 * hour, 2), ("a", 10 * hour, 10 * hour, 1), ("b", hour, 2 * hour, 1)]


def test_triple_tally(spark, tmp_path):
    labels = [(1, 0, 1), (2, 1, 0), (3, 1, 0), (4, 0, 1), (5, 1, 1)]
    docs = [(i, 900 * (i % 3)) for i in range(1, 5)]
    got = run(spark, tmp_path, "triple_tally", labels=(labels, "doc_id long, quality int, toxic int"), documents=(docs, "doc_id long, n_chars int"))
    assert [r.asDict() for r in got.collect()] == [{"gains": 2, "losses": 2, "held": 1, "n": 4}]
