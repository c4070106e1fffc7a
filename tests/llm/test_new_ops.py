"""Operators 11 to 13 against brute force, on small fixtures with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.llm import multi_index, periodic_runs, queries, spelling

SF = "/root/testdata/sf0.001"


# -- operator 11


def brute_links(rows, threshold=0.93):
    """(id, vector, label) rows -> n_links and component of each row."""
    sound = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2]:
                w = max(len(rows[i][1]), len(rows[j][1]))
                x, y = (np.array([*r[1], *[0] * (w - len(r[1]))], float) for r in (rows[i], rows[j]))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    named = [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return n, named


def vectors(seed, count, dims, copies):
    rng, rows = np.random.default_rng(seed), []
    for i in range(count):
        v = rng.standard_normal(dims)
        rows.append((len(rows), [float(np.float32(x)) for x in v], i % 3))
        for _ in range(int(rng.integers(0, copies))):
            # from within the threshold to beyond it
            w = v + rng.standard_normal(dims) * rng.uniform(0, 0.6)
            rows.append((len(rows), [float(np.float32(x)) for x in w], i % 3))
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, n_links string, node string, key string, v string, own string, root string, least string, n string, kept string, k_id string"


def vector_rows(spark, rows, parts=5):
    return spark.createDataFrame([(*r, *"abcdefghij") for r in rows], VECTORS).repartition(parts)


@pytest.mark.parametrize("recall", [0.999, 1.0])
def test_multi_index_finds_the_links(spark, recall):
    rows = vectors(1, 60, 16, 6)
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(20)]  # repeated vectors
    rows += [(None, rows[5][1], rows[5][2]), (3, rows[9][1], rows[9][2]), (900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, rows[5][1], None)]
    rows += [(905, [float("inf")] * 16, 1), (906, [], 1), (907, rows[5][1][:3], rows[5][2]), (908, rows[5][1][:3] + [0.0], rows[5][2]), (None, None, None)]
    n, named = brute_links(rows)
    got = multi_index.near_duplicates(vector_rows(spark, rows), recall=recall).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == collections.Counter((r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, named, strict=True))
    assert all(r.node == "b" and r.key == "c" and r.least == "g" for r in got)
    assert sum(n) > 200


def test_multi_index_in_blocks(spark, monkeypatch):
    """A hot cell is dealt over blocks of pairs; parts of components in each are put together."""
    monkeypatch.setattr(multi_index, "BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in 1 + rng.standard_normal(6) * 0.2], 1) for i in range(120)]
    n, named = brute_links(rows)
    got = {r.vec_id: r for r in multi_index.near_duplicates(vector_rows(spark, rows)).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * sum(n) and all(got[i].n_links <= k for i, k in enumerate(n))
    assert [got[i].component_id for i in range(120)] == named


def test_multi_index_recall_at_the_threshold():
    """What the traversal reaches of pairs exactly at the threshold, the hardest ones, and all of them with a target of one."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.standard_normal((2000, 64))
    d -= (d * x).sum(axis=1, keepdims=True) * x
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * d
    for recall, least in ((0.9, 0.87), (0.999, 0.99), (1.0, 1.0)):
        grid = multi_index.Grid(x[:1000], 12, 0.93, recall)
        assert (grid.needed(x, y) <= grid.radius + 1e-12).mean() >= least
    # the traversal visits exactly the cells within the radius
    grid = multi_index.Grid(x[:1000], 6, 0.93, 0.99)
    (own_a, gap_a), (own_b, gap_b) = grid.gaps(x[:50])
    for i, (cell, met) in enumerate(grid.visits(x[:50])):
        assert cell == own_a[i] * 6 + own_b[i] == met[0]
        assert set(met[1:]) == {a * 6 + b for a in range(6) for b in range(6) if gap_a[i, a] + gap_b[i, b] <= grid.radius and a * 6 + b > cell}


def test_multi_index_of_nothing(spark):
    empty = vector_rows(spark, vectors(1, 2, 4, 1)).limit(0)
    assert multi_index.near_duplicates(empty).count() == 0
    lone = multi_index.near_duplicates(vector_rows(spark, [(1, [2.0], 1), (2, [3.0], 1), (3, [-3.0], 1)])).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in lone} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


# -- operator 12


def brute_runs(words, least=24):
    found = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.items())


def random_texts(seed, count, longest=400):
    rng = random.Random(seed)
    for _ in range(count):
        letters, out = rng.choice([1, 2, 2, 3, 9, 50]), []
        while len(out) < longest and rng.random() < 0.9:
            if rng.random() < 0.5:
                out += [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
            else:
                p = rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 17, 23, 24, 31, 40, 47, 48, 60])
                root = [rng.randrange(letters) for _ in range(p)]
                if rng.random() < 0.4:
                    root = (root[: p // 3 or 1] * p)[:p]
                    root[-1] = rng.randrange(letters + 1)
                out += (root * 9)[: rng.randrange(1, 6 * p + 2)]
        yield out[:longest]


def test_runs_equal_brute_force():
    texts = [*random_texts(1, 900), [], [1], [1] * 23, [1] * 24, [1] * 25, [0, 1] * 200, ([0] * 15 + [1]) * 20]
    sizes = [len(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)[:-1]))
    words = np.array([x for i, t in enumerate(texts) for x in [*t, -1 - i]])
    got = periodic_runs.maximal_runs(words, starts, np.array(sizes))
    want = [(int(s) + a, int(s) + a + m, q) for s, t in zip(starts, texts, strict=True) for a, m, q in brute_runs(t)]
    assert got == sorted(want)
    assert {q for _, _, q in want} > {1, 2, 12, 24, 48}
    with pytest.raises(ValueError):
        periodic_runs.maximal_runs(words, starts, np.array(sizes), power=2)


def brute_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_query_against_brute_force(spark, tmp_path):
    """On documents of the smallest tables up to 1,500 words, and planted ones; the query itself has no limit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.size(F.split("text", "[ \\x09-\\x0D]+")) < 1500)
    planted = [(10_000 + i, " ".join(f"w{x}" for x in t), "en", "s", 0) for i, t in enumerate(random_texts(2, 60, 300))]
    planted += [(20_000, None, "en", "s", 0), (20_001, "", "en", "s", 0), (20_002, " \t\n", "en", "s", 0), (20_003, "a\x1cb " * 30, "en", "s", 0), (20_004, "x y  z\x85 " * 40, "en", "s", 0)]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_periodic(r.doc_id, r.text) for r in rows)


def test_runs_operator_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "x", "y", "z", "u"), (None, None, "x", "y", "z", "u"), (1, "a b " * 20, "x", "y", "z", "u")], "doc_id long, text string, runs string, t string, i string, k_t string")
    got = periodic_runs.find_runs(docs, change=periodic_runs.repeated_from).collect()
    assert [(r.t, r.i, r.k_t) for r in got] == [("y", "z", "u")] * 3
    assert sorted((r.doc_id or 0, r.n_words, r.collapsed) for r in got) == [(0, 0, ""), (1, 40, "a b"), (1, 40, "a b")]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_runs_of_a_long_text():
    """A text of 400,000 words, periodic throughout at several scales."""
    rng = np.random.default_rng(6)
    words = np.concatenate([np.tile(rng.integers(0, 1000, p), 5) for p in (7, 100, 3000, 20_000)] + [rng.integers(0, 1000, 280_000), [-1]])
    got = periodic_runs.maximal_runs(words, [0], np.array([len(words) - 1]))
    assert [q for _, _, q in got] == [7, 100, 3000, 20_000] and all(hi - lo >= 5 * q for lo, hi, q in got)


# -- operator 13


def brute_words(rows, slip=True):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}


def brute_groups(n):
    gaps = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[len(w), i, w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for words in gaps.values():
        for w in words:
            near[w] |= words - {w}
    for w in n:
        for i in range(len(w)):
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def noisy(seed, count):
    """Texts over few stems with slips of one letter, and accents."""
    rng = random.Random(seed)
    letters, stems = "abenoéÉ×", ["banana", "étéolo", "aaaaaa", "nobean", "beano", "abcdefghij" * 9]
    for i in range(count):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1 :]
            words.append(rng.choice([w, w.upper(), w.title()]))
        yield i, " ".join(words) + rng.choice([", 1x", "ŸĀ", "\n"])


def test_spelling_against_brute_force(spark):
    rows = [*noisy(3, 60), (None, "banana Banana BANANA ßeano"), (7, None), (7, ""), (7, "1 2 3")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, word string, n string").repartition(4)
    for slip in (False, True):
        got = spelling.group_variants(docs, slip=slip)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert set(map(tuple, got.collect())) == brute_groups(brute_words(rows, slip))
    assert max(len(w) for w in brute_words(rows)) > 80


def test_spelling_in_passes_and_parts(spark, monkeypatch):
    """Several shards a length, several passes, and tasks that hand on their counts early give the same."""
    rows = list(noisy(4, 80))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = set(map(tuple, spelling.group_variants(docs).collect()))
    monkeypatch.setattr(spelling, "SHARD", 9)
    monkeypatch.setattr(spelling, "PASS_BYTES", 8 * spelling.BLOCKS * 5)
    monkeypatch.setattr(spelling, "HELD", 20)
    assert set(map(tuple, spelling.group_variants(docs).collect())) == whole == brute_groups(brute_words(rows, False))
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(40_000)})
    vocabulary = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    built, parts = spelling.shards(vocabulary)
    filters = spelling.Filters(built.collect(), parts)
    powers = spelling._powers(8)
    hashed = lambda some: (spelling._points(some) * powers).sum(axis=1, dtype=np.uint64)
    assert filters.may_hold(8, hashed(words)).all()
    others = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(40_000)} - set(words))
    assert filters.may_hold(8, hashed(others)).mean() < 0.03
    # the edits' hashes are those of the strings: each near word passes
    some = words[:50]
    found = set(spelling.edits(some, filters, np.array([ord(c) for c in "abcdefghijklmnop"], np.uint64)))
    held = set(words)
    want = {(i, w[:j] + c + w[j + 1 :]) for i, w in enumerate(some) for j in range(8) for c in "abcdefghijklmnop" if c > w[j] and w[:j] + c + w[j + 1 :] in held}
    assert want <= found


def test_op13_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_spelling_variants"](spark, SF).collect()
    assert set(map(tuple, got)) == brute_groups(brute_words(rows)) and len(got) > 1000


@pytest.mark.parametrize("name", ["op11_multi_index", "op12_periodic_runs", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows)) and len(rows) > 100
