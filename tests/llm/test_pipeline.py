"""The corpus pipeline on the smallest tables, stage by stage against brute force."""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import regex

import corpus_pipeline
from spotlake.llm import gam, pii, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _classified(docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    x = {r["doc_id"]: gam.text_features(r["text"]) for r in docs}
    rows = sorted((i, x[i], labels[i]) for i in x if i in labels)
    features, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    order = np.lexsort((*features.T, y, np.array([r[0] for r in rows])))
    scores = gam.fit(features[order], y[order]).scores(np.array([x[r["doc_id"]] for r in docs]))
    return {r["doc_id"] for r, s in zip(docs, scores, strict=True) if s >= 0.3}


def _passing(docs):
    """Base rules and the fences of each language and source; quantiles as sketches of few values have them: the value at rank ceil(q n)."""
    counts = {}
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0d]+", r["text"])
        places = collections.defaultdict(list)
        for k in range(len(words) - 7):
            places[tuple(words[k : k + 8])].append(k)
        covered = {x for v in places.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
        lines = [x for x in r["text"].split("\n") if x.strip()]
        n, chars = len(words), sum(map(len, words))
        base = n < 20 or 100 * len(covered) > 30 * n
        # name: (ratio, events, exposure in events)
        measures = {
            "symbols": (len(re.findall(r"[#*$%&|<>]", r["text"])), chars, 1),
            "lines": (len(lines) - len(set(lines)), n, 1),
            "repeats": (len(covered), n, 8),
        }
        counts[r["doc_id"]] = (base, measures, chars / max(n, 1))

    def fence(values):
        low, middle, high, tail = (sorted(values)[max(int(np.ceil(q * len(values))), 1) - 1] for q in (0.25, 0.5, 0.75, 0.95))
        return high + 3 * (high - low) if high > low else middle + (tail - middle) / 4

    groups = collections.defaultdict(list)
    for r in docs:
        groups[r["lang"], r["source"]].append(counts[r["doc_id"]])
    kept = set()
    for r in docs:
        base, measures, length = counts[r["doc_id"]]
        group = groups[r["lang"], r["source"]]
        ok = not base and length <= fence([g[2] for g in group])
        for name, (count, exposure, size) in measures.items():
            expected = fence([g[1][name][0] / max(g[1][name][1], 1) for g in group]) * exposure / size
            ok = ok and count / size <= expected + 3 * max(expected, 1) ** 0.5
        if ok:
            kept.add(r["doc_id"])
    return kept


def _representatives(docs):
    fp = {r["doc_id"]: simhash.fingerprint(r["text"]) & (2**64 - 1) for r in docs}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in fp}


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append([r.asDict() for r in docs.collect()])
    raw = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    by_id = {r["doc_id"]: r for r in raw}
    classified, passed, single, private, pieces = results
    assert all(set(r) == set(COLUMNS) for rows in results[:4] for r in rows)
    assert {r["doc_id"] for r in classified} == _classified(raw)
    assert {r["doc_id"] for r in passed} == _passing(classified)
    assert {r["doc_id"] for r in single} == _representatives(passed)
    assert all(r == by_id[r["doc_id"]] for rows in (classified, passed, single) for r in rows)
    find = regex.compile(pii.ENTITY)
    for r in private:
        old = by_id[r["doc_id"]]["text"]
        assert find.split(old) == find.split(r["text"]) and r["n_chars"] == len(r["text"])
        assert not set(find.findall(old)) & set(find.findall(r["text"]))
    assert {r["doc_id"] for r in private} == {r["doc_id"] for r in single}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in private}
    for p in pieces:
        assert zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    assert sorted((r.doc_id, r.start) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((p["doc_id"], p["start"]) for p in pieces)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, uid string, kept string, n_entities string, features string, sequence_id string, __hits string"


def _odd_documents(spark):
    plain = " ".join(f"word{i % 97} of the hill" for i in range(60)) + ". Mr. John Smith, a@b.example.com"
    texts = [None, "", " ", plain, plain, plain, "x" * 200_000, "one two " * 30_000, "\u00e9\u4e16 " * 40 + "\U0001f389", "# | $ " * 50]
    rows = [(i if i != 2 else None, t, "en" if i % 3 else None, "s" if i % 2 else None, None, 1.0, "f", "u", "k", "n", "v", "q", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[0]], ODD)


def test_stages_on_odd_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns: each stage keeps columns and whole rows."""
    docs = _odd_documents(spark)
    have = collections.Counter(r.text for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        if name == "personal_data":
            assert len(rows) == docs.count() and not any("Smith" in (r.text or "") or "a@b" in (r.text or "") for r in rows)
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and all(r.fp == "f" for r in rows)
        else:
            assert not collections.Counter(r.text for r in rows) - have and all(r.uid == "u" and r.kept == "k" for r in rows), name
        if name == "near_dedup":
            assert len({r.text for r in rows if r.text and r.text.strip()}) == len([r for r in rows if r.text and r.text.strip()])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_stages_on_no_documents(spark):
    docs = _odd_documents(spark).limit(0)
    assert all(stage(spark, docs, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
