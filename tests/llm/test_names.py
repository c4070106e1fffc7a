"""Extra columns under every name that the operators use themselves."""

from __future__ import annotations

import inspect
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spotlake.llm import byte_bpe, common, components, gam, license_scan, multi_index, packing, periodic_runs, pii, quality_rules, simhash, spelling, token_count

MODULES = (byte_bpe, common, components, gam, license_scan, multi_index, packing, periodic_runs, pii, quality_rules, simhash, spelling, token_count)
#: Every quoted or keyword name in the modules, as they are and as the operators shield them.
NAMES = sorted({n.lower() for m in MODULES for n in re.findall(r"""["'`(]([A-Za-z_][A-Za-z0-9_]{0,30})["'`]|\b([a-z_]+)=""", inspect.getsource(m)) for n in n if n})
NAMES = [n for n in NAMES if n not in ("doc_id", "text", "lang", "source")]
NAMES = sorted({*NAMES, *[f"k_{n}" for n in NAMES[::7]], "k_doc_id", "k_text"})
TEXT = "Dr. Jane Moore wrote to jane@moore.org from 10.0.0.1 on Monday, and then she sent the same long letter again to all of them, licensed under the mit license."


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, f"{TEXT} {i}" if i < 4 else [None, "", TEXT][i - 4], "en", "s") for i in range(7)], "doc_id long, text string, lang string, source string")
    return common.stored(rows.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES)]), "names")


LABELS = "doc_id long, quality int"
RUNS = {
    "op2": lambda d, _: simhash.near_duplicates(d),
    "op2 keep": lambda d, _: simhash.keep_one(d),
    "op3": lambda d, _: pii.replace_entities(d, "key"),
    "op4": lambda d, _: license_scan.scan(d),
    "op5": lambda d, labels: gam.classify(d, labels),
    "op5 keep": lambda d, labels: gam.keep_good(d, labels),
    "op7": lambda d, _: byte_bpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded_col="decoded"),
    "op7 decode": lambda d, _: byte_bpe.decode(d.withColumn("ids", F.lit(None).cast("binary")), P.path("byte_bpe_multi_50k.tiktoken")),
    "op9": lambda d, _: quality_rules.apply_rules(d),
    "op9 keep": lambda d, _: quality_rules.keep_passing(d),
    "op10": lambda d, _: token_count.count_tokens(d, P.path("piece_bpe_32k.model")),
    "op12": lambda d, _: periodic_runs.find_runs(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_columns_are_kept_under_any_name(spark, docs, name):
    assert len(NAMES) > 150
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], LABELS)
    got = RUNS[name](docs, labels)
    rows = got.collect()
    assert len(rows) == 7 or "keep" in name
    added = [c for c in got.columns if c not in docs.columns]
    kept = [c for c in NAMES if c in got.columns and c not in OUTPUTS.get(name, ())]
    assert len(kept) >= len(NAMES) - len(OUTPUTS.get(name, ())) and len(set(got.columns)) == len(got.columns) and len(added) < 12
    place = {n: f"x{i}" for i, n in enumerate(NAMES)}
    assert all(r[c] == place[c] for r in rows for c in kept)


#: Columns named as an operator's outputs are replaced.
OUTPUTS = {
    "op2": ("fp", "component_id"),
    "op3": ("n_entities",),
    "op4": ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"),
    "op5": ("score", "predicted"),
    "op7": ("n_tokens", "ids", "decoded"),
    "op7 decode": ("ids", "decoded"),
    "op9": (*quality_rules.COUNTS, "base_failed", "kept", "reason"),
    "op10": ("n_bytes", "n_tokens", "over_limit"),
    "op12": ("n_words", "runs", "collapsed"),
}


def test_stages_of_the_pipeline(spark, docs, tmp_path):
    spark.createDataFrame([(i, 1) for i in range(7)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        if name != "packing":
            assert rows.columns == docs.columns
    assert rows.count() > 0
