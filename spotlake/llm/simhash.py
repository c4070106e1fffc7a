"""Operator 2: near-duplicates by SimHash fingerprints, a byte-position inverted index and count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at
least four positional bytes: the guaranteed minimum. A list of all fingerprints with one byte at one place would hold a 256th of them, so the index lists each
distinct fingerprint under its bytes at three positions at a time; any four positions hold one of the triples. Of each pair that meets the
shared positional bytes are tallied; pairs below LEAST_SHARED are dropped, and the rest are verified bit by bit. Every link passes that filter.

Large postings aren't expanded into pairs. First each fingerprint of a posting is compared with the posting's smallest
member only, which joins nearly all of a group of near copies. Pairs are then sought only in postings that still hold more than one
component, and there only between members outside the posting's largest component and all others, so a group that is already joined
is never paired with itself. A posting of more than HOT_POSTING members is split by a fourth byte, at each of its five other positions: a pair with four shared bytes meets
in one of those at least.

Null text counts as empty: fingerprint zero, linked like any other. Rows are kept one by one, repeated rows and ids
included; a null id stays null and never names a component (a component of null ids only has a null id). Other
columns are kept; columns named as the outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import attach, cut, slices, stored
from spotlake.llm.components import smallest_reachable

BYTES = 8
SEED = 42
#: Positional bytes that a link of four bits shares at least.
LEAST_SHARED = 4
#: Members of a posting above which it is split by a fourth byte.
HOT_POSTING = 4096


def index_positions() -> list[tuple[int, ...]]:
    """Triples of byte positions of which any four positions hold at least one, as few as can be.

    Turan's construction: the positions in three groups; a triple is listed if it lies in one group, or has two positions in one and the third in the next.
    """
    group = {p: p * 3 // BYTES for p in range(BYTES)}

    def listed(triple: tuple[int, ...]) -> bool:
        counts = [sum(group[p] == g for p in triple) for g in range(3)]
        return 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(BYTES), 3) if listed(t)]


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    tokens = text.encode().lower().split()  # on bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not tokens:
        return 0
    joined, hashes, ends, at = b" ".join(tokens), [], [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends]]
    one = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [one(joined, SEED)]
    else:
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(raw), 65536):
        counts += np.unpackbits(raw[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(raw), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4) -> DataFrame:
    """docs without the text, with fp (long)."""
    kept = [c for c in docs.columns if c not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(kept)):
            fps = [fingerprint(text or "", words) for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*kept, "fp"])

    cols = [F.col(f"`{c}`") for c in kept]
    schema = docs.select(*cols).schema.add("fp", "long")
    return docs.select(*cols, F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)


def _postings(distinct: DataFrame) -> DataFrame:
    """(fp, node) -> (key, fp, node), a row for each triple of positions."""
    keys = []
    for i, triple in enumerate(index_positions()):
        key = F.lit(i).cast("long")
        for position in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftright("fp", 8 * position).bitwiseAND(F.lit(255)))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "node")


def _linked(x: str, y: str, bits: int) -> Column:
    """The tally of shared positional bytes reaches the guaranteed minimum, and the bits are near enough."""
    apart = F.col(x).bitwiseXOR(F.col(y))
    shared = sum(F.when(F.shiftrightunsigned(apart, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(BYTES))
    return (shared >= LEAST_SHARED) & (F.bit_count(apart) <= bits)


def _split(rows: DataFrame) -> DataFrame:
    """rows (key, fp, size, ...) with the keys of large postings taken apart by one more byte, at each position that the posting's triple leaves."""
    others = F.array(*[F.array(*[F.lit(p) for p in range(BYTES) if p not in triple]) for triple in index_positions()])
    byte = lambda p: F.expr("shiftrightunsigned(fp, 8 * p)").bitwiseAND(F.lit(255))
    hot = rows.where(F.col("size") > HOT_POSTING).withColumn("p", F.explode(F.get(others, F.shiftright("key", 24).cast("int"))))
    # keys of the parts are negative, so they are no posting's own
    hot = hot.withColumn("key", -(F.col("key") * 4096 + F.col("p") * 256 + byte("p")) - 1).drop("p")
    return rows.where(F.col("size") <= HOT_POSTING).unionByName(hot)


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, node) with distinct fp -> (node, root): components over links of at most `bits` (up to 4) differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees links of up to four bits")
    postings = _postings(distinct)
    heads = postings.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("head"), F.count("*").alias("members"))
    heads = heads.where("members > 1").select("key", F.col("head.node").alias("a"), F.col("head.fp").alias("head_fp"))
    shared = cut(postings.join(heads, "key"))
    stars = shared.where("node <> a").where(_linked("fp", "head_fp", bits)).select("a", F.col("node").alias("b")).distinct()
    first = cut(smallest_reachable(stars))
    named = cut(shared.select("key", "fp", "node").join(first, "node", "left").select("key", "fp", F.coalesce("root", "node").alias("root")))
    # per posting the members by component: only postings of several components have pairs left, and those outside its largest one seek them
    held = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = held.groupBy("key").agg(F.max(F.struct("n", "root")).getField("root").alias("top"), F.count("*").alias("roots"), F.sum("n").alias("size")).where("roots > 1").select("key", "top", "size")
    open_rows = cut(_split(named.join(mixed, "key")))
    x = open_rows.where("root <> top").select("key", F.col("fp").alias("fp_x"), F.col("root").alias("a"))
    y = open_rows.select("key", F.col("fp").alias("fp_y"), F.col("root").alias("b"), (F.col("root") == F.col("top")).alias("in_top"))
    met = x.join(y, "key").where((F.col("a") != F.col("b")) & (F.col("in_top") | (F.col("fp_x") < F.col("fp_y"))) & _linked("fp_x", "fp_y", bits))
    second = smallest_reachable(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    onto = second.select(F.col("node").alias("mid"), F.col("root").alias("last"))
    lone = second.select("node", "root").join(first.select("node"), "node", "left_anti")
    moved = first.select("node", F.col("root").alias("mid")).join(onto, "mid", "left").select("node", F.coalesce("last", "mid").alias("root"))
    return moved.unionByName(lone)


#: Parts that a component's rows are dealt over when they learn its smallest id.
PARTS = 16


def _component_of(marked: DataFrame, id_col: str, bits: int) -> DataFrame:
    """(fp, root, component_id, n) for each distinct fingerprint of marked, n being its rows."""
    # fingerprints are the nodes: one id may stand on several texts, and their order is as good as random, which keeps hooking chains short
    least = F.min(F.col(f"`{id_col}`")).cast("long").alias("least")
    nodes = cut(marked.groupBy("fp").agg(least, F.count("*").alias("n")).withColumn("node", F.col("fp")))
    named = cut(nodes.join(links(nodes.select("fp", "node"), bits), "node", "left").select("fp", "least", "n", "root"))
    alone = named.where("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "n")
    # only linked ones meet, in parts, so that a large component is spread
    linked = named.where("root IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int"))
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return alone.unionByName(linked.join(by_root, ["root", "part"]).select("fp", "root", "component_id", "n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """docs without the text, with fp (long) and component_id (smallest id reachable through links, itself included)."""
    kept = [c for c in docs.columns if c not in (text_col, "fp", "component_id")]
    marked = cut(fingerprints(docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in kept], F.col(f"`{text_col}`").alias("__t")), "__t", words))
    by_fp = cut(_component_of(marked, f"k_{id_col}", bits).select("fp", "component_id", "n"))
    out = attach(marked, by_fp, "fp", "n", marked.count())
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in kept], "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row of docs for each component, that of the smallest id (null ids last; of equal ids any one row), with the same columns."""
    names = [f"k_{c}" for c in docs.columns]
    told = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").alias("__text"))
    rows = stored(fingerprints(told.withColumn("__t", F.col("__text")).drop("__text"), "__t", words), "simhash")
    marked = rows.select(F.col(f"`k_{id_col}`").alias(id_col), "uid", "fp")
    place = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("uid"))
    # the first row of each fingerprint, then the first of those of each component: no join meets the rows of a group
    first = marked.groupBy("fp").agg(F.min(place).alias("first"))
    by_fp = _component_of(marked, id_col, bits).select("fp", "root")
    best = first.join(by_fp, "fp").groupBy("root").agg(F.min("first").getField("uid").alias("uid"))
    return rows.join(best, "uid", "left_semi").select(*[F.col(f"`{n}`").alias(c) for c, n in zip(docs.columns, names, strict=True)])
