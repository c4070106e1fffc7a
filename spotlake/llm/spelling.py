"""Operator 13: groups of spelling variants by Bloom-guided neighbourhoods.

Words are counted over all documents, in the tasks first. Two words of the vocabulary are near if one inserted, deleted or replaced code point makes one
the other. Each word generates its edits and probes them against Bloom filters of the vocabulary; only positives are written
as strings and shuffled to an exact join with the vocabulary, which removes the false ones.

Nearness goes both ways, so a word generates its deletions and its replacements by a greater code point only (over the code points
that occur in the vocabulary), and a found pair counts for both. Hashes are polynomial, so an edit's hash follows from the word's in a few operations, whole
lengths of words at a time, without any string.

Filters are sharded by word length and, within a length, by hash, SHARD words each; each is blocked, all bits of a word lying in one 64-bit block.
Shards are built in tasks and broadcast in passes of at most PASS_BYTES, whatever the vocabulary's size; a pass probes only words of
the lengths that its shards can answer.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that is at least `ratio` times its own; counts at least double from form to form,
so the way to the root is short, and is found by doubling. Null texts have no words, a null id counts as an empty one. Columns other than the two named are not read. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import attach, cut, slices, stored

#: Runs of A-Z, a-z and U+00C0 to U+00FF, as UTF-8 whose A-Z have been lower-cased.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Different words that a task counts before it hands them on.
HELD = 400_000
#: Words and 64-bit blocks of a shard of the filters (16 bits a word), and bytes of the shards of a pass.
SHARD, BLOCKS, PASS_BYTES = 32_768, 8192, 32 << 20
#: Multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Probes worked on at once.
PROBES = 1 << 18


def slips(doc_id: int | None, run: bytes, start: int) -> bytes:
    """The run, without one code point where 97 divides the crc32 of `<doc_id>:<run>`; start: the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run, start)
    if h % 97:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str, text_col: str, shortest: int, slip: bool) -> DataFrame:
    """(word, n) over all documents, for words of at least `shortest` code points; slip: apply slips()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = [w.decode() for w in held]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for word, n in Counter(RUN.findall((text or "").encode().lower())).items():
                    if len(word) < shortest:  # fewer bytes than code points asked for
                        continue
                    if slip:
                        word = slips(doc_id, word, start)
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "word string, n long").where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int):
    import numpy as np

    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _points(words: list[str]):
    """Code points of words of one length, a row each."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _final(h):
    """The hash from which shard, block and bits are taken."""
    import numpy as np

    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _place(h):
    """Block and bits of final hashes."""
    import numpy as np

    mask = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(24)) & np.uint64(BLOCKS - 1)).astype(np.int64), mask


def _by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for word in words:
        out.setdefault(len(word), []).append(word)
    return out


def _hashed(vocabulary: DataFrame) -> DataFrame:
    """(word) -> (size, h): length and final hash of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for size, words in _by_length(batch.column(0).to_pylist()).items():
                h = _final((_points(words) * _powers(size)).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), size), pa.int32()), pa.array(h.view(np.int64), pa.int64())], names=["size", "h"])

    return vocabulary.select("word").mapInArrow(run, "size int, h long")


def shards(vocabulary: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(size, part, bits): the filters of the words of each length, and the number of parts by length."""
    parts = {r["size"]: -(-r["n"] // SHARD) for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    by_size = F.create_map(*[F.lit(x) for item in parts.items() for x in item])

    def build(table: pa.Table) -> pa.Table:
        import numpy as np

        block, mask = _place(table.column("h").to_numpy().view(np.uint64))
        bits = np.zeros(BLOCKS, np.uint64)
        np.bitwise_or.at(bits, block, mask)
        return pa.table([table.column("size")[:1], table.column("part")[:1], pa.array([bits.tobytes()], pa.binary())], names=["size", "part", "bits"])

    part = F.pmod(F.shiftrightunsigned("h", 40), by_size[F.col("size")]).cast("int")
    return _hashed(vocabulary).withColumn("part", part).groupBy("size", "part").applyInArrow(build, "size int, part int, bits binary"), parts


class Filters:
    """The shards of a pass."""

    def __init__(self, rows: list, parts: dict[int, int]):
        import numpy as np

        self.parts, self.slot, self.bits = parts, {}, np.frombuffer(b"".join(r["bits"] for r in rows), np.uint64)
        for i, r in enumerate(rows):
            self.slot.setdefault(r["size"], np.full(parts[r["size"]], -1))[r["part"]] = i

    def may_hold(self, size: int, h):
        """Whether words of `size` code points with these polynomial hashes may be in the vocabulary, as far as its shards are in this pass."""
        import numpy as np

        h = _final(h)
        slot = self.slot[size][((h >> np.uint64(40)) % np.uint64(self.parts[size])).astype(np.int64)]
        block, mask = _place(h)
        return (slot >= 0) & ((self.bits[np.maximum(slot, 0) * BLOCKS + block] & mask) == mask)


def edits(words: list[str], filters: Filters, alphabet) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) for the edits of words of one length that the filters may hold: deletions, and replacements by greater code points."""
    import numpy as np

    size, points, power = len(words[0]), _points(words), _powers(len(words[0]) + 1)
    terms = points * power[:size]
    whole = terms.sum(axis=1, dtype=np.uint64)
    if size in filters.slot:
        for i in range(size):
            h = whole[:, None] + (alphabet[None, :] - points[:, i : i + 1]) * power[i]
            row, column = np.nonzero(alphabet[None, :] > points[:, i : i + 1])
            hit = filters.may_hold(size, h[row, column])
            for w, c in zip(row[hit].tolist(), alphabet[column[hit]].tolist(), strict=True):
                yield w, words[w][:i] + chr(c) + words[w][i + 1 :]
    if size > 1 and size - 1 in filters.slot:
        before = np.zeros(len(words), np.uint64)
        for i in range(size):
            after = whole - before - terms[:, i]
            # of equal neighbours only the first is deleted: the others give the same word
            row = np.arange(len(words)) if not i else np.flatnonzero(points[:, i] != points[:, i - 1])
            hit = filters.may_hold(size - 1, before[row] + after[row] * np.uint64(INVERSE))
            for w in row[hit].tolist():
                yield w, words[w][:i] + words[w][i + 1 :]
            before = before + terms[:, i]


def _probe(vocabulary: DataFrame, filters, sizes: list[int], alphabet: list[int]) -> DataFrame:
    """(word, n) -> (word, n, edit) for the positives of a pass; filters: a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        letters = np.array(alphabet, np.uint64)
        for batch in batches:
            counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for words in _by_length(list(counts)).values():
                step = max(1, PROBES // len(letters))
                for i in range(0, len(words), step):
                    some = words[i : i + step]
                    found = list(edits(some, filters.value, letters))
                    names = [some[w] for w, _ in found]
                    columns = [pa.array(names, pa.string()), pa.array([counts[w] for w in names], pa.int64()), pa.array([e for _, e in found], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "edit"])

    asked = sorted({*sizes, *[s + 1 for s in sizes]})
    return vocabulary.where(F.length("word").isin(asked)).select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n), words distinct -> (word, near, near_n): each pair of near words, both ways."""
    spark = vocabulary.sparkSession
    none = spark.createDataFrame([], "word string, near string, near_n long")
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    # at most 26 + 64 letters
    alphabet = sorted(ord(r["c"]) for r in letters.collect())
    if not alphabet:
        return none
    built, parts = shards(vocabulary)
    built = stored(built, "spelling-filters")
    names = sorted((size, part) for size, n in parts.items() for part in range(n))
    step = max(1, PASS_BYTES // (8 * BLOCKS))
    pairs = None
    for i in range(0, len(names), step):
        (low, low_part), (high, high_part) = names[i], names[min(i + step, len(names)) - 1]
        place = F.struct("size", "part")
        held = built.where(place.between(F.struct(F.lit(low), F.lit(low_part)), F.struct(F.lit(high), F.lit(high_part)))).collect()
        filters = spark.sparkContext.broadcast(Filters(held, parts))
        sizes = sorted({r["size"] for r in held})
        found = _probe(vocabulary, filters, sizes, alphabet).join(vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
        found = cut(found.select("word", "n", "edit", "edit_n"))
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return none
    there = pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    return there.unionByName(pairs.select(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) without nulls -> (word, root), by doubling the way."""
    way = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        reached = way.groupBy("root").agg(F.count("*").alias("n"))
        onward = cut(reached.join(way.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"))
        if onward.isEmpty():
            return way
        way = cut(attach(way, onward, "root", "n", way.count()).select("word", F.coalesce("next", "root").alias("root")))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, rarest: int = 3, ratio: int = 2, slip: bool = False) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least `shortest` code points and `rarest` occurrences.

    slip: first delete a code point of one word of a document in 97, as in slips(); a check on rare spellings.
    """
    vocabulary = stored(word_counts(docs, id_col, text_col, shortest, slip).where(F.col("n") >= rarest), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = vocabulary.join(near, "word", "left").withColumn("form_n", -F.col("best.m"))
    right = F.col("form_n") >= F.col("n") * ratio
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(right, F.col("best.w")).alias("form"), F.when(right, F.col("form_n")).alias("form_n")))
    out = told.join(_roots(told.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
