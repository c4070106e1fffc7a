"""Operator 1: packing by non-negative least squares over a histogram of lengths.

A document's ids, its end id included, are cut into whole windows and a remainder. The histogram of remainders has at
most window - 1 rows, so the driver can hold it whatever the corpus. Over it, shallow combinations of two or three lengths
that fill the window exactly are enumerated, their repeat counts solved by non-negative least squares, and rounded to what
the histogram can supply. Combinations fill sequences without padding and without cutting a remainder.

The solver works on the histogram alone, so its limits are the same at every size: ROUNDS rounds that each move at most A_ROUND
combinations, of which the MOST with the largest counts are used. Whatever they leave goes to the residual stream; no id is lost by them.

Residual remainders are packed greedily: laid end to end in a fixed order and cut where a window is full. What is left at
the very end is cut into powers of two, the lengths at which a sequence needs no padding. So no sequence is padded.

Everything that grows with the corpus (ranks inside a length, places in the residual stream) is a prefix sum over
(length, block) counts, block being the writing task of a row; no length, however common, meets in one task.

Null or empty text is the end id alone. Rows are packed one by one, repeated rows and ids included; a null id stays null.
An empty table gives an empty table. Other columns aren't carried.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.chunks import ChunkEncoder
from spotlake.llm.common import cut, slices, stored

#: Rounds of the solver, combinations raised in a round, and combinations kept at most.
ROUNDS, A_ROUND, MOST = 160, 192, 4096


class JsonIds:
    """Text to little-endian 32-bit ids, by a tokenizer file.

    A part that is one word, or a word and a mark after it, is one or two pre-tokens of a plain byte-level tokenizer and goes
    to its model directly; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.text_ids = ChunkEncoder(self.whole, re.compile("|".join(special)) if special else None)
        settings = json.loads(self.tokenizer.to_str())
        split = settings["pre_tokenizer"] or {}
        if settings["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
            hidden = [b for b in range(256) if b not in shown]
            self.chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
            self.marks = {m: self.whole(m) for m in ".,;:!?"}
            self.newline = self.whole("\n")
            self.text_ids.parts.encode = self.part

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.chars))]).tobytes()

    def part(self, part: str) -> bytes:
        """The ids of a part that follows a blank, or starts with a newline."""
        if part.isalpha():
            return self._word(" " + part)
        if part[-1:] in self.marks and part[:-1].isalpha():
            return self.text_ids.parts[part[:-1]] + self.marks[part[-1]]
        if part[:1] == "\n" and part[1:].isalpha():
            return self.newline + self._word(part[1:])
        return self.whole(part if part.startswith("\n") else " " + part)


@lru_cache(maxsize=2)
def _ids(path: str) -> JsonIds:
    return JsonIds(path)


def token_ids(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: uid, doc_id, doc_tokens, full_crcs (a checksum per whole window), rest (length), rest_crc, rest_ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_ids, end = _ids(tokenizer_path).text_ids, end_id.to_bytes(4, "little")
        for batch in slices(batches, 2):
            n, fulls, rest, crcs, raws = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                ids = text_ids(text or "") + end
                at = len(ids) // (4 * window) * 4 * window
                n.append(len(ids) // 4)
                fulls.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, at, 4 * window)])
                rest.append((len(ids) - at) // 4)
                crcs.append(zlib.crc32(ids[at:]))
                raws.append(ids[at:])
            long = pa.int64()
            arrays = [pa.array(n, long), pa.array(fulls, pa.list_(long)), pa.array(rest, long), pa.array(crcs, long), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["uid", "doc_id", "doc_tokens", "full_crcs", "rest", "rest_crc", "rest_ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid long, doc_id {kind}, doc_tokens long, full_crcs array<long>, rest long, rest_crc long, rest_ids binary")


def combinations_filling(window: int, lengths: list[int]):
    """(n, 3) array: two (with a 0) or three of the given lengths, ascending, that fill the window."""
    import numpy as np

    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(np.arange(0, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    c = window - a - b
    good = (a <= b) & (b <= c) & (have[a] | (a == 0)) & have[b] & have[np.clip(c, 0, window)]
    return np.stack([a[good], b[good], c[good]], axis=1)


def solve_counts(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to use each; together they use no length more often than it occurs.

    Non-negative least squares min |Ax - h| over x >= 0, by block coordinate descent: each round takes the combinations of
    steepest descent that share no length, moves each to its own optimum, and clips at zero. Counts are rounded in order
    of size, within what is left of each length.
    """
    import numpy as np

    combos = combinations_filling(window, [n for n in histogram if 0 < n < window])
    if not len(combos):
        return []
    h = np.zeros(window + 1)
    for n, count in histogram.items():
        if 0 < n < window:
            h[n] = count
    part = (combos > 0).astype(float)
    squares = part.sum(axis=1) + 2 * ((combos[:, 0] == combos[:, 1]) & (combos[:, 0] > 0)) + 2 * (combos[:, 1] == combos[:, 2])
    squares += 2 * ((combos[:, 0] == combos[:, 2]) & (combos[:, 0] > 0))
    x, left = np.zeros(len(combos)), h.copy()
    for _ in range(ROUNDS):
        slope = (left[combos] * part).sum(axis=1)
        step = np.maximum(slope / squares, -x)
        gain = np.abs(step) * np.sqrt(squares)
        best = np.argpartition(gain, -min(A_ROUND * 16, len(gain)))[-min(A_ROUND * 16, len(gain)) :]
        best = best[np.argsort(-gain[best], kind="stable")]
        taken, moved = np.zeros(window + 1, bool), 0
        for j in best.tolist():
            lengths = [n for n in combos[j].tolist() if n]
            if gain[j] < 0.25 or moved == A_ROUND:
                break
            if not taken[lengths].any():
                taken[lengths] = True
                moved += 1
                x[j] += step[j]
                for n in lengths:
                    left[n] -= step[j]
        if not moved:
            break
    spare, chosen = h.astype(np.int64), []
    for j in np.argsort(-x, kind="stable")[:MOST].tolist():
        lengths = [n for n in combos[j].tolist() if n]
        count = min([int(np.floor(x[j] + 0.5))] + [int(spare[n]) // lengths.count(n) for n in lengths])
        if count > 0:
            for n in lengths:
                spare[n] -= count
            chosen.append((tuple(lengths), count))
    return chosen


def _places(chosen: list[tuple[tuple[int, ...], int]]):
    """The plan as sorted arrays: from (length, first rank) on, sequence first + (rank - first rank) at an offset; and ranks used by length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, count in chosen:
        offset = 0
        for n in sorted(lengths, reverse=True):
            first = used.get(n, 0)
            rows.append((n, first, sequence, offset))
            used[n] = first + count
            offset += n
        sequence += count
    return sorted(rows), used, sequence


def _running(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts per (keys, block) -> the sum over earlier blocks, as base. A row per block and key, not per document."""
    window = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(value).over(window), F.lit(0)))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and how (whole, combined or residual)."""
    import numpy as np

    wide = stored(token_ids(docs, tokenizer_path, window, end_id, id_col, text_col), "packing")
    block = F.shiftrightunsigned("uid", 33).alias("block")
    rows = wide.select("uid", block, "rest", F.size("full_crcs").alias("fulls"))

    # whole windows: sequences 0, 1, ... in the order of uid
    per_block = cut(rows.groupBy("block").agg(F.sum("fulls").cast("long").alias("fulls")))
    n_full = per_block.agg(F.sum("fulls")).first()[0] or 0
    inside = Window.partitionBy("block").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    long_docs = wide.where(F.size("full_crcs") > 0).select("uid", block, "doc_id", "doc_tokens", "full_crcs")
    first = F.col("base") + F.coalesce(F.sum(F.size("full_crcs")).over(inside), F.lit(0))
    whole = long_docs.join(_running(per_block, [], "fulls").select("block", "base"), "block").select("doc_id", "doc_tokens", "full_crcs", first.alias("first"))
    whole = whole.select("doc_id", "doc_tokens", "first", F.posexplode("full_crcs").alias("i", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit("whole").alias("how"))

    # combinations: a remainder's rank among those of its length names its sequence
    counts = cut(rows.where("rest > 0").groupBy("rest", "block").agg(F.count("*").alias("n")))
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # below `window` rows
    plan, used, n_combined = _places(solve_counts(histogram, window))
    ranked = rows.where("rest > 0").join(_running(counts, ["rest"], "n").select("rest", "block", "base"), ["rest", "block"])
    rank = F.col("base") + F.row_number().over(Window.partitionBy("rest", "block").orderBy("uid")) - 1
    ranked = cut(ranked.select("uid", "block", "rest", rank.alias("rank")))
    starts = np.array([(n << 40) + first for n, first, _, _ in plan], np.int64)
    sequences, offsets = np.array([s for _, _, s, _ in plan], np.int64), np.array([o for _, _, _, o in plan], np.int64)
    firsts, ends = np.array([f for _, f, _, _ in plan], np.int64), np.zeros(window + 1, np.int64)
    for n, end in used.items():
        ends[n] = end

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, rest, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ok = rank < ends[rest]
            uid, rest, rank = uid[ok], rest[ok], rank[ok]
            at = np.searchsorted(starts, (rest << 40) + rank, side="right") - 1
            out = [uid, sequences[at] + rank - firsts[at] + n_full, offsets[at]] if len(uid) else [uid, uid, uid]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["uid", "sequence_id", "offset"])

    combined = ranked.select("uid", "rest", "rank").mapInArrow(place, "uid long, sequence_id long, offset long")
    combined = combined.withColumn("begin", F.lit(0).cast("long")).withColumn("length", F.lit(None).cast("long"))

    # residual: a stream that is cut where a window is full, its end cut into powers of two
    lengths, stops = F.col("rest"), {n: used.get(n, 0) for n in histogram}
    taken = F.create_map(*[F.lit(x) for pair in stops.items() for x in pair]) if stops else F.create_map(F.lit(0), F.lit(0))
    residual = ranked.where(F.col("rank") >= taken[lengths.cast("int")])
    sums = cut(residual.groupBy("block").agg(F.sum("rest").cast("long").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    at = F.col("base") + F.coalesce(F.sum("rest").over(inside), F.lit(0))
    stream = residual.join(_running(sums, [], "n").select("block", "base"), "block").select("uid", "rest", at.alias("at"))
    tail, bounds = total // window * window, []
    while (bounds[-1] if bounds else tail) < total:
        here = bounds[-1] if bounds else tail
        bounds.append(here + (1 << ((total - here).bit_length() - 1)))
    base_sequence = n_full + n_combined

    def slice_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for uid, rest, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                here, end = start, start + rest
                while here < end:
                    if here < tail:
                        sequence, opens, shuts = here // window, here // window * window, (here // window + 1) * window
                    else:
                        k = next(i for i, bound in enumerate(bounds) if here < bound)
                        sequence, opens, shuts = tail // window + k, bounds[k - 1] if k else tail, bounds[k]
                    stop = min(end, shuts)
                    for column, value in zip(out, (uid, base_sequence + sequence, here - opens, here - start, stop - here), strict=True):
                        column.append(value)
                    here = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["uid", "sequence_id", "offset", "begin", "length"])

    pieces = stream.mapInArrow(slice_stream, "uid long, sequence_id long, offset long, begin long, length long")
    placed = combined.select("uid", "sequence_id", "offset", "begin", "length").unionByName(pieces)
    rests = wide.where("rest > 0").select("uid", "doc_id", "doc_tokens", "rest", "rest_crc", "rest_ids").join(placed, "uid")
    length = F.coalesce("length", "rest")
    crc = F.when(length == F.col("rest"), F.col("rest_crc")).otherwise(F.crc32(F.expr("substring(rest_ids, int(begin * 4 + 1), int(length * 4))")))
    how = F.when(F.col("length").isNull(), "combined").otherwise("residual")
    rests = rests.select("doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("begin")).alias("start"), length.alias("length"), crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", how.alias("how"))
    return whole.unionByName(rests)
