"""Operator 10: token counts of a sentencepiece BPE vocabulary by heap-and-linked-list merging.

The symbols of a word form a linked list; a heap holds its adjacent pairs that are pieces, best score first. Popping and
joining until the heap is empty leaves initial symbols minus merges; no identifier is ever looked up. No piece has the
blank mark after another character, so merges never cross from one word into the next and words are counted once each.
A symbol without a piece falls back to its bytes, as in the library. The counter is for models that add a leading blank and otherwise
leave texts as they are; it is compared with the library on a few texts when it is made, and another normaliser raises an error.

Null or empty text: 0 tokens, 0 bytes. Rows and all other columns are kept, repeated rows included; columns named as the
outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.chunks import PartCache
from spotlake.llm.common import shielded, slices, unshielded

MARK = "▁"
#: Texts on which a counter has to agree with the library when it is made: blanks and their runs, newlines, marks, accents, bytes.
PROBES = ("a", " two  blanks ", "a\n b\n\nc", "\t tab", "▁ mark▁", "\ufb01 \u2460 e\u0301 \uff21", "日本 🎉", "  ")


def count_symbols(word: str, score: dict[str, float], byte_fallback: bool = True) -> int:
    """Tokens of a string without white space runs to split at: initial symbols, minus merges, plus fallback bytes."""
    symbols: list[str | None] = list(word)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        joined = symbols[i] + symbols[i + 1]
        if joined in score:
            heap.append((-score[joined], i, joined))
    heapq.heapify(heap)
    count = n
    while heap:
        _, left, joined = heapq.heappop(heap)
        right = after[left]
        if symbols[left] is None or right >= n or symbols[left] + symbols[right] != joined:
            continue
        symbols[left], symbols[right] = joined, None
        count -= 1
        nxt = after[left] = after[right]
        if nxt < n:
            before[nxt] = left
            pair = joined + symbols[nxt]
            if pair in score:
                heapq.heappush(heap, (-score[pair], left, pair))
        prev = before[left]
        if prev >= 0:
            pair = symbols[prev] + joined
            if pair in score:
                heapq.heappush(heap, (-score[pair], prev, pair))
    if byte_fallback:
        count += sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in score)
    return count


class PieceCounter:
    """Counts the tokens of a text as the library does for its model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(model.get_piece_size())]
        self.score = {model.id_to_piece(i): model.get_score(i) for i, no in enumerate(special) if not no}
        crossing = [p for p in self.score if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross words, as {crossing[0]!r}; words can't be counted one by one")
        score = self.score
        self.word = PartCache(lambda part: count_symbols(MARK + part, score))
        self.line = PartCache(lambda part: count_symbols(part, score), 8 << 20)
        for probe in PROBES:
            if self(probe) != len(model.encode(probe)):
                raise ValueError(f"the normaliser of {path} is not the one counted by: {probe!r}")

    def __call__(self, text: str) -> int:
        """Text is led by one blank; blanks stand as marks; newlines have no piece and never merge."""
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        lines = text.split("\n")
        total = len(lines) - 1
        for i, line in enumerate(lines):
            words = line.split(" ")
            if "" in words:
                total += self._runs(line, led=not i)
                continue
            if not i:
                total += self.word[words[0]]
            else:
                total += self.line[words[0]]
            total += sum(map(self.word.__getitem__, words[1:]))
        return total

    def _runs(self, line: str, led: bool) -> int:
        """A line that is empty, starts or ends with blanks or has runs of them: each run goes with the word after it."""
        marked = (MARK if led else "") + line.replace(" ", MARK)
        total, at = 0, 0
        while at < len(marked):
            start = at
            while at < len(marked) and marked[at] == MARK:
                at += 1
            end = marked.find(MARK, at)
            at = len(marked) if end < 0 else end
            total += count_symbols(marked[start:at], self.score)
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """df without its text, with n_bytes (UTF-8), n_tokens (both long) and over_limit (boolean)."""
    kept = [c for c in df.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(model_path)
        for batch in slices(batches, len(kept) + 1):
            counts = [tokens(text or "") for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    told = shielded(df, kept, text=text_col).withColumn("text", F.col("text").cast("string"))
    narrow = told.select(*[F.col(f"`k_{c}`") for c in kept], F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = narrow.drop("text").schema.add("n_tokens", "long")
    return unshielded(narrow.mapInArrow(run, schema), kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
