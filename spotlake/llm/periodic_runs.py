"""Operator 12: periodic runs of words by string synchronising sets at dyadic scales.

A run is a maximal stretch of words with smallest period q and at least POWER periods. At scale t (a power of two) a position is in the
synchronising set if the least hash of the t-word strings at it and at the t places after stands at the first or at the last of them;
t-word strings of a period up to t/3 take no part. Whether a position is in the set depends on the 2t words from it alone, so equal contexts are
chosen alike. A run of period p of (3t-1)/2 to 3t-1 words holds a chosen position i with all of i .. i+p+2t inside it: a
stretch of t positions without any would have a period of up to t/3, and then p were not the smallest. So the chosen position p words on
has the same context, and pairs of equal contexts up to 3t-1 words apart propose every such period. Each proposal is extended word by word in both
directions, so hashes never decide. The strings left out are regions of high periodicity: periods up to DIRECT words are detected separately, by comparing the
words with those q places on, and larger ones have been found at smaller scales.

The texts of a batch are worked on together, with a mark of its own after each; texts too short for a scale leave it. Time is about
words times the logarithm of a text's length; memory is that of one slice of texts (4 MB, or one longer text, some 200 bytes a word).

Null or empty text: no words, no runs, an empty collapsed text. Rows and other columns are kept, repeated rows included; columns named as the
outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.llm.common import slices

#: Periods found by comparing words directly: those below the first scale's.
DIRECT, FIRST_SCALE = 11, 8
OUTPUTS = ("n_words", "runs", "collapsed")
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _stretches(equal, least: int):
    """Starts and ends of the stretches of True of at least `least`."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _mixed(x, y=None):
    """64-bit hashes of numbers, or of pairs of them."""
    import numpy as np

    z = x * np.uint64(0x9E3779B97F4A7C15) if y is None else x * np.uint64(0xD6E8FEB86659FD93) + (y ^ (y >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def _doubled(hashes, t: int):
    return _mixed(hashes[:-t], hashes[t:]) if len(hashes) > t else hashes[:0]


def _window_min(x, size: int):
    """Minimum of `size` values from each place on, size being a power of two and one more."""
    import numpy as np

    t, low = 1, x
    while t * 2 < size:
        low = np.minimum(low[:-t], low[t:])
        t *= 2
    return np.minimum(low[: len(low) - (size - t)], low[size - t :])


def _extended(words, i: int, d: int) -> tuple[int, int]:
    """The stretch around i of places whose word equals that d places on."""
    import numpy as np

    lo, hi, step = i, i, 64
    while hi + d < len(words):
        part = words[hi : min(hi + step, len(words) - d)] != words[hi + d : hi + d + step]
        bad = int(part.argmax()) if part.any() else len(part)
        hi += bad
        if bad < len(part):
            break
        step *= 2
    step = 64
    while lo > 0:
        at = max(lo - step, 0)
        part = np.flatnonzero(words[at:lo] != words[at + d : lo + d])
        if len(part):
            lo = at + int(part[-1]) + 1
            break
        lo, step = at, step * 2
    return lo, hi


def _proposals(ids, contexts, periodic, t: int):
    """Pairs of places of the synchronising set with equal contexts, (3t-1)/2 to 3t-1 apart: places of the first, distances."""
    import numpy as np

    ids = ids.copy()
    ids[periodic[: len(ids)]] = np.iinfo(np.uint64).max
    low = _window_min(ids, t + 1)
    chosen = np.flatnonzero(((low == ids[: len(low)]) | (low == ids[t:])) & (low != np.iinfo(np.uint64).max))
    chosen = chosen[chosen < len(contexts)]
    keys = contexts[chosen]
    order = np.argsort(keys, kind="stable")
    keys, chosen = keys[order], chosen[order]
    at, apart, k = [], [], 1
    while k < len(keys):
        d = chosen[k:] - chosen[:-k]
        near = (keys[k:] == keys[:-k]) & (d <= 3 * t - 1)
        if not near.any():
            break
        hit = near & (2 * d >= 3 * t - 1)
        at.append(chosen[:-k][hit])
        apart.append(d[hit])
        k += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(apart)) if at else (none, none)


def maximal_runs(words, starts, sizes, least: int = 24, power: int = 3):
    """Starts, ends and periods of the runs in an array of word numbers; each text of `sizes` words from `starts` on is followed by a number of its own.

    power: at least 3, on which the guarantee of the scales rests.
    """
    import numpy as np

    if power < 3:
        raise ValueError("the scales guarantee runs of three periods or more")
    found: list[tuple[int, int, int]] = []
    small: list[tuple[int, object, object]] = []
    for q in range(1, min(DIRECT, len(words) - 1) + 1):
        lo, hi = _stretches(words[:-q] == words[q:], FIRST_SCALE - q if 3 * q <= 2 * FIRST_SCALE else max(least, power * q) - q)
        if 3 * q <= 2 * FIRST_SCALE:  # also asked for by the first two scales, whatever their length
            small.append((q, lo, hi + q))
        long = hi + q - lo >= max(least, power * q)
        found += zip(lo[long].tolist(), (hi[long] + q).tolist(), [q] * int(long.sum()), strict=True)
    hashes, t = _mixed(words.view(np.uint64)), 1
    while t < FIRST_SCALE:
        hashes, t = _doubled(hashes, t), t * 2
    place = np.arange(len(words))
    starts, sizes = np.asarray(starts), np.asarray(sizes)
    while True:
        enough = sizes >= power * ((3 * t) // 2)
        if not enough.any():
            break
        if not enough.all():
            edge = np.zeros(len(place) + 1, np.int64)
            np.add.at(edge, starts[enough], 1)
            np.add.at(edge, starts[enough] + sizes[enough] + 1, -1)
            stay = np.cumsum(edge[:-1]) > 0
            hashes, place = hashes[stay[: len(hashes)]], place[stay]
            sizes = sizes[enough]
            starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        contexts = _doubled(hashes, t)
        # regions with a period of up to a third of the scale
        high = [(lo, hi) for q, los, his in small if 3 * q <= t for lo, hi in zip(los.tolist(), his.tolist(), strict=True)] if t <= 2 * FIRST_SCALE else [(lo, hi) for lo, hi, q in found if 3 * q <= t]
        edge = np.zeros(len(words) + 1, np.int64)
        for lo, hi in high:
            if hi - lo >= t:
                edge[lo] += 1
                edge[hi - t + 1] -= 1
        periodic = (np.cumsum(edge[:-1]) > 0)[place]
        at, apart = _proposals(hashes, contexts, periodic, t)
        last, reach = 0, -1
        order = np.lexsort((at, apart))
        for i, d in zip(place[at[order]].tolist(), apart[order].tolist(), strict=True):
            if d == last and i < reach:
                continue
            lo, hi = _extended(words, i, d)
            last, reach = d, hi
            if hi + d - lo >= max(least, power * d):
                found.append((lo, hi + d, d))
        hashes, t = contexts, t * 2
    # a stretch has been found for multiples of its period too: the smallest names it
    best: dict[tuple[int, int], int] = {}
    for lo, hi, q in found:
        if q < best.get((lo, hi), q + 1):
            best[lo, hi] = q
    return sorted((lo, hi, q) for (lo, hi), q in best.items())


def repeated_from(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten, by its id's crc32, with a stretch of them repeated from some place to the end: a check on long periods."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 24, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """docs without the text, with n_words, runs (start, length, period in words; by start, then period) and collapsed: the words, joined by blanks, without
    those that a run holds after its first period.

    change: applied to each document's words and id beforehand.
    """
    kept = [c for c in docs.columns if c != text_col and c not in OUTPUTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, batch_text):
            texts = [(text or "").encode().split() for text in batch.column(batch_text).to_pylist()]  # on bytes: exactly \x20 \x09-\x0D
            if change is not None:
                texts = [change(words, i) for words, i in zip(texts, batch.column(batch_text + 1).to_pylist(), strict=True)]
            sizes = np.array([len(words) for words in texts])
            starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
            numbers: dict[bytes, int] = {}
            numbered = np.full(int(sizes.sum()) + len(texts), -1)
            for n, (start, words) in enumerate(zip(starts.tolist(), texts, strict=True)):
                numbered[start : start + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
                numbered[start + len(words)] = -1 - n
            found: list[list] = [[] for _ in texts]
            every = maximal_runs(numbered, starts, sizes, least)
            owner = np.searchsorted(starts, [lo for lo, _, _ in every], side="right") - 1
            for n, (lo, hi, q) in zip(owner.tolist(), every, strict=True):
                found[n].append((lo - int(starts[n]), hi - lo, q))
            out = [_collapsed(words, runs) for words, runs in zip(texts, found, strict=True)]
            runs = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:batch_text], pa.array(sizes, pa.int64()), runs, pa.array(out, pa.string())], names=[*[f"k_{c}" for c in kept], *OUTPUTS])

    batch_text = len(kept)
    cols = [F.col(f"`{c}`").alias(f"k_{c}") for c in kept]
    held = docs.select(*cols, F.col(f"`{text_col}`").cast("string").alias("t"), *([F.col(f"`{id_col}`").alias("i")] if change is not None else []))
    schema = docs.select(*cols).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return held.mapInArrow(run, schema).select(*[F.col(f"`k_{c}`").alias(c) for c in kept], *OUTPUTS)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """runs by start."""
    kept, at = [], 0
    for start, length, period in sorted((s + q, m - q, q) for s, m, q in runs):
        kept += words[at : max(start, at)]
        at = max(at, start + length)
    return b" ".join(kept + words[at:]).decode()
