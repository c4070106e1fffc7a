"""Operator 5: quality classifier, a generalised additive model with pairwise interactions.

Features are counts and ratios over the whole text. Each is cut into quantile bins; training cycles over the features and
boosts a shallow tree (up to three leaves) on one feature at a time against the log-loss gradient, adding its shrunken
leaves to that feature's lookup table. Afterwards the pairs of features whose two-way split removes most of the residual
gain tables of their own, boosted the same way over coarser bins. A score is the intercept plus one table entry for each
feature and pair, added by array lookups over a whole batch.

Training rows come from the labels that the caller passes: a sample bounded by `most_rows` (about 20,000 by default), taken by a
hash of the id, so it is the same in every run. Only the sample's ids are broadcast and only its features reach the driver.

Null text counts as empty; an empty text has a score like any other. Rows and ids are kept one by one; other columns are
kept, those named as the outputs are replaced. Without a label of each class the score is the share of label 1 (0.5
without labels). An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.llm.common import cut, shielded, slices, unshielded

FEATURES = (
    "log_words", "mean_word", "long_words", "symbols", "digits", "upper", "exclaims", "pipes", "commas", "stops",
    "distinct_words", "top_word", "same_as_last", "distinct_lines", "words_a_line", "bad_ends", "capital_words", "long_lines",
)
_SYMBOLS = re.compile(rb"[#*$%&|<>{}\[\]\\^~=_+@/]")
_DIGITS = re.compile(rb"[0-9]")
_UPPER = re.compile(rb"[A-Z]")
BINS, PAIR_BINS, PAIRS = 24, 8, 6


def text_features(text: str) -> list[float]:
    """Values in the order of FEATURES; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    chars = len(raw)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    sample = "".join(words)
    return [
        math.log1p(n),
        len(sample) / n,
        sum(c for w, c in counts.items() if len(w) > 12) / n,
        len(_SYMBOLS.findall(raw)) / chars,
        len(_DIGITS.findall(raw)) / chars,
        len(_UPPER.findall(raw)) / chars,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        raw.count(b",") / n,
        (raw.count(b". ") + raw.count(b".\n")) / n,
        len(counts) / math.sqrt(n),
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / len(lines),
        min(n / len(lines), 1000.0),
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\"") / n,
        sum(c for w, c in counts.items() if w[0].isupper()) / n,
        max(map(len, lines)) / len(sample),
    ]


def with_features(docs: DataFrame, text_col: str = "text", out_col: str = "__features") -> DataFrame:
    """docs without the text, with out_col (array<double>)."""
    kept = [c for c in docs.columns if c not in (text_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(kept)):
            values = [text_features(text or "") for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))], names=[*kept, out_col])

    cols = [F.col(f"`{c}`") for c in kept]
    schema = docs.select(*cols).schema.add(out_col, T.ArrayType(T.DoubleType()))
    return docs.select(*cols, F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)


@dataclass
class Model:
    """Edges of the bins, an additive table for each feature, and (i, j, table) for each pair, over coarser edges."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaves(gradient: np.ndarray, hessian: np.ndarray, leaves: int = 3, smooth: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins, from sums per bin: the value of each bin's leaf, by best-first splits."""
    parts = [(0, len(gradient))]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + smooth)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (a, b), a + 1 + k)
        if best[1] is None:
            break
        (a, b), at = best[1], best[2]
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smooth)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15) -> Model:
    """Cyclic boosting of the feature tables, then of the pair tables on what is left."""
    if not len(y):
        return Model()
    share = float(y.mean())
    if not 0 < share < 1:
        return Model(intercept=math.log((share + 1e-3) / (1 - share + 1e-3)))
    n_features = x.shape[1]
    model = Model(math.log(share / (1 - share)), [_edges(x[:, i], BINS) for i in range(n_features)], [_edges(x[:, i], PAIR_BINS) for i in range(n_features)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.coarse)]
    logits = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logits))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, bins in enumerate(fine):
            gradient, hessian = slopes()
            size = len(model.tables[i])
            step = rate * _leaves(np.bincount(bins, gradient, size), np.bincount(bins, hessian, size))
            model.tables[i] += step
            logits += step[bins]
    gradient, hessian = slopes()
    gains = []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
            cell = rough[i] * shape[1] + rough[j]
            g, h = np.bincount(cell, gradient, shape[0] * shape[1]), np.bincount(cell, hessian, shape[0] * shape[1])
            gains.append((float((g**2 / (h + 1)).sum()), i, j, shape, cell))
    chosen = sorted(gains, key=lambda v: (-v[0], v[1], v[2]))[:PAIRS]
    model.pairs = [(i, j, np.zeros(shape)) for _, i, j, shape, _ in chosen]
    for _ in range(rounds // 4):
        for (i, j, table), (_, _, _, shape, cell) in zip(model.pairs, chosen, strict=True):
            gradient, hessian = slopes()
            g = np.bincount(cell, gradient, shape[0] * shape[1]).reshape(shape)
            h = np.bincount(cell, hessian, shape[0] * shape[1]).reshape(shape)
            rows = _leaves(g.sum(axis=1), h.sum(axis=1), 2)
            step = np.zeros(shape)
            for value in np.unique(rows):  # one split along i, then one along j on either side
                side = rows == value
                step[side] = rate * _leaves(g[side].sum(axis=0), h[side].sum(axis=0), 2)
            table += step
            logits += step.ravel()[cell]
    return model


def label_sample(labels: DataFrame, id_col: str, label_col: str, most_rows: int) -> DataFrame:
    """(__id, __label) of about most_rows labelled ids: those whose hash lies below a bound that the number of labels sets. All, if fewer."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__label"))
    one = cut(one)
    n, parts = one.count(), 1 << 40
    return one if n <= most_rows else one.where(F.pmod(F.xxhash64("__id"), F.lit(parts)) < max(1, parts * most_rows // n))


def training_rows(features: DataFrame, sample: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in the order of id and label, on the driver."""
    met = features.select(F.col(f"`{id_col}`").alias("__doc"), F.col("__features").alias("features")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    rows = met.groupBy("__id").agg(F.min("features").alias("features"), F.max("__label").alias("__label")).toPandas()  # a row for each of about most_rows ids, however often one is repeated
    if rows.empty:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x, y = np.stack(rows["features"].to_numpy()), rows["__label"].to_numpy(float)
    order = np.lexsort((*x.T, y, rows["__id"].to_numpy()))
    return x[order], y[order]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", least: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """docs without the text, with score (double) and predicted (int: 1 if score >= least). labels: the rows to learn from."""
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    features = cut(with_features(shielded(docs, kept, id=id_col, text=text_col), "text"))
    model = fit(*training_rows(features, label_sample(labels, id_col, label_col, most_rows), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            scores = model.scores(flat.reshape(batch.num_rows, len(FEATURES)))
            arrays = [*batch.columns[:-1], pa.array(scores), pa.array((scores >= least).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "score", "predicted"])

    cols = [F.col(f"`k_{c}`") for c in kept]
    schema = features.select(*cols).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return unshielded(features.select(*cols, "__features").mapInArrow(run, schema), kept, "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", least: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with the same columns. The sample is drawn from the labels, so that only its texts are read twice."""
    sample = label_sample(labels, id_col, label_col, most_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(sample.select(F.col("__id").alias("id"))), "id", "left_semi")  # about most_rows ids
    model = fit(*training_rows(with_features(texts, "text"), sample, "id"))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            values = np.array([text_features(text or "") for text in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.scores(values) >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 0 by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
