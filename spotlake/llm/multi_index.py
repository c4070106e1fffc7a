"""Operator 11: near-duplicate vectors by an inverted multi-index.

Vectors of one label link when their cosine reaches a threshold. Unit vectors are cut into halves; each half has a codebook of its own,
and the pairs of codes form a grid of cells. From a vector's own cell the grid is visited by the multi-sequence traversal: the codes of
each half in the order of the least distance at which a vector can lie behind their border, cells in the order of the sum of both
squares, from a heap. It stops at the radius that reaches the target recall: the quantile, over a sample, of what the traversal needs from a
vector to another one exactly at the threshold, in a random direction, and to the sample's own links. With a target of 1 the radius is the threshold's chord
itself, below which no border can hide a link, and no link is lost. Rows of a visited cell are then verified by exact cosines in
double precision.

Repeated vectors of a label are one node with a count. A pair of cells is visited from one side only, and from a cell's own rows to themselves.
Cells and their visitors of over BLOCK rows are dealt over blocks, each pair of blocks is one matrix product, and what leaves it is one row
per linked vector: its number of links and the smallest vector of its part of the block, so a group of near copies is never expanded into pairs.
Codebooks and radius are fitted on a bounded sample (SAMPLE vectors, those of the smallest hashes); every row is indexed.

Vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing. A shorter vector counts as
ended by zeros. Rows stay one by one, repeated ids included; a null id names no component unless all its ids are null. Other
columns are kept; columns named as the outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.llm.common import attach, cut, stored
from spotlake.llm.components import smallest_reachable

#: Vectors that codebooks and radius are fitted on, rows of a block, and rounds of fitting.
SAMPLE, BLOCK, ROUNDS = 8192, 2048, 12
#: Codes of a half, at least and at most; between them the fourth root of the number of vectors.
FEWEST, MOST = 4, 256
OUTPUTS = ("n_links", "component_id", "kept")


def unit(rows, width: int):
    """Rows of unit length in double precision, ended by zeros; `rows` are lists of numbers."""
    import numpy as np

    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), 1e-320)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _squares(x, codes):
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ codes.T) + (codes * codes).sum(axis=1)[None, :]


def codebook(half, k: int, seed: int):
    """Means of k groups of the rows, by rounds of assignment and averaging; empty groups keep their mean."""
    import numpy as np

    first = np.random.default_rng(seed).permutation(len(half))[:k]
    codes = half[first].copy()
    for _ in range(ROUNDS):
        own = _squares(half, codes).argmin(axis=1)
        sums, counts = np.zeros_like(codes), np.bincount(own, minlength=len(codes))
        np.add.at(sums, own, half)
        held = counts > 0
        codes[held] = sums[held] / counts[held, None]
    return codes


class Grid:
    """Two codebooks and a radius."""

    def __init__(self, sample, k: int, threshold: float, recall: float):
        import numpy as np

        self.at = (sample.shape[1] + 1) // 2
        self.codes = [codebook(sample[:, : self.at], k, 1), codebook(sample[:, self.at :], k, 2)]
        # the distance between two codes, for borders; equal codes have none
        self.apart = [np.sqrt(np.maximum(_squares(c, c), 0)) for c in self.codes]
        self.radius = self._radius(sample, threshold, recall)

    def gaps(self, x):
        """Per half the own codes and, for each code, the squared least distance from a row to where that code is the nearest."""
        import numpy as np

        out = []
        for half, codes, apart in zip((x[:, : self.at], x[:, self.at :]), self.codes, self.apart, strict=True):
            squares = _squares(half, codes)
            own = squares.argmin(axis=1)
            far = np.maximum(squares - squares[np.arange(len(half)), own][:, None], 0)
            gap = np.divide(far, 2 * apart[own], out=np.zeros_like(far), where=apart[own] > 0)
            out.append((own, gap * gap))
        return out

    def needed(self, x, y):
        """The bound up to which the traversal from each row of x has to go to visit the cell of that row of y."""
        import numpy as np

        at = np.arange(len(x))
        return sum(gap[at, own] for (_, gap), (own, _) in zip(self.gaps(x), self.gaps(y), strict=True))

    def _radius(self, sample, threshold: float, recall: float) -> float:
        import numpy as np

        chord = 2 - 2 * threshold
        if recall >= 1 or len(sample) < 2 or sample.shape[1] < 2:
            return chord
        draw = np.random.default_rng(3).standard_normal(sample.shape)
        draw -= (draw * sample).sum(axis=1, keepdims=True) * sample
        draw /= np.maximum(np.sqrt((draw * draw).sum(axis=1, keepdims=True)), 1e-12)
        radius = float(np.quantile(self.needed(sample, threshold * sample + np.sqrt(1 - threshold**2) * draw), recall))
        links: list[list[int]] = [[], []]
        for i in range(0, len(sample), BLOCK):
            a, b = np.nonzero(np.triu(sample[i : i + BLOCK] @ sample.T >= threshold, i + 1))
            links[0] += (a + i)[:SAMPLE].tolist()
            links[1] += b[:SAMPLE].tolist()
        if links[0]:
            radius = max(radius, float(np.quantile(self.needed(sample[links[0]], sample[links[1]]), recall)))
        return min(radius, chord)

    def visits(self, x) -> Iterator[tuple[int, list[int]]]:
        """For each row its own cell, and the cells of higher number that the traversal visits, its own one first."""
        import numpy as np

        (own_a, gap_a), (own_b, gap_b) = self.gaps(x)
        width, radius = len(self.codes[1]), self.radius
        order_a, order_b = gap_a.argsort(axis=1, kind="stable"), gap_b.argsort(axis=1, kind="stable")
        sorted_a, sorted_b = np.take_along_axis(gap_a, order_a, 1), np.take_along_axis(gap_b, order_b, 1)
        for row in range(len(x)):
            cell = int(own_a[row]) * width + int(own_b[row])
            a, b, codes_a, codes_b = sorted_a[row].tolist(), sorted_b[row].tolist(), order_a[row].tolist(), order_b[row].tolist()
            met, heap = [cell], [(a[0] + b[0], 0, 0)]
            while heap:
                bound, i, j = heapq.heappop(heap)
                if bound > radius:
                    break
                other = codes_a[i] * width + codes_b[j]
                if other > cell:
                    met.append(other)
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            yield cell, met


def _parts(linked):
    """Connected parts of a matrix of links between rows and columns: part of each row and of each column, -1 without links."""
    import numpy as np

    row_part, col_part, n = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1), 0
    for start in np.nonzero(linked.any(axis=1))[0]:
        if row_part[start] >= 0:
            continue
        rows = np.array([start])
        while len(rows):
            row_part[rows] = n
            columns = np.nonzero(linked[rows].any(axis=0) & (col_part < 0))[0]
            col_part[columns] = n
            rows = np.nonzero(linked[:, columns].any(axis=1) & (row_part < 0))[0] if len(columns) else columns
        n += 1
    return row_part, col_part, n


def _verify(threshold: float, width: int):
    """Visitors of a cell's block against its members: (node, links, root) of those that link, root being the smallest node of their part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out: list = []
        if left.num_rows and right.num_rows:
            (x, x_node, x_n), (y, y_node, y_n) = ((unit(t.column("v").to_pylist(), width), t.column("node").to_numpy(), t.column("n").to_numpy()) for t in (left, right))
            inside = left.column("cell").to_numpy() == left.column("own").to_numpy()
            linked = (x @ y.T >= threshold) & (x_node[:, None] != y_node[None, :])
            if linked.any():
                x_part, y_part, parts = _parts(linked)
                root = np.full(parts, np.iinfo(np.int64).max)
                np.minimum.at(root, x_part[x_part >= 0], x_node[x_part >= 0])
                np.minimum.at(root, y_part[y_part >= 0], y_node[y_part >= 0])
                # rows of the own cell meet each other from both sides, so only the visitor counts there
                for node, part, links in ((x_node, x_part, linked @ y_n), (y_node, y_part, (x_n * ~inside) @ linked)):
                    hit = part >= 0
                    out.append((node[hit], links[hit], root[part[hit]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"])

    return run


def _index(nodes: DataFrame, grid: Grid, width: int) -> DataFrame:
    """(node, label, v, n) with own cell and visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, met = zip(*grid.visits(unit(batch.column(2).to_pylist(), width)), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(met, pa.list_(pa.int32()))], names=[*batch.schema.names, "own", "visits"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields]).add("own", "integer").add("visits", T.ArrayType(T.IntegerType())))


def links(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, label, v, n: copies) -> (node, links, root): linked nodes, once for each block of a cell in which they link."""
    total, width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return nodes.sparkSession.createDataFrame([], "node long, links long, root long")
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    grid = Grid(unit(drawn, width), min(max(round(total**0.25), FEWEST), MOST), threshold, recall)
    placed = stored(_index(nodes.select("node", "label", "v", "n"), grid, width), "multi-index")
    again = [F.col(c).alias(c) for c in ("label", "node", "v", "n")]  # attributes of their own: both sides come from one table
    members = placed.select(*again, F.col("own").alias("cell"))
    visitors = placed.select("label", F.explode("visits").alias("cell"), "own", "node", "v", "n")
    counts = members.groupBy("label", "cell").agg(F.count("*").alias("m")).join(visitors.groupBy("label", "cell").agg(F.count("*").alias("w")), ["label", "cell"])
    blocks = cut(counts.select("label", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("m"), F.ceil(F.col("w") / BLOCK).cast("int").alias("w")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(f"{own}_part")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_part")
        return rows.join(blocks, ["label", "cell"]).select(*[c for c in rows.columns], part, each)

    key = ["label", "cell", "m_part", "w_part"]
    met = dealt(visitors, "w", "m").groupBy(*key).cogroup(dealt(members, "m", "w").groupBy(*key))
    return met.applyInArrow(_verify(threshold, width), "node long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.999) -> DataFrame:
    """df without the vector, with n_links (other rows linked directly), component_id (smallest id reachable, itself included) and kept (the id is that)."""
    names = [c for c in df.columns if c != vector_col and c not in OUTPUTS]
    v = F.col(f"`{vector_col}`")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    label = F.col(f"`{label_col}`").cast("string")
    key = F.when(label.isNotNull() & F.coalesce(sound, F.lit(False)), F.struct(label.alias("label"), v.alias("v")))
    rows = cut(df.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in names], F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("key")))
    usable = rows.where("key IS NOT NULL")
    nodes = usable.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes.select("node", F.col("key.label").alias("label"), F.col("key.v").alias("v"), "least", "n"), "multi-index-nodes")
    found = cut(links(nodes, threshold, recall))
    rooted = smallest_reachable(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(rooted, "node")
    named = cut(nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # the least id of each component, from partial minima; nodes of a component learn it in a join by root, in which AQE splits a large one
    least = named.where("links IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    alone = named.where("links IS NULL").withColumn("component_id", F.col("least"))
    whole = named.where("links IS NOT NULL").join(least, "root").select(*alone.columns).unionByName(alone)
    told = whole.select(F.struct("label", "v").alias("key"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = attach(usable, cut(told), "key", "n", usable.count())
    rest = rows.where("key IS NULL").select(*rows.columns, F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = done.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in names], *OUTPUTS)
