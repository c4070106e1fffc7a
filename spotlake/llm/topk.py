"""Operator 8: exact top-k search by distributed histogram selection.

Each pass scores everything and counts all scores of a query's range into a global histogram of that query; the histogram says in
which bin the kth highest score lies, and the next pass splits that bin alone, until a bin is one score: the kth value itself. A last
pass keeps scores at or above it, and ties at the kth value go to the smallest ids. A block of candidates sends its histogram from
the top down to the bin in which its own count reaches k, since no lower bin can hold the kth value; likewise at most k ties.

Queries are a stated subset of the rows, in blocks against all rows in blocks: candidates are dealt over salts and sent once
per query block, queries once per salt, and each (query block, salt) is one matrix product of bounded size. Nothing is
broadcast or collected. The ranges found by a pass are written to the shared folder.

Scores are exact: products that 64-bit floats could round are taken in integers, those beyond 64 bits in Python's, and what a long can't
hold is the largest or smallest long. Components beyond a long are clipped likewise. A vector shorter than another counts as ended by
zeros. Vectors that are null or hold null or non-finite components take no part, as a query or as a candidate; neither does a null id.
A query is left out of its own candidates as a row: other rows of the same id take part. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import cut

#: Bits by which a pass narrows a range; vectors in a block of queries and of candidates, about.
PASS_BITS, QUERIES, CANDIDATES = 8, 1024, 8192
#: Integers up to which 64-bit floats are exact, and the ends of a long.
EXACT, LEAST, MOST = 2**53, -(2**63), 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v: array<long>) with floor(scale * x) for each component, without vectors that take no part."""
    v = F.col(f"`{vector_col}`")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x: Column) -> Column:
        y = F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(9.2e18)), F.lit(-9.2e18)))
        return y.cast("long")

    return df.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, whole).alias("v"))


def _matrix(table: pa.Table, width: int):
    """The vectors as rows of 64-bit integers, ended by zeros."""
    import numpy as np

    v = table.column("v").combine_chunks()
    flat, sizes = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((table.num_rows, width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(q, c):
    """All inner products of the rows of two integer matrices as longs, exact; those beyond a long are clipped."""
    import numpy as np

    def longest(m):
        return np.maximum(m.max(axis=1, initial=0).astype(float), -m.min(axis=1, initial=0).astype(float))

    width, q_most, c_most = max(q.shape[1], 1), longest(q), longest(c)
    small = math.sqrt(EXACT / width) - 1
    out = np.empty((len(q), len(c)), np.int64)
    q_small, c_small = np.nonzero(q_most <= small)[0], np.nonzero(c_most <= small)[0]
    out[np.ix_(q_small, c_small)] = (q[q_small].astype(float) @ c[c_small].astype(float).T).astype(np.int64)

    def slowly(rows, columns):
        if not len(rows) or not len(columns):
            return
        if q_most[rows].max() * c_most[columns].max() * width < 2.0**62:
            out[np.ix_(rows, columns)] = q[rows] @ c[columns].T
        else:
            exact = q[rows].astype(object) @ c[columns].astype(object).T
            out[np.ix_(rows, columns)] = np.vectorize(lambda x: min(max(int(x), LEAST), MOST), otypes=[np.int64])(exact)

    q_large, c_large = np.nonzero(q_most > small)[0], np.nonzero(c_most > small)[0]
    slowly(q_large, np.arange(len(c)))
    slowly(q_small, c_large)
    return out


def _scored(queries: pa.Table, candidates: pa.Table):
    """Keys, ids and lows of the queries, keys and ids of the candidates, and all scores."""
    width = max(int(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (queries, candidates))
    key, q_id, low = (queries.column(n).to_numpy() for n in ("key", "id", "low"))
    c_key, c_id = (candidates.column(n).to_numpy() for n in ("key", "id"))
    return key, q_id, low, c_key, c_id, products(_matrix(queries, width), _matrix(candidates, width))


def _histogram(k: int, shift: int, top: int):
    """Per query the counts by bin of all its scores at or above its low, down to where they reach k; bin `top` holds what is above the range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out: list[list[int]] = [[], [], []]
        if left.num_rows and right.num_rows:
            key, _, low, c_key, _, scores = _scored(left, right)
            for i in range(len(key)):
                mine = scores[i][(scores[i] >= low[i]) & (c_key != key[i])]
                # differences are taken unsigned: a range may be as wide as all longs
                above = (mine.view(np.uint64) - np.int64(low[i]).view(np.uint64)) >> np.uint64(shift)
                counts = np.bincount(np.minimum(above, np.uint64(top)).astype(np.int64), minlength=top + 1)
                from_top = np.cumsum(counts[::-1])[::-1]
                bins = np.nonzero((counts > 0) & (from_top - counts < k))[0]
                out[0] += [int(key[i])] * len(bins)
                out[1] += bins.tolist()
                out[2] += counts[bins].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["key", "bin", "n"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(id, v) -> query_id, rank (int, from 1), vec_id, score: the k best other rows of each row for which is_query holds."""
    vectors = cut(vectors.withColumn("key", F.monotonically_increasing_id()))
    queries = vectors.where(is_query)
    size = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    n_c, high, wide = vectors.agg(F.count("*"), size, F.max(F.size("v"))).first()
    n_q = queries.count()
    if not n_c or not n_q:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = min(max(wide, 1) * high * high, MOST)
    kind = "array<int>" if high < 2**31 else "array<long>"
    salts, groups = math.ceil(n_c / CANDIDATES), math.ceil(n_q / QUERIES)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    again = [F.col(c).alias(c) for c in ("key", "id")]
    v = F.col("v").cast(kind).alias("v")
    right = vectors.select(F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"), *again, v).withColumn("g", spread(groups)).groupBy("g", "salt")
    asked = queries.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("g"), *again, v)

    def against(lows: DataFrame, run, schema: str) -> DataFrame:
        left = asked.join(lows, "key").withColumn("salt", spread(salts)).groupBy("g", "salt")
        return left.cogroup(right).applyInArrow(run, schema)

    lows = asked.select("key", F.lit(max(-bound, LEAST)).cast("long").alias("low"))
    bits = max(1, (2 * bound + 1).bit_length())
    while bits > 0:
        step = min(PASS_BITS, bits)
        bits -= step
        shift = bits
        bins = against(lows, _histogram(k, shift, 1 << step), "key long, bin long, n long").groupBy("key", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("bin")))
        found = bins.withColumn("above", above).where(F.col("above") >= k).groupBy("key").agg(F.max("bin").alias("bin"))
        wide_sum = F.col("low").cast("decimal(38,0)") + F.col("bin").cast("decimal(38,0)") * F.lit(Decimal(2**shift))
        moved = F.coalesce(wide_sum.cast("long"), F.col("low"))
        lows = cut(lows.join(found, "key", "left").select("key", moved.alias("low")))  # fewer than k scores: the range stays, all are kept

    def winners(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out: list[list[int]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            key, q_id, low, c_key, c_id, scores = _scored(left, right)
            for i in range(len(key)):
                hit = np.nonzero((scores[i] >= low[i]) & (c_key != key[i]))[0]
                hit = hit[np.lexsort((c_id[hit], ~scores[i][hit]))][:k]  # ~x falls as x rises, for every long
                out[0] += [int(key[i])] * len(hit)
                out[1] += [int(q_id[i])] * len(hit)
                out[2] += c_id[hit].tolist()
                out[3] += scores[i][hit].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["key", "query_id", "vec_id", "score"])

    hits = against(lows, winners, "key long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
