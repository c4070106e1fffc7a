"""Edit distances of texts, a row of the table at a time as whole numbers of a bit a column (by Myers and Hyyro)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F


def rows(a: str, b: str) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For each character of a, by bits for the characters of b: which equal it; where the cell equals that up and left of it; where it is one more than that above; one more, and one less, than that to its left; all bits."""
    import numpy as np

    codes, full = np.frombuffer(b.encode("utf-32-le"), np.uint32), (1 << len(b)) - 1
    equals = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    up, down = full, 0
    for c in a:
        equal = equals[c]
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        more = down | ((same | up) ^ full)
        less = (same & up) << 1
        above = (more << 1 | 1) & full
        up, down = (less & full) | ((same | above) ^ full), above & same
        yield equal, same, more, up, down, full


def distance(a: str, b: str) -> int:
    """Least number of characters inserted, deleted or replaced."""
    short, long = sorted((a, b), key=len)
    at = 0
    for c in short:
        at = long.find(c, at) + 1
        if not at:
            break
    else:  # all of the short one stands in the long one in order
        return len(long) - len(short)
    up, down = (1 << len(long)) - 1, 0
    for _, _, _, up, down, _ in rows(short, long):
        pass
    return len(short) + up.bit_count() - down.bit_count()


def edit_distance(a, b):
    """distance() of two columns, in Arrow batches; null if either is."""

    @F.arrow_udf("int")
    def told(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return told(a, b)
