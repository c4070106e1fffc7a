"""Operator 7: byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

Each byte is one private character, each rank one piece with score -rank, and normalisation is the identity, so that
sentencepiece's best-score-first merging is the rank-first merging of the vocabulary. Pre-tokens are encoded one by one;
ids decode through the inverse table of pieces.

Where the pattern allows it (its pre-tokens never cross a blank or a newline, as tried on a few texts) the parts of a text between
blanks are encoded once each and kept in a cache of bounded bytes; otherwise each text is encoded whole. Batches are taken in slices
of a few megabytes, so memory doesn't grow with the length or number of texts; a single text is held whole.

Null or empty text: no ids, n_tokens 0, empty bytes. Rows and all other columns are kept, repeated rows included; columns
named as the outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.chunks import ChunkEncoder, parts_alone
from spotlake.llm.common import shielded, slices, unshielded

#: Where the 256 byte characters start; no character there is special to sentencepiece.
FIRST_CHAR = 0x4E00
_TO_CHARS = {b: chr(FIRST_CHAR + b) for b in range(256)}
NORMAL, UNKNOWN, BPE = 1, 2, 2


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary in order of rank; ranks have to be 0, 1, 2, ... without gaps."""
    with open(path, "rb") as file:
        found = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, file)}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks have gaps")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces by rank, then the unknown piece that sentencepiece insists on."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    pieces = b"".join(piece(as_chars(raw), -float(rank), NORMAL) for rank, raw in enumerate(vocabulary))
    trainer = _field(3, BPE) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + piece("<unk>", 0.0, UNKNOWN) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes strings to little-endian 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(path)
        self.rank_of = {raw: struct.pack("<I", rank) for rank, raw in enumerate(self.vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.vocabulary))
        self.pre_tokens = regex.compile(pattern).findall
        self.text_ids = ChunkEncoder(self.encode_part) if parts_alone(self.pre_tokens) else self.encode_part

    def encode_part(self, part: str) -> bytes:
        out = []
        for token in self.pre_tokens(part):
            raw = token.encode()
            known = self.rank_of.get(raw)
            if known is None:
                ids = self.model.encode(as_chars(raw))
                known = struct.pack(f"<{len(ids)}I", *ids)
            out.append(known)
        return b"".join(out)


    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, by the inverse table."""
        import numpy as np

        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def _engine(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """df without its text, with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers).

    decoded_col: a further column (binary) with the ids decoded again, in the same pass and by the same worker.
    """
    added = ["n_tokens", "ids", *([decoded_col] if decoded_col else [])]
    kept = [c for c in df.columns if c not in (text_col, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks_path, pattern)
        for batch in slices(batches, len(kept)):
            ids = [engine.text_ids(text or "") for text in batch.column(len(kept)).to_pylist()]
            arrays = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded_col:
                arrays.append(pa.array([engine.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *added])

    told = shielded(df, kept, text=text_col).withColumn("text", F.col("text").cast("string"))
    schema = told.drop("text").schema
    for name in added:
        schema = schema.add(name, "long" if name == "n_tokens" else "binary")
    return unshielded(told.mapInArrow(run, schema), kept, *added)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col (binary): the bytes that ids_col stands for, and ids_col kept. Null ids: empty bytes."""
    kept = [c for c in df.columns if c not in (ids_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        piece = _vocabulary(ranks_path).__getitem__
        for batch in slices(batches, len(kept)):
            ids = batch.column(len(kept))
            raw = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(raw, pa.binary())], names=[*kept, ids_col, out_col])

    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`")).schema.add(out_col, "binary")
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`")).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> list[bytes]:
    return read_ranks(path)
