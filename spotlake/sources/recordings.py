"""Sample recordings as a Spark data source: WAV, raw and described recordings, a task for each range of bytes.

spark.dataSource.register(IqSource), then spark.read.format("iq").load(path), or read_recordings(). A file's kind is told by what lies beside it (metadata of a described
recording), by the option `format` (cf32 or ci16: raw), or else it is a WAV. Headers and metadata are read once, on the driver; samples are read by tasks, each
its own range, in blocks that end where a gap is. A block's start_ts counts the samples lost in gaps too, so it is a clock; the first block after a gap says how
many were lost before it. Nothing is dropped in silence: a header that can't be read, metadata that is torn or contradicts the file, and half frames raise errors.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "input string, start_ts bigint, lost bigint, ends boolean, rate double, center double, re array<float>, im array<float>"
#: Bytes of a frame of two samples, and what full scale is, by kind.
FRAMES = {"cf32": (8, None), "ci16": (4, 2.0**15), "f32": (8, None), "i16": (4, 2.0**15), "i24": (6, 2.0**23), "i32": (8, 2.0**31)}
METADATA, UNFINISHED = ".meta.jsonl", ".meta.jsonl.partial"
#: Ending of the schema name and the sample format of a described recording, and the highest rate taken.
DESCRIBED, SAMPLES, FASTEST = "iq.v1", "cf32_le", 10_000_000.0


@dataclass
class Recording:
    path: str
    kind: str
    offset: int
    frames: int
    rate: float
    center: float
    #: Stored frames before each gap, and samples lost in it.
    gaps: tuple[tuple[int, int], ...] = ()


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _read(fs: pafs.FileSystem, path: str, start: int = 0, size: int | None = None) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - start if size is None else max(min(size, f.size() - start), 0), start)


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


def wav_layout(head) -> tuple[str, int, int, float]:
    """head(start, size) of a WAV file -> kind, offset and bytes of its samples, and rate. Chunks are found by their sizes, so only headers are read."""
    if head(0, 4) != b"RIFF" or head(8, 4) != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, None, 0.0
    while len(chunk := head(at, 8)) == 8:
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            form, channels, rate, _, align, bits = struct.unpack("<HHIIHH", head(at + 8, 16))
            if form == 0xFFFE:  # extensible: the form is the first two bytes of the sub-format
                form = struct.unpack("<H", head(at + 8 + 24, 2))[0]
            kind = {(3, 32): "f32", (1, 16): "i16", (1, 24): "i24", (1, 32): "i32"}.get((form, bits))
            if channels != 2:
                raise ValueError(f"two channels are needed, not {channels}")
            if kind is None or align != FRAMES[kind][0]:
                raise ValueError(f"samples of form {form} and {bits} bits can't be read")
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            if not 0 < rate <= FASTEST:
                raise ValueError(f"a rate of {rate} Hz")
            if size % FRAMES[kind][0]:
                raise ValueError("half a frame at the end")
            return kind, at + 8, size, float(rate)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def described(lines: Iterator[str]) -> tuple[dict, int, tuple[tuple[int, int], ...]]:
    """The header, number of stored frames and gaps of a described recording's metadata; raises on what is torn or out of order."""
    header, gaps, frames = None, [], None
    for n, line in enumerate(lines, 1):
        record = json.loads(line)
        kind = record.get("type")
        if frames is not None:
            raise ValueError(f"line {n}: a record after the end")
        if kind == "header":
            if header is not None or n > 1:
                raise ValueError(f"line {n}: a second header")
            if not str(record["schema"]).endswith(DESCRIBED) or record["sample_format"] != SAMPLES:
                raise ValueError(f"schema {record['schema']}, samples {record['sample_format']}")
            if not 0 < record["sample_rate_hz"] <= FASTEST:
                raise ValueError(f"a rate of {record['sample_rate_hz']} Hz")
            header = record
        elif header is None:
            raise ValueError("the first record is no header")
        elif kind == "gap":
            if gaps and record["before_sample"] <= gaps[-1][0]:
                raise ValueError(f"line {n}: gaps out of order")
            gaps.append((record["before_sample"], record["missing_samples"]))
        elif kind == "end":
            frames = record["sample_count"]
        else:
            raise ValueError(f"line {n}: a record of type {kind}")
    if frames is None:
        raise ValueError("no end")
    if gaps and gaps[-1][0] > frames:
        raise ValueError("a gap after the end")
    return header, frames, tuple(gaps)


def opened(path: str, options: dict[str, str]) -> Recording:
    """A recording by what lies beside it, its options or its header."""
    fs, name = _files(path)
    size = fs.get_file_info(name).size
    center = float(options["center"]) if "center" in options else None
    rate, kind = float(options["rate"]) if "rate" in options else None, options.get("format")
    if _exists(fs, name + METADATA):
        if kind not in (None, "cf32"):
            raise ValueError(f"{path}: described as cf32, asked for as {kind}")
        header, frames, gaps = described(iter(_read(fs, name + METADATA).decode().splitlines()))
        if rate not in (None, header["sample_rate_hz"]):
            raise ValueError(f"{path}: described at {header['sample_rate_hz']} Hz, asked for at {rate} Hz")
        if frames * 8 != size:
            raise ValueError(f"{path}: {size} bytes, described as {frames} frames")
        return Recording(path, "cf32", 0, frames, header["sample_rate_hz"], header["center_freq_hz"] if center is None else center, gaps)
    if _exists(fs, name + UNFINISHED):
        raise ValueError(f"{path}: the recording was not finished")
    if kind is not None:
        if rate is None or center is None:
            raise ValueError(f"{path}: raw samples need a rate and a centre")
        if size % FRAMES[kind][0]:
            raise ValueError(f"{path}: half a frame at the end")
        return Recording(path, kind, 0, size // FRAMES[kind][0], rate, center)
    if rate is not None:
        raise ValueError(f"{path}: a WAV says its own rate")
    kind, offset, held, rate = wav_layout(lambda start, n: _read(fs, name, start, n))
    if offset + held > size:
        raise ValueError(f"{path}: cut off after {size} bytes")
    side = name.rsplit(".", 1)[0] + ".json"
    if center is None:
        center = float(json.loads(_read(fs, side))["center_freq_hz"]) if _exists(fs, side) else 0.0
    return Recording(path, kind, offset, held // FRAMES[kind][0], rate, center)


def samples(raw: bytes, kind: str):
    """The two channels as 32-bit floats of full scale one."""
    import numpy as np

    scale = FRAMES[kind][1]
    if kind == "i24":
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = (parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8
    else:
        flat = np.frombuffer(raw, {"cf32": "<f4", "f32": "<f4", "ci16": "<i2", "i16": "<i2", "i32": "<i4"}[kind])
    flat = flat.astype(np.float32) if scale is None else (flat / scale).astype(np.float32)
    return flat[0::2], flat[1::2]


@dataclass
class Range(InputPartition):
    """Frames first to last (exclusive) of a recording."""

    recording: Recording
    first: int
    last: int


class IqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.block, self.share = int(options.get("block", 65536)), int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))

    def partitions(self) -> list[Range]:
        out = []
        for path in _listed(self.options["path"]):
            recording = opened(path, self.options)
            step = max(self.share // FRAMES[recording.kind][0] // self.block, 1) * self.block
            out += [Range(recording, i, min(i + step, recording.frames)) for i in range(0, recording.frames, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Blocks start at multiples of the block size and after gaps."""
        r = part.recording
        (fs, name), width = _files(r.path), FRAMES[r.kind][0]
        places, lost = [g[0] for g in r.gaps], [g[1] for g in r.gaps]
        floats = pa.list_(pa.float32())
        with fs.open_input_file(name) as f:
            at = part.first
            while at < part.last:
                n = bisect_right(places, at)
                stop = min((at // self.block + 1) * self.block, part.last, places[n] if n < len(places) else part.last)
                re, im = samples(f.read_at((stop - at) * width, r.offset + at * width), r.kind)
                before = lost[n - 1] if n and places[n - 1] == at else 0
                row = [[r.path], [at + sum(lost[:n])], [before], [stop == r.frames], [r.rate], [r.center]]
                types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()]
                arrays = [pa.array(v, t) for v, t in zip(row, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([re], floats), pa.array([im], floats)], names=["input", "start_ts", "lost", "ends", "rate", "center", "re", "im"])
                at = stop


def _listed(path: str) -> list[str]:
    """Recordings of a path: itself, or in a folder all but what describes others."""
    fs, name = _files(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(name)) if i.type == pafs.FileType.File)
    return [p for p in found if not p.endswith((".jsonl", ".partial", ".json")) and not p.rsplit("/", 1)[-1].startswith((".", "_"))]


class IqSource(DataSource):
    """Options: format (cf32, ci16: raw samples), rate and center (Hz), block (frames), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IqReader:
        return IqReader(dict(self.options))


def read_recordings(spark: SparkSession, path: str, **options) -> DataFrame:
    """Blocks of the recordings at a path: SCHEMA."""
    spark.dataSource.register(IqSource)
    reader = spark.read.format("iq")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
