"""Recordings by ranges of bytes: every kind, gaps, and what must not be read."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from spotlake.operators import signal
from spotlake.sources import recordings


def noise(n, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.integers(-(2**15), 2**15, n) / 2**15 * 0.99).astype("f4") + 1j * (rng.integers(-(2**15), 2**15, n) / 2**15 * 0.99).astype("f4")


def interleaved(x, kind):
    flat = np.empty(2 * len(x))
    flat[0::2], flat[1::2] = x.real, x.imag
    if kind in ("cf32", "f32"):
        return flat.astype("<f4").tobytes()
    bits = {"ci16": 16, "i16": 16, "i24": 24, "i32": 32}[kind]
    whole = np.round(flat * 2 ** (bits - 1)).astype(np.int64)
    return b"".join(int(v).to_bytes(4, "little", signed=True)[: bits // 8] for v in whole)


def wav(x, kind, rate=96_000, channels=2, extensible=False, extra=b""):
    bits, form = {"f32": (32, 3), "i16": (16, 1), "i24": (24, 1), "i32": (32, 1)}[kind]
    body = interleaved(x, kind)
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else form, channels, rate, rate * bits // 4, bits // 4, bits)
    if extensible:
        fmt += struct.pack("<HHIH14s", 22, bits, 3, form, b"\0" * 14)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def whole(df):
    rows = sorted(df.collect(), key=lambda r: r.start_ts)
    return rows, np.concatenate([np.array(r.re) + 1j * np.array(r.im) for r in rows])


@pytest.mark.parametrize("kind", ["f32", "i16", "i24", "i32"])
def test_wav_files(spark, tmp_path, kind):
    x = noise(1000)
    path = tmp_path / "a.wav"
    path.write_bytes(wav(x, kind, extensible=kind == "i24", extra=b"LIST\x03\0\0\0abc\0"))
    (tmp_path / "a.json").write_text(json.dumps({"center_freq_hz": 7_020_000.0}))
    df = recordings.read_recordings(spark, str(path), block=64, partitionBytes=1024)
    assert df.rdd.getNumPartitions() >= 4  # one file is many tasks
    rows, got = whole(df)
    assert np.abs(got - x).max() < 5e-5 if kind == "i16" else np.allclose(got, x, atol=1e-6)
    assert {(r.rate, r.center, r.lost) for r in rows} == {(96_000.0, 7_020_000.0, 0)} and [r.ends for r in rows] == [False] * (len(rows) - 1) + [True]
    assert [r.start_ts for r in rows] == list(range(0, 1000, 64))
    assert {r.center for r in recordings.read_recordings(spark, f"file://{path}", center=5.0).collect()} == {5.0}


@pytest.mark.parametrize("kind", ["cf32", "ci16"])
def test_raw_files(spark, tmp_path, kind):
    x = noise(500)
    (tmp_path / "x.iq").write_bytes(interleaved(x, kind))
    rows, got = whole(recordings.read_recordings(spark, str(tmp_path / "x.iq"), format=kind, rate=48_000, center=1e6, block=100))
    assert np.allclose(got, x, atol=2e-5) and len(rows) == 5 and rows[0].rate == 48_000


def describe(path, x, gaps, **changes):
    path.write_bytes(interleaved(x, "cf32"))
    header = {"type": "header", "schema": "example-iq.v1", "sample_format": "cf32_le", "sample_rate_hz": 96_000.0, "center_freq_hz": 14_050_000.0, "start_unix_seconds": 0, "start_nanoseconds": 0}
    lines = [header, *[{"type": "gap", "before_sample": b, "missing_samples": m} for b, m in gaps], {"type": "end", "sample_count": len(x), "reason": "eof"}]
    lines[0] |= changes
    path.with_name(path.name + ".meta.jsonl").write_text("".join(json.dumps(line) + "\n" for line in lines))
    return lines


def test_described_recordings_with_gaps(spark, tmp_path):
    x = noise(640)
    describe(tmp_path / "r.cf32", x, [(0, 7), (100, 1000), (128, 0), (300, 50), (640, 9)])
    rows, got = whole(recordings.read_recordings(spark, str(tmp_path / "r.cf32"), block=64, partitionBytes=1600))
    assert np.array_equal(got, x.astype("c8"))
    # a block never spans a gap, and the clock counts what was lost
    clock = [(r.start_ts, len(r.re), r.lost) for r in rows]
    assert clock[:4] == [(7, 64, 7), (71, 36, 0), (1107, 28, 1000), (1135, 64, 0)] and (1357, 20, 50) in clock
    assert sum(n for _, n, _ in clock) == 640 and [lost for _, _, lost in clock if lost] == [7, 1000, 50]
    # frames are not made across a gap: blocks meet by their clock
    hops = signal.channelize(recordings.read_recordings(spark, str(tmp_path / "r.cf32"), block=64).select("input", "start_ts", "start_ts", "re", "im").toDF("input", "block", "start_ts", "re", "im"), 16, 2)
    assert all(not (h.sample_ts < 107 < h.sample_ts + 32) for h in hops.collect())


def test_a_folder_of_kinds(spark, tmp_path):
    describe(tmp_path / "a.cf32", noise(100), [])
    (tmp_path / "b.wav").write_bytes(wav(noise(50), "i16"))
    (tmp_path / "_c").write_bytes(b"x")
    got = recordings.read_recordings(spark, str(tmp_path)).groupBy("input").count().collect()
    assert sorted(r.input.rsplit("/", 1)[-1] for r in got) == ["a.cf32", "b.wav"]


@pytest.mark.parametrize("options", [{"format": "cf32"}, {"rate": 5}, {"format": "ci16", "rate": 48_000, "center": 0}, {}])
def test_options_that_contradict(tmp_path, options):
    (tmp_path / "x").write_bytes(b"123456789012345")
    with pytest.raises(ValueError):
        recordings.opened(str(tmp_path / "x"), {k: str(v) for k, v in options.items()})


def test_broken_recordings(tmp_path):
    x, path = noise(20), tmp_path / "r.cf32"
    lines = describe(path, x, [(5, 1)])
    assert recordings.opened(str(path), {}).gaps == ((5, 1),)
    meta = tmp_path / "r.cf32.meta.jsonl"
    header, gap, end = lines
    for bad in ([header], [gap, end], [header, header, end], [header, gap, gap, end], [header, end, gap], [{**header, "schema": "v9"}, end], [{**header, "sample_rate_hz": 0}, end], [header, {**gap, "before_sample": 99}, end], [header, {**end, "sample_count": 19}], [header, {"type": "x"}, end]):
        meta.write_text("".join(json.dumps(line) + "\n" for line in bad))
        with pytest.raises(ValueError):
            recordings.opened(str(path), {})
    meta.write_text(json.dumps(header) + "\n{torn")
    with pytest.raises(ValueError):
        recordings.opened(str(path), {})
    meta.rename(tmp_path / "r.cf32.meta.jsonl.partial")
    with pytest.raises(ValueError, match="not finished"):
        recordings.opened(str(path), {})
    for raw in (wav(x, "i16", channels=1), wav(x, "i16")[:60], wav(x, "i16", rate=0), wav(x, "i16")[:-2], b"RIFF", b"RIFF\0\0\0\0WAVEdata\x04\0\0\0abcd"):
        (tmp_path / "w.wav").write_bytes(raw)
        with pytest.raises((ValueError, struct.error)):
            recordings.opened(str(tmp_path / "w.wav"), {})
