"""Kernels over blocks of samples: filters, a polyphase channelizer and power spectra.

A kernel needs samples beyond its block, so a block first gets its halo, the head of the block that starts where it ends, by an
equi-join on recording and time; then blocks are independent, and a recording is as many tasks as its blocks allow. The numpy part of each kernel is one array expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.numeric import CHANNEL_HZ


def with_halo(blocks: DataFrame, need: int) -> DataFrame:
    """blocks (input, block, start_ts, re, im) with n (own samples) and re, im lengthened by up to `need` samples of the next block."""
    heads = blocks.select(F.col("input").alias("__input"), F.col("start_ts").alias("__ts"), F.slice("re", 1, need).alias("__re"), F.slice("im", 1, need).alias("__im"))
    sized = blocks.withColumn("n", F.size("re"))
    joined = sized.join(heads, (F.col("input") == F.col("__input")) & (F.col("start_ts") + F.col("n") == F.col("__ts")), "left")
    grown = lambda c: F.when(F.col("__ts").isNotNull(), F.concat(F.col(c), F.col(f"__{c}"))).otherwise(F.col(c))
    return joined.withColumn("re", grown("re")).withColumn("im", grown("im")).drop("__input", "__ts", "__re", "__im")


def prototype(n_channels: int, taps: int = 8, beta: float = 7.857) -> np.ndarray:
    """Windowed-sinc low-pass of taps * n_channels points with unit gain, its edge half a channel from the centre."""
    at = np.arange(taps * n_channels) - (taps * n_channels - 1) / 2
    shape = np.sinc(at / n_channels) * np.kaiser(taps * n_channels, beta)
    return shape / shape.sum()


def channelize(blocks: DataFrame, n_channels: int, taps: int = 8) -> DataFrame:
    """Hops of a weighted-overlap-add filter bank: input, hop, sample_ts, power (array of n_channels); a hop every quarter of n_channels samples.

    Windows of taps * n_channels samples are weighted, folded to n_channels and transformed. Blocks have to start at whole hops.
    """
    size, step = taps * n_channels, n_channels // 4
    window = prototype(n_channels, taps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, times, powers = [], [], []
            for name, start, n, re, im in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                x = np.asarray(re, "f8") + 1j * np.asarray(im, "f8")
                hops = np.arange(0, min(n, len(x) - size + 1), step)
                if len(hops):
                    folded = (x[hops[:, None] + np.arange(size)] * window).reshape(len(hops), taps, n_channels).sum(axis=1)
                    names += [name] * len(hops)
                    times.append(start + hops)
                    powers.append(np.abs(np.fft.fft(folded, axis=1)) ** 2)
            if names:
                at, flat = np.concatenate(times), np.concatenate(powers)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * n_channels, pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(at // step, pa.int64()), pa.array(at, pa.int64()), held], names=["input", "hop", "sample_ts", "power"])

    ready = with_halo(blocks, size - 1).select(F.col("input").cast("string").alias("input"), "start_ts", "n", "re", "im")
    return ready.mapInArrow(run, "input string, hop long, sample_ts long, power array<double>")


def fir(blocks: DataFrame, taps: np.ndarray, every: int = 1) -> DataFrame:
    """blocks through a filter of real or complex taps, one sample in `every` kept: input, block, start_ts (of the output), re, im. Blocks start at multiples of `every`."""
    kernel = np.asarray(taps)[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, parts = [], []
            for start, n, re, im in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x = np.asarray(re, "f8") + 1j * np.asarray(im, "f8")
                starts.append(start // every)
                parts.append(np.convolve(x, kernel, "valid")[:n:every] if len(x) >= len(kernel) else np.zeros(0, complex))
            real, imaginary = (pa.array([getattr(y, side) for y in parts], pa.list_(pa.float64())) for side in ("real", "imag"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), real, imaginary], names=["input", "block", "start_ts", "re", "im"])

    ready = with_halo(blocks, len(kernel) - 1).select(F.col("input").cast("string").alias("input"), F.col("block").cast("long").alias("block"), "start_ts", "n", "re", "im")
    return ready.mapInArrow(run, "input string, block long, start_ts long, re array<double>, im array<double>")


def half_band(taps: int = 127) -> np.ndarray:
    """A low-pass at a quarter of the sample rate, for decimation by two."""
    at = np.arange(taps) - (taps - 1) / 2
    shape = np.sinc(at / 2) * np.kaiser(taps, 8.0)
    return shape / shape.sum()


def decimate(blocks: DataFrame, factor: int, taps: int = 127) -> DataFrame:
    """blocks at a `factor`-th of their rate, a power of two, by as many half-band stages. Blocks have to start at multiples of factor; the last taps - 1 samples of a stretch give none."""
    if factor < 1 or factor & (factor - 1):
        raise ValueError("the factor has to be a power of two")
    while factor > 1:
        blocks, factor = fir(blocks, half_band(taps), 2), factor // 2
    return blocks


def trusted_bandwidth(rate: float, factor: int, taps: int = 127, beta: float = 8.0) -> float:
    """Hz around the centre that decimate() neither dampens nor folds: the output's rate less the last stage's transition, twice half of it on either side."""
    if factor == 1:
        return rate
    attenuation = beta / 0.1102 + 8.7  # of a Kaiser window
    transition = (attenuation - 7.95) / (14.36 * (taps - 1)) * (2 * rate / factor)
    return rate / factor - transition


def analytic(taps: int = 511) -> np.ndarray:
    """Complex taps that pass positive frequencies of a real signal: a delay plus i times a Hilbert filter."""
    at = np.arange(taps) - (taps - 1) // 2
    with np.errstate(divide="ignore"):
        hilbert = np.where(at % 2 != 0, 2 / (np.pi * at), 0.0) * np.hamming(taps)
    return (at == 0).astype(complex) + 1j * hilbert


def power_spectrum(blocks: DataFrame, n_fft: int) -> DataFrame:
    """Welch spectrum: mean over Hann-weighted segments, half overlapped, of the power per bin: input, bin, power."""
    window = np.hanning(n_fft)
    window = window / math.sqrt(float((window**2).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, re, im in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.asarray(re, "f8") + 1j * np.asarray(im, "f8")
                at = np.arange(0, min(n, len(x) - n_fft + 1), n_fft // 2)
                if len(at):
                    total = (np.abs(np.fft.fft(x[at[:, None] + np.arange(n_fft)] * window, axis=1)) ** 2).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n_fft), pa.array(np.arange(n_fft), pa.int64()), pa.array(total), pa.array([len(at)] * n_fft, pa.int64())], names=["input", "bin", "total", "segments"])

    ready = with_halo(blocks, n_fft - 1).select(F.col("input").cast("string").alias("input"), "n", "re", "im")
    parts = ready.mapInArrow(run, "input string, bin long, total double, segments long")
    return parts.groupBy("input", "bin").agg((F.sum("total") / F.sum("segments")).alias("power"))


def spectrum_rate(n_channels: int) -> float:
    """Sample rate at which channels are CHANNEL_HZ apart."""
    return n_channels * CHANNEL_HZ
