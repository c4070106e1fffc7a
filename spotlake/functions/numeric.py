"""Column functions on powers, frequencies, speeds and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel spacing and hop rate (Hz), dB from a channel to 2500 Hz and from there to 500 Hz.
CHANNEL_HZ, HOP_HZ, TO_2500_DB, TO_500_DB = 93.75, 375.0, -14.3, 6.9897
#: Amateur bands as (low Hz, high Hz, label), both ends inside.
BANDS = (
    (135_700, 137_800, "2200m"), (472_000, 479_000, "630m"), (1_800_000, 2_000_000, "160m"), (3_500_000, 4_000_000, "80m"), (5_330_000, 5_407_000, "60m"),
    (7_000_000, 7_300_000, "40m"), (10_100_000, 10_150_000, "30m"), (14_000_000, 14_350_000, "20m"), (18_068_000, 18_168_000, "17m"), (21_000_000, 21_450_000, "15m"),
    (24_890_000, 24_990_000, "12m"), (28_000_000, 29_700_000, "10m"), (50_000_000, 54_000_000, "6m"),
)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles; by 0 it is infinite, or NaN if a is 0 as well, in place of an error."""
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def logarithm(x: Column) -> Column:
    """The natural logarithm of a double; of 0 it is minus infinity, below it NaN, in place of null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def rounded(x: Column, digits: int) -> Column:
    """A double to that many digits as C libraries round it: the nearest whole number of the scaled double, halves away from zero, scaled back; a negative value that rounds to zero keeps its sign."""
    scale = float(10**digits)
    whole = F.round(x * scale)
    kept = F.when(whole == 0, x * 0.0).otherwise(whole / scale)
    return F.when(F.abs(x * scale) < float("inf"), kept).otherwise(x)


def fixed(x: Column) -> Column:
    """A double with two decimals, rounded by its exact value, halves to even; null for null."""
    return F.call_function("format_number", x, F.lit("0.00"))


def power_db(p: Column) -> Column:
    """10 times the decimal logarithm, a trifle above p; of 0 it is minus infinity, below it NaN, in place of null."""
    x = p + 1e-20
    return 10 * F.when(x > 0, F.log10(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def power_linear(p: Column) -> Column:
    return p + 1e-20


def band_of(freq: Column, bands: tuple = BANDS) -> Column:
    """Label of the first band that holds freq, both ends inside, else 'unknown'."""
    label = F.lit("unknown")
    for low, high, name in reversed(bands):
        label = F.when((freq >= low) & (freq <= high), name).otherwise(label)
    return label


def band_rank(label: Column, bands: tuple = BANDS) -> Column:
    """Place of a band in order; unknown ones last."""
    at = F.array_position(F.array(*[F.lit(b[2]) for b in bands]), label)
    return F.when(at > 0, at - 1).otherwise(len(bands))


def parabolic_offset(left: Column, middle: Column, right: Column) -> Column:
    """Offset of the peak of a parabola through three dB values, within half a bin; null if the middle is no maximum."""
    bend = left - 2 * middle + right
    offset = 0.5 * (left - right) / bend
    return F.when((bend < 0) & (middle >= left) & (middle >= right), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), offset)))


def sign_correction(hop: Column, channel: Column) -> Column:
    return F.when((hop % 2 == 1) & (channel % 2 == 1), -1.0).otherwise(1.0)


def channel_freq_hz(center: Column, channel: Column, n_channels: int) -> Column:
    """Frequency of a channel in FFT order: the upper half are negative offsets."""
    signed = F.when(channel < n_channels // 2, channel).otherwise(channel - n_channels)
    return center + signed * CHANNEL_HZ


def phase_position(re: Column, im: Column, near: Column) -> Column:
    """Channel position that a lag-1 phase says, unwrapped to the turn nearest to `near`."""
    turns = F.atan2(im, re) / (2 * 3.141592653589793)
    return turns * 4 + 4 * F.round((near - turns * 4) / 4)


def wire_snr(snr_2500: Column) -> Column:
    return F.round(snr_2500 + TO_500_DB).cast("int")


def wpm_of(dit_ms: Column) -> Column:
    return quotient(F.lit(1200.0), dit_ms)


def log_normal_likelihood(duration: Column, mean: Column, sigma: float) -> Column:
    d = logarithm(duration) - logarithm(mean)
    return -(d * d) / (2 * sigma * sigma)


def geometric_mean(values: Column, floor: float = 1e-6) -> Column:
    """Of an array; 0 for an empty one."""
    logs = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.ln(F.greatest(x.cast("double"), F.lit(floor))))
    return F.when(F.size(values) > 0, F.exp(logs / F.size(values))).otherwise(0.0)


def call_confidence(values: Column, reps: Column) -> Column:
    return geometric_mean(values) * (1 - F.pow(F.lit(0.5), reps))


def listed_boost(c: Column, listed: Column) -> Column:
    return F.when(listed, F.least(c * 1.15, F.lit(1.0))).otherwise(c)


def has_evidence(values: Column) -> Column:
    return F.exists(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0))


def calibration_factor(ppm: Column) -> Column:
    """1 + ppm millionths; null beyond 1000 ppm."""
    return F.when(F.abs(ppm) <= 1000, 1 + ppm * 1e-6)


def correction_ppm(reference: Column, measured: Column) -> Column:
    return (quotient(reference, measured) - 1) * 1e6


def ppm_error(n: Column, freq: Column) -> Column:
    return quotient(quotient(F.lit(50.0), F.sqrt(n)), freq) * 1e6


def image_rejection_db(re: Column, im: Column) -> Column:
    return -10 * F.log10(re * re + im * im + 1e-20)


def ms_to_hops(ms: Column) -> Column:
    return F.round(ms * HOP_HZ / 1000).cast("long")


def next_backoff(seconds: Column) -> Column:
    return F.least(seconds * 2, F.lit(60))


def usable(samples: Column) -> Column:
    """An array with NaN, infinite and huge values as 0."""
    return F.transform(samples, lambda x: F.when(F.isnan(x) | (F.abs(x) > 1e17), 0.0).otherwise(x))


def khz(hz: Column) -> Column:
    return fixed(hz / 1000)


def class_sigma(n: Column, variance: Column, mean: Column, least: int, fallback: Column, floor: float = 0.02) -> Column:
    """Standard deviation of the logarithm of a class of durations by the delta method, at least `floor`; `fallback` for a class of fewer than `least`."""
    return F.when((n < least) | (mean <= 0), fallback).otherwise(F.greatest(F.sqrt(variance) / mean, F.lit(floor)))


def common_time(offset: Column, ts: Column, scale: Column) -> Column:
    """A local sample time on the common clock."""
    return (offset + F.round(ts * scale)).cast("long")


def unix_of(epoch: Column, ts: Column, rate: Column) -> Column:
    """Unix seconds of a sample time."""
    return F.floor(epoch + ts / rate).cast("long")


def input_of_track(track: Column, inputs: int) -> Column:
    """The input that a track id belongs to: ids start at 1 + input and rise by the number of inputs; null below 1."""
    return F.when(track >= 1, F.pmod(track - 1, F.lit(inputs)))


def status_code(flags: list[Column]) -> Column:
    """How many of the flags hold; a null flag doesn't."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
