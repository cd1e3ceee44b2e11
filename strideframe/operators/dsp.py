"""Filters over whole sample arrays ``(utt_id, samples)``: FIR, IIR, Butterworth, band masks, ring modulation, inversion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def map_samples(audio: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a function of one sample array to every utterance; rows stay where they are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(samples=[kernel(np.asarray(s, float)) for s in batch["samples"]])

    return audio.mapInPandas(run, audio.schema)


def fir(taps: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Convolution with the taps over the sum of their absolute values."""
    h = np.asarray(taps, float)
    h = h / np.abs(h).sum()
    return lambda x: np.convolve(x, h)[: len(x)]


def iir(b: Sequence[float], a: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Direct form: a0 y(n) = sum b x(n - k) - sum a y(n - k)."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]

    def run(x: np.ndarray) -> np.ndarray:
        forward = np.convolve(x, b)[: len(x)]
        y, back = np.zeros(len(x) + len(a) - 1), a[1:][::-1]
        k = len(a) - 1
        for n in range(len(x)):
            y[n + k] = forward[n] - back @ y[n : n + k]
        return y[k:]

    return run


def _digital(zeros: np.ndarray, poles: np.ndarray, gain: complex) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear transform at two samples a second, with the gain kept."""
    degree = len(poles) - len(zeros)
    z, p = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    k = gain * np.prod(4 - zeros) / np.prod(4 - poles)
    return np.real(k * np.poly(np.append(z, -np.ones(degree)))), np.real(np.poly(p))


def butterworth(order: int, cut: float | tuple[float, float], kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """(b, a) for a cut (or two) as a share of half the sample rate. kind: low, high, band or stop."""
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    zeros, gain = np.array([]), 1.0
    warp = lambda f: 4 * math.tan(math.pi * f / 2)
    if kind in ("low", "high"):
        w = warp(cut)
        if kind == "low":
            poles, gain = poles * w, gain * w**order
        else:
            gain = gain * np.real(1 / np.prod(-poles))
            poles, zeros = w / poles, np.zeros(order)
    else:
        lo, hi = map(warp, cut)
        bw, w0 = hi - lo, math.sqrt(lo * hi)
        if kind == "band":
            half = poles * bw / 2
            root = np.sqrt(half.astype(complex) ** 2 - w0**2)
            poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), gain * bw**order
        else:
            gain = gain * np.real(1 / np.prod(-poles))
            half = bw / 2 / poles
            root = np.sqrt(half.astype(complex) ** 2 - w0**2)
            poles = np.concatenate([half + root, half - root])
            zeros = np.concatenate([np.full(order, 1j * w0), np.full(order, -1j * w0)])
    return _digital(zeros, poles, gain)


def butterworth_order(passband: float, stopband: float, ripple_db: float, attenuation_db: float) -> tuple[int, float]:
    """Least order and its cut for a low- or high-pass that keeps ripple and attenuation."""
    wp, ws = math.tan(math.pi * passband / 2), math.tan(math.pi * stopband / 2)
    ratio = ws / wp if stopband > passband else wp / ws
    gs, gp = 10 ** (attenuation_db / 10) - 1, 10 ** (ripple_db / 10) - 1
    order = math.ceil(math.log10(gs / gp) / (2 * math.log10(ratio)))
    w = wp * gp ** (-1 / (2 * order)) if stopband > passband else wp * gp ** (1 / (2 * order))
    return order, math.atan(w) * 2 / math.pi


def band_pass(bands: Sequence[tuple[float, float]], rate: int, size: int = 1024, invert: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Spectral mask over triangularly overlapping blocks that add up to the signal."""
    hz = np.fft.rfftfreq(size, 1 / rate)
    mask = np.zeros(len(hz), bool)
    for lo, hi in bands:
        mask |= (hz >= lo) & (hz <= hi)
    mask = mask ^ invert
    half = size // 2
    w = 1 - np.abs(np.arange(size) - half) / half

    def run(x: np.ndarray) -> np.ndarray:
        padded = np.concatenate([np.zeros(half), x, np.zeros(size)])
        out = np.zeros(len(padded))
        for at in range(0, len(padded) - size + 1, half):
            out[at : at + size] += np.fft.irfft(np.fft.rfft(padded[at : at + size] * w) * mask, size)
        return out[half : half + len(x)]

    return run


def ring_modulation(audio: DataFrame, hz: float, rate: int) -> DataFrame:
    """Samples times cos(2 pi f n / rate), n from 1: an expression, nothing leaves the JVM."""
    return audio.withColumn("samples", F.transform("samples", lambda v, n: v * F.cos(2 * math.pi * hz / rate * (n + 1))))


def split_band_inversion(split: float, rate: int, order: int = 6, top: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Both bands mirrored within themselves: filtered, modulated by their upper edge, low-passed and added."""
    top = top or rate / 2 * 0.95
    low, high = butterworth(order, split / (rate / 2), "low"), butterworth(order, split / (rate / 2), "high")
    clean = butterworth(order, top / (rate / 2), "low")

    def run(x: np.ndarray) -> np.ndarray:
        n = np.arange(1, len(x) + 1)
        ring = lambda v, f: v * np.cos(2 * np.pi * f * n / rate)
        a = iir(*low)(ring(iir(*low)(x), split))
        b = iir(*clean)(ring(iir(*high)(x), split + top))
        return a + b

    return run


def sine(spark: SparkSession, n: int, rate: int, *hz: float, utt_id: str = "sine") -> DataFrame:
    """(utt_id, n, v): the sum of sines times 0.3, generated in the plan."""
    value = sum((F.sin(2 * math.pi * f / rate * F.col("id")) for f in hz), F.lit(0.0)) * 0.3
    return spark.range(n).select(F.lit(utt_id).alias("utt_id"), F.col("id").alias("n"), value.alias("v"))


def constant(spark: SparkSession, n: int, value: float, utt_id: str = "constant") -> DataFrame:
    return spark.range(n).select(F.lit(utt_id).alias("utt_id"), F.col("id").alias("n"), F.lit(float(value)).alias("v"))


def recursive_median(size: int, repeat: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """Running median in which what is behind has been filtered already."""
    half = size // 2

    def run(x: np.ndarray) -> np.ndarray:
        y = np.pad(x.astype(float), half, mode="edge" if repeat else "constant")
        for i in range(half, half + len(x)):
            y[i] = np.median(y[i - half : i + half + 1])
        return y[half : half + len(x)]

    return run


def natural_spline(knots: Sequence[float], values: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """The natural cubic spline through the knots; its tridiagonal system is solved in linear time and memory."""
    x, y = np.asarray(knots, float), np.asarray(values, float)
    n = len(x)
    if n < 2:
        return lambda t: np.full(np.shape(t), y[0] if n else 0.0)
    h = np.diff(x)
    m = np.zeros(n)
    if n > 2:
        right = 6 * np.diff(np.diff(y) / h)
        # Row k: h[k] m[k] + 2 (h[k] + h[k + 1]) m[k + 1] + h[k + 1] m[k + 2]; each is freed of its first term by the row before.
        upper, known = np.zeros(n - 2), np.zeros(n - 2)
        for k in range(n - 2):
            before, part = (upper[k - 1], known[k - 1]) if k else (0.0, 0.0)
            pivot = 2 * (h[k] + h[k + 1]) - h[k] * before
            upper[k], known[k] = h[k + 1] / pivot, (right[k] - h[k] * part) / pivot
        for k in range(n - 3, -1, -1):
            m[k + 1] = known[k] - upper[k] * m[k + 2]

    def at(t: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(x, t) - 1, 0, n - 2)
        a, b = (x[k + 1] - t) / h[k], (t - x[k]) / h[k]
        return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6

    return at


def sinc_at(x: np.ndarray, t: float, taps: int = 500) -> float:
    """The signal's value at a fractional sample."""
    k = np.arange(max(0, int(t) - taps), min(len(x), int(t) + taps + 1))
    return float(np.sum(x[k] * np.sinc(t - k)))


def value_at(samples: Column, t: Column, linear: bool = True) -> Column:
    """The signal's value at a fractional sample: between its neighbours, or that of the sample before; null outside."""
    k = F.floor(t).cast("int")
    near, part = F.get(samples, k), t - k
    return F.when(part > 0, near + part * (F.get(samples, k + 1) - near)).otherwise(near) if linear else near


def extent(samples: Column) -> Column:
    """(lowest, highest) sample."""
    return F.struct(F.array_min(samples).alias("lowest"), F.array_max(samples).alias("highest"))


def sinc_shift(part: float, taps: int = 500) -> Callable[[np.ndarray], np.ndarray]:
    """The signal's values at all samples but the last, plus a part of one: sinc_at everywhere by one convolution."""
    kernel = np.sinc(part + np.arange(-taps, taps + 1))

    def run(x: np.ndarray) -> np.ndarray:
        return np.convolve(x, kernel)[taps : taps + max(0, len(x) - 1)]

    return run


def refill_pitch(f0: DataFrame) -> DataFrame:
    """Frames that aren't selected, between the first and last selected one, from the spline through those that are.

    f0: (utt_id, frame_idx, f0, selected boolean).
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx").reset_index(drop=True)
        knots = pdf[pdf["selected"]]
        if len(knots) > 1:
            t = pdf["frame_idx"].to_numpy(float)
            inside = (t > knots["frame_idx"].iloc[0]) & (t < knots["frame_idx"].iloc[-1]) & ~pdf["selected"].to_numpy()
            values = pdf["f0"].to_numpy(float).copy()
            values[inside] = natural_spline(knots["frame_idx"], knots["f0"])(t[inside])
            pdf["f0"] = values
        return pdf

    return f0.groupBy("utt_id").applyInPandas(run, f0.schema)


def correct_pitch(f0: DataFrame, action: str, value: float = 0.0, low: float = 50.0, high: float = 600.0) -> DataFrame:
    """zero, half, double, reset or set the selected frames; half and double only within the limits.

    f0: (utt_id, frame_idx, f0, original, selected).
    """
    v = F.col("f0")
    new = {
        "zero": F.lit(0.0), "half": F.when(v >= 2 * low, v / 2).otherwise(v), "double": F.when(v <= high / 2, v * 2).otherwise(v),
        "reset": F.col("original"), "set": F.lit(float(value)),
    }[action]
    return f0.withColumn("f0", F.when(F.col("selected"), new).otherwise(v))
