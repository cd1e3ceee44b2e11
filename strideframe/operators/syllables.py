"""Syllable nuclei over three frequency bands: peaks between minima, decided between bands, with tempo and loudness features.

The bands are low (voicing), sonorant and fricative energies. Detection is the only step that needs an utterance in one
place; everything before it is framing, spectrum, bands and median as elsewhere, everything after it window expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strideframe.operators import context as cx, frames as fr, spectral as sp

# Borders of the bands in Hz, and frames that must follow a nucleus before it is decided.
BANDS = ((100.0, 300.0), (300.0, 2300.0), (2300.0, 5000.0))
LOW, SONORANT, FRICATIVE = 0, 1, 2
GUARD = 5
SCHEMA = "start_min long, start long, peak long, stop long, stop_min long, band int, max_energy double, sum_energy double"


@dataclass(frozen=True)
class Options:
    """Least peak, share of a peak that the minima beside it must fall by (and the softer share that splits long nuclei), widths in frames."""

    significance: float = 0.0
    factor: float = 0.5
    soft_factor: float = 0.25
    width: int = 2
    distance: int = 2
    context: int = 1


@dataclass(frozen=True)
class Nucleus:
    start_min: int
    start: int
    peak: int
    stop: int
    stop_min: int
    band: int
    max_energy: float
    sum_energy: float

    def touches(self, other: Nucleus) -> bool:
        return self.start <= other.stop and self.stop >= other.start


class Band:
    """One band's energies with their local extremes."""

    def __init__(self, energies: np.ndarray, number: int, options: Options):
        self.e, self.number, self.options = np.asarray(energies, float), number, options
        n, c = len(self.e), options.context
        around = [self.e[max(0, i - c) : i + c + 1] for i in range(n)]
        self.high = np.array([self.e[i] >= w.max() for i, w in enumerate(around)], bool)
        self.low = np.array([self.e[i] <= w.min() for i, w in enumerate(around)], bool)

    def _minimum(self, peak: int, step: int, end: int, limit: float) -> int | None:
        """The first minimum below the limit on one side, before the energy rises above the peak."""
        at = peak
        while at != end:
            if self.low[at] and self.e[at] < limit:
                return at
            if self.e[at] > self.e[peak]:
                return None
            at += step
        return None

    def nucleus_at(self, peak: int, begin: int, factor: float) -> Nucleus | None:
        """The nucleus of a local maximum, looking no further left than behind ``begin``."""
        top = self.e[peak]
        limit = (1 - factor) * top
        left = self._minimum(peak, -1, begin, limit)
        right = self._minimum(peak, 1, len(self.e), limit)
        if left is None or right is None:
            return None
        below = lambda part, low: int(np.argmax(part < (top + low) / 2))
        start = peak - below(self.e[left : peak + 1][::-1], self.e[left])
        stop = peak + below(self.e[peak : right + 1], self.e[right])
        if stop - start < self.options.width:
            return None
        own = self.e[start : stop + 1]
        return Nucleus(left, start, peak, stop, right, self.number, float(own.max()), float(own.sum()))

    def first(self, begin: int, seen: int, factor: float, search: int | None = None) -> Nucleus | None:
        """The nucleus of the earliest peak that is complete when ``seen`` frames are there."""
        for peak in range(begin if search is None else search, seen):
            if self.high[peak] and self.e[peak] > self.options.significance:
                found = self.nucleus_at(peak, begin, factor)
                if found is not None and found.stop_min + GUARD <= seen:
                    return found
        return None

    def completions(self, begin: int, factor: float) -> list[int]:
        """Numbers of frames at which another nucleus of the band is complete."""
        ends = set()
        for peak in range(begin, len(self.e)):
            if self.high[peak] and self.e[peak] > self.options.significance:
                found = self.nucleus_at(peak, begin, factor)
                if found is not None:
                    ends.add(found.stop_min + GUARD)
        return [n for n in ends if n <= len(self.e)]


def decide(low: Nucleus | None, sonorant: Nucleus | None, fricative: Nucleus | None) -> Nucleus | None:
    """A sonorant nucleus unless a stronger fricative one touches it; but a low one that doesn't touch a sonorant one goes first."""
    chosen = None
    if sonorant is not None and (fricative is None or not sonorant.touches(fricative) or fricative.sum_energy < sonorant.sum_energy):
        chosen = sonorant
    if low is not None and (sonorant is None or not low.touches(sonorant)):
        chosen = low
    return chosen


def detect(bands: np.ndarray, options: Options = Options()) -> list[Nucleus]:
    """Nuclei of (frames, 3) energies, in order."""
    rows = [Band(bands[:, b], b, options) for b in range(bands.shape[1])]
    found: list[Nucleus] = []
    begin = 0
    while True:
        # Decisions can only change when a nucleus of some band becomes complete.
        chosen = None
        for seen in sorted({n for b in rows for n in b.completions(begin, options.factor)}):
            chosen = decide(*(b.first(begin, seen, options.factor) for b in rows))
            if chosen is not None:
                break
        if chosen is None:
            return found
        if not found or chosen.start - found[-1].stop >= options.distance:
            band = rows[chosen.band]
            one = band.first(begin, seen, options.soft_factor)
            two = band.first(begin, seen, options.soft_factor, one.stop_min) if one is not None and one.stop_min < chosen.stop_min else None
            found += [chosen] if two is None else [one, two]
        begin = chosen.stop_min


def band_energies(audio: DataFrame, rate: int, length: int, step: int, median: int = 5) -> DataFrame:
    """(utt_id, frame_idx, x) of (utt_id, samples): the energies of the three bands, smoothed by a running median."""
    size = sp.fft_size(length)
    bank = np.array([sp.rectangle(size // 2 + 1, lo, hi, rate / size) for lo, hi in BANDS])
    rows = sp.Chain(sp.power_spectrum(), sp.filter_bank(bank, log=False)).apply(fr.framing(audio, length, step, [1.0] * length))
    return cx.median(rows, median)


def syllable_nuclei(bands: DataFrame, options: Options = Options()) -> DataFrame:
    """(utt_id, nucleus, start_min, start, peak, stop, stop_min, band, max_energy, sum_energy) of (utt_id, frame_idx, x) with three energies."""
    kind = bands.schema["utt_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("frame_idx")["x"].to_numpy())
        rows = [(key[0], k, n.start_min, n.start, n.peak, n.stop, n.stop_min, n.band, n.max_energy, n.sum_energy) for k, n in enumerate(detect(x, options))]
        return pd.DataFrame(rows, columns=["utt_id", "nucleus", *(c.split()[0] for c in SCHEMA.split(", "))])

    return bands.select("utt_id", "frame_idx", "x").groupBy("utt_id").applyInPandas(run, f"utt_id {kind}, nucleus int, {SCHEMA}")


def nucleus_features(nuclei: DataFrame, frames_per_second: float, shift: int) -> DataFrame:
    """nuclei with tempo, positions in samples, seconds, and contrasts of duration and loudness to both neighbours.

    The tempo is the mean of 2 * frames per second over the distance to the peak before and behind, of those there are.
    """
    order = Window.partitionBy("utt_id").orderBy("nucleus")
    before, behind = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    rate = lambda d: 2 * frames_per_second / d
    left, right = rate(F.col("peak") - before("peak")), rate(behind("peak") - F.col("peak"))
    frames = F.col("stop") - F.col("start")
    rows = nuclei.withColumn("_d", frames)
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), before(c)), F.lit(0.0)) + F.coalesce(F.try_divide(F.col(c), behind(c)), F.lit(0.0)) - 2
    return rows.withColumns({
        "tempo": F.coalesce((left + right) / 2, left, right, F.lit(0.0)),
        "positions": F.transform(F.array("start_min", "start", "peak", "stop", "stop_min"), lambda p: p * shift),
        "seconds": frames / frames_per_second,
        "duration_contrast": (2 * F.col("_d") - F.coalesce(before("_d"), F.lit(0)) - F.coalesce(behind("_d"), F.lit(0))) / F.lit(1000.0 / frames_per_second),
        "max_contrast": ratio("max_energy"), "sum_contrast": ratio("sum_energy"),
    }).drop("_d")
