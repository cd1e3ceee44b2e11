"""Feature extraction from samples by parameter strings: one plan from audio rows to normalised frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from strideframe.errors import MalformedParameterError
from strideframe.functions.vectors import parse_selection
from strideframe.functions.weights import WINDOWS
from strideframe.operators import context as cx, frames as fr, spectral as sp


def parse_window(spec: str, rate: int) -> tuple[list[float], int, int]:
    """``hamm|hann|rect|tri,length,shift`` in ms (16 and 10 by default), or in samples with a trailing s, to weights, length, shift."""
    kind, *rest = spec.split(",")
    if kind not in WINDOWS or len(rest) not in (0, 2):
        raise MalformedParameterError(f"bad window {spec!r}")
    try:
        length, shift = (int(r[:-1]) if r.endswith("s") else int(rate * float(r) / 1000) for r in rest or ("16", "10"))
    except ValueError:
        raise MalformedParameterError(f"bad window {spec!r}") from None
    if length < 1 or shift < 1:
        raise MalformedParameterError(f"bad window {spec!r}")
    return WINDOWS[kind](length), length, min(shift, length)


def parse_mel(spec: str, bins: int, resolution: float, warp: Callable[[float], float] | None = None):
    """``low,high,width,arg`` in Hz and mel; empty fields keep their defaults."""
    fields = [f.strip() for f in spec.split(",")] if spec else []
    names = ("lower", "upper", "width", "arg")
    if len(fields) > len(names):
        raise MalformedParameterError(f"bad filter bank {spec!r}")
    return sp.mel_bank(bins, resolution, warp=warp, **{n: float(f) for n, f in zip(names, fields, strict=False) if f})


def finite(frames: DataFrame) -> DataFrame:
    """frames, with an error when the plan meets a value that isn't finite."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return frames.filter(F.when(bad, F.raise_error(F.concat(F.lit("value that isn't finite in "), F.col("utt_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))


def extract(
    audio: DataFrame, rate: int, window: str = "hamm,16,10", bank: str = "", selection: str = "0-11", slopes: str = "", mvn: str = "",
    warp: Callable[[float], float] | None = None, energy: bool = False,
) -> DataFrame:
    """(utt_id, frame_idx, x) of (utt_id, samples): window, spectrum, mel bank, DCT, selection, slopes, normalisation.

    All row-wise steps after framing are one Python pass; slopes and normalisation (``turn`` or ``all``) exchange by
    utterance. With ``energy`` the first coefficient is replaced by the log of the frame's summed spectrum.
    """
    weights, length, shift = parse_window(window, rate)
    size = sp.fft_size(length)
    mel = parse_mel(bank, size // 2 + 1, rate / size, warp)
    dims = parse_selection(selection)
    if max(dims) >= len(mel):
        raise MalformedParameterError(f"{selection!r} asks for more than {len(mel)} coefficients")
    import numpy as np

    spectrum, filters, cosine = sp.power_spectrum(), sp.filter_bank(mel), sp.dct(len(mel))

    def coefficients(x):
        power = spectrum(x)
        y = cosine(filters(power))
        if energy:
            y[:, 0] = np.log(power.sum(1) + 1e-6)
        return y[:, dims]

    out = sp.Chain(coefficients).apply(fr.framing(audio, length, shift, weights))
    if slopes:
        tirol, contexts = cx.parse_slopes(slopes)
        out = cx.slopes(out, contexts, tirol)
    if mvn not in ("", "turn", "all"):
        raise MalformedParameterError(f"bad normalisation {mvn!r}")
    if mvn:
        out = cx.mvn(out, per_utterance=mvn == "turn")
    return finite(out.select("utt_id", "frame_idx", "x"))


def spectrogram(audio: DataFrame, rate: int, window: str = "hann,32,8", gamma: float = 1.0) -> DataFrame:
    """(utt_id, frame_idx, x): log magnitudes scaled to 0..1 between the extremes of all frames, to the power gamma."""
    weights, length, shift = parse_window(window, rate)
    rows = sp.Chain(sp.magnitude_spectrum(log=True)).apply(fr.framing(audio, length, shift, weights))
    span = rows.agg(F.min(F.array_min("x")).alias("_lo"), F.max(F.array_max("x")).alias("_hi"))
    scaled = F.transform("x", lambda v: F.pow(F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(gamma)))
    return rows.crossJoin(F.broadcast(span)).withColumn("x", scaled).drop("_lo", "_hi")  # one row


def gaussianize(frames: DataFrame) -> DataFrame:
    """(utt_id, frame_idx, dim, v): each dimension's ranks through the normal quantile function."""
    import pandas as pd

    ranks = cx.gaussianize_ranks(frames)
    kind = ranks.schema["utt_id"].dataType.simpleString()

    def run(batches):
        from statistics import NormalDist

        inverse = NormalDist().inv_cdf
        for batch in batches:
            known = {q: inverse(q) if 0 < q < 1 else 0.0 for q in batch["q"].unique()}
            yield pd.DataFrame({"utt_id": batch["utt_id"], "frame_idx": batch["frame_idx"], "dim": batch["dim"], "v": batch["q"].map(known)})

    return ranks.mapInPandas(run, f"utt_id {kind}, frame_idx long, dim int, v double")
