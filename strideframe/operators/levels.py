"""Speech levels: energy thresholds from two Gaussians, reports on segmented speech, running removal of the mean."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from strideframe.operators.context import by_time
from strideframe.operators.gaussians import Mixture, em, hierarchical, kmeans, partitioned_init

STRATEGIES = ("MEAN", "CLUSTER", "EM1", "EM5")
# Fixed value: steps between the two means.
BOUNDARY_STEPS = 10_000


def decision_boundary(model: Mixture) -> float:
    """The first of evenly spaced points from the first mean to the second at which the second component is likelier; else the second mean."""
    if model.means.shape != (2, 1):
        raise ValueError("a boundary needs two components of one dimension")
    first, second = model.means[:, 0]
    x = first + np.arange(BOUNDARY_STEPS) * ((second - first) / BOUNDARY_STEPS)
    p = model.posteriors(x[:, None])
    over = np.flatnonzero(p[:, 1] > p[:, 0])
    return float(x[over[0]]) if len(over) else float(second)


def energy_threshold(energies: DataFrame, strategy: str = "MEAN", least: int = 50) -> float:
    """The threshold of frame energies (utt_id, frame_idx, x of one dimension) by MEAN, CLUSTER, EM1 or EM5; 0 for fewer than two frames.

    CLUSTER splits once by hierarchical clustering, by k-means where a side would be too small; EM1 and EM5 go on with so
    many EM steps. Only sums reach the driver.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    n, mean = energies.agg(F.count("*"), F.avg(F.col("x")[0])).first()
    if n < 2:
        return 0.0
    if strategy == "MEAN":
        return float(mean)
    model = hierarchical(energies, 2, "COVARIANCE", least)
    if len(model.weights) != 2:
        model = kmeans(energies, partitioned_init(energies, 2, "uniform"))
    steps = {"CLUSTER": 0, "EM1": 1, "EM5": 5}[strategy]
    return decision_boundary(em(energies, model, steps)[0])


def running_mean_removed(frames: DataFrame) -> DataFrame:
    """One-dimensional samples without the mean of all samples of their utterance so far."""
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("x")[0]
    return frames.withColumn("x", F.array(v - F.avg(v).over(upto)))


# Fixed value: amplitudes above it count as saturated.
SATURATED = 0.999


def speech_report(segments: DataFrame, levels: DataFrame, seconds: float, min_snr: float = 0.0, start: float = 0.0) -> DataFrame:
    """What a listener asks of an utterance's windows from ``start`` seconds on.

    (utt_id, duration, snr, has_speech, initial_silence, terminal_silence, saturated, last_saturation) from segments
    (utt_id, frame_idx, speech, peak) and levels (utt_id, snr). Speech counts only where the signal-to-noise ratio is
    reached; without it both silences are the whole duration. The last saturation is -1 where there is none.
    """
    first = int(start / seconds)
    here = F.col("frame_idx") >= first
    spoken = F.when(here & (F.col("speech") == 1), F.col("frame_idx"))
    loud = F.when(here & (F.col("peak") > SATURATED), F.col("frame_idx"))
    rows = segments.groupBy("utt_id").agg(
        (F.count("*") * seconds).alias("duration"), F.max("frame_idx").alias("last"), F.min(spoken).alias("a"), F.max(spoken).alias("b"), F.max(loud).alias("s"),
    ).join(levels.select("utt_id", F.coalesce(F.nanvl("snr", F.lit(0.0)), F.lit(0.0)).alias("snr")), "utt_id", "left")
    snr = F.coalesce("snr", F.lit(0.0))
    speech = F.col("a").isNotNull() & (snr >= min_snr)
    # The last window itself never counts as initial silence.
    initial = F.least(F.col("a"), F.col("last")) - first
    return rows.select(
        "utt_id", "duration", snr.alias("snr"), speech.alias("has_speech"),
        F.when(speech, initial * seconds).otherwise(F.col("duration")).alias("initial_silence"),
        F.when(speech, (F.col("last") - F.col("b")) * seconds).otherwise(F.col("duration")).alias("terminal_silence"),
        F.col("s").isNotNull().alias("saturated"), F.coalesce(F.col("s") * seconds, F.lit(-1.0)).alias("last_saturation"),
    )


def peaks(frames: DataFrame) -> DataFrame:
    """(utt_id, frame_idx, peak): the largest amplitude of each window."""
    return frames.select("utt_id", "frame_idx", F.array_max(F.transform("x", F.abs)).alias("peak"))
