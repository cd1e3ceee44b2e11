"""Operators over neighbouring frames: deltas, trajectories, smoothing and normalisation by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from strideframe.functions import vectors as V
from strideframe.functions.weights import dct_matrix, regression


def by_time() -> WindowSpec:
    """The frames of an utterance in order."""
    return Window.partitionBy("utt_id").orderBy("frame_idx")


def whole() -> WindowSpec:
    """All frames of an utterance."""
    return by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def neighbour(column: str, offset: int) -> Column:
    """The value so many frames on; beyond the ends the first or last one."""
    if offset == 0:
        return F.col(column)
    move = F.lead(column, offset) if offset > 0 else F.lag(column, -offset)
    return F.coalesce(move.over(by_time()), (F.last(column) if offset > 0 else F.first(column)).over(whole()))


def _weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    """Sum of vectors times constants, in one pass over a zipped array."""
    names = [f"v{k}" for k in range(len(parts))]
    zipped = F.arrays_zip(*[c.alias(n) for n, (_, c) in zip(names, parts, strict=True)])
    return F.transform(zipped, lambda s: sum((w * s[n] for n, (w, _) in zip(names[1:], parts[1:], strict=True)), parts[0][0] * s[names[0]]))


def parse_slopes(spec: str) -> tuple[bool, list[tuple[int, int, float]]]:
    """``[tirol,]context:order[:scale],...`` to (smoothing, contexts)."""
    fields = [f for f in spec.split(",") if f]
    tirol = bool(fields) and fields[0] == "tirol"
    out = []
    for field in fields[tirol:]:
        parts = field.split(":")
        if len(parts) not in (2, 3):
            raise ValueError(f"bad slope {field!r}")
        out.append((int(parts[0]), int(parts[1]), float(parts[2]) if len(parts) == 3 else 1.0))
    return tirol, out


def slopes(frames: DataFrame, contexts: Sequence[tuple[int, int, float]], tirol: bool = False) -> DataFrame:
    """Statics followed by regression slopes (context, order, scale). Edges repeat the first and last frame.

    Utterances shorter than half the longest context plus one give nothing. ``tirol`` smooths the statics by 1-2-1.
    """
    longest = max([3, *(c for c, _, _ in contexts)])
    reach = longest // 2
    wide = frames.select("*", *[neighbour("x", k).alias(f"_n{k + reach}") for k in range(-reach, reach + 1)], F.count("*").over(whole()).alias("_n"))
    at = lambda k: F.col(f"_n{k + reach}")
    parts = [_weighted([(0.25, at(-1)), (0.5, at(0)), (0.25, at(1))]) if tirol else F.col("x")]
    for context, order, scale in contexts:
        half = context // 2
        w = [scale * v for v in regression(context, order)]
        parts.append(_weighted([(v, at(k)) for v, k in zip(w, range(-half, half + 1), strict=True) if v != 0.0]))
    return wide.filter(F.col("_n") >= reach + 1).withColumn("x", F.concat(*parts)).drop("_n", *[f"_n{k}" for k in range(2 * reach + 1)])


def shifted_deltas(frames: DataFrame, d: int, p: int, k: int, copy: bool = False) -> DataFrame:
    """K deltas x(t + iP + D + 1) - x(t + iP), after the centre frame if asked for; (K - 1)P + D + 1 frames are lost."""
    ring = (k - 1) * p + d + 2
    lead = lambda n: F.lead("x", n).over(by_time()) if n else F.col("x")
    offsets = sorted({n for i in range(k) for n in (i * p, i * p + d + 1)} | {ring - 1} | ({(ring - 1) // 2} if copy else set()))
    wide = frames.select("*", *[lead(n).alias(f"_l{n}") for n in offsets]).filter(f"_l{ring - 1} IS NOT NULL")
    parts = [F.col(f"_l{(ring - 1) // 2}")] * copy + [V.subtract(F.col(f"_l{i * p + d + 1}"), F.col(f"_l{i * p}")) for i in range(k)]
    return wide.withColumn("x", F.concat(*parts)).drop(*[f"_l{n}" for n in offsets])


def traps(frames: DataFrame, context: int, dct: bool = False, scale: bool = True) -> DataFrame:
    """Temporal trajectories: for each dimension its values over ``context`` frames, by dimension; optionally their DCT."""
    span = by_time().rowsBetween(0, context - 1)
    wide = frames.withColumn("_c", F.collect_list("x").over(span)).filter(F.size("_c") == context)
    by_dim = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.transform("_c", lambda v: F.get(v, i)))
    if dct:
        matrix = dct_matrix(context, scale)
        by_dim = F.transform(by_dim, lambda v: V.matvec(matrix, v))
    return wide.withColumn("x", F.flatten(by_dim)).drop("_c")


def median(frames: DataFrame, size: int, repeat: bool = True) -> DataFrame:
    """Running median per dimension over an odd number of frames, not recursive; edges repeat or are zero."""
    half = size // 2
    zero = F.transform("x", lambda v: v * 0.0)
    around = [neighbour("x", k) if repeat else F.coalesce((F.lead("x", k) if k > 0 else F.lag("x", -k)).over(by_time()), zero) if k else F.col("x") for k in range(-half, half + 1)]
    wide = frames.withColumn("_m", F.array(*around))
    mid = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.sort_array(F.transform("_m", lambda v: F.get(v, i)))[half])
    return wide.withColumn("x", mid).drop("_m")


def dim_stats(frames: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of each dimension, per group or overall: (by..., n, mean, sd)."""
    long = frames.select(*by, F.posexplode("x").alias("_i", "_v"))
    each = long.groupBy(*by, "_i").agg(F.count("*").alias("n"), F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"))
    packed = each.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", "m", "s"))).alias("_p"))
    return packed.select(*by, "n", F.transform("_p", lambda p: p["m"]).alias("mean"), F.transform("_p", lambda p: p["s"]).alias("sd"))


def apply_mvn(frames: DataFrame, stats: DataFrame, *by: str, means: bool = True, variances: bool = True) -> DataFrame:
    """(x - mean) / sd by given statistics; null where sd is 0."""
    joined = frames.join(stats, list(by)) if by else frames.crossJoin(F.broadcast(stats))  # one row
    x = V.subtract(F.col("x"), F.col("mean")) if means else F.col("x")
    x = V.divide(x, F.col("sd")) if variances else x
    return joined.withColumn("x", x).drop("mean", "sd", "n")


def mvn(frames: DataFrame, per_utterance: bool = True, means: bool = True, variances: bool = True) -> DataFrame:
    """Mean and variance normalisation, turn-wise or over everything."""
    by = ("utt_id",) if per_utterance else ()
    return apply_mvn(frames, dim_stats(frames, *by), *by, means=means, variances=variances)


def merge_stats(parts: DataFrame, *by: str) -> DataFrame:
    """Statistics (by..., i, n, mean, var) of disjoint sets as those of their union: sums of moments."""
    moments = parts.groupBy(*by, "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s1"), F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))).alias("_s2"),
    )
    mean = F.col("_s1") / F.col("n")
    return moments.select(*by, "i", "n", mean.alias("mean"), (F.col("_s2") / F.col("n") - mean * mean).alias("var"))


def gaussianize_ranks(frames: DataFrame) -> DataFrame:
    """(utt_id, frame_idx, dim, q): rank over count of each dimension's values, ties by arrival, the last two alike."""
    long = frames.select("utt_id", "frame_idx", F.posexplode("x").alias("dim", "v"))
    by = Window.partitionBy("utt_id", "dim")
    rank = F.row_number().over(by.orderBy("v", "frame_idx"))
    n = F.count("*").over(by)
    return long.select("utt_id", "frame_idx", "dim", (F.least(rank, n - 1) / n).alias("q"))


def smooth_decisions(decisions: DataFrame, column: str = "voiced") -> DataFrame:
    """Run-length smoothing over five frames: voiced needs three in a row, unvoiced two. column: 0 or 1."""
    v = F.col(column)
    same = lambda k: F.coalesce((F.lead(column, k) if k > 0 else F.lag(column, -k)).over(by_time()) == v, F.lit(False)).cast("int")
    run = 1 + same(-1) + same(-1) * same(-2) + same(1) + same(1) * same(2)
    wide = decisions.withColumn("_run", run)
    return wide.withColumn(column, F.when((v == 1) & (F.col("_run") < 3), 0).when((v == 0) & (F.col("_run") < 2), 1).otherwise(v)).drop("_run")


def morphology(frames: DataFrame, radius: int, column: str = "speech") -> DataFrame:
    """Closing, then opening of a 0/1 column: maxima and minima over windows of the given radius."""
    span = by_time().rowsBetween(-radius, radius)
    out = frames
    for step in (F.max, F.min, F.min, F.max):
        out = out.withColumn(column, step(column).over(span))
    return out


def segment_speech(frames: DataFrame, radius: int, base: float = 1e-6) -> DataFrame:
    """(utt_id, frame_idx, energy, speech): energy around the running mean, geometric-mean threshold, morphology.

    x holds the samples of a non-overlapping window; the running mean covers all samples up to the window's end.
    """
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum(V.total(F.col("x"))).over(upto) / F.sum(F.size("x")).over(upto)
    square = V.let(mean, lambda m: V.total(F.transform("x", lambda v: (v - m) * (v - m)))) / F.size("x")
    rows = frames.select("utt_id", "frame_idx", square.alias("energy"))
    level = F.exp(F.avg(F.log(F.col("energy") + base)).over(whole()))
    rows = rows.withColumn("speech", (F.col("energy") >= level).cast("int"))
    return morphology(rows, radius)


def speech_levels(segments: DataFrame, base: float = 1e-6) -> DataFrame:
    """(utt_id, speech_level, silence_level, snr): arithmetic mean of speech, geometric of silence, their dB difference."""
    e = F.col("energy")
    levels = segments.groupBy("utt_id").agg(
        F.avg(F.when(F.col("speech") == 1, e)).alias("speech_level"), F.exp(F.avg(F.when(F.col("speech") == 0, F.log(e + base)))).alias("silence_level"),
    )
    return levels.withColumn("snr", 10 * F.log10(F.col("speech_level")) - 10 * F.log10(F.col("silence_level")))
