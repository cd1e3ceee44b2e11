"""Frame streams as DataFrames: ``(utt_id, frame_idx, x)`` with the order as data; selection, merging, splitting, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.functions import vectors as V
from strideframe.operators.order import total_before


def to_frames(df: DataFrame, utt: str, order: Sequence[str], values: Sequence[str], *keep: str) -> DataFrame:
    """Frames from the rows of a table: one per row, numbered within its utterance in the given order."""
    number = F.row_number().over(Window.partitionBy(utt).orderBy(*order)) - 1
    x = F.array(*[F.col(v).cast("double") for v in values])
    return df.select(F.col(utt).alias("utt_id"), number.cast("long").alias("frame_idx"), x.alias("x"), *keep)


def buffered(frames: DataFrame) -> DataFrame:
    """frames, computed once and kept for readers at any place; unpersist when done."""
    return frames.persist()


def frame_at(frames: DataFrame, places: Sequence[int]) -> DataFrame:
    """The frames at given places of each utterance; negative ones count from its end."""
    n = F.count("*").over(Window.partitionBy("utt_id"))
    wanted = F.array(*[F.lit(p).cast("long") for p in places])
    return frames.withColumn("_n", n).filter(F.array_contains(wanted, F.col("frame_idx")) | F.array_contains(wanted, F.col("frame_idx") - F.col("_n"))).drop("_n")


def long_form(frames: DataFrame, *keep: str, column: str = "x", digits: int = 6) -> DataFrame:
    """(utt_id, frame_idx, dim, v): one row per element, rounded."""
    return frames.select("utt_id", "frame_idx", *keep, F.posexplode(column).alias("dim", "v")).withColumn("v", F.round("v", digits) + F.lit(0.0))


def select_dims(frames: DataFrame, spec: str, energy_at: int | None = None, energy: str = "energy") -> DataFrame:
    """Dimensions by ``0,3-8,1``; short-time energy (log of the energy column) instead of one of them if asked for."""
    dims = V.parse_selection(spec)
    picked = [F.get("x", F.lit(d)) for d in dims]
    if energy_at is not None:
        picked = [F.log(F.col(energy) + 1e-6) if d == energy_at else p for d, p in zip(dims, picked, strict=True)]
    return frames.withColumn("x", F.array(*picked))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Streams side by side: an inner join on the place, so the shortest one ends the utterance."""
    out = first.select("utt_id", "frame_idx", "x")
    for other in others:
        right = other.select("utt_id", "frame_idx", F.col("x").alias("_y"))
        out = out.join(right, ["utt_id", "frame_idx"]).select("utt_id", "frame_idx", F.concat("x", "_y").alias("x"))
    return out


def concat(frames: DataFrame, file: str = "utt_id", into: Column | None = None) -> DataFrame:
    """Files one after another, in the order of their names, numbered anew; by prefix sums of lengths, not by one sort.

    Frames of different widths are an error when the plan runs.
    """
    into = F.lit("all") if into is None else into
    lengths = frames.groupBy(file).agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"))
    starts = total_before(lengths.select(file, "n"), file, "n", "_before").select(file, "_before")
    widths = lengths.agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))  # one row
    fits = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("frames of different widths")).cast("boolean")).otherwise(F.lit(True))
    rows = frames.join(starts, file).crossJoin(F.broadcast(widths)).filter(fits)
    return rows.select(into.alias("utt_id"), (F.col("_before") + F.col("frame_idx")).alias("frame_idx"), "x")


RUN_BLOCK = 4096


def split_runs(frames: DataFrame, runs: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """Consecutive runs of each utterance to outputs. runs: (ord, out, n_frames); a range join on cumulated lengths.

    Runs are listed under each block of frames that they touch, so that frames meet them by an equi-join on the block.
    """
    spans = total_before(runs, "ord", "n_frames", "_from").select("out", "_from", (F.col("_from") + F.col("n_frames")).alias("_to")).filter("_to > _from")
    touched = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    hit = (F.col("frame_idx") >= F.col("_from")) & (F.col("frame_idx") < F.col("_to"))
    placed = frames.withColumn("_block", F.floor(F.col("frame_idx") / block))
    return placed.join(touched, "_block").filter(hit).select("utt_id", "out", (F.col("frame_idx") - F.col("_from")).alias("frame_idx"), "x")


def first_n(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames of every utterance."""
    return frames.filter(F.col("frame_idx") < n)


def keep_class(samples: DataFrame, c, column: str = "c") -> DataFrame:
    return samples.filter(F.col(column) == c)


def drop_class(samples: DataFrame, c, column: str = "c") -> DataFrame:
    return samples.filter(F.col(column) != c)


def label_filter(frames: DataFrame, labels: DataFrame, ignore: Sequence) -> DataFrame:
    """Frames whose label, by place, is none of the ignored ones. labels: (utt_id, frame_idx, label)."""
    return frames.join(labels, ["utt_id", "frame_idx"]).filter(~F.col("label").isin(list(ignore)))


def vad_filter(frames: DataFrame, decisions: DataFrame) -> DataFrame:
    """Frames with decision 1; where decisions end early the last one holds, more of them than frames are an error when the plan runs.

    decisions: (utt_id, frame_idx, keep).
    """
    joined = frames.join(decisions, ["utt_id", "frame_idx"], "full")
    there = F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("more decisions than frames in "), F.col("utt_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    held = F.last("keep", ignorenulls=True).over(Window.partitionBy("utt_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    return joined.filter(there).withColumn("keep", held).filter("keep = 1").drop("keep")


def energy(x: Column) -> Column:
    """Sum of absolute values."""
    return V.norm1(x)


def energy_filter(frames: DataFrame, threshold: Column | float) -> DataFrame:
    """Frames with more energy than the threshold."""
    return frames.filter(energy(F.col("x")) > threshold)


def mean_threshold(frames: DataFrame) -> DataFrame:
    """Frames above the mean energy of all frames: one row is broadcast."""
    mean = frames.agg(F.avg(energy(F.col("x"))).alias("_mean"))
    return frames.join(F.broadcast(mean), energy(F.col("x")) > F.col("_mean")).drop("_mean")


def remove_mean(x: Column) -> Column:
    """x without its own mean (DC)."""
    return V.let(V.total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))


def preemphasis(x: Column, a: float = 0.95, carried: Column | float = 0.0) -> Column:
    """x(n) - a x(n-1), with the last sample of the block before carried in."""
    before = F.concat(F.array(carried if isinstance(carried, Column) else F.lit(float(carried))), F.slice(x, 1, F.size(x) - 1))
    return F.zip_with(x, before, lambda p, q: p - a * q)


def power_db(x: Column) -> Column:
    """10 log10 of the mean square, moved up by 300 log10 2."""
    return 10 * F.log10(V.dot(x, x)) - 10 * F.log10(F.size(x).cast("double")) + 300 * F.log10(F.lit(2.0))


def zero_crossings(x: Column) -> Column:
    """Neighbours of different sign."""
    return F.size(F.filter(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda p, q: p * q), lambda v: v < 0))


def voiced(x: Column, rate: int, max_zcr: float, min_energy: float, min_peak: float) -> Column:
    """Few crossings (per second of the frame's length), enough mean square and a high enough peak."""
    zcr = zero_crossings(x) * (F.lit(float(rate)) / F.size(x))
    return (zcr < max_zcr) & (V.dot(x, x) / F.size(x) > min_energy) & (F.array_max(x) > min_peak)


def framing(audio: DataFrame, length: int, step: int, weights: Sequence[float], pad_tail: bool = True, dc: str = "hop") -> DataFrame:
    """Windows over ``samples`` of each utterance: (utt_id, frame_idx, x).

    A tail frame padded with zeros follows the whole ones where frames overlap or samples are left. With ``dc='hop'``
    each hop of new samples after the first frame loses its own mean, with ``frame`` each frame does, else none.
    """
    step = min(step, length)
    n = F.size("samples")
    whole = F.greatest(F.floor((n - length) / step), F.lit(0)) + 1
    tail = F.when((F.lit(step < length)) | (n > length + (whole - 1) * step) | (n < length), 1).otherwise(0) if pad_tail else F.lit(0)
    count = F.when(n >= length, whole + tail).when(n > 0, F.lit(1)).otherwise(F.lit(0)).cast("int")
    samples = F.col("samples")
    if dc == "hop":
        # Samples from ``length`` on come in hops of ``step``; each hop loses its mean.
        hops = F.when(n > length, F.sequence(F.lit(length), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        samples = F.concat(F.slice("samples", 1, length), F.flatten(F.transform(hops, lambda at: remove_mean(F.slice("samples", at + 1, step)))))
    cut = V.let(samples, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(s, k * step + 1, length)))
    rows = audio.filter(count > 0).select("utt_id", F.posexplode(cut).alias("frame_idx", "x"))
    x = F.col("x")
    if dc == "frame":
        x = remove_mean(x)
    x = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(x)))
    return rows.select("utt_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.zip_with(x, V.literal(weights), lambda p, w: p * w).alias("x"))


def sequences(frames: DataFrame) -> DataFrame:
    """One-dimensional frames as ``(utt_id, samples)``: one array per utterance."""
    packed = frames.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", F.get("x", F.lit(0)).alias("v")))).alias("s"))
    return packed.select("utt_id", F.transform("s", lambda p: p["v"]).alias("samples"))
