"""Structured Streaming twins of framing, running normalisation and speech segmentation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideframe.session import scratch_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """(utt_id, ts, value) from event files as they arrive."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select(F.col("user_id").alias("utt_id"), "ts", "event_id", "value")


def windowed_means(stream: DataFrame, length: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, utt_id, n, mean): event-time windows with a watermark; append mode."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, step), "utt_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(
        F.col("window.start").alias("start"), "utt_id", "n", "mean")


def speech_sessions(stream: DataFrame, threshold: float, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, utt_id, n): runs of values above the threshold, closed by a gap."""
    loud = stream.filter(F.col("value") > threshold).withWatermark("ts", late)
    return loud.groupBy(F.session_window("ts", gap), "utt_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "utt_id", "n")


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def _stay(state: GroupState, idle: int | None, *values) -> None:
    """Keep the values, and give them up when no event comes for so many milliseconds."""
    state.update(values)
    if idle is not None:
        state.setTimeoutDuration(idle)


def running_mvn(stream: DataFrame, idle: int | None = None) -> DataFrame:
    """(utt_id, ts, v): (value - mean) / deviation by all values of the utterance up to the batch's order so far.

    State is (n, sum, sum of squares): constant per utterance, whatever the length of the stream. An utterance that is
    idle for so many milliseconds is forgotten and starts anew with its next event.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, s1, s2 = state.get if state.exists else (0, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        x = pdf["value"].to_numpy(float)
        count, c1, c2 = n + np.arange(1, len(x) + 1), s1 + np.cumsum(x), s2 + np.cumsum(x * x)
        mean = c1 / count
        sd = np.sqrt(np.maximum(c2 / count - mean**2, 0))
        _stay(state, idle, int(count[-1]), float(c1[-1]), float(c2[-1]))
        yield pd.DataFrame({"utt_id": key[0], "ts": pdf["ts"], "v": np.where(sd > 1e-12, (x - mean) / np.where(sd > 1e-12, sd, 1), 0.0)})

    return stream.groupBy("utt_id").applyInPandasWithState(run, "utt_id long, ts timestamp, v double", "n long, s1 double, s2 double", "append", _timeout(idle))


def stream_framing(stream: DataFrame, length: int, step: int, weights: Sequence[float], last: str | None = None, idle: int | None = None) -> DataFrame:
    """(utt_id, frame_idx, x): whole windows as soon as their samples are there; the rest stays in state.

    ``last`` names a boolean column that marks an utterance's last event: with it the frames that are left, filled with
    zeros, follow and the state ends, as ``frames.framing`` with a padded tail does for finished utterances. With ``idle``
    an utterance without events for so many milliseconds ends in the same way.
    """
    w = np.asarray(weights, float)

    def tail(x: np.ndarray, k: int) -> list[list[float]]:
        """The padded frame that follows k whole ones where frames overlap or samples are left."""
        open_end = len(x) > 0 and (step < length or k == 0 or len(x) > length - step)
        return [(np.pad(x, (0, length - len(x))) * w).tolist()] if open_end else []

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, rest = state.get if state.exists else (0, [])
        x, frames, ended = np.asarray(rest, float), [], state.hasTimedOut
        if not ended:
            pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            x = np.concatenate([x, pdf["value"].to_numpy(float)])
            ended = last is not None and bool(pdf[last].any())
        while len(x) >= length:
            frames.append((x[:length] * w).tolist())
            x = x[step:]
        if ended:
            frames += tail(x, k + len(frames))
            state.remove()
        else:
            _stay(state, idle, k + len(frames), x.tolist())
        yield pd.DataFrame([(key[0], k + i, f) for i, f in enumerate(frames)], columns=["utt_id", "frame_idx", "x"])

    return stream.groupBy("utt_id").applyInPandasWithState(run, "utt_id long, frame_idx long, x array<double>", "k long, rest array<double>", "append", _timeout(idle))


def mark_last(stream: DataFrame, ends: DataFrame) -> DataFrame:
    """stream with ``last``: whether the event is the one that a static table (utt_id, event_id) names as its utterance's last."""
    known = ends.select("utt_id", F.col("event_id").alias("_last"))
    return stream.join(known, "utt_id", "left").withColumn("last", F.coalesce(F.col("event_id") == F.col("_last"), F.lit(False))).drop("_last")


def run_to_end(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """What a stream gives for all that is there, from Parquet in the shared folder: each batch is written under its number.

    A batch that runs again after a failure overwrites its own files. In update mode the last row of each ``keys`` counts,
    in complete mode the last batch.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))  # one row
        rows = rows.join(F.broadcast(last), "batch")
    elif mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_row")).select("_row.*")
    return rows.drop("batch").select(*stream.columns)
