"""Streams over several files: state carried between batches, ends, idle utterances."""

import time

import numpy as np
import pytest

from strideframe.streaming import frames as sf


def framed(x, length, step):
    """Whole windows, then one filled with zeros where windows overlap or samples are left."""
    out, at = [], 0
    while at + length <= len(x):
        out.append(list(x[at : at + length]))
        at += step
    left = x[at:]
    if len(left) and (step < length or not out or len(left) > length - step):
        out.append([*left, *[0.0] * (length - len(left))])
    return out


@pytest.fixture
def files(spark, tmp_path):
    """Five files of a user's values in order, 23 in all, and 4 of another one."""
    rng = np.random.default_rng(1)
    values = {1: rng.random(23).tolist(), 2: rng.random(4).tolist()}
    rows = [(100 * u + i, 1_700_000_000 + 60 * i, u, "x", v, "") for u, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value", "props")
    for k in range(5):
        df.filter(f"event_id % 100 >= {5 * k} AND event_id % 100 < {5 * k + 5}").coalesce(1).write.parquet(str(tmp_path / f"part{k}.parquet"))
    return values, str(tmp_path / "part*.parquet"), df


@pytest.mark.parametrize("length,step", [(6, 4), (5, 5), (30, 10)])
def test_frames_over_batches(spark, files, length, step):
    values, path, df = files
    ends = df.groupBy("user_id").agg({"event_id": "max"}).toDF("utt_id", "event_id")
    stream = sf.mark_last(sf.event_stream(spark, path), ends)
    found = {}
    for r in sf.run_to_end(sf.stream_framing(stream, length, step, [1.0] * length, "last")).orderBy("utt_id", "frame_idx").collect():
        found.setdefault(r["utt_id"], []).append(r["x"])
        assert r["frame_idx"] == len(found[r["utt_id"]]) - 1
    assert {u: np.round(v, 9).tolist() for u, v in found.items()} == {u: np.round(framed(x, length, step), 9).tolist() for u, x in values.items() if framed(x, length, step)}


def test_running_moments_over_batches(spark, files):
    values, path, _ = files
    found = {}
    for r in sf.run_to_end(sf.running_mvn(sf.event_stream(spark, path))).orderBy("utt_id", "ts").collect():
        found.setdefault(r["utt_id"], []).append(r["v"])
    for u, x in values.items():
        expected = [(x[i] - np.mean(x[: i + 1])) / np.std(x[: i + 1]) if i else 0.0 for i in range(len(x))]
        assert np.allclose(found[u], expected)


def test_idle_utterances_end(spark, files, tmp_path):
    values, path, _ = files
    framing = sf.stream_framing(sf.event_stream(spark, path, 10), 6, 4, [1.0] * 6, idle=1000)
    query = framing.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("idle").count() < sum(len(framed(x, 6, 4)) for x in values.values()):
            time.sleep(0.5)
    finally:
        query.stop()
    assert spark.table("idle").count() == sum(len(framed(x, 6, 4)) for x in values.values())


def test_windows_and_sessions_over_batches(spark, files):
    values, path, df = files
    windows = sf.run_to_end(sf.windowed_means(sf.event_stream(spark, path), "10 minutes", "10 minutes"), "update", ("start", "utt_id")).collect()
    assert sum(r["n"] for r in windows) == 27 and np.isclose(sum(r["n"] * r["mean"] for r in windows), sum(map(sum, values.values())))
    sessions = sf.run_to_end(sf.speech_sessions(sf.event_stream(spark, path), -1.0, "30 minutes"), "complete").collect()
    assert sorted((r["utt_id"], r["n"]) for r in sessions) == [(1, 23), (2, 4)]
