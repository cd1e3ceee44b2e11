"""Catalogue: streams over the event file, drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import weights as W
from strideframe.session import table
from strideframe.streaming import frames as sf

Q, SQL = {}, {}


def _stream(spark, d):
    return sf.event_stream(spark, f"{d}/events.parquet*")


_drain = sf.run_to_end


def stream_framing(spark, d):
    return _drain(sf.stream_framing(_stream(spark, d), 16, 10, W.rectangular(16))).select("utt_id", "frame_idx", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


def stream_flush(spark, d):
    """Frames with the padded tail that the last event of each user sends off."""
    ends = table(spark, d, "events").groupBy(F.col("user_id").alias("utt_id")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    marked = sf.mark_last(_stream(spark, d), ends)
    return _drain(sf.stream_framing(marked, 16, 10, W.rectangular(16), "last")).select("utt_id", "frame_idx", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


def stream_mvn(spark, d):
    return _drain(sf.running_mvn(_stream(spark, d))).withColumn("v", F.round("v", 5))


def stream_windows(spark, d):
    return _drain(sf.windowed_means(_stream(spark, d), "1 hour", "30 minutes"), "update", ("start", "utt_id")).withColumn("mean", F.round("mean", 6))


def stream_segment(spark, d):
    return _drain(sf.speech_sessions(_stream(spark, d), 20.0, "2 hours"), "complete")


Q.update(stream_framing=stream_framing, stream_flush=stream_flush, stream_mvn=stream_mvn, stream_windows=stream_windows, stream_segment=stream_segment)
SQL.update(
    stream_flush="""WITH e AS (SELECT user_id AS utt_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v FROM events),
c AS (SELECT DISTINCT utt_id, CASE WHEN n >= 16 THEN (n - 16) // 10 + 2 ELSE 1 END AS c FROM e)
SELECT e.utt_id, k AS frame_idx, round(sum(v), 5) AS total FROM e JOIN c USING (utt_id), LATERAL unnest(generate_series(0, c - 1)) AS t(k) WHERE i >= k * 10 AND i < k * 10 + 16 GROUP BY e.utt_id, k""",
    stream_mvn="""WITH r AS (SELECT user_id AS utt_id, ts, value AS v, count(*) OVER w AS n, sum(value) OVER w AS s1, sum(value * value) OVER w AS s2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) AS sd FROM r)
SELECT utt_id, ts, round(CASE WHEN n > 1 AND sd > 1e-12 THEN (v - s1 / n) / sd ELSE 0 END, 5) AS v FROM d""",
    stream_segment="""WITH l AS (SELECT user_id AS utt_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WHERE value > 20),
g AS (SELECT *, sum(cut) OVER (PARTITION BY utt_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", utt_id, count(*) AS n FROM g GROUP BY utt_id, g""",
    stream_framing="""WITH e AS (SELECT user_id AS utt_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v FROM events)
SELECT utt_id, k AS frame_idx, round(sum(v), 5) AS total FROM e, LATERAL unnest(generate_series(0, 1 + n // 10)) AS t(k) WHERE i >= k * 10 AND i < k * 10 + 16 AND k * 10 + 16 <= n GROUP BY utt_id, k""",
    stream_windows="""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE AS start, user_id AS utt_id, count(*) AS n, round(avg(value), 6) AS mean FROM events, (VALUES (0), (1)) AS s(k) GROUP BY ALL""",
)
