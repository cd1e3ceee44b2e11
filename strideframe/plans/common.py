"""Frames derived from the driver's tables, in Spark and in SQL, for the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strideframe.operators import frames as fr
from strideframe.session import table

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
LINE_VALUES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """One-dimensional frames: a user's events in time order."""
    return fr.to_frames(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), ("value",), *keep)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-dimensional samples of class c: a supplier's line items."""
    return fr.to_frames(table(spark, sf_dir, "lineitem"), "l_suppkey", LINE_ORDER, LINE_VALUES, F.col("l_returnflag").alias("c"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-dimensional samples: the embeddings of a label."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return rows.select(F.col("label").alias("utt_id"), number.cast("long").alias("frame_idx"), F.col("embedding").alias("x"), F.col("label").alias("c"), "vec_id")


E_SQL = "e AS (SELECT user_id AS utt_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS v, event_type FROM events)"
L_SQL = """l AS (SELECT l_suppkey AS utt_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS frame_idx,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS x, l_returnflag AS c FROM lineitem),
ll AS (SELECT utt_id, frame_idx, c, d - 1 AS dim, x[d] AS v FROM l, LATERAL unnest(generate_series(1, 4)) AS t(d))"""
V_SQL = """vv AS (SELECT vec_id, label AS utt_id, label AS c, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS x FROM embeddings),
vl AS (SELECT vec_id, utt_id, c, frame_idx, d - 1 AS dim, x[d] AS v FROM vv, LATERAL unnest(generate_series(1, 64)) AS t(d))"""
