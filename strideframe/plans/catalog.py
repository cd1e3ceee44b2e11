"""The driver's queries over the frame engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideframe.operators import context as cx, frames as fr
from strideframe.plans import common, frame_queries, io_queries, model_queries, signal_queries, stat_queries, stream_queries, text_queries

MODULES = (frame_queries, stat_queries, model_queries, signal_queries, text_queries, stream_queries, io_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frames: turn-wise normalisation, deltas, then the frames with energy above a threshold."""
    normal = cx.mvn(common.lines(spark, sf_dir)).drop("c")
    moved = cx.slopes(normal, cx.parse_slopes("3:1")[1])
    return fr.long_form(fr.energy_filter(moved, 4.0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
