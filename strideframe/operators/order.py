"""Running totals over a whole table in the order of a key, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one window task sorts, and the most tasks (their totals meet in one small window).
PER_PART, MOST_PARTS = 100_000, 1024


def _range_of(key: Column, bounds: list) -> Column:
    """How many bounds are at most the key, by halving."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def total_before(rows: DataFrame, key: str, value: Column | str, out: str = "before", per_part: int = PER_PART) -> DataFrame:
    """rows with the sum of value over all rows of smaller keys. Keys are distinct and not null.

    A sample of keys, drawn by their hash, gives the bounds of ranges; ranges are summed up by a window within each and
    a window over their totals. The sample moves bounds only, so the result does not depend on it.
    """
    value = F.col(value) if isinstance(value, str) else value
    n = rows.count()
    parts = min(MOST_PARTS, -(-n // per_part))
    bounds: list = []
    if parts > 1:
        share = max(1, n // (64 * parts))  # about 64 keys a part reach the driver
        drawn = sorted(r[0] for r in rows.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(key).collect())
        bounds = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
    part = rows.withColumns({"_part": _range_of(F.col(key), bounds), "_value": value})
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_value").over(earlier("_part").orderBy(key)), F.lit(0))
    # At most MOST_PARTS rows.
    totals = part.groupBy("_part").agg(F.sum("_value").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(earlier(F.lit(0)).orderBy("_part")), F.lit(0)).alias("_first"))
    return part.withColumn("_inside", inside).join(F.broadcast(totals), "_part").withColumn(out, F.col("_first") + F.col("_inside")).drop("_part", "_value", "_inside", "_first")
