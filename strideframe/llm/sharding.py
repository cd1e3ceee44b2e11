"""Sharding by sampled splitters: records are dealt by size into shards of nearly equal bytes, equal texts together.

A record's key is a hash of its text. A sample of keys, drawn with a chance in proportion to size, gives quantile
boundaries; records are range-partitioned between them. Ranges that turn out overfull, as all do in a large corpus, are
subdivided at equal steps of the key.

Groups of equal texts that weigh more than ``LARGE`` of a shard are placed first, the heaviest first, each whole into
the shard with most room left. Only a group that no shard has room for is cut: it fills
that shard and goes on in the next one, its records in the order of ids. So groups are kept whole as far as nearly equal
sizes allow. All other records stand in one line, in the order of keys, and each shard takes what room it has left: the
shard is the one in which a record's group of equal texts begins. Sizes differ from their mean by at most ``LARGE`` of a
shard and two records. ``slot`` numbers the records of a shard from 0 without gaps: those of the line first, then large
groups by key, each by id.

Defined results: size is the text's UTF-8 bytes plus 1 (a null text: 1, and no CRC). Null ids and repeated rows are
dealt like all others; repeated rows get a slot each. An empty table gives no rows. Only the id and text columns are
read, so other columns may have any name; they are not carried.

Scale: after the text is measured, only (id, size, hashes) move: one exchange by bucket, with a window per bucket of at
most about ``RANGE_BYTES`` of text, a large group being spread over buckets by sampled splitters of its ids. On the driver are the
sample (bounded), the totals of ranges, of buckets (one per RANGE_BYTES) and of large groups (at most shards / LARGE).
The sample moves boundaries of ranges only, never records between shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.llm.common import Scratch, quoted

SHARDS, RANGES, SAMPLE, LARGE = 16, 192, 6000, 0.02
#: Bytes of text whose records one window task sorts: some two million records of 2 KB.
RANGE_BYTES = 4 << 30
#: Keys are the first 60 bits of a SHA-256; ranges are numbered in steps of _PARTS, those of large groups from _FIRST_LARGE on.
_KEYS, _PARTS, _FIRST_LARGE = 1 << 60, 1 << 24, 1 << 50


def _key(digest: Column, start: int) -> Column:
    """15 hexadecimal digits of a digest as a number; 0 where there is no text."""
    return F.coalesce(F.conv(F.substring(digest, start, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def _search(key: Column, splitters: list) -> Column:
    """How many splitters are at most the key: a balanced tree of comparisons, so log2 steps a row."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < splitters[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(splitters))


def _pack(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Pieces (group, from, to, shard) of the groups (number, bytes), and the room left in each shard."""
    room, pieces = [total / shards] * shards, []
    for g, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < size:
            s = max(range(shards), key=lambda k: (room[k], -k))
            take = size - at if size - at <= room[s] else max(1, math.ceil(room[s]))
            pieces.append((g, at, at + take, s))
            room[s] -= take
            at += take
    return pieces, room


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges: int = RANGES,
    sample: int = SAMPLE, large: float = LARGE, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every record; the law is ``bytes``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(quoted(text_col))
    rows = scratch.keep(docs.select(
        F.col(quoted(id_col)).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
    ).select("doc_id", "size", "text_crc32", _key(F.col("digest"), 1).alias("key"), _key(F.col("digest"), 16).alias("key2")))
    total = rows.agg(F.sum("size")).first()[0] or 0

    # A size-weighted sample of about ``sample`` keys: its length is bounded by the parameter, whatever the input.
    chance = F.col("size") * (sample / max(total, 1))
    u = F.pmod(F.xxhash64(F.lit("sample"), "key", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter(u < chance).select("key", "key2", "doc_id").collect()
    keys = sorted(r["key"] for r in drawn)
    splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else [])

    # Groups of copies that weigh more than ``large`` of a shard: fewer than shards / large of them.
    heavy = rows.groupBy("key", "key2").agg(F.sum("size").alias("b"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("b") > large * total / shards))
    heavy = sorted(heavy.collect(), key=lambda r: (r["key"], r["key2"]))
    pieces, room = _pack([(g, r["b"]) for g, r in enumerate(heavy)], shards, total)
    fair = max(1.0, min(total / ranges, range_bytes))
    known = spark.createDataFrame([(r["key"], r["key2"], g) for g, r in enumerate(heavy)], "key long, key2 long, g int")
    ranged = rows.withColumn("range", _search(F.col("key"), splitters)).join(F.broadcast(known), ["key", "key2"], "left")

    # Totals of at most ``ranges`` ranges; the overfull ones are cut into as many equal steps as they have fair shares.
    sums = {r["range"]: r["b"] for r in ranged.filter("g IS NULL").groupBy("range").agg(F.sum("size").alias("b")).collect()}
    bounds = [0, *splitters, _KEYS]
    steps = [(r, float(bounds[r]), float(bounds[r + 1] - bounds[r]), math.ceil(b / fair)) for r, b in sums.items() if b > 2 * fair and bounds[r + 1] > bounds[r]]
    cut_ranges = spark.createDataFrame(steps, "range int, low double, width double, parts int")
    part = F.least(F.floor((F.col("key") - F.col("low")) / F.col("width") * F.col("parts")), F.col("parts") - 1)
    small = F.col("range") * F.lit(_PARTS).cast("long") + F.coalesce(part, F.lit(0))

    # Large groups are cut by quantiles of the sampled ids, about thirty for each part; a null id comes first.
    ids: dict[tuple, list] = {}
    for r in drawn:
        ids.setdefault((r["key"], r["key2"]), []).append(r["doc_id"])
    own_part = F.lit(0)
    for g, r in enumerate(heavy):
        n, known_ids = math.ceil(r["b"] / fair), sorted(i for i in ids.get((r["key"], r["key2"]), []) if i is not None)
        if n > 1 and known_ids:
            cuts = sorted({known_ids[len(known_ids) * k // n] for k in range(1, n)})
            own_part = F.when(F.col("g") == g, F.when(F.col("doc_id").isNull(), 0).otherwise(_search(F.col("doc_id"), cuts))).otherwise(own_part)
    large_bucket = F.lit(_FIRST_LARGE) + F.col("g") * F.lit(_PARTS).cast("long") + own_part
    dealt = ranged.join(F.broadcast(cut_ranges), "range", "left").withColumn("bucket", F.coalesce(large_bucket, small).cast("long"))

    # Bytes before each bucket in its line: that of the small records, or of its large group.
    totals = dealt.groupBy("bucket", "g").agg(F.sum("size").alias("b")).collect()
    before, at, line = [], 0, None
    for r in sorted(totals, key=lambda r: (-1 if r["g"] is None else r["g"], r["bucket"])):
        at, line = 0 if r["g"] != line else at, r["g"]
        before.append((r["bucket"], at))
        at += r["b"]
    offsets = spark.createDataFrame(before, "bucket long, before long")
    inside = Window.partitionBy("bucket").orderBy("key", "key2", "doc_id")
    upto = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(offsets), "bucket").withColumns({"rn": F.row_number().over(inside), "own": F.col("before") + upto})
    placed = placed.withColumn("start", F.when(F.col("g").isNotNull(), F.col("own")).otherwise(F.min("own").over(Window.partitionBy("bucket", "key", "key2"))))
    cuts, at = [], 0.0
    for r in room:
        at += max(0.0, r)
        cuts.append(math.ceil(at))
    in_line = F.least(F.lit(shards - 1), _search(F.col("start"), cuts[:-1]))
    cut = spark.createDataFrame(pieces, "piece int, begin long, end long, own_shard int")
    placed = placed.join(F.broadcast(cut), (F.col("g") == F.col("piece")) & (F.col("start") >= F.col("begin")) & (F.col("start") < F.col("end")), "left")
    placed = scratch.keep(placed.select("doc_id", "size", "text_crc32", "bucket", "rn", F.coalesce("own_shard", in_line).cast("int").alias("shard")))
    scratch.drop(rows)

    # Where each shard's records begin in each bucket: one entry per bucket, and per shard that begins inside one.
    runs = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"), F.min("rn").alias("first")).orderBy("shard", "bucket").collect()
    bases, at, of = [], 0, None
    for r in runs:
        at = at if r["shard"] == of else 0
        of = r["shard"]
        bases.append((r["shard"], r["bucket"], at - r["first"]))
        at += r["n"]
    base = spark.createDataFrame(bases, "shard int, bucket long, base long")
    return placed.join(F.broadcast(base), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
