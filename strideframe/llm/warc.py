"""WARC records and a Merkle fixity audit of their replicas.

Pages become WARC records, ordered by id into files of ``per_file`` ids; a record's offset is the bytes before it. Each
replica's manifest is made from its own records: places, offset ranges and digests. The audit hashes them into a tree:
a leaf covers the records of one slot of a file (a slot is a remainder of the id, so that a lost or added record moves
no other to another leaf), with their ordered offset ranges, taken from the leaf's own begin, and digests; a node covers
up to ``fanout`` nodes below it with their order, bytes and digests, up through files and groups of files to one root.
Two replicas are compared from the root down: of each level only the children of mismatching nodes are joined, to the
leaves that differ; there records of one id and URL are paired, equal ones first, the rest in their order.

Defined results: a null URL or page is written as an empty one; a null id goes to a file chosen by its URL's hash.
Repeated ids and repeated rows are records of their own, in the order of URL and digest. Extra columns are not read.
Two empty replicas have no roots and no differences. A record that the copy lacks is ``missing``, one that only the
copy has is ``extra``, one with other bytes ``corrupt``; a record that only stands at another offset is not a difference.

Scale: record bytes never move, only digests of them (64 bytes a record, less for each next level). Ids that repeat so
often that a file has more than ``OVERFULL`` times its records are dealt over files of their own by a hash of URL and
page, so that files are bounded as long as rows equal in all three are few. The levels are as many as log(records) /
log(fanout), the deepest joins are limited to what lies under damaged nodes. Levels are written to the shared folder and
survive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strideframe.llm.common import BROADCAST_BYTES, Scratch

PER_FILE, FANOUT, OVERFULL = 256, 16, 16
_PARTS = 40  # files of overfull ids are numbered above this bit


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 resource record as text, UTF-8 byte for byte."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def to_records(pages: DataFrame, per_file: int = PER_FILE, overfull: int = OVERFULL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(file, page_id, url, record) for every page."""
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url"), F.lit(1 << 20))).cast("long")
    rows = pages.select(file.alias("file"), "page_id", "url", "html")
    many = rows.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > overfull * per_file)
    many = many.select("file", F.ceil(F.col("n") / per_file).alias("parts"))
    few = many.count() * 32 <= broadcast_bytes
    dealt = rows.join(F.broadcast(many) if few else many, "file", "left")
    part = F.coalesce(F.shiftleft(F.pmod(F.xxhash64("url", "html"), F.col("parts")) + 1, _PARTS), F.lit(0))
    return dealt.select((F.col("file") + part).alias("file"), "page_id", "url", record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def manifest(records: DataFrame) -> DataFrame:
    """(file, ord, page_id, url, start, stop, digest): place, offset range and SHA-256 of every record of a replica."""
    hashed = records.select("file", "page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    upto = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return hashed.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("ord"), "page_id", "url", (upto - F.col("length")).alias("start"), upto.alias("stop"), "digest",
    )


def _slot(per_file: int) -> Column:
    return F.pmod(F.coalesce(F.col("page_id"), F.xxhash64("url")), F.lit(per_file)).cast("long").alias("idx")


def _hashed(children: Column) -> Column:
    """The digest of ordered (order, length, digest), each with the bytes before it."""
    text = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["at"].cast("string"), x["length"].cast("string"), x["digest"])), ",")
    return F.sha2(text, 256).alias("digest")


def _above(nodes: DataFrame, group: list[str], idx: Column) -> DataFrame:
    """The next level: nodes (*group, idx, length, digest) of the children under each new index."""
    packed = nodes.withColumn("parent", idx).groupBy(*group, "parent").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "length", "digest"))).alias("c"), F.sum("length").alias("length"))
    return packed.select(*group, F.col("parent").alias("idx"), "length", _hashed(F.col("c")))


class Tree:
    """Levels from leaves up to one root. Below the file level nodes are keyed by (file, idx), above by idx alone."""

    def __init__(self, listed: DataFrame, scratch: Scratch, per_file: int, fanout: int, depth: int | None = None):
        up = F.floor(F.col("idx") / fanout).cast("long")
        # The ordered ranges of a leaf's records, from its own begin.
        begin = F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy("file", "idx").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
        placed = listed.select("file", _slot(per_file), "ord", "start", "stop", "digest").withColumn("at", F.coalesce(begin, F.lit(0)))
        leaves = placed.groupBy("file", "idx").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("stop") - F.col("start")).alias("length"), "digest"))).alias("c"), F.sum(F.col("stop") - F.col("start")).alias("length"))
        self.levels = [scratch.keep(leaves.select("file", "idx", "length", _hashed(F.col("c"))))]
        width = per_file
        while width > 1:
            self.levels.append(scratch.keep(_above(self.levels[-1], ["file"], up)))
            width = -(-width // fanout)
        self.in_file = len(self.levels)
        # Files are numbered from 0 on, those below zero in between, so that there is one root.
        self.levels.append(scratch.keep(self.levels[-1].select(_numbered().alias("idx"), "length", "digest")))
        while depth is None and self.levels[-1].limit(2).count() > 1 or depth is not None and len(self.levels) < depth:
            self.levels.append(scratch.keep(_above(self.levels[-1], [], up)))

    def root(self) -> list:
        """(idx, digest) of the top level."""
        return sorted((r["idx"], r["digest"]) for r in self.levels[-1].select("idx", "digest").limit(2).collect())


def _numbered() -> Column:
    return F.when(F.col("file") >= 0, F.col("file") * 2).otherwise(-2 * F.col("file") - 1)


def audit(kept: DataFrame, copy: DataFrame, per_file: int = PER_FILE, fanout: int = FANOUT) -> DataFrame:
    """The records of two manifests that differ: (file, page_id, url, ord, start, stop, digest, copy_ord, copy_start, copy_stop, copy_digest, status).

    The status is corrupt, missing (in the copy) or extra; what is missing or extra has no place on the other side.
    """
    spark = kept.sparkSession
    scratch = Scratch(spark, "fixity")
    a, b = Tree(kept, scratch, per_file, fanout), Tree(copy, scratch, per_file, fanout)
    while len(a.levels) != len(b.levels):
        low, high = sorted((a, b), key=lambda t: len(t.levels))
        while len(low.levels) < len(high.levels):
            low.levels.append(scratch.keep(_above(low.levels[-1], [], F.floor(F.col("idx") / fanout).cast("long"))))
    same = a.root() == b.root()
    wrong = None
    for k in range(len(a.levels) - 1, -1, -1) if not same else ():
        keys = ["file", "idx"] if k < a.in_file else ["idx"]
        x, y = a.levels[k], b.levels[k]
        if wrong is not None:
            if k == a.in_file - 1:
                up, on = wrong.select(F.col("idx").alias("up")), ["up"]
                x, y = (t.withColumn("up", _numbered()) for t in (x, y))
            else:
                on = [*keys[:-1], "up"]
                up = wrong.select(*keys[:-1], F.col("idx").alias("up"))
                x, y = (t.withColumn("up", F.floor(F.col("idx") / fanout).cast("long")) for t in (x, y))
            x, y = (t.join(up, on, "left_semi") for t in (x, y))
        met = x.select(*keys, F.col("digest").alias("was")).join(y.select(*keys, F.col("digest").alias("now")), keys, "full_outer")
        wrong = scratch.keep(met.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keys))
    if wrong is None:
        wrong = spark.createDataFrame([], "file long, idx long")
    found = _paired(*(t.withColumn("idx", _slot(per_file)).join(wrong, ["file", "idx"], "left_semi") for t in (kept, copy)))
    out = scratch.keep(found)
    scratch.drop(wrong, *a.levels, *b.levels)
    return out


def _paired(x: DataFrame, y: DataFrame) -> DataFrame:
    """The records of two sides that have no equal one, met by id and URL in their order."""
    place = ["ord", "start", "stop", "digest"]
    # Nulls are told from empty URLs and from any id.
    key = F.to_json(F.struct(F.col("page_id"), F.col("url"))).alias("key")
    sides = [t.select("file", key, "page_id", "url", *place) for t in (x, y)]
    nth = F.row_number().over(Window.partitionBy("file", "key", "digest").orderBy("ord"))
    sides = [t.withColumn("nth", nth) for t in sides]
    equal = ["file", "key", "digest", "nth"]
    left = [sides[i].join(sides[1 - i].select(*equal), equal, "left_anti") for i in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("file", "key").orderBy("ord"))
    was, now = (t.select("file", "key", turn.alias("turn"), F.struct("page_id", "url", *place).alias(name)) for t, name in zip(left, ("was", "now"), strict=True))
    met = was.join(now, ["file", "key", "turn"], "full_outer")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").otherwise("corrupt")
    either = lambda c: F.when(F.col("was").isNotNull(), F.col("was")[c]).otherwise(F.col("now")[c]).alias(c)
    return met.select("file", either("page_id"), either("url"), *[F.col("was")[c].alias(c) for c in place], *[F.col("now")[c].alias(f"copy_{c}") for c in place], status.alias("status"))


def write_warc(records: DataFrame, path: str) -> None:
    """One folder per file with the records in order, byte for byte, through Spark's text writer."""
    digest = F.sha2("record", 256).alias("digest")
    ordered = records.select("file", "page_id", "url", "record", digest).repartition("file").sortWithinPartitions("file", "page_id", "url", "digest")
    # A record ends with a newline; the writer sets it as the line's end.
    ordered.select("file", F.expr("left(record, length(record) - 1)").alias("record")).write.partitionBy("file").option("lineSep", "\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, stop, url, record, html) of every record of WARC files: header lines, then Content-Length bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                found, at = [], 0
                while (head := data.find(b"\r\n\r\n", at)) >= 0:
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head].decode().split("\r\n")[1:])}
                    stop = head + 4 + int(fields.get("content-length", 0))
                    found.append((name, at, stop + 4, fields.get("warc-target-uri"), bytes(data[at : stop + 4]), bytes(data[head + 4 : stop])))
                    at = stop + 4
                yield pd.DataFrame(found, columns=["path", "start", "stop", "url", "record", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, start long, stop long, url string, record binary, html binary")
