"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes and confirmed by full digests.

A rule is (host, path, verdict). It fits a URL if the URL's host is the rule's host or one of its subdomains and the
URL's path starts with the rule's path. Every URL is expanded into its host suffixes (at label borders) times its path
prefixes (at the lengths that some rule has); an expression meets the rules by an equi-join on the first four bytes of
its SHA-256, and counts only if the whole digest is equal. Of the rules that fit, the longest (host and path
together) wins; of equally long ones the one with the longer host; of the same rule with both verdicts, block.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the default
verdict. Repeated rows are returned as often as they occur; a null id is an id like any other. Only the id and URL
columns are read, so other columns may have any name. No rules: every row gets the default verdict.

Scale: URLs never move for the join while the rules' digests fit BROADCAST_BYTES (measured, not assumed); beyond, the
rules are copied SALTS times and the expressions spread over the copies, so that an expression held by a third of all
rows (a hot host) goes to SALTS tasks. The rows of one URL meet again in a partial aggregate, one long per URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.llm.common import BROADCAST_BYTES, ascii_lower, quoted

SALTS = 32
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.filter(suffixes, lambda s: s != "")


def expressions(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Structs (text, rank base) of host suffix and path prefix; the rank orders by total length, then by host length."""
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda n: F.struct(
            F.concat(h, F.substring(path, 1, n)).alias("text"),
            (F.shiftleft((F.length(h) + n).cast("long"), 33) + F.shiftleft(F.length(h).cast("long"), 1)).alias("rank"),
        )))
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages. rules: (host, path, verdict allow or block)."""
    listed = rules.select(
        F.sha2(F.concat("host", "path"), 256).alias("digest"), (F.col("verdict") == "block").cast("long").alias("block"),
        F.length("path").alias("path_length"), F.col("host").alias("rule_host"),
    ).groupBy("digest", "rule_host").agg(F.max("block").alias("block"), F.first("path_length").alias("path_length"))
    # Lengths of rule paths: distinct small integers, at most as many as the longest path has characters.
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())
    n_rules = listed.count()
    listed = listed.select(F.substring("digest", 1, PREFIX_HEX).alias("prefix"), "digest", F.length("rule_host").alias("host_length"), "block")

    url = F.col(quoted(url_col))
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    if not lengths:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # The marker keeps each row once, whether or not an expression of it is listed.
    marker = F.array(F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("rank")))
    spread = rows.select("*", F.explode(F.concat(marker, expressions(F.col("host"), F.col("path"), lengths))).alias("e"))
    spread = spread.select("page_id", "host", "path", F.col("e.rank").alias("rank"), F.when(F.col("e.rank") > 0, F.sha2("e.text", 256)).alias("full"))
    spread = spread.withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    if n_rules * 128 <= broadcast_bytes:
        met = spread.join(F.broadcast(listed), "prefix", "left")
    else:
        copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = spread.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(copies, ["prefix", "salt"], "left")
    host_length = F.shiftright("rank", 1).bitwiseAND(F.lit((1 << 32) - 1))
    hit = F.when((F.col("full") == F.col("digest")) & (host_length == F.col("host_length")), F.col("rank") + F.col("block"))
    best = met.groupBy("page_id", "host", "path").agg(
        F.max(hit).alias("best"), F.sum((F.col("rank") == 0).cast("int")).alias("copies")
    )
    h = F.shiftright("best", 1).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    n = F.shiftright("best", 33).cast("int") - h
    out = best.select(
        "page_id", "host", "path",
        F.when(F.col("best").isNotNull(), F.concat(F.substring("host", F.length("host") - h + 1, h), F.substring("path", F.lit(1), n))).alias("rule"),
        F.when(F.col("best").isNull(), default).when(F.col("best").bitwiseAND(F.lit(1)) == 1, "block").otherwise("allow").alias("verdict"),
        "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
