"""Trees of tokens in context as tables ``(token, left, right, ...)``: linking, pruning, and statistics moved along the links.

A node is a centre token between the tokens to its left and right. One with less context generalises another if its left
context ends that one's left and its right context begins that one's right. Every step is a join on whole contexts or on
links; depths are bounded by the context, so levels are walked by a fixed number of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.operators.lexicon import context_name
from strideframe.operators.order import total_before


def uid(left: str = "left", token: str = "token", right: str = "right") -> Column:
    """The name of a node."""
    return context_name(F.col(left), F.col(token), F.col(right))


def link(tokens: DataFrame) -> DataFrame:
    """tokens with ``uid`` and ``parent``: the node that generalises it and has the most context, at equal size the most to its right.

    Roots have no parent. Each node is expanded into its own shorter contexts, which meet the nodes by an equi-join.
    """
    nodes = tokens.withColumn("uid", uid())
    upto = lambda c: F.sequence(F.lit(0), F.size(c))
    less = nodes.select("uid", "token", "left", "right", F.explode(upto("left")).alias("l")).select("*", F.explode(upto("right")).alias("r"))
    less = less.filter((F.col("l") < F.size("left")) | (F.col("r") < F.size("right"))).select(
        "uid", "l", "r", context_name(F.slice("left", F.size("left") - F.col("l") + 1, F.col("l")), F.col("token"), F.slice("right", F.lit(1), F.col("r"))).alias("parent"),
    )
    found = less.join(nodes.select(F.col("uid").alias("parent")).distinct(), "parent")
    best = found.groupBy("uid").agg(F.max_by("parent", F.struct(F.col("l") + F.col("r"), "r")).alias("parent"))
    return nodes.join(best, "uid", "left")


def prune_single(linked: DataFrame, levels: int) -> DataFrame:
    """Without nodes that are the only child of their parent; their children move up. levels: the depth of the tree."""
    only = linked.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n"), F.first("uid").alias("uid")).filter("n = 1").select(F.col("uid").alias("gone"), F.col("parent").alias("above"))
    kept = linked.join(only, linked["uid"] == only["gone"], "left_anti")
    for _ in range(levels):
        kept = kept.join(only, kept["parent"] == only["gone"], "left").withColumn("parent", F.coalesce("above", "parent")).drop("gone", "above")
    return kept


def prune_rare(linked: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Roots, and nodes that occur often enough. counts: (uid, n) with descendants added, so what is above a kept node is kept."""
    return linked.join(counts, "uid", "left").filter(F.col("parent").isNull() | (F.coalesce("n", F.lit(0)) >= least)).drop("n")


def reduce_context(linked: DataFrame, most: int) -> DataFrame:
    """Roots, and nodes with at most so many tokens on either side."""
    return linked.filter(F.col("parent").isNull() | ((F.size("left") <= most) & (F.size("right") <= most)))


def propagate(linked: DataFrame, stats: DataFrame, levels: int) -> DataFrame:
    """(uid, n): each node's n with those of all nodes below it. stats: (uid, n)."""
    up = linked.select("uid", "parent")
    total = moving = linked.select("uid").join(stats, "uid", "left").select("uid", F.coalesce("n", F.lit(0)).alias("n"))
    for _ in range(levels):
        moving = moving.join(up, "uid").filter("parent IS NOT NULL").groupBy(F.col("parent").alias("uid")).agg(F.sum("n").alias("n"))
        total = total.union(moving)
    return total.groupBy("uid").agg(F.sum("n").alias("n"))


def interpolate(linked: DataFrame, stats: DataFrame, rho: float, levels: int) -> DataFrame:
    """(uid, v): from the roots down, v = r * parent's v + (1 - r) * own v with r = rho / (rho + mass). stats: (uid, mass, v)."""
    rows = linked.select("uid", "parent").join(stats, "uid")
    done = rows.filter("parent IS NULL").select("uid", "v")
    last = done
    share = F.lit(float(rho)) / (F.lit(float(rho)) + F.col("mass"))
    for _ in range(levels):
        above = last.select(F.col("uid").alias("parent"), F.col("v").alias("pv"))
        last = rows.join(above, "parent").select("uid", (share * F.col("pv") + (1 - share) * F.col("v")).alias("v"))
        done = done.union(last)
    return done


def depth(linked: DataFrame, levels: int) -> DataFrame:
    """(uid, depth): 0 for roots."""
    up = linked.select("uid", "parent")
    at = up.withColumn("depth", F.lit(0))
    for _ in range(levels):
        step = up.select(F.col("uid").alias("parent"), F.col("parent").alias("next"))
        at = at.join(step, "parent", "left").select("uid", F.col("next").alias("parent"), (F.col("depth") + F.col("parent").isNotNull().cast("int")).alias("depth"))
    return at.select("uid", "depth")


def traverse(linked: DataFrame, levels: int) -> DataFrame:
    """(place, uid, depth) in depth-first order, siblings by name: the order of the names from each root down to the node."""
    up = linked.select("uid", "parent")
    rows = up.select("uid", F.array("uid").alias("path"), "parent")
    for _ in range(levels):
        step = up.select(F.col("uid").alias("parent"), F.col("parent").alias("next"))
        rows = rows.join(step, "parent", "left").select("uid", F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path"), F.col("next").alias("parent"))
    roots = rows.withColumn("root", F.col("path")[0])
    before = total_before(roots.groupBy("root").agg(F.count("*").alias("n")), "root", "n", "b").select("root", "b")
    inside = F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1
    return roots.withColumn("k", inside).join(before, "root").select((F.col("b") + F.col("k")).alias("place"), "uid", (F.size("path") - 1).alias("depth"))
