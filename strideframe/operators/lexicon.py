"""Alphabets, lexicons, context tokens and n-gram models as tables; look-ups are joins, probabilities are expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.operators.order import total_before
from strideframe.errors import OutOfVocabularyError

OOV = 0.001


def tokenize_words(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(utt_id, pos, word, tokens) of each turn's words; tokens is null for words that the lexicon lacks."""
    words = turns.select("utt_id", F.posexplode("words").alias("pos", "word"))
    return words.join(lexicon.select("word", "tokens"), "word", "left").select("utt_id", "pos", "word", "tokens")


def tokenize_sentences(turns: DataFrame, lexicon: DataFrame, check: bool = True) -> DataFrame:
    """(utt_id, tokens) of whole turns; a missing word is an error."""
    rows = tokenize_words(turns, lexicon)
    if check and (missing := rows.filter("tokens IS NULL").select("word").limit(1).collect()):
        raise OutOfVocabularyError(missing[0]["word"])
    packed = rows.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("p"))
    return packed.select("utt_id", F.flatten(F.transform("p", lambda p: p["tokens"])).alias("tokens"))


def oov_report(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, n) of the words that the lexicon lacks."""
    words = turns.select(F.explode("words").alias("word"))
    return words.join(lexicon.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


def token_contexts(sequences: DataFrame, width: int) -> DataFrame:
    """(utt_id, pos, token, left, right) for each token with growing contexts: right grows first, then left, up to width expansions.

    sequences: (utt_id, tokens).
    """
    t = F.col("tokens")
    rows = sequences.select("utt_id", "tokens", F.posexplode("tokens").alias("pos", "token"))
    sizes = [((k + 1) // 2, k // 2) for k in range(width + 1)]  # (right, left)
    variants = F.array(*[F.struct(
        F.slice(t, F.greatest(F.col("pos") - left + 1, F.lit(1)), F.least(F.lit(left), F.col("pos"))).alias("left"), F.slice(t, F.col("pos") + 2, right).alias("right"),
        ((F.col("pos") >= left) & (F.col("pos") + right < F.size(t))).alias("whole"),
    ) for right, left in sizes])
    return rows.select("utt_id", "pos", "token", F.explode(variants).alias("v")).filter("v.whole").select("utt_id", "pos", "token", "v.left", "v.right")


def context_name(left: Column, token: Column, right: Column) -> Column:
    """left / token / right as one string."""
    return F.concat_ws("/", F.concat_ws(" ", left), token, F.concat_ws(" ", right))


def prune_contexts(contexts: DataFrame, least: int) -> DataFrame:
    """(left, token, right, n) with at least so many occurrences; bare tokens stay."""
    counts = contexts.groupBy("left", "token", "right").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= least) | ((F.size("left") == 0) & (F.size("right") == 0)))


def longest_match(contexts: DataFrame, kept: DataFrame) -> DataFrame:
    """(utt_id, pos, token, left, right): for each place the kept context with the most tokens around it."""
    hit = contexts.join(kept.select("left", "token", "right"), ["left", "token", "right"])
    order = Window.partitionBy("utt_id", "pos").orderBy((F.size("left") + F.size("right")).desc(), F.size("right").desc())
    return hit.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def zerogram(lexicon: DataFrame, silences: dict[str, float]) -> DataFrame:
    """(word, p): silences as given, the rest of the mass evenly over the other words."""
    words = lexicon.select("word").distinct()
    given = F.coalesce(*[F.when(F.col("word") == w, F.lit(p)) for w, p in silences.items()], F.lit(None).cast("double"))
    others = words.filter(~F.col("word").isin(list(silences))).agg(F.count("*").alias("_n"))
    left = 1.0 - sum(silences.values())
    return words.crossJoin(F.broadcast(others)).select("word", F.coalesce(given, F.lit(left) / F.col("_n")).alias("p"))  # one row


def unigram(lexicon: DataFrame, ngrams: DataFrame, silences: dict[str, float]) -> DataFrame:
    """(word, p): n-gram probabilities, OOV for words without, rescaled to the mass that silences leave."""
    words = lexicon.select("word").distinct().filter(~F.col("word").isin(list(silences)))
    own = words.join(ngrams.filter("n = 1").select(F.col("words")[0].alias("word"), "p"), "word", "left").withColumn("p", F.coalesce("p", F.lit(OOV)))
    total = own.agg(F.sum("p").alias("_s"))
    return own.crossJoin(F.broadcast(total)).select("word", (F.col("p") * (1.0 - sum(silences.values())) / F.col("_s")).alias("p"))  # one row


def bigram(pairs: DataFrame, ngrams: DataFrame) -> DataFrame:
    """(w1, w2, p): the bigram if there is one, else the back-off weight of w1 times the unigram of w2."""
    two = ngrams.filter("n = 2").select(F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"), F.col("p").alias("p2"))
    one = ngrams.filter("n = 1")
    back = one.select(F.col("words")[0].alias("w1"), "backoff")
    uni = one.select(F.col("words")[0].alias("w2"), F.col("p").alias("p1"))
    rows = pairs.join(two, ["w1", "w2"], "left").join(back, "w1", "left").join(uni, "w2", "left")
    return rows.select("w1", "w2", F.coalesce("p2", F.coalesce("backoff", F.lit(1.0)) * F.coalesce("p1", F.lit(OOV))).alias("p"))


def sorted_lexicon(lexicon: DataFrame) -> DataFrame:
    """(place, word, tokens) in the order of words, which are distinct."""
    return total_before(lexicon.select("word", "tokens"), "word", F.lit(1), "place").select(F.col("place").cast("long").alias("place"), "word", "tokens")


def next_words(lexicon: DataFrame) -> DataFrame:
    """(word, next): each word with the one behind it in the sorted lexicon, null for the last."""
    rows = sorted_lexicon(lexicon).select("place", "word")
    return rows.join(rows.select((F.col("place") - 1).alias("place"), F.col("word").alias("next")), "place", "left").select("word", "next")


def estimate_ngrams(turns: DataFrame) -> DataFrame:
    """(n, words, p, backoff) of orders 1 and 2 by counts, with absolute discounting of half a count for bigrams."""
    words = F.col("words")
    ones = turns.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    total = ones.agg(F.sum("c").alias("t"))
    uni = ones.crossJoin(F.broadcast(total)).select("w", (F.col("c") / F.col("t")).alias("p"))  # one row
    pairs = turns.select(F.explode(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("q")).select("q.*").filter("b IS NOT NULL")
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("a")))
    two = cells.select("a", "b", ((F.col("c") - 0.5) / F.col("t")).alias("p"))
    seen = two.join(uni.select(F.col("w").alias("b"), F.col("p").alias("u")), "b").groupBy("a").agg(F.sum("p").alias("sp"), F.sum("u").alias("su"))
    back = seen.select(F.col("a").alias("w"), F.coalesce(F.try_divide(1 - F.col("sp"), 1 - F.col("su")), F.lit(1.0)).alias("backoff"))
    first = uni.join(back, "w", "left").select(F.lit(1).alias("n"), F.array("w").alias("words"), "p", "backoff")
    return first.union(two.select(F.lit(2).alias("n"), F.array("a", "b").alias("words"), "p", F.lit(None).cast("double").alias("backoff")))


def lexical_tree(lexicon: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(i, token, word, f): the nodes of a LexicalTree over the words that have a probability, in depth-first order.

    lexicon: (word, tokens), probabilities: (word, p). Nodes are the distinct token prefixes with summed masses; the root
    and the ends of words have no token, only ends have a word. Siblings are in the order of
    their tokens' code points, the end of a word before its longer ones.
    """
    words = lexicon.join(probabilities, "word").select("word", "tokens", "p")
    prefixes = words.select("p", F.explode(F.transform(F.sequence(F.lit(0), F.size("tokens")), lambda k: F.slice("tokens", 1, k))).alias("path"))
    nodes = prefixes.groupBy("path").agg(F.sum("p").alias("mass"))
    inner = nodes.select("path", F.lit(None).cast("string").alias("word"), "mass", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("above"))
    ends = words.select(F.col("tokens").alias("path"), "word", F.col("p").alias("mass"), F.col("tokens").alias("above"))
    rows = inner.union(ends).join(nodes.select(F.col("path").alias("above"), F.col("mass").alias("_m")), "above")
    share = F.when((F.col("mass") > 0) & (F.col("_m") > 0), F.log("mass") - F.log("_m")).otherwise(F.lit(float("-inf")))
    top = (F.size("path") == 0) & F.col("word").isNull()
    # Numbers from prefix sums over the groups of the first three tokens, which follow each other in this order.
    rows = rows.select("path", "word", F.when(top, F.lit(0.0)).otherwise(share).alias("f"), F.slice("path", 1, 3).alias("_g"))
    starts = rows.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_name", F.array_join("_g", "\x00"))
    starts = total_before(starts, "_name", "_n", "_s").select("_g", "_s")
    inside = F.row_number().over(Window.partitionBy("_g").orderBy("path", F.col("word").isNotNull(), "word")) - 1
    token = F.when(F.col("word").isNull() & (F.size("path") > 0), F.element_at("path", -1))
    return rows.withColumn("_r", inside).join(starts, "_g").select((F.col("_s") + F.col("_r")).cast("int").alias("i"), token.alias("token"), "word", "f")


@dataclass
class Node:
    """One token of the lexical tree; f is its language-model factor."""

    token: str | None
    word: str | None = None
    f: float = 0.0
    mass: float = 0.0
    children: list[Node] = field(default_factory=list)


class LexicalTree:
    """A prefix tree of the words that have a probability, with probabilities pushed toward the root."""

    def __init__(self, lexicon: dict[str, Sequence[str]], probabilities: dict[str, float]):
        self.root = Node(None)
        for word in sorted(w for w in lexicon if w in probabilities):
            at = self.root
            for token in lexicon[word]:
                nxt = next((c for c in at.children if c.token == token and c.word is None), None)
                if nxt is None:
                    nxt = Node(token)
                    at.children.append(nxt)
                at = nxt
            at.children.append(Node(None, word, mass=probabilities[word]))
        self.factor()

    def factor(self) -> None:
        """A node's mass is its children's sum; each child's factor is the log of its share."""
        import math

        order = self.dfs()
        for node in reversed(order):
            if node.children:
                node.mass = sum(c.mass for c in node.children)
        for node in order:
            for c in node.children:
                c.f = math.log(c.mass) - math.log(node.mass) if c.mass > 0 and node.mass > 0 else float("-inf")

    def dfs(self) -> list[Node]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += reversed(node.children)
        return out

    def bfs(self) -> list[Node]:
        out = [self.root]
        for node in out:
            out += node.children
        return out

    def leaves(self) -> list[Node]:
        return [n for n in self.dfs() if n.word is not None]

    def size(self) -> int:
        return len(self.dfs())

    def __str__(self) -> str:
        lines = []

        def walk(node: Node, depth: int) -> None:
            for c in node.children:
                lines.append("  " * depth + (c.word if c.word is not None else str(c.token)) + f" {c.f:.4f}")
                walk(c, depth + 1)

        walk(self.root, 0)
        return "\n".join(lines)
