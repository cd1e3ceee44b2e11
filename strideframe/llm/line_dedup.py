"""Line dedup over a whole corpus by a deletion-neighbourhood join; the earliest of equal or nearly equal lines stays.

Lines are what newlines separate; words are what space, tab, vertical tab, form feed and carriage return separate within
them. Lines are near if both have at least ``min_words`` words and one word edit (substitution, insertion or deletion)
or none makes their words equal. Of equal lines the first by (doc_id, line number) stays. A different line near to one
that starts earlier goes too, at all its places, whether or not that earlier line goes itself. Lines without words
stay. What is left of a document is joined again by newlines; a document that loses all lines with words has none.

The join: a line emits a hashed key for each of its words left out (with the place left out: a substitution is a pair
of lines equal without the same place) and one for itself as a whole (insertions and deletions are a whole line equal
to another with a word left out). Keys are XORs of 64-bit hashes of words at their places, so all variants of a line
cost one running XOR. Lines only emit variants if they share a half with another line: one edit leaves the first or
the second half as it was, so no near pair is lost, and most lines of a corpus share no half. A key's group is never
paired off: its earliest member by role is aggregated and joined back; each line that would go is then compared with
the earlier line word by word, and goes only if the edit distance is at most one.

Defined results: a null text has no lines and stays null. Ids may be of any type that has an order; a null id comes
after all ids. Where ids repeat, lines are earlier by number, then by a hash of their text; so rows of one id and
different texts are told apart, and rows equal in id and text keep the same lines. Extra columns of any name are kept
as they are. An empty table stays empty.

Scale: all keys are 64-bit; a key held by a third of all lines is pre-aggregated where it is read and meets its lines
in a plain equi-join, which adaptive execution splits. Texts move once, to meet their list of lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.llm.common import BROADCAST_BYTES, Scratch, fresh, let, quoted, running

MIN_WORDS = 8
#: Powers of two that hold a line number and the hash of a text in a position: 64 bits of id, 31 and 30 bits below them.
_LINES, _TEXTS = 1 << 31, 1 << 30


def line_words(line: Column) -> Column:
    """The words of a line."""
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _is_integral(df: DataFrame, id_col: str) -> bool:
    return df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _text_key(doc_id: Column, text: Column) -> Column:
    """Tells the texts of one id apart; equal keys of different texts do no harm, as lines are compared by hash as well."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(_TEXTS)).cast("int")


def _position(document: Column, doc_id: Column, line_no: Column, text_key: Column, integral: bool) -> Column:
    """One ordered value for (doc_id, line number, text key); null ids come last. A number for integral ids, else a struct."""
    if not integral:
        return F.struct(doc_id.isNull().alias("last"), doc_id.alias("id"), line_no.cast("long").alias("n"), text_key.cast("long").alias("t"))
    low = line_no.cast("long") * _TEXTS + text_key
    return (document + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def _document(doc_id: Column, integral: bool) -> Column:
    """What positions of equal ids have in common; never null."""
    if not integral:
        return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("none"))
    above = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (above.cast("decimal(38,0)") * F.lit(str(_LINES * _TEXTS)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _parts(pos: Column, integral: bool) -> tuple[Column, Column, Column]:
    """(document, line number, text key) of a position."""
    if not integral:
        return _document(pos["id"], False), pos["n"], pos["t"]
    low = F.pmod(pos, F.lit(str(_LINES * _TEXTS)).cast("decimal(38,0)")).cast("long")
    return (pos - low.cast("decimal(19,0)")).cast("decimal(38,0)"), F.shiftright(low, 30), low.bitwiseAND(F.lit(_TEXTS - 1))


def _half_keys(words: Column) -> Column:
    """Hashes of the halves that a line has in common with any line one edit away, on the side without the edit."""
    n = F.size(words)
    first = lambda k: F.xxhash64(F.lit("first"), F.slice(words, F.lit(1), k))
    last = lambda k: F.xxhash64(F.lit("last"), F.slice(words, n - k + 1, k))
    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    return F.array_distinct(F.array(first(low), first(high), last(high), last(F.floor((n + 2) / 2).cast("int"))))


def running_xor(values: Column) -> Column:
    """Element i is the XOR of all values up to i."""
    return running(values, lambda x, y: x.bitwiseXOR(y))


def variants(words: Column) -> Column:
    """Structs (key, kind) of a line: kind 0 the whole, 1 a word left out, 2 a word left out at that place."""
    at = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("own"), F.xxhash64(w, i - 1).alias("moved")))

    def keyed(at: Column) -> Column:
        whole = F.aggregate(at, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x["own"]))
        moved = F.aggregate(at, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x["moved"]))
        return let(F.struct(
            whole.alias("whole"), moved.alias("moved"), running_xor(F.transform(at, lambda x: x["own"].bitwiseXOR(x["moved"]))).alias("upto"),
        ), lambda t: _emit(at, t))

    return let(at, keyed)


def _emit(at: Column, t: Column) -> Column:
    n = F.size(at)
    # The words before i keep their place, those after it move up by one.
    without = F.transform(at, lambda x, i: t["upto"][i].bitwiseXOR(x["own"]).bitwiseXOR(t["moved"]))
    return let(without, lambda d: F.concat(
        F.array(F.struct(F.xxhash64(F.lit("edit"), n, t["whole"]).alias("key"), F.lit(0).alias("kind"))),
        F.transform(d, lambda x: F.struct(F.xxhash64(F.lit("edit"), n - 1, x).alias("key"), F.lit(1).alias("kind"))),
        F.transform(d, lambda x, i: F.struct(F.xxhash64(F.lit("place"), n, i, x).alias("key"), F.lit(2).alias("kind"))),
    ))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word edit apart."""
    def longer(x: Column, y: Column) -> Column:
        same = F.zip_with(F.slice(x, F.lit(1), F.size(y)), y, lambda p, q: p == q)
        return let(F.array_position(same, False), lambda p: (p == 0) | (
            F.slice(x, (p + 1).cast("int"), F.size(x)) == F.slice(y, p.cast("int"), F.size(y))
        ))

    diff = F.size(F.filter(F.zip_with(a, b, lambda p, q: p == q), lambda same: ~same))
    return F.when(F.size(a) == F.size(b), diff <= 1).when(F.size(a) == F.size(b) + 1, longer(a, b)).when(F.size(b) == F.size(a) + 1, longer(b, a)).otherwise(False)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pos, line, h1, h2) of every line that has a word."""
    integral, doc_id, text = _is_integral(docs, id_col), F.col(quoted(id_col)), F.col(quoted(text_col))
    # What is the same for all lines of a text is computed before they are listed.
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), _text_key(doc_id, text).alias("t"), _document(doc_id, integral).alias("of"))
    rows = rows.select("doc_id", "of", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        _position(F.col("of"), F.col("doc_id"), F.col("line_no"), F.col("t"), integral).alias("pos"), "line",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
    )


def near_duplicates(first: DataFrame, lines: DataFrame, scratch: Scratch, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(pos) of the distinct lines to drop. first: (h1, h2, pos, halves) with halves null for short lines."""
    keyed = first.filter("halves IS NOT NULL").select("pos", "h1", "h2", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    chosen = scratch.keep(keyed.join(shared, "half").select("pos", "h1", "h2").distinct())
    few = chosen.count() * 64 <= broadcast_bytes
    found = lines.join(F.broadcast(chosen) if few else chosen, ["pos", "h1", "h2"]).select("pos", "h1", "h2", line_words(F.col("line")).alias("words"))
    found = scratch.keep(found.dropDuplicates(["pos", "h1", "h2"]))
    emitted = scratch.keep(found.select("pos", "h1", "h2", F.explode(variants(F.col("words"))).alias("v")).select("pos", "h1", "h2", "v.key", "v.kind"))
    least = lambda k: F.min(F.when(F.col("kind") == k, F.col("pos")))
    # Few keys occur twice: they are counted by themselves, and only their variants move on with their places.
    twice = scratch.keep(emitted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    few = twice.count() * 32 <= broadcast_bytes
    met = scratch.keep(emitted.join(F.broadcast(twice) if few else twice, "key", "left_semi"))
    scratch.drop(chosen, emitted, twice)
    groups = scratch.keep(met.groupBy("key").agg(
        least(0).alias("whole"), least(1).alias("less"), least(2).alias("place"), F.max(F.when(F.col("kind") == 2, F.col("pos"))).alias("last"),
    ).filter("(whole IS NOT NULL AND less IS NOT NULL) OR place < last"))
    earlier = F.when(F.col("kind") == 0, F.col("less")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("place"))
    pairs = met.join(groups, "key").select("pos", "h1", "h2", earlier.alias("partner")).filter("partner < pos").distinct()
    # A place has two lines only where texts of one id have equal keys; then any of them that is near counts.
    own = found.select("pos", "h1", "h2", F.col("words").alias("own_words"))
    theirs = found.select(F.col("pos").alias("partner"), F.col("words").alias("their_words"))
    checked = pairs.join(own, ["pos", "h1", "h2"]).join(theirs, "partner")
    near = scratch.keep(checked.filter(within_one_edit(F.col("own_words"), F.col("their_words"))).select("pos", "h1", "h2").distinct())
    scratch.drop(found, met, groups)
    return near


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the text that is left; nothing else changes."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _lines(docs, id_col, text_col)
    halves = let(line_words(F.col("line")), lambda w: F.when(F.size(w) >= min_words, _half_keys(w)))
    k = [F.get("halves", F.lit(i)) for i in range(4)]
    counted = lines.select("pos", "h1", "h2", halves.alias("halves")).select("pos", "h1", "h2", *[c.alias(f"k{i}") for i, c in enumerate(k)])
    first = counted.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    first = scratch.keep(first.select("h1", "h2", "pos", F.when(F.col("k0").isNotNull(), F.array_compact(F.array(*[f"k{i}" for i in range(4)]))).alias("halves")))
    near = near_duplicates(first, lines, scratch, broadcast_bytes)
    stays = first.join(near.withColumn("gone", F.lit(True)), ["h1", "h2", "pos"], "left").filter("gone IS NULL")
    integral, doc_id, text = _is_integral(docs, id_col), F.col(quoted(id_col)), F.col(quoted(text_col))
    of, which, stay, line, number = fresh(docs, "of", "which", "stay", "h1", "n")
    document, n, t = _parts(F.col("pos"), integral)
    kept = F.struct(n.cast("int").alias(number), F.col("h1").alias(line))
    numbers = scratch.keep(stays.select(document.alias(of), t.cast("int").alias(which), kept.alias(stay)).groupBy(of, which).agg(F.array_sort(F.collect_set(stay)).alias(stay)))
    # The lists stand by themselves, so that the lines' table is gone before the texts move.
    scratch.drop(first, near)

    left = let(F.split(text, "\n"), lambda ps: let(
        F.array_sort(F.concat(
            F.transform(F.filter(F.coalesce(F.col(stay), F.array().cast(f"array<struct<{number}:int,{line}:bigint>>")), lambda s: F.xxhash64(F.get(ps, s[number])) == s[line]), lambda s: s[number]),
            F.filter(F.transform(ps, lambda p, i: F.when(~p.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()),
        )), lambda at: F.array_join(F.transform(at, lambda i: F.get(ps, i)), "\n"),
    ))
    joined = docs.withColumns({of: _document(doc_id, integral), which: _text_key(doc_id, text)}).join(numbers, [of, which], "left")
    return joined.select(*[F.when(text.isNotNull(), left).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])
