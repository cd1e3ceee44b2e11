"""Utterance annotations and transcriptions: nested rows, cut and edited by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.functions.vectors import let

# Kinds of the annotation document; values are checked where documents are read.
BOUNDARIES, STRESS, ACCENTS = ("B2", "B3"), ("NONE", "PRIMARY", "SECONDARY"), ("NONE", "PRIMARY", "SECONDARY", "EXTRA")


def mood(orthography: Column) -> Column:
    """EXCLAMATION for ``!!``, COMMAND for ``!``, QUESTION for ``?`` at the end, else STATEMENT."""
    text = F.rtrim(orthography)
    return F.when(text.endswith("!!"), "EXCLAMATION").when(text.endswith("!"), "COMMAND").when(text.endswith("?"), "QUESTION").otherwise("STATEMENT")


def word_starts(orthography: Column, words: Column) -> Column:
    """Character offset of each word in the text, searched case-insensitively from the end of the word before; -1 if absent."""
    text = F.lower(orthography)
    return F.aggregate(
        words, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, w: let(_find(text, F.lower(w), acc["at"]), lambda p: F.struct(
            F.when(p >= 0, p + F.length(w)).otherwise(acc["at"]).alias("at"), F.concat(acc["found"], F.array(p)).alias("found"))),
        lambda acc: acc["found"],
    )


def _find(text: Column, word: Column, start: Column) -> Column:
    """0-based position of word at or after start, -1 if none."""
    hit = F.instr(F.substring(text, start + 1, F.length(text)), word)
    return F.when(hit > 0, hit - 1 + start).otherwise(-1).cast("int")


def slice_words(orthography: Column, starts: Column, first: Column | int, after: Column | int) -> Column:
    """The text of words first to after - 1, with what follows them up to the next word."""
    first, after = (v if isinstance(v, Column) else F.lit(v) for v in (first, after))
    begin = F.when(first == 0, F.lit(0)).otherwise(F.get(starts, first))
    end = F.coalesce(F.get(starts, after), F.length(orthography))
    return F.substring(orthography, begin + 1, end - begin)


def sub_utterance(utterances: DataFrame, first: int, after: int) -> DataFrame:
    """utterances cut to words first to after - 1: words, boundaries moved along (one at the end stays), text."""
    starts = word_starts(F.col("orthography"), F.transform("words", lambda w: w["graphemes"]))
    kept = F.filter("boundaries", lambda b: (b["index"] >= first) & (b["index"] <= after))
    return utterances.withColumns({
        "orthography": slice_words(F.col("orthography"), starts, first, after),
        "words": F.slice("words", first + 1, after - first),
        "boundaries": F.transform(kept, lambda b: b.withField("index", b["index"] - first)),
    })


def subdivision_bounds(utterances: DataFrame, start: int, end: int) -> DataFrame:
    """(first, after): word range of subdivisions start to end, both included."""
    n = F.size("words")
    at = lambda k: F.get("subdivisions", F.lit(k))["index"]
    return utterances.select("*", at(start).alias("first"), F.coalesce(at(end + 1), n).alias("after"))


def render_text(utterance_words: Column, boundaries: Column) -> Column:
    """Words with boundary marks before the words they stand at."""
    marked = F.transform(utterance_words, lambda w, i: F.concat_ws(" ", F.array_join(F.transform(F.filter(boundaries, lambda b: b["index"] == i), lambda b: b["type"]), " "), w["graphemes"]))
    return F.trim(F.regexp_replace(F.array_join(marked, " "), r"\s+", " "))


def overlaps(entries: DataFrame) -> DataFrame:
    """Entries that start before the one before them ends. entries: (utt_id, entry_idx, word, start_sample, end_sample)."""
    order = Window.partitionBy("utt_id").orderBy("start_sample", "entry_idx")
    return entries.withColumn("_e", F.lag("end_sample").over(order)).filter("_e > start_sample").drop("_e")


def insert_entry(entries: DataFrame, utt_id, word: str, start: int, end: int) -> DataFrame:
    """entries with one more, numbered by start; overlapping ones are an error when the plan runs."""
    one = entries.sparkSession.createDataFrame([(utt_id, -1, word, start, end)], entries.schema)
    hit = (F.col("utt_id") == utt_id) & (F.col("start_sample") < end) & (F.col("end_sample") > start)
    checked = entries.filter(F.when(hit, F.raise_error(F.lit("overlapping entries")).cast("boolean")).otherwise(F.lit(True)))
    return renumber(checked.union(one))


def renumber(entries: DataFrame) -> DataFrame:
    order = Window.partitionBy("utt_id").orderBy("start_sample", "end_sample", "word")
    return entries.withColumn("entry_idx", (F.row_number().over(order) - 1).cast(entries.schema["entry_idx"].dataType))


def delete_entry(entries: DataFrame, utt_id, index: int) -> DataFrame:
    return renumber(entries.filter(~((F.col("utt_id") == utt_id) & (F.col("entry_idx") == index))))


def move_border(entries: DataFrame, index: int, to: int, right: bool = True, least: int = 1) -> DataFrame:
    """Move a word's border as far as its neighbour and a least word length allow."""
    order = Window.partitionBy("utt_id").orderBy("entry_idx")
    here = F.col("entry_idx") == index
    if right:
        limit = F.coalesce(F.lead("start_sample").over(order), F.lit(1 << 62))
        new = F.least(F.greatest(F.lit(to), F.col("start_sample") + least), limit)
        return entries.withColumn("end_sample", F.when(here, new).otherwise(F.col("end_sample")))
    limit = F.coalesce(F.lag("end_sample").over(order), F.lit(0))
    new = F.greatest(F.least(F.lit(to), F.col("end_sample") - least), limit)
    return entries.withColumn("start_sample", F.when(here, new).otherwise(F.col("start_sample")))


def connect(entries: DataFrame) -> DataFrame:
    """Each entry's end moved to the start of the next one."""
    order = Window.partitionBy("utt_id").orderBy("entry_idx")
    return entries.withColumn("end_sample", F.coalesce(F.lead("start_sample").over(order), F.col("end_sample")))


def disconnect(entries: DataFrame) -> DataFrame:
    """Entries that end right before the next one starts end one sample earlier."""
    order = Window.partitionBy("utt_id").orderBy("entry_idx")
    touches = F.col("end_sample") == F.lead("start_sample").over(order) - 1
    return entries.withColumn("end_sample", F.when(touches, F.col("end_sample") - 1).otherwise(F.col("end_sample")))


def same_document(a: Column, b: Column) -> Column:
    """Whether two utterances (structs) are written as the same document: equal text forms of all their fields."""
    return F.to_json(a) == F.to_json(b)


def turn_fields(line: Column) -> list[Column]:
    """name, start_ms, end_ms and text of ``name_start_end.wav text``."""
    pattern = r"^((?:\S*?)_(\d+)_(\d+)\.wav)\s*(.*)$"
    return [F.regexp_extract(line, pattern, k).alias(n) if k not in (2, 3) else F.regexp_extract(line, pattern, k).cast("long").alias(n) for k, n in ((1, "file"), (2, "start_ms"), (3, "end_ms"), (4, "text"))]


def find_turn(turns: DataFrame, search: str) -> DataFrame:
    """The first turn whose name is at least the search string."""
    return turns.filter(F.col("name") >= search).orderBy("name").limit(1)
