"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a built-in expression of one row: no shuffle, no user function, and the rules are data. ``measures``
gives one struct per text, ``compile_rules`` turns (measure, lowest, highest) rows into one boolean expression.

The stop-word ratio fits the four languages of ``STOP_WORDS``; for others pass their words, or rules without it.

Defined results: words are what stands between space, tab, newline, vertical tab, form feed and carriage return. A
null text is judged as an empty one: no words, base_failed. Ratios with nothing to divide by are 0. Repeated rows and
ties are judged row by row. Texts of any length are read whole; the costliest part, sorting the hashes of 8-word
windows, takes n log n steps and is entered only by texts in which two windows are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.llm.common import let, quoted, without

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# The commonest short words of English, German, French and Spanish prose.
STOP_WORDS = (
    "the of and to in is that with be have a it for on by an was are as at or this from not which "
    "der die und das den von mit ist zu im auf des nicht sich ein eine dem auch für als es an "
    "le la les de et des que dans un une du en est pour qui sur pas par au il avec "
    "el los las y una con se del por no para lo su como más"
).split()

#: (measure, lowest, highest), both included; None: no bound.
RULES = (
    ("mean_word_length", 3.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("exclamation_ratio", None, 0.3),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("line_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def window_hashes(words: Column, window: int) -> Column:
    """64-bit hashes of all windows of so many words (a power of two), made by doubling: pairs of words, pairs of pairs."""
    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < window:
        hashes = let(hashes, lambda h, k=width: F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - k, F.lit(0))), F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)
        ))
        width *= 2
    return hashes


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that are found at least twice in the array, the first find included."""
    def covered(hashes: Column) -> Column:
        def runs(order: Column) -> Column:
            n = F.size(order)
            twin = lambda k: F.when((k >= 1) & (k <= n), F.get(order, k - 1)["h"])
            starts = F.array_sort(F.filter(
                F.transform(order, lambda x, k: F.when((x["h"] == twin(k)) | (x["h"] == twin(k + 2)), x["i"])),
                lambda i: i.isNotNull(),
            ))
            return let(starts, lambda s: F.aggregate(
                F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window))),
                F.lit(0).cast("long"), lambda total, x: total + x,
            ))

        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(order, runs))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(window_hashes(words, window), covered))


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """One struct of counts and ratios of a text. stop_words: lower-case; a capital first letter counts as well."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    marks = F.regexp_replace(text, f"[^{SYMBOLS}!]+", "")
    stops = sorted({*stop_words, *(w.capitalize() for w in stop_words)})

    counts = let(words_of(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stops"),
        repeat_words(words).alias("n_repeat_words"),
    ))
    by_line = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    ))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    by_mark = let(marks, lambda s: F.struct(
        F.length(without(s, "!")).cast("long").alias("n_symbols"), (F.length(s) - F.length(without(s, "!"))).cast("long").alias("n_marks"),
    ))
    return let(F.struct(counts.alias("c"), by_line.alias("l"), by_mark.alias("m")), lambda x: F.struct(
        x["c"]["n_words"].alias("n_words"), x["c"]["word_chars"].alias("word_chars"), x["m"]["n_symbols"].alias("n_symbols"),
        x["l"]["n_dup_lines"].alias("n_dup_lines"), x["c"]["n_repeat_words"].alias("n_repeat_words"),
        share(x["c"]["word_chars"], x["c"]["n_words"]).alias("mean_word_length"), share(x["m"]["n_symbols"], x["c"]["n_words"]).alias("symbol_ratio"),
        share(x["m"]["n_marks"], x["c"]["n_words"]).alias("exclamation_ratio"), share(x["c"]["n_stops"], x["c"]["n_words"]).alias("stop_ratio"),
        share(x["l"]["n_dup_lines"], x["l"]["n_lines"]).alias("dup_line_ratio"), share(x["l"]["n_lines"], x["c"]["n_words"]).alias("line_ratio"),
    ))


def base_failed(m: Column) -> Column:
    """Too short, or too much of it in repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def compile_rules(m: Column, rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> Column:
    """Whether every measure lies within the bounds of its rule."""
    verdict = F.lit(True)
    for name, lowest, highest in rules:
        if lowest is not None:
            verdict = verdict & (m[name] >= lowest)
        if highest is not None:
            verdict = verdict & (m[name] <= highest)
    return verdict


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence = RULES, out: str = "quality", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with a struct column ``out``: the measures, base_failed and kept. A column of that name is replaced."""
    judged = docs.withColumn(out, measures(F.col(quoted(text_col)), stop_words))
    failed = base_failed(F.col(out))
    return judged.withColumn(out, F.col(out).withField("base_failed", failed).withField("kept", ~failed & compile_rules(F.col(out), rules)))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The documents that pass, with their own columns only."""
    m = measures(F.col(quoted(text_col)), stop_words)
    return docs.filter(let(m, lambda x: ~base_failed(x) & compile_rules(x, rules)))
