"""Readers of list, lexicon, n-gram, model and annotation files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.errors import InvalidFormatError, LanguageModelError

ANNOTATION = """_speaker string, _NR string, _ID string, _TRACK string, _REV string, _FILENAME string, utterance struct<
  orthography: string, melody: double, boundary: array<struct<_beforeWord: int, _type: string>>, subdivision: array<struct<_firstWord: int>>,
  word: array<struct<_graphemes: string, _phraseAccent: string, _stressWrongProb: double,
    syllable: array<struct<_position: int, _nPhonemes: int, _stress: string>>, phoneme: array<struct<_symbols: string>>>>>"""


def read_alphabet(spark: SparkSession, path: str) -> DataFrame:
    """(token, n_states): ``token n`` lines, ``;`` comments."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(trim(value), ';')")
    return rows.select(fields[0].alias("token"), fields[1].cast("short").alias("n_states"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, tokens): ``word token token ...`` lines."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(fields[0].alias("word"), F.slice(fields, F.lit(2), F.size(fields)).alias("tokens"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, words): ``file word word ...`` lines."""
    return read_lexicon(spark, path).select(F.col("word").alias("utt_id"), F.col("tokens").alias("words"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, utt_id, words): the lines of one list file in order, a file's name and what is said in it, if anything."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    fields = F.split(F.trim("line"), r"\s+")
    return rows.select("pos", fields[0].alias("utt_id"), F.slice(fields, F.lit(2), F.size(fields)).alias("words"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, utt_id): ``model file`` lines."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(fields[0].alias("model_id"), fields[1].alias("utt_id"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, rater_id, rating): columns are raters, rows subjects, ``nan`` is missing. Subjects keep the file's order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("subject_id", "line"))
    cells = rows.select(F.col("subject_id").cast("long").alias("subject_id"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("r", "v"))
    return cells.select("subject_id", F.col("r").cast("string").alias("rater_id"), F.when(F.lower("v") != "nan", F.col("v").cast("double")).alias("rating"))


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, entry_idx, word, start_sample, end_sample): ``file (word start end)*`` lines."""
    fields = F.split(F.trim("value"), r"\s+")
    n = ((F.size(fields) - 1) / 3).cast("int")
    entries = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(fields, k * 3 + 2, 3))
    rows = spark.read.text(path).filter("trim(value) <> ''").filter(n > 0).select(fields[0].alias("utt_id"), F.posexplode(entries).alias("entry_idx", "e"))
    return rows.select("utt_id", "entry_idx", F.col("e")[0].alias("word"), F.col("e")[1].cast("long").alias("start_sample"), F.col("e")[2].cast("long").alias("end_sample"))


def transcription_lines(entries: DataFrame) -> DataFrame:
    """(value): the lines that read_transcriptions reads."""
    packed = entries.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("entry_idx", "word", "start_sample", "end_sample"))).alias("e"))
    parts = F.transform("e", lambda e: F.concat_ws(" ", e["word"], e["start_sample"].cast("string"), e["end_sample"].cast("string")))
    return packed.select(F.concat_ws(" ", F.col("utt_id").cast("string"), F.array_join(parts, " ")).alias("value"))


def parse_arpa(text: str) -> list[tuple[int, list[str], float, float | None]]:
    """(n, words, p, backoff) of an ARPA model; the order is the number of counts, at most 2."""
    out, order, section = [], 0, None
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        if line.startswith("\\"):
            section = line
            if section.endswith("-grams:") and int(section[1:].split("-")[0]) > 2:
                raise LanguageModelError("n-grams above 2 aren't supported")
        elif section == "\\data\\":
            order += 1
            if order > 2:
                raise LanguageModelError("n-grams above 2 aren't supported")
        elif section and section.endswith("-grams:"):
            n = int(section[1:].split("-")[0])
            fields = line.split()
            if len(fields) not in (n + 1, n + 2):
                raise LanguageModelError(f"bad n-gram {line!r}")
            out.append((n, fields[1 : n + 1], _power(fields[0]), _power(fields[n + 1]) if len(fields) == n + 2 else None))
    if not order:
        raise LanguageModelError("no counts")
    return out


def _power(log: str) -> float:
    """10 to a written logarithm, and below the logarithm in digits enough that the same number comes back."""
    import numpy as np

    return float(np.longdouble(10) ** np.longdouble(log))


def _log10(p: float) -> str:
    import numpy as np

    if not p > 0:
        raise LanguageModelError(f"no logarithm of {p!r}")
    return np.format_float_positional(np.log10(np.longdouble(p)), trim="-")


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, words, p, backoff) of an ARPA file, or of its parts in the order of their names, as ``write_arpa`` leaves them.

    Lines are parsed where they are read. The few lines that begin sections are on the driver, with their places, so that
    each n-gram knows its section. Fields are told apart by spaces and tabs.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.btrim("value", F.lit(" \t\r")).alias("value"))
    heads = sorted(tuple(r) for r in rows.filter("startswith(value, 'ngram') OR startswith(value, '\\\\')").collect())
    places, sections, counts, order, section = [], [], 0, 0, None
    for *place, line in heads:
        if line.startswith("\\"):
            if line.endswith("-grams:") and int(line[1:].split("-")[0]) > 2:
                raise LanguageModelError("n-grams above 2 aren't supported")
            section, order = line, 0
            places.append(tuple(place))
            sections.append(line)
        elif section == "\\data\\":
            counts, order = counts + 1, order + 1
            if order > 2:
                raise LanguageModelError("n-grams above 2 aren't supported")
    if not counts:
        raise LanguageModelError("no counts")

    def run(batches):
        from bisect import bisect_right

        import pandas as pd

        known: dict[str, float] = {}

        def value(log: str) -> float:
            if log not in known:
                if len(known) >= 1 << 16:
                    known.clear()
                known[log] = _power(log)
            return known[log]

        for batch in batches:
            out = []
            for *place, line in batch.itertuples(index=False, name=None):
                if not line or line.startswith("\\"):
                    continue
                at = bisect_right(places, tuple(place)) - 1
                if at < 0 or not sections[at].endswith("-grams:"):
                    if at >= 0 and sections[at] == "\\end\\" and places[at][0] != place[0]:
                        raise LanguageModelError("no counts")
                    continue
                n, fields = int(sections[at][1:].split("-")[0]), line.replace("\t", " ").split(" ")
                fields = [x for x in fields if x]
                if len(fields) not in (n + 1, n + 2):
                    raise LanguageModelError(f"bad n-gram {line!r}")
                out.append((n, fields[1 : n + 1], value(fields[0]), value(fields[n + 1]) if len(fields) == n + 2 else None))
            if out:
                yield pd.DataFrame(out, columns=["n", "words", "p", "backoff"])

    return rows.mapInPandas(run, "n int, words array<string>, p double, backoff double")


def write_arpa(ngrams: DataFrame, path: str) -> None:
    """The ARPA document of (n, words, p, backoff) as text files whose concatenation in the order of their names it is: sorted by ranges, no task holds it whole."""
    def run(batches):
        known: dict[float, str] = {}

        def log(p: float) -> str:
            if p not in known:
                if len(known) >= 1 << 16:
                    known.clear()
                known[p] = _log10(p)
            return known[p]

        for batch in batches:
            text = [" ".join([log(p), *w, *([log(b)] if b > 0 else [])]) for w, p, b in zip(batch["words"], batch["p"], batch["backoff"], strict=True)]
            yield batch[["n", "words"]].assign(value=text)

    lines = ngrams.select(F.col("n").cast("int").alias("n"), "words", "p", "backoff").mapInPandas(run, "n int, words array<string>, value string").persist(StorageLevel.DISK_ONLY)
    try:
        counts = [tuple(r) for r in lines.groupBy("n").count().orderBy("n").collect()]
        frame = [(0, [], "\n".join(["\\data\\", *(f"ngram {n}={c}" for n, c in counts), ""])), *((n, [], f"{chr(10) if k else ''}\\{n}-grams:") for k, (n, _) in enumerate(counts)), (1 << 30, [], "\n\\end\\")]
        whole = lines.union(lines.sparkSession.createDataFrame(frame, lines.schema))
        whole.repartitionByRange("n", "words").sortWithinPartitions("n", "words").select("value").write.text(path)
    finally:
        lines.unpersist()


def arpa_text(ngrams) -> str:
    """The ARPA document of rows (n, words, p, backoff): log10 values; back-off weights where there are any."""
    rows = sorted((n, list(words), p, b) for n, words, p, b in ngrams)
    orders = sorted({r[0] for r in rows})
    lines = ["\\data\\", *(f"ngram {n}={sum(r[0] == n for r in rows)}" for n in orders), ""]
    for n in orders:
        lines.append(f"\\{n}-grams:")
        for _, words, p, b in (r for r in rows if r[0] == n):
            lines.append(" ".join([_log10(p), *words, *([_log10(b)] if b is not None and b > 0 else [])]))
        lines.append("")
    return "\n".join([*lines, "\\end\\", ""])


def annotation_xml(rows) -> str:
    """An annotation document of utterances: dicts with role, segment_id, track, orthography, words, boundaries and subdivisions.

    A word is (graphemes, accent, syllables (position, phonemes, stress), symbols); a boundary (word, type).
    """
    import xml.etree.ElementTree as ET

    root = ET.Element("recordingSessionAnnotation", ANNOFORMAT="XML")
    for nr, u in enumerate(rows):
        segment = ET.SubElement(root, "textsegment", speaker=u["role"], NR=str(nr), ID=str(u["segment_id"]), TRACK=str(u["track"]), REV="0")
        own = ET.SubElement(segment, "utterance")
        ET.SubElement(own, "orthography").text = u["orthography"]
        for index, kind in u.get("boundaries", ()):
            ET.SubElement(own, "boundary", beforeWord=str(index), type=kind)
        for index in u.get("subdivisions", ()):
            ET.SubElement(own, "subdivision", firstWord=str(index))
        for graphemes, accent, syllables, symbols in u.get("words", ()):
            word = ET.SubElement(own, "word", graphemes=graphemes, phraseAccent=accent)
            for position, n, stress in syllables:
                ET.SubElement(word, "syllable", position=str(position), nPhonemes=str(n), stress=stress)
            for s in symbols:
                ET.SubElement(word, "phoneme", symbols=s)
    return ET.tostring(root, encoding="unicode")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per utterance of annotation XML: role, track, segment id, text, words, boundaries, subdivisions."""
    raw = spark.read.format("xml").option("rowTag", "textsegment").schema(ANNOTATION).load(path)
    u = F.col("utterance")
    word = lambda w: F.struct(
        w["_graphemes"].alias("graphemes"), w["_phraseAccent"].alias("phrase_accent"), w["_stressWrongProb"].alias("stress_wrong_prob"),
        F.transform(w["syllable"], lambda s: F.struct(s["_position"].alias("position"), s["_nPhonemes"].alias("n_phonemes"), s["_stress"].alias("stress"))).alias("syllables"),
        F.transform(w["phoneme"], lambda p: F.struct(p["_symbols"].alias("symbols"))).alias("phonemes"),
    )
    return raw.select(
        F.col("_speaker").alias("role"), F.col("_NR").alias("nr"), F.col("_ID").alias("segment_id"), F.col("_TRACK").alias("track"), F.col("_REV").alias("rev"), F.col("_FILENAME").alias("filename"),
        u["orthography"].alias("orthography"), u["melody"].alias("melody"),
        F.transform(u["boundary"], lambda b: F.struct(b["_beforeWord"].alias("index"), b["_type"].alias("type"))).alias("boundaries"),
        F.transform(u["subdivision"], lambda s: F.struct(s["_firstWord"].alias("index"))).alias("subdivisions"),
        F.transform(u["word"], word).alias("words"),
    )


def read_configuration(text: str) -> dict:
    """alphabet {token: states}, lexicon {word: tokens}, hierarchy [(token, left, right, hmm id)] of a configuration document."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise InvalidFormatError(str(e)) from None
    found = {"alphabet": {}, "lexicon": {}, "hierarchy": []}
    for t in root.iterfind(".//alphabet/token"):
        found["alphabet"][t.get("n")] = int(t.get("s"))
    for t in root.iterfind(".//tokenizer/tokenization"):
        found["lexicon"][t.get("w")] = t.get("t").split()
    for t in root.iterfind(".//hierarchy//token"):
        found["hierarchy"].append((t.get("n"), (t.get("l") or "").split(), (t.get("r") or "").split(), t.get("h")))
    return found
