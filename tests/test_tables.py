"""Operators on small tables: edges, nulls and files."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators import agreement as ag, annotation as an, context as cx, dsp, frames as fr
from strideframe.sources import binary, text


def frames(spark, *streams):
    rows = [(str(u), i, [float(v) for v in (x if isinstance(x, (list, tuple)) else [x])]) for u, s in enumerate(streams) for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "utt_id string, frame_idx long, x array<double>")


def values(df):
    return [[round(v, 6) for v in r["x"]] for r in df.orderBy("utt_id", "frame_idx").collect()]


def test_slopes_need_enough_frames(spark):
    f = frames(spark, [1, 2], [5])
    assert values(cx.slopes(f, [(3, 1, 1.0)])) == [[1, 0.5], [2, 0.5]]
    assert values(cx.slopes(f, [(5, 1, 1.0)])) == []
    assert cx.parse_slopes("tirol,5:1,3:2:2.0") == (True, [(5, 1, 1.0), (3, 2, 2.0)])


def test_shifted_deltas_and_traps(spark):
    f = frames(spark, [0, 1, 4, 9, 16, 25])
    assert values(cx.shifted_deltas(f, 1, 1, 2)) == [[4, 8], [8, 12], [12, 16]]
    assert values(cx.shifted_deltas(f, 1, 1, 2, copy=True))[0] == [1, 4, 8]
    assert values(cx.traps(f, 3))[0] == [0, 1, 4] and len(values(cx.traps(f, 3))) == 4


@pytest.mark.parametrize("n, expected", [(0, 0), (2, 1), (4, 2), (5, 2), (6, 3), (7, 3)])
def test_frame_counts(spark, n, expected):
    audio = spark.createDataFrame([("u", [1.0] * n)], "utt_id string, samples array<double>")
    assert fr.framing(audio, 4, 2, [1.0] * 4).count() == expected


def test_constant_dimension_is_null_after_mvn(spark):
    assert values(cx.mvn(frames(spark, [[1, 0], [3, 0]]), means=True, variances=False)) == [[-1, 0], [1, 0]]
    rows = cx.mvn(frames(spark, [[1, 0], [3, 0]])).orderBy("frame_idx").collect()
    assert [r["x"] for r in rows] == [[-1.0, None], [1.0, None]]


def test_merge_takes_the_shortest_and_concat_numbers_on(spark):
    a, b = frames(spark, [1, 2, 3]), frames(spark, [7, 8])
    assert values(fr.merge(a, b)) == [[1, 7], [2, 8]]
    both = fr.concat(frames(spark, [1, 2], [3])).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["x"]) for r in both] == [(0, [1.0]), (1, [2.0]), (2, [3.0])]


def ratings(spark, *columns):
    rows = [(s, str(k), v) for k, c in enumerate(columns) for s, v in enumerate(c)]
    return spark.createDataFrame(rows, "subject_id long, rater_id string, rating double")


def test_agreement_of_identical_raters(spark):
    r = ratings(spark, [0.0, 1.0, 2.0, 1.0], [0.0, 1.0, 2.0, 1.0])
    assert ag.kappa(r).first()[0] == pytest.approx(1) and ag.alpha(r).first()[0] == pytest.approx(1)


def test_agreement_with_gaps(spark):
    r = ratings(spark, [1.0, 2.0, None, 1.0], [1.0, 2.0, 2.0, None], [None, None, None, 3.0])
    assert ag.alpha(r).first()[0] is not None
    assert ag.kappa(ratings(spark, [None], [None])).first()[0] is None


def test_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 2.0, 4.0)], "v double")
    s = ag.basic_stats(df, "v").first()
    assert (s["n"], s["lo"], s["hi"], s["median"], s["mean"]) == (4, 1.0, 4.0, 3.0, 2.5)
    bins = {r["bin"]: r["n"] for r in ag.histogram(spark.createDataFrame([(-0.4,), (0.4,), (1.2,)], "v double"), "v", 0.5).collect()}
    assert bins == {0.0: 2, 1.0: 1}
    assert df.select(ag.clock(F.lit(3725.9))).first()[0] == "01:02:05"


def test_smoothing_of_decisions(spark):
    rows = [("u", i, v) for i, v in enumerate([0, 1, 0, 0, 1, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "utt_id string, frame_idx long, voiced int")
    assert [r["voiced"] for r in cx.smooth_decisions(df).orderBy("frame_idx").collect()] == [1, 0, 0, 0, 1, 1, 1, 1, 0]


def test_pitch_edits(spark):
    df = spark.createDataFrame([("u", 0, 120.0, 99.0, True), ("u", 1, 90.0, 99.0, True), ("u", 2, 80.0, 99.0, False)], "utt_id string, frame_idx long, f0 double, original double, selected boolean")
    f0 = lambda a: [r["f0"] for r in dsp.correct_pitch(df, a).orderBy("frame_idx").collect()]
    assert f0("half") == [60, 90, 80] and f0("double") == [240, 180, 80] and f0("reset") == [99, 99, 80] and f0("zero") == [0, 0, 80]


def entries(spark):
    return spark.createDataFrame([("u", 0, "a", 0, 10), ("u", 1, "b", 20, 30)], "utt_id string, entry_idx int, word string, start_sample long, end_sample long")


def test_transcription_edits(spark):
    e = entries(spark)
    assert [r["word"] for r in an.insert_entry(e, "u", "c", 12, 18).orderBy("entry_idx").collect()] == ["a", "c", "b"]
    with pytest.raises(Exception, match="overlapping"):
        an.insert_entry(e, "u", "c", 5, 18).collect()
    assert an.move_border(e, 0, 25).orderBy("entry_idx").first()["end_sample"] == 20
    assert an.connect(e).orderBy("entry_idx").first()["end_sample"] == 20
    assert an.delete_entry(e, "u", 0).first()["entry_idx"] == 0


def weather_report():
    """An utterance of our own, as the writer takes it."""
    words = [("snow", "EXTRA", [(0, 3, "PRIMARY")], ["s", "n", "oʊ"]), ("melted", "NONE", [(0, 4, "SECONDARY"), (1, 2, "NONE")], ["m", "ɛ", "l", "t", "ə", "d"]),
             ("overnight", "PRIMARY", [(0, 1, "NONE"), (1, 2, "NONE"), (2, 3, "PRIMARY")], ["oʊ", "v", "ə", "n", "aɪ", "t"]),
             ("and", "NONE", [], []), ("rivers", "SECONDARY", [(0, 2, "PRIMARY"), (1, 3, "NONE")], ["r"]), ("rose", "NONE", [], [])]
    return {"role": "reporter", "segment_id": 86, "track": "north", "orthography": "Snow melted overnight - and rivers rose.", "words": words, "boundaries": [(1, "B2"), (3, "B3")], "subdivisions": [0, 3]}


def test_annotations(spark, tmp_path):
    path = tmp_path / "report.xml"
    path.write_text(text.annotation_xml([weather_report(), {**weather_report(), "role": "anchor", "orthography": "Snow melted"}]), encoding="utf-8")
    u = text.read_annotations(spark, str(path)).persist()
    assert {r["role"]: r["nr"] for r in u.collect()} == {"reporter": "0", "anchor": "1"}
    u = u.filter("role = 'reporter'")
    row = u.first()
    assert [w["graphemes"] for w in row["words"]] == ["snow", "melted", "overnight", "and", "rivers", "rose"]
    assert row["words"][2]["syllables"][2]["n_phonemes"] == 3 and row["words"][2]["syllables"][2]["stress"] == "PRIMARY" and row["words"][1]["phonemes"][3]["symbols"] == "t"
    assert [(b["index"], b["type"]) for b in row["boundaries"]] == [(1, "B2"), (3, "B3")] and row["subdivisions"][1]["index"] == 3 and (row["segment_id"], row["track"]) == ("86", "north")
    assert an.sub_utterance(u, 0, 3).first()["orthography"] == "Snow melted overnight - "
    tail = an.sub_utterance(u, 3, 6).first()
    assert tail["orthography"] == "and rivers rose." and [b["index"] for b in tail["boundaries"]] == [0]
    assert an.sub_utterance(u, 1, 3).first()["boundaries"][1]["index"] == 2


def test_file_sources(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(binary.encode_frames([[1.0, 2.0], [3.0, 4.0]]))
    rows = binary.read_frames(spark, str(tmp_path / "f.bin")).orderBy("frame_idx").collect()
    assert [r["x"] for r in rows] == [[1.0, 2.0], [3.0, 4.0]] and rows[0]["utt_id"] == "f.bin"
    (tmp_path / "l.txt").write_text("ab a b\ncab c a b\n")
    assert {r["word"]: r["tokens"] for r in text.read_lexicon(spark, str(tmp_path / "l.txt")).collect()} == {"ab": ["a", "b"], "cab": ["c", "a", "b"]}
    (tmp_path / "t.txt").write_text("f.wav a 0 5 b 5 9\n")
    read = text.read_transcriptions(spark, str(tmp_path / "t.txt"))
    assert read.count() == 2 and text.transcription_lines(read).first()["value"] == "f.wav a 0 5 b 5 9"
    (tmp_path / "r.txt").write_text("1 nan\n2 2\n")
    assert {(r["subject_id"], r["rater_id"]): r["rating"] for r in text.read_ratings(spark, str(tmp_path / "r.txt")).collect()} == {(0, "0"): 1, (0, "1"): None, (1, "0"): 2, (1, "1"): 2}


def test_entry_points_import():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_arpa_in_parts(spark, tmp_path):
    """Written and read by many tasks, with the same numbers, also words like numbers and like heads; whole files read the same."""
    import random

    from strideframe.errors import LanguageModelError

    rng = random.Random(4)
    p = [0.009765625, 1 / 3, *(rng.random() for _ in range(300))]
    rows = [(1, [f"w{i}"], v, rng.choice([None, rng.random()])) for i, v in enumerate(p)] + [(2, [f"w{i}", rng.choice(["7", "ngram", "\\data\\", "é"])], v, None) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "n int, words array<string>, p double, backoff double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_arpa(df, f"{tmp_path}/parts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(tmp_path.glob("parts/part-*"))
    whole = "".join(q.read_text() for q in parts)
    expected = sorted(rows)
    assert len(parts) > 1 and sorted(text.parse_arpa(whole)) == expected and whole == text.arpa_text(rows)
    (tmp_path / "whole").write_text(whole)
    for name in ("parts", "whole"):
        assert sorted(map(tuple, text.read_arpa(spark, f"{tmp_path}/{name}").collect())) == expected
    (tmp_path / "bad").write_text("-1 a\n")
    with pytest.raises(LanguageModelError):
        text.read_arpa(spark, f"{tmp_path}/bad").collect()
