"""Feature extraction by parameter strings, stored models, labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.errors import CodebookError, MalformedParameterError
from strideframe.functions.labels import id_to_label, label_to_id
from strideframe.operators import features as ft, hmm
from strideframe.operators.gaussians import Mixture
from strideframe.sources import models, text


def test_window_strings():
    w, length, shift = ft.parse_window("hann,25,10", 16000)
    assert (len(w), length, shift) == (400, 400, 160) and ft.parse_window("rect,8s,9s", 8000)[1:] == (8, 8)
    for bad in ("x,1,2", "hamm,1", "hamm,a,b", "rect,0s,1s"):
        with pytest.raises(MalformedParameterError):
            ft.parse_window(bad, 8000)


def test_extraction(spark):
    t = np.arange(4000) / 8000
    audio = spark.createDataFrame([("a", np.sin(2 * np.pi * 500 * t).tolist()), ("b", np.sin(2 * np.pi * 900 * t).tolist())], "utt_id string, samples array<double>")
    rows = ft.extract(audio, 8000, "hamm,25,10", "100,3800", "0-5", "5:1", "turn").collect()
    assert {len(r["x"]) for r in rows} == {12} and len(rows) == 2 * 49
    x = np.array([r["x"] for r in rows if r["utt_id"] == "a"])
    assert np.allclose(x.mean(0), 0, atol=1e-9)
    s = ft.spectrogram(audio, 8000).agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    assert (s[0], s[1]) == (0, 1)
    with pytest.raises(Exception, match="finite"):
        ft.finite(spark.createDataFrame([("a", 0, [float("nan")])], "utt_id string, frame_idx long, x array<double>")).collect()
    assert ft.gaussianize(spark.createDataFrame([("a", i, [float(v)]) for i, v in enumerate([3, 1, 2, 5])], "utt_id string, frame_idx long, x array<double>")).count() == 4


def test_stored_models(spark):
    full = Mixture([0.5, 0.5], [[0, 1], [1, 0]], [[[2, 0.5], [0.5, 1]], [[1, 0], [0, 3]]])
    diagonal = Mixture([1.0], [[1, 2]], [[3, 4]])
    table = models.mixtures_frame(spark, {"f": full, "d": diagonal, "h/0": diagonal, "h/1": diagonal})
    assert np.allclose(models.load_mixture(table, "f").covs, full.covs) and models.load_mixture(table, "d").diagonal
    with pytest.raises(CodebookError):
        models.load_mixture(table, "none")
    assert models.supervectors(table, True, True, True).filter("model_id = 'd'").first()["x"] == [1, 1, 2, 3, 4]
    stored = models.hmms_frame(spark, {"h": hmm.Hmm(np.array([1.0, 0]), hmm.topology(2, "LINEAR"))})
    assert len(models.load_hmm(stored, "h", table).mixtures) == 2


def test_configuration_round_trip():
    doc = models.configuration_xml({"a": 2}, {"ab": ["a", "b"]}, [("a", ["x"], [], 3)])
    assert text.read_configuration(doc) == {"alphabet": {"a": 2}, "lexicon": {"ab": ["a", "b"]}, "hierarchy": [("a", ["x"], [], "3")]}


def test_labels(spark):
    row = spark.range(1).select(label_to_id(F.lit("A")), id_to_label(F.lit(10)), label_to_id(F.lit("?"))).first()
    assert tuple(row) == (10, "A", -1)
