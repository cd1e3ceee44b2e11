"""Models as tables: mixtures, projections and hidden Markov models to Parquet and back; alignments and configurations as text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.errors import CodebookError
from strideframe.operators.gaussians import Mixture
from strideframe.operators.hmm import Hmm

GMM = "model_id string, fd int, nd int, diagonal boolean, components array<struct<id: int, apr: double, mue: array<double>, cov: array<double>>>"
HMM = "model_id string, ns int, pi array<double>, a array<array<double>>, symbols array<array<double>>"


def _pack(c: np.ndarray) -> list[float]:
    """Lower triangle by rows."""
    return [float(c[i, j]) for i in range(len(c)) for j in range(i + 1)]


def _unpack(v: Sequence[float], d: int) -> np.ndarray:
    c = np.zeros((d, d))
    c[np.tril_indices(d)] = v
    return c + np.tril(c, -1).T


def mixtures_frame(spark: SparkSession, models: dict[str, Mixture]) -> DataFrame:
    rows = []
    for name, m in models.items():
        parts = [(k, float(m.weights[k]), m.means[k].tolist(), m.covs[k].tolist() if m.diagonal else _pack(m.covs[k])) for k in range(len(m.weights))]
        rows.append((name, m.means.shape[1], len(m.weights), m.diagonal, parts))
    return spark.createDataFrame(rows, GMM)


def load_mixture(gmm: DataFrame, name: str) -> Mixture:
    row = gmm.filter(F.col("model_id") == name).first()
    if row is None:
        raise CodebookError(f"no mixture {name!r}")
    parts = sorted(row["components"], key=lambda c: c["id"])
    covs = [c["cov"] if row["diagonal"] else _unpack(c["cov"], row["fd"]) for c in parts]
    return Mixture([c["apr"] for c in parts], [c["mue"] for c in parts], covs, name)


def hmms_frame(spark: SparkSession, models: dict[str, Hmm]) -> DataFrame:
    """Discrete models; mixtures of continuous ones are stored by mixtures_frame under ``name/state``."""
    rows = [(n, len(m.pi), m.pi.tolist(), m.a.tolist(), None if m.symbols is None else m.symbols.tolist()) for n, m in models.items()]
    return spark.createDataFrame(rows, HMM)


def load_hmm(hmms: DataFrame, name: str, gmm: DataFrame | None = None) -> Hmm:
    row = hmms.filter(F.col("model_id") == name).first()
    if row is None:
        raise CodebookError(f"no model {name!r}")
    symbols = None if row["symbols"] is None else np.array(row["symbols"])
    mixtures = None if symbols is not None or gmm is None else [load_mixture(gmm, f"{name}/{s}") for s in range(row["ns"])]
    return Hmm(np.array(row["pi"]), np.array(row["a"]), symbols, mixtures, name=name)


def alignment_lines(alignment: DataFrame) -> DataFrame:
    """(utt_id, value): ``token length q0 q1 ...`` per segment, in order."""
    line = F.concat_ws(" ", "token", F.col("n_frames").cast("string"), F.array_join(F.transform("q", lambda q: q.cast("string")), " "))
    return alignment.orderBy("utt_id", "seg_idx").select("utt_id", line.alias("value"))


def supervectors(gmm: DataFrame, weights: bool = False, means: bool = True, variances: bool = False) -> DataFrame:
    """(model_id, x): chosen parameters of all components, as an expression over the stored table."""
    part = lambda c: F.concat(*([F.array(c["apr"])] * weights + [c["mue"]] * means + [c["cov"]] * variances))
    return gmm.select("model_id", F.flatten(F.transform(F.array_sort("components"), part)).alias("x"))


def configuration_xml(alphabet: dict[str, int], lexicon: dict[str, Sequence[str]], hierarchy: Sequence[tuple] = ()) -> str:
    """The document that text.read_configuration reads."""
    root = ET.Element("configuration")
    a, t, h = (ET.SubElement(root, n) for n in ("alphabet", "tokenizer", "hierarchy"))
    for token, states in alphabet.items():
        ET.SubElement(a, "token", n=token, s=str(states))
    for word, tokens in lexicon.items():
        ET.SubElement(t, "tokenization", w=word, t=" ".join(tokens))
    for token, left, right, model in hierarchy:
        ET.SubElement(h, "token", n=token, l=" ".join(left), r=" ".join(right), h=str(model))
    return ET.tostring(root, encoding="unicode")
