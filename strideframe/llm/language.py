"""Language identification in two steps: the family first, then one-versus-one linear SVMs between its languages.

A text becomes the square roots of the counts of its hashed letter n-grams, scaled to length one. One linear SVM per
family, against the rest, picks the family; within it, each pair of languages has a linear SVM, and the language
with most votes (then the largest sum of margins, then the smallest name) is predicted. All of them are trained here,
by accelerated gradient descent on the squared hinge loss.

The classifiers are fitted on a bounded sample of whole texts: at most ``per_language`` documents of each label, and less
where there are so many labels that all of them together would have more than ``most_rows``; every label that has a
text with a letter is learned (so with more labels than ``most_rows`` there is one document of each). Which rows are in
it is decided by a hash of the id, so it is the same each time. Counting labels covers all rows, and every row is
predicted, from its text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing
to learn from. Rows with a null label or id are never learned from. Repeated rows are predicted row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strideframe.llm.common import BROADCAST_BYTES, map_batches

DIMENSIONS = 4096
PER_LANGUAGE, MOST_ROWS = 300, 19200

# Families of ISO 639-1 codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return bool(text) and any(map(str.isalpha, text))


def features(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of hashed byte n-grams (1 to 4) of the folded text; everything but letters is one kind of border."""
    raw = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    upper = np.zeros(len(raw), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    raw = np.where(upper, raw + 32, raw).astype(np.uint8)
    raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))]  # one border between words
    grams = np.concatenate(([32], raw, [32])).astype(np.uint32)
    counts, gram = np.zeros(dimensions, np.float32), grams
    for n in range(1, 5):
        if n > 1:
            gram = (gram[:-1] * np.uint32(16777619)) ^ grams[n - 1 :]
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(dimensions))), minlength=dimensions)
    counts = np.sqrt(counts)
    return counts / max(1e-9, float(np.linalg.norm(counts)))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM for labels -1 and 1, with both classes weighing the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 2
    w = v = np.zeros(x.shape[1])
    rate = 1.0 / (1.0 + 4 * c)
    for k in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ v))
        new = v - rate * (v - x.T @ (2 * weight * y * slack))
        w, v = new, new + k / (k + 3) * (new - w)
    return w


class Model:
    """Family SVMs and the pair SVMs within each family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILY):
        labels = np.array(langs)
        self.langs = sorted(set(langs))
        family = {lang: families.get(lang, lang) for lang in self.langs}
        self.members = {f: [a for a in self.langs if family[a] == f] for f in sorted(set(family.values()))}
        of = np.array([family[a] for a in langs])
        self.by_family = {f: train_svm(x, np.where(of == f, 1, -1)) for f in self.members} if len(self.members) > 1 else {}
        self.by_pair = {
            (a, b): train_svm(x[rows], np.where(labels[rows] == a, 1, -1))
            for own in self.members.values() for a, b in combinations(own, 2) for rows in [np.flatnonzero((labels == a) | (labels == b))]
        }

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1."""
        if not self.langs or not has_letter(text):
            return "und", 0.0
        x = np.append(features(text), 1.0)
        chance = lambda margin: 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, 2.0 * margin))))
        margins = {f: float(w @ x) for f, w in self.by_family.items()}
        family = max(sorted(self.members), key=lambda f: margins.get(f, 0.0))
        score = chance(margins[family]) if margins else 1.0
        votes = {a: [0, 0.0, 1.0] for a in self.members[family]}
        for (a, b), w in self.by_pair.items():
            if a in votes:
                m = float(w @ x)
                for name, own in ((a, m), (b, -m)):
                    votes[name][0] += own > 0
                    votes[name][1] += own
                    votes[name][2] = min(votes[name][2], chance(own))
        best = max(sorted(votes), key=lambda a: votes[a][:2])
        return best, score * votes[best][2]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS,
) -> Model:
    """Fit on a bounded sample of the rows for which learn_from holds."""
    rows = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # One row per label: as many as there are languages, not documents.
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not counts:
        return Model(np.zeros((0, DIMENSIONS)), [])
    per = max(1, min(per_language, most_rows // len(counts)))
    listed = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * per + 20.0) / r["count"])) for r in counts], "_lang string, _share double")
    u = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    labelled = rows.select(u.alias("u"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    drawn = labelled.join(F.broadcast(listed) if len(counts) * 64 <= BROADCAST_BYTES else listed, F.col("lang") == F.col("_lang")).filter("u < _share").select("u", "lang", "text")
    schema = T.StructType([T.StructField("u", T.DoubleType()), T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
            own = batch.take(pa.array(keep, pa.int32()))
            x = [features(t).astype(np.float16).tobytes() for t in own.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("u"), own.column("lang"), pa.array(x, pa.binary())], names=schema.names)

    # About 1.5 times per + 20 rows of 8 KB for each label.
    sample: dict[str, list] = {}
    for r in sorted(drawn.mapInArrow(run, schema).collect(), key=lambda r: (r["u"], r["lang"], r["x"])):
        sample.setdefault(r["lang"], []).append(r["x"])
    pairs = [(lang, x) for lang in sorted(sample) for x in sample[lang][:per]]
    x = np.array([np.frombuffer(x, np.float16) for _, x in pairs], np.float32).reshape(len(pairs), DIMENSIONS)
    return Model(x, [lang for lang, _ in pairs])


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; former columns of these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name not in (out, score)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(text_col)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, out, score])

    return map_batches(docs, run, schema)
