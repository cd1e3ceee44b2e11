"""Linear transforms: PCA, LDA, sparse PCA and nuisance projection. Sums in the plan, small eigenproblems on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from strideframe.errors import TrainingError
from strideframe.functions import vectors as V
from strideframe.operators.gaussians import second_order


class Projection:
    """y = A (x - m); rows of A are axes."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, values: np.ndarray | None = None):
        self.mean, self.axes, self.values = np.asarray(mean, float), np.asarray(axes, float), values

    def apply(self, frames: DataFrame, rank: int | None = None) -> DataFrame:
        """As an expression: no Python per row."""
        axes = self.axes[:rank]
        centred = F.zip_with("x", V.literal(self.mean), lambda p, m: p - m)
        return frames.withColumn("x", V.let(centred, lambda c: V.matvec(axes, c)))

    def apply_batches(self, frames: DataFrame, rank: int | None = None) -> DataFrame:
        """As one matrix product per Arrow batch, for wide frames."""
        axes, mean = self.axes[:rank], self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(x=list((np.stack(batch["x"].to_numpy()) - mean) @ axes.T))

        return frames.mapInPandas(run, frames.schema)


def canonical(axes: np.ndarray) -> np.ndarray:
    """Rows with their largest component positive."""
    top = np.abs(axes).argmax(1)
    return axes * np.where(axes[np.arange(len(axes)), top] < 0, -1.0, 1.0)[:, None]


def pca(samples: DataFrame, rank: int | None = None) -> Projection:
    """Eigenvectors of the covariance by descending eigenvalue; at most as many as samples or dimensions."""
    s = second_order(samples)
    m = s["s1"] / s["n"]
    values, vectors = np.linalg.eigh(s["s2"] / s["n"] - np.outer(m, m))
    keep = min(s["n"], len(m), rank or len(m))
    order = np.argsort(-values)[:keep]
    return Projection(m, canonical(vectors.T[order]), values[order])


def scatter(samples: DataFrame, priors: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(mean, within, between, priors) from per-class sums."""
    stats = {k[0]: v for k, v in second_order(samples, "c").items()}
    total = sum(s["n"] for s in stats.values())
    p = priors or {c: s["n"] / total for c, s in stats.items()}
    means = {c: s["s1"] / s["n"] for c, s in stats.items()}
    mean = sum(p[c] * means[c] for c in stats)
    within = sum(p[c] * (s["s2"] / s["n"] - np.outer(means[c], means[c])) for c, s in stats.items())
    between = sum(p[c] * np.outer(means[c] - mean, means[c] - mean) for c in stats)
    return mean, within, between, p


def lda(samples: DataFrame, rank: int | None = None, priors: dict | None = None) -> Projection:
    """Eigenvectors of pinv(within) between; at most classes - 1."""
    mean, within, between, p = scatter(samples, priors)
    if len(p) < 2:
        raise TrainingError("LDA needs two classes")
    values, vectors = np.linalg.eig(np.linalg.pinv(within, rcond=1e-12) @ between)
    keep = min(len(p) - 1, rank or len(mean))
    order = np.argsort(-values.real)[:keep]
    axes = vectors.real.T[order]
    return Projection(mean, canonical(axes / np.linalg.norm(axes, axis=1, keepdims=True)), values.real[order])


def sparse_pca(samples: DataFrame, rank: int) -> Projection:
    """As pca, but the values are not divided by the sample count; fewer samples than dimensions go through their inner products."""
    first = samples.select("x").first()
    if first is None:
        raise TrainingError("no samples")
    d = len(first["x"])
    rows = samples.select("x").limit(d).collect()
    if len(rows) == d:
        s = second_order(samples)
        mean = s["s1"] / s["n"]
        values, vectors = np.linalg.eigh(s["s2"] - s["n"] * np.outer(mean, mean))
        order = np.argsort(-values)[: min(rank, d)]
        return Projection(mean, canonical(vectors.T[order]), np.maximum(values[order], 0.0))
    x = np.array([r["x"] for r in rows])
    mean = x.mean(0)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    keep = min(rank, len(s))
    return Projection(mean, canonical(vt[:keep]), s[:keep] ** 2)


class Nuisance:
    """x minus its part in the span of orthonormal rows v."""

    def __init__(self, axes: np.ndarray):
        self.axes = np.asarray(axes, float)

    def matrix(self, rank: int = 0) -> np.ndarray:
        """I - V V^T with the first ``rank`` axes, 0: all."""
        v = self.axes[: rank or None]
        return np.eye(v.shape[1]) - v.T @ v

    def apply(self, frames: DataFrame, rank: int = 0, block: int | None = None) -> DataFrame:
        """Project frames, or each block of a frame of that width."""
        v = self.axes[: rank or None]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_numpy())
                    wide = x.reshape(-1, block) if block else x
                    yield batch.assign(x=list((wide - (wide @ v.T) @ v).reshape(x.shape)))

        return frames.mapInPandas(run, frames.schema)


def nap(samples: DataFrame, rank: int, session: str = "utt_id", speaker: str = "c") -> Nuisance:
    """Main axes of what differs between samples of one speaker: eigenvectors of the within-speaker scatter.

    With weight 1 between samples of one speaker, sum W_ij (x_i - x_j)(x_i - x_j)^T is, per speaker, n times its
    scatter: block sums replace the n x n weights.
    """
    stats = second_order(samples.withColumn("c", F.col(speaker)), "c")
    d = len(next(iter(stats.values()))["s1"])
    z = np.zeros((d, d))
    for s in stats.values():
        z += s["n"] * s["s2"] - np.outer(s["s1"], s["s1"])
    values, vectors = np.linalg.eigh(z)
    order = np.argsort(-values)[:rank]
    return Nuisance(canonical(vectors.T[order]))


def nap_kernel(x: np.ndarray, w: np.ndarray, rank: int) -> np.ndarray:
    """Axes by explicit weights of a few samples: eigenvectors of A^T Z(W) A, or of Z K where samples are fewer than dimensions."""
    z = np.diag(w.sum(1)) - w
    if len(x) > x.shape[1]:
        values, vectors = np.linalg.eigh(x.T @ z @ x)
        axes = vectors.T[np.argsort(-values)[:rank]]
    else:
        values, vectors = np.linalg.eig(z @ (x @ x.T))
        axes = (x.T @ vectors.real[:, np.argsort(-values.real)[:rank]]).T
    return canonical(axes / np.linalg.norm(axes, axis=1, keepdims=True))


def mnap(samples: DataFrame, rank: int, width: int, speaker: str = "c") -> dict[int, Nuisance]:
    """A nuisance projection for each block of ``width`` dimensions."""
    cut = F.transform(F.sequence(F.lit(0), (F.size("x") / width).cast("int") - 1), lambda b: F.slice("x", b * width + 1, width))
    blocks = samples.select(F.col(speaker).alias("c"), F.posexplode(cut).alias("b", "x"))
    stats = second_order(blocks, "b", "c")
    out: dict[int, np.ndarray] = {}
    for (b, _), s in stats.items():
        out[b] = out.get(b, 0) + s["n"] * s["s2"] - np.outer(s["s1"], s["s1"])
    made = {}
    for b, z in sorted(out.items()):
        values, vectors = np.linalg.eigh(z)
        made[b] = Nuisance(canonical(vectors.T[np.argsort(-values)[:rank]]))
    return made


def apply_mnap(frames: DataFrame, projections: dict[int, Nuisance], width: int) -> DataFrame:
    """Each block by its own projection."""
    mats = {b: n.matrix() for b, n in projections.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).copy()
                for b, m in mats.items():
                    x[:, b * width : (b + 1) * width] = x[:, b * width : (b + 1) * width] @ m
                yield batch.assign(x=list(x))

    return frames.mapInPandas(run, frames.schema)


def pinv(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse; singular values below max(shape) * largest * eps count as 0."""
    return np.linalg.pinv(np.asarray(a, float), rcond=max(np.shape(a)) * np.finfo(float).eps)


def axes_frame(spark, projection: Projection) -> DataFrame:
    """(k, dim, v) of the axes."""
    rows = [(k, i, float(v)) for k, axis in enumerate(projection.axes) for i, v in enumerate(axis)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("v", T.DoubleType())]))
