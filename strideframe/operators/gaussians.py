"""Gaussians and mixtures: scoring as expressions, estimation as mergeable sums over frames and small driver-side updates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strideframe.errors import TrainingError
from strideframe.functions import vectors as V
from strideframe.operators.order import total_before

LOG_FLOOR = math.log(1e-256)
PLAIN_FLOOR, MLE_FLOOR = 1e-10, 1e-3


@dataclass
class Mixture:
    """Weights (k), means (k, d) and covariances: (k, d) where diagonal, else (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    name: str = "mixture"
    diagonal: bool = field(init=False)

    def __post_init__(self):
        self.weights, self.means, self.covs = (np.asarray(v, float) for v in (self.weights, self.means, self.covs))
        self.diagonal = self.covs.ndim == 2

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row and component, floored."""
        d = self.means.shape[1]
        if self.diagonal:
            # (x - m)^2 / v as three matrix products.
            p = 1.0 / self.covs
            square = (x * x) @ p.T - 2 * x @ (self.means * p).T + (self.means**2 * p).sum(1)
            norm = np.log(self.covs).sum(1)
        else:
            square, norm = np.empty((len(x), len(self.weights))), np.empty(len(self.weights))
            for k, (m, c) in enumerate(zip(self.means, self.covs, strict=True)):
                try:
                    low = np.linalg.cholesky(c)
                    square[:, k] = (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
                    norm[k] = 2 * np.log(np.diag(low)).sum()
                except np.linalg.LinAlgError:  # not positive definite: its diagonal
                    v = np.maximum(np.diag(c), PLAIN_FLOOR)
                    square[:, k], norm[k] = ((x - m) ** 2 / v).sum(1), np.log(v).sum()
        dense = np.maximum(-0.5 * (norm + d * math.log(2 * math.pi) + square), LOG_FLOOR)
        with np.errstate(divide="ignore"):
            return np.log(self.weights) + dense

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scored(x)[1]

    def scored(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the components and log score of each row, from one evaluation of the densities."""
        parts = self.log_parts(x)
        top = parts.max(1, keepdims=True)
        p = np.exp(parts - top)
        total = p.sum(1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self.scored(x)[0]

    def draw(self, n: int, seed: int) -> np.ndarray:
        """n samples; the deviation is the square root of the variance."""
        rng = np.random.default_rng(seed)
        ks = rng.choice(len(self.weights), n, p=self.weights / self.weights.sum())
        z = rng.standard_normal((n, self.means.shape[1]))
        if self.diagonal:
            return self.means[ks] + z * np.sqrt(self.covs[ks])
        lows = np.linalg.cholesky(self.covs)
        return self.means[ks] + np.einsum("nij,nj->ni", lows[ks], z)

    def marginalize(self, keep: Sequence[int]) -> Mixture:
        """Only the kept dimensions."""
        covs = self.covs[:, keep] if self.diagonal else self.covs[:, keep][:, :, keep]
        return Mixture(self.weights, self.means[:, keep], covs, self.name)

    def supervector(self, weights: bool = False, means: bool = True, variances: bool = False) -> np.ndarray:
        """Chosen parameters of all components, one after another."""
        parts = []
        for k in range(len(self.weights)):
            parts += [[self.weights[k]]] * weights + [self.means[k]] * means + [np.ravel(self.covs[k])] * variances
        return np.concatenate(parts)

    def interpolate(self, other: Mixture, alpha: float) -> Mixture:
        """alpha * other + (1 - alpha) * self."""
        mix = lambda a, b: alpha * b + (1 - alpha) * a
        return Mixture(mix(self.weights, other.weights), mix(self.means, other.means), mix(self.covs, other.covs), self.name)

    def variances(self) -> np.ndarray:
        return self.covs if self.diagonal else np.array([np.diag(c) for c in self.covs])


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def cdf(x: float) -> float:
    return NormalDist().cdf(x)


# ---- expressions with fixed parameters


def log_density(x: Column, mean: Sequence[float], var: Sequence[float]) -> Column:
    """Log density of a diagonal Gaussian."""
    constant = sum(map(math.log, var)) + len(var) * math.log(2 * math.pi)
    terms = F.zip_with(F.zip_with(x, V.literal(mean), lambda p, m: (p - m) * (p - m)), V.literal(var), lambda q, v: q / v)
    return F.greatest(-0.5 * (V.total(terms) + F.lit(constant)), F.lit(LOG_FLOOR))


def log_parts(x: Column, model: Mixture) -> Column:
    """Array of log(weight * density) of a diagonal mixture."""
    return F.array(*[F.lit(math.log(w)) + log_density(x, m, v) for w, m, v in zip(model.weights, model.means, model.covs, strict=True)])


def log_sum(parts: Column) -> Column:
    return V.let(F.array_max(parts), lambda top: top + F.log(V.total(F.transform(parts, lambda p: F.exp(p - top)))))


def log_score(x: Column, model: Mixture) -> Column:
    return V.let(log_parts(x, model), log_sum)


def posteriors(x: Column, model: Mixture) -> Column:
    """Probabilities of the components given x, by log-sum-exp."""
    return V.let(log_parts(x, model), lambda ps: V.let(log_sum(ps), lambda s: F.transform(ps, lambda p: F.exp(p - s))))


def classify(x: Column, model: Mixture, priors: bool = True) -> Column:
    """The most probable component, with or without its weight."""
    flat = Mixture(np.ones(len(model.weights)), model.means, model.covs)
    return V.let(log_parts(x, model if priors else flat), V.argmax)


def akl(a: Column, b: Column, model: Mixture, kernel: bool = False) -> Column:
    """Distance sum of w (ma - mb)^2 / v of two mean supervectors, or the kernel sum of w ma mb / v."""
    scale = np.ravel(model.weights[:, None] / model.variances())
    pair = V.multiply(a, b) if kernel else F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return V.dot(pair, V.literal(scale))


# ---- moments and maximum likelihood


def moments(samples: DataFrame, *by: str) -> DataFrame:
    """(by..., dim, n, mean, var): population moments per dimension."""
    long = samples.select(*by, F.posexplode("x").alias("dim", "v"))
    return long.groupBy(*by, "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def covariances(samples: DataFrame, dims: int, *by: str) -> DataFrame:
    """(by..., i, j, cov) with j <= i: population covariances by one aggregation of dims(dims+1)/2 sums."""
    x = F.col("x")
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    aggs = [F.covar_pop(x[i], x[j]).alias(f"c{V.packed_index(i, j)}") for i, j in pairs]
    wide = samples.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{V.packed_index(i, j)}").alias("cov")) for i, j in pairs])).alias("_p")).select(*by, "_p.*")


def gaussian(samples: DataFrame, diagonal: bool = True) -> Mixture:
    """One Gaussian of all samples: sums in the plan, one small row to the driver."""
    stats = second_order(samples)
    m = stats["s1"] / stats["n"]
    c = stats["s2"] / stats["n"] - np.outer(m, m)
    c = np.maximum(np.diag(c), PLAIN_FLOOR) if diagonal else c
    return Mixture(np.ones(1), m[None], c[None])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as one matrix, rows of equal width."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def vector_sums(samples: DataFrame, terms: Callable[[np.ndarray], np.ndarray], *by: str, label: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
    """Sums over all samples x of a group of what ``terms`` gives for some of its rows: one vector of fixed length per group.

    Groups are told by the columns ``by``, or by the integers that ``label`` gives for a batch's rows (those below 0 are
    left out). One pass: a task adds its batches up and gives one row per entry, which one small exchange sums.
    """
    fields = [samples.schema[c] for c in by] if label is None else [T.StructField("c", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("_i", T.IntegerType()), T.StructField("_v", T.DoubleType())])
    names = [f.name for f in fields]

    def flush(sums: dict) -> Iterator[pa.RecordBatch]:
        for key, total in sums.items():
            columns = [pa.repeat(pa.scalar(k, from_key.type), len(total)) for k, from_key in zip(key, keys_like, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=schema.names)

    keys_like: list[pa.Array] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("x"))
            if label is not None:
                groups = {(int(c),): np.flatnonzero(found == c) for found in [label(x)] for c in np.unique(found) if c >= 0}
                keys_like[:] = [pa.array([], pa.int32())]
            else:
                keys_like[:] = [batch.column(c) for c in by]
                rows: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(k.to_pylist() for k in keys_like), strict=True)) if by else ():
                    rows.setdefault(key, []).append(i)
                groups = rows or {(): slice(None)}
            for key, mine in groups.items():
                part = terms(x[mine])
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) > 1024:
                yield from flush(sums)
                sums = {}
        yield from flush(sums)

    long = samples.select(*by, "x").mapInArrow(run, schema).groupBy(*names, "_i").agg(F.sum("_v").alias("_v"))
    out: dict[tuple, dict[int, float]] = {}
    for row in long.collect():
        out.setdefault(tuple(row[: len(names)]), {})[row["_i"]] = row["_v"]
    return {key: np.array([v for _, v in sorted(values.items())]) for key, values in out.items()}


def _squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), np.ravel(x.T @ x)])


def _unpacked(v: np.ndarray) -> dict:
    d = round((math.sqrt(4 * len(v) - 3) - 1) / 2)  # 1 + d + d^2 entries
    return {"n": int(v[0]), "s1": v[1 : 1 + d], "s2": v[1 + d :].reshape(d, d)}


def second_order(samples: DataFrame, *by: str) -> dict:
    """n, sum of x and of x x^T in one pass; a dict per group where ``by`` is given."""
    out = {key: _unpacked(v) for key, v in vector_sums(samples, _squares, *by).items()}
    if not out:
        raise TrainingError("no samples")
    return out if by else out[()]


def _second_order_by(samples: DataFrame, label: Callable[[np.ndarray], np.ndarray]) -> dict[int, dict]:
    return {key[0]: _unpacked(v) for key, v in vector_sums(samples, _squares, label=label).items()}


# ---- expectation maximisation


def accumulate(samples: DataFrame, model: Mixture) -> dict:
    """Zeroth, first and second moments weighted by the posteriors, with the summed log score: one row to the driver."""
    k, d = model.means.shape

    def terms(x: np.ndarray) -> np.ndarray:
        g, score = model.scored(x)
        s2 = g.T @ (x * x) if model.diagonal else np.einsum("nk,ni,nj->kij", g, x, x, optimize=True)
        return np.concatenate([[len(x), score.sum()], g.sum(0), np.ravel(g.T @ x), np.ravel(s2)])

    found = vector_sums(samples, terms)
    if not found:
        raise TrainingError("no samples")
    v = found[()]
    shape = (k, d) if model.diagonal else (k, d, d)
    return {"n": int(v[0]), "llh": float(v[1]), "occ": v[2 : 2 + k], "s1": v[2 + k : 2 + k + k * d].reshape(k, d), "s2": v[2 + k + k * d :].reshape(shape)}


def merge(a: dict, b: dict) -> dict:
    """Accumulators of disjoint data as that of all."""
    return {key: a[key] + b[key] for key in a}


def mle_update(model: Mixture, acc: dict, flags: str = "wmv", min_occ: float = 0.0, floor: float = MLE_FLOOR) -> Mixture:
    """New parameters from an accumulator; components with too little mass stay as they are; only variances are floored."""
    ok = acc["occ"] > max(min_occ, 0.0)
    occ = np.where(ok, acc["occ"], 1.0)
    means = np.where(ok[:, None], acc["s1"] / occ[:, None], model.means) if "m" in flags else model.means
    covs = model.covs
    if "v" in flags:
        if model.diagonal:
            covs = np.where(ok[:, None], np.maximum(acc["s2"] / occ[:, None] - means**2, floor), model.covs)
        else:
            covs = np.where(ok[:, None, None], acc["s2"] / occ[:, None, None] - np.einsum("ki,kj->kij", means, means), model.covs)
            i = np.arange(covs.shape[1])
            covs[:, i, i] = np.maximum(covs[:, i, i], floor)
    weights = acc["occ"] / acc["occ"].sum() if "w" in flags else model.weights
    return Mixture(weights, means, covs, model.name)


def em(samples: DataFrame, model: Mixture, iterations: int, **options) -> tuple[Mixture, list[float]]:
    """So many EM steps; also the log score before each. The samples should be persisted by the caller."""
    scores = []
    for _ in range(iterations):
        acc = accumulate(samples, model)
        scores.append(acc["llh"])
        model = mle_update(model, acc, **options)
    return model, scores


def map_update(model: Mixture, acc: dict, relevance: float = 16.0, flags: str = "pmc") -> Mixture:
    """MAP adaptation: alpha = n / (relevance + n) of the new moments, the rest of the old; p, m, c choose what moves."""
    occ = acc["occ"]
    a = occ / (relevance + occ)
    safe = np.where(occ > 0, occ, 1.0)
    weights, means, covs = model.weights, model.means, model.covs
    if "p" in flags:
        weights = a * occ / acc["n"] + (1 - a) * weights
        weights = weights / weights.sum()
    if "m" in flags:
        means = a[:, None] * acc["s1"] / safe[:, None] + (1 - a)[:, None] * model.means
    if "c" in flags:
        if model.diagonal:
            covs = a[:, None] * acc["s2"] / safe[:, None] + (1 - a)[:, None] * (model.covs + model.means**2) - means**2
        else:
            outer = lambda m: np.einsum("ki,kj->kij", m, m)
            b = a[:, None, None]
            covs = b * acc["s2"] / safe[:, None, None] + (1 - b) * (model.covs + outer(model.means)) - outer(means)
    return Mixture(weights, means, covs, model.name)


# ---- initialisation and clustering


def partitioned_init(samples: DataFrame, n: int, method: str = "sequential", seed: int = 0, order: Sequence[str] = ("utt_id", "frame_idx")) -> Mixture:
    """A diagonal Gaussian for each part of the data: blocks (sequential), every n-th (uniform) or hashed (random)."""
    if method == "random":
        keyed = samples.select("x", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(n)).cast("int").alias("c"))
    else:
        numbered = _numbered(samples, order)
        total = samples.count()
        place = F.floor(F.col("_i") * n / total) if method == "sequential" else F.col("_i") % n
        keyed = numbered.select("x", place.cast("int").alias("c"))
    stats = second_order(keyed, "c")
    if len(stats) < n or any(s["n"] < 3 for s in stats.values()):
        raise TrainingError("each part needs three samples")
    return _from_groups([stats[(c,)] for c in range(n)])


def _numbered(samples: DataFrame, order: Sequence[str]) -> DataFrame:
    """A global number in the order of utterances, from prefix sums of their lengths, not one global sort."""
    first, *rest = order
    starts = total_before(samples.groupBy(first).agg(F.count("*").alias("n")), first, "n", "_s").select(first, "_s")
    inside = F.row_number().over(Window.partitionBy(first).orderBy(*(rest or [first]))) - 1
    return samples.join(starts, first).withColumn("_i", F.col("_s") + inside)


def _from_groups(groups: list[dict]) -> Mixture:
    n = np.array([g["n"] for g in groups], float)
    means = np.array([g["s1"] / g["n"] for g in groups])
    squares = [g["s2"] if np.ndim(g["s2"]) == 1 else np.diag(g["s2"]) for g in groups]
    covs = np.array([np.maximum(q / g["n"] - m**2, PLAIN_FLOOR) for g, q, m in zip(groups, squares, means, strict=True)])
    return Mixture(n / n.sum(), means, covs)


def nearest(x: Column, means: Sequence[Sequence[float]]) -> Column:
    """The nearest of a few means, the first of equals."""
    squares = F.array(*[V.total(F.zip_with(x, V.literal(m), lambda p, q: (p - q) * (p - q))) for m in means])
    return V.let(squares, V.argmin)


def _closest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Places of the nearest means, the first of equals."""
    return np.stack([((x - m) ** 2).sum(1) for m in means], 1).argmin(1)


def _cluster_sums(samples: DataFrame, label: Callable[[np.ndarray], np.ndarray], d: int) -> dict[int, dict]:
    """n, the sum of x and of its squares by label, in one pass."""
    found = vector_sums(samples, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), label=label)
    return {key[0]: {"n": int(v[0]), "s1": v[1 : 1 + d], "s2": v[1 + d :]} for key, v in found.items()}


def kmeans(samples: DataFrame, start: Mixture, most: int = 100, eps: float = 1e-5) -> Mixture:
    """Lloyd's algorithm; an empty cluster restarts beside the largest one. Only sums per cluster reach the driver."""
    model = start
    for _ in range(most):
        means = model.means
        stats = _cluster_sums(samples, lambda x, means=means: _closest(x, means), means.shape[1])
        if not stats:
            raise TrainingError("no samples")
        model = _from_groups(_restarted(stats, len(means)))
        if np.linalg.norm(model.means - means, axis=1).sum() <= eps:
            break
    return model


def _restarted(stats: dict[int, dict], k: int) -> list[dict]:
    """The sums of k clusters; an empty one gets a place beside the largest."""
    largest = max(stats, key=lambda c: stats[c]["n"])
    groups = []
    for c in range(k):
        if c in stats:
            groups.append(stats[c])
        else:
            g = stats[largest]
            moved = g["s1"] * (1 + 1e-3)
            groups.append({"n": 1, "s1": moved / g["n"], "s2": (moved / g["n"]) ** 2})
    return groups


# Samples near a border between clusters that the driver may hold at once, and the margins (distances to the second
# nearest mean less that to the nearest) among which it chooses.
NEAR_BYTES = 8 << 20
MARGINS = 2.0 ** np.arange(-30, 30.5, 0.5)


def _nearest(x: np.ndarray, centres: dict[int, np.ndarray], cell: Callable[[np.ndarray], np.ndarray] | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Label (cell * width + place of the nearest centre, the first of equals; -1 in other cells) and margin of each row."""
    where = np.zeros(len(x), int) if cell is None else cell(x)
    label, margin = np.full(len(x), -1), np.full(len(x), np.inf)
    for c, own in centres.items():
        mine = where == c
        square = np.stack([((x[mine] - m) ** 2).sum(1) for m in own], 1)
        label[mine] = c * width + square.argmin(1)
        if len(own) > 1:
            two = np.sqrt(np.partition(square, 1, axis=1)[:, :2])
            margin[mine] = two[:, 1] - two[:, 0]
    return label, margin


def _lloyd(samples: DataFrame, centres: dict[int, np.ndarray], step: Callable[[dict, dict], dict], cell: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
    """Lloyd's algorithm within cells until ``step`` (centres, sums by label -> new centres of the cells that go on) gives none.

    A sample whose margin is more than twice what any centre has moved since keeps its place. So after a pass over all
    samples the driver takes those of the least margins, as many as it may hold, and goes on with them and the sums of
    the others, step by step as passes would, until a centre has left that range.
    """
    d, width = next(iter(centres.values())).shape[1], max(map(len, centres.values()))
    sums_of = lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
    stats_of = lambda sums: {c: {"n": int(v[0]), "s1": v[1 : 1 + d], "s2": v[1 + d : 1 + 2 * d]} for c, v in sums.items() if v[0] > 0.5}

    def by_label(x: np.ndarray, label: np.ndarray) -> dict[int, np.ndarray]:
        return {int(c): sums_of(x[label == c]) for c in np.unique(label) if c >= 0}

    while centres:
        anchor = centres
        near = lambda x, anchor=anchor: _nearest(x, anchor, cell, width)

        def terms(x: np.ndarray, near=near) -> np.ndarray:
            return np.concatenate([sums_of(x), np.searchsorted(np.sort(near(x)[1]), MARGINS, "right")])

        found = {key[0]: v for key, v in vector_sums(samples, terms, label=lambda x, near=near: near(x)[0]).items()}
        if not found:
            raise TrainingError("no samples")
        centres = step(anchor, stats_of(found))
        moved = lambda now, anchor=anchor: max(np.linalg.norm(now[c] - anchor[c], axis=1).max() for c in now)
        few = np.flatnonzero(sum(v[1 + 2 * d :] for v in found.values()) <= NEAR_BYTES // (8 * d))
        if not centres or not len(few) or 0.49 * MARGINS[few[-1]] < 3 * moved(centres):
            continue
        most = float(MARGINS[few[-1]])

        def close(batches: Iterator[pa.RecordBatch], near=near, most=most) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    label, margin = near(matrix(batch.column("x")))
                    kept = np.flatnonzero((label >= 0) & (margin <= most))
                    if len(kept):
                        yield batch.take(pa.array(kept))

        table = samples.select("x").mapInArrow(close, T.StructType([samples.schema["x"]])).toArrow()
        x = matrix(table.column("x").combine_chunks()) if len(table) else np.empty((0, d))
        parts = by_label(x, near(x)[0])
        rest = {c: v[: 1 + 2 * d] - parts.get(c, 0) for c, v in found.items()}
        while centres and moved(centres) <= 0.49 * most:
            parts = by_label(x, _nearest(x, centres, cell, width)[0])
            centres = step(centres, stats_of({c: rest.get(c, 0) + parts.get(c, 0) for c in {*rest, *parts} if c // width in centres}))


def _settled(samples: DataFrame, means: np.ndarray) -> Mixture:
    """K-means until no mean moves any more."""
    found: list[Mixture] = []

    def step(centres: dict, stats: dict) -> dict:
        found[:] = [_from_groups(_restarted(stats, len(centres[0])))]
        return {} if np.linalg.norm(found[0].means - centres[0], axis=1).sum() <= 1e-10 else {0: found[0].means}

    _lloyd(samples, {0: np.asarray(means, float)}, step)
    return found[0]


def lbg(samples: DataFrame, n: int, eps: float = 0.05, conv: float = 1e-3) -> Mixture:
    """Split the most populated cell into m (1 + eps) and m (1 - eps), refine by k-means, until there are n."""
    model = gaussian(samples)
    while len(model.weights) < n:
        k = int(model.weights.argmax())
        means = np.vstack([np.delete(model.means, k, 0), model.means[k] * (1 + eps), model.means[k] * (1 - eps)])
        model = kmeans(samples, Mixture(np.full(len(means), 1 / len(means)), means, np.ones_like(means)), 20, conv)
    return model


# Levels and critical values of the Anderson-Darling normality test with estimated parameters.
AD_CRITICAL = {0.1: 0.656, 0.05: 0.787, 0.025: 0.918, 0.001: 1.092, 0.0001: 1.8692}


def anderson_darling(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by..., n, a2): the test statistic for normality, (1 + 4/n - 25/n^2) times A^2.

    Phi is taken by Spark's error function twin: 1 - erfc, through a vectorised function, as the JVM has none.
    """
    part = Window.partitionBy(*by)
    rows = df.select(*by, F.col(column).cast("double").alias("v"))
    rows = rows.withColumns({"m": F.avg("v").over(part), "s": F.stddev_pop("v").over(part), "n": F.count("*").over(part)})
    rows = rows.withColumns({"i": F.row_number().over(part.orderBy("v")), "z": (F.col("v") - F.col("m")) / F.col("s")})
    phi = normal_cdf(F.col("z"))
    clipped = F.greatest(F.least(phi, F.lit(1 - 1e-15)), F.lit(1e-15))
    terms = rows.select(*by, "n", "i", clipped.alias("p"))
    # Row i pairs with row n + 1 - i: weights of ln F_i and of ln(1 - F_i) by its own place.
    w1, w2 = 2 * F.col("i") - 1, 2 * (F.col("n") - F.col("i")) + 1
    sums = terms.groupBy(*by, "n").agg(F.sum(w1 * F.log("p") + w2 * F.log(1 - F.col("p"))).alias("t"))
    n = F.col("n").cast("double")
    return sums.select(*by, "n", ((-n - F.col("t") / n) * (1 + 4 / n - 25 / (n * n))).alias("a2"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function as an expression: a published rational approximation, error < 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _split_axis(stats: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = stats["s1"] / stats["n"]
    values, axes = np.linalg.eigh(stats["s2"] / stats["n"] - np.outer(m, m))
    return m, axes[:, -1], values


RANKINGS = ("COVARIANCE", "SUM_EIGENVALUE", "EV_DIFFERENCE", "EV", "AD_STATISTIC", "NUM_SAMPLES")


def hierarchical(samples: DataFrame, most: int, ranking: str = "EV", least: int = 50, ad_limit: float = 2.0) -> Mixture:
    """Split the highest-ranked cluster at its mean along its first axis, while both children keep enough samples.

    A split is a rule (parent, point, axis), so the tree of rules, not the samples, is what the driver holds; each
    step is one pass that sums what the open clusters need.
    """
    if ranking not in RANKINGS:
        raise ValueError(f"ranking must be one of {RANKINGS}")
    tree: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []  # (node, point, axis, left, right)
    fresh, closed, leaves = 1, set(), {0}

    def stats_now() -> dict[int, dict]:
        rules = list(tree)

        def label(x: np.ndarray) -> np.ndarray:
            node = np.zeros(len(x), np.int32)
            for parent, point, axis, left, right in rules:
                mine = node == parent
                node[mine] = np.where((x[mine] - point) @ axis <= 0, left, right)
            return node

        return _second_order_by(samples, label)

    now, normality = stats_now(), {}
    while len(leaves) < most:
        scores = {}
        for leaf in leaves - closed:
            m, axis, values = _split_axis(now[leaf])
            if ranking == "AD_STATISTIC" and leaf not in normality:
                normality[leaf] = projected_ad(samples, tree, leaf, m, axis)
            scores[leaf] = {"COVARIANCE": float(np.abs(values).prod()), "SUM_EIGENVALUE": float(values.sum()), "EV_DIFFERENCE": float(values[-1] - values[0]),
                            "EV": float(values[-1]), "NUM_SAMPLES": float(now[leaf]["n"]), "AD_STATISTIC": normality.get(leaf)}[ranking]
        if not scores:
            break
        leaf = max(sorted(scores), key=scores.get)
        m, axis, _ = _split_axis(now[leaf])
        if ranking == "AD_STATISTIC" and normality[leaf] <= ad_limit:
            closed.add(leaf)
            continue
        tree.append((leaf, m, axis, fresh, fresh + 1))
        after = stats_now()
        if min(after.get(c, {"n": 0})["n"] for c in (fresh, fresh + 1)) < least:
            tree.pop()
            closed.add(leaf)
            continue
        leaves = leaves - {leaf} | {fresh, fresh + 1}
        fresh, now = fresh + 2, after
    return _from_groups([now[leaf] for leaf in sorted(leaves)])


def projected_ad(samples: DataFrame, tree: list, leaf: int, point: np.ndarray, axis: np.ndarray) -> float:
    """The normality statistic of a cluster's samples along an axis."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                node = np.zeros(len(x), np.int32)
                for parent, at, way, left, right in tree:
                    mine = node == parent
                    node[mine] = np.where((x[mine] - at) @ way <= 0, left, right)
                yield pd.DataFrame({"v": (x[node == leaf] - point) @ axis})

    return normality_statistic(samples.select("x").mapInPandas(run, "v double"))


def normality_statistic(values: DataFrame) -> float:
    """As anderson_darling for one group (v) of any size: ranked by range partitions, a few sums of each on the driver; 0 for constants."""
    values = values.persist()
    try:
        n, mean, dev = values.agg(F.count("v"), F.avg("v"), F.stddev_pop("v")).first()
        if n < 2 or not dev > 0:
            return 0.0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Row j of a partition has rank offset + j; what depends on the offset is kept apart.
            count, fixed, slope, low = 0, 0.0, 0.0, None
            for batch in batches:
                if len(batch):
                    v = batch["v"].to_numpy()
                    low = v[0] if low is None else low
                    f = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in (v - mean) / dev])
                    f = np.clip(f, 1e-15, 1 - 1e-15)
                    a, b, j = np.log(f), np.log1p(-f), count + np.arange(1, len(v) + 1)
                    fixed += float(((2 * j - 1) * a + (2 * (n - j) + 1) * b).sum())
                    slope += float((2 * (a - b)).sum())
                    count += len(v)
            if count:
                yield pd.DataFrame([[low, count, fixed, slope]], columns=["low", "count", "fixed", "slope"])

        parts = values.repartitionByRange("v").sortWithinPartitions("v").mapInPandas(run, "low double, count long, fixed double, slope double")
        total, offset = 0.0, 0
        for row in sorted(parts.collect(), key=lambda r: r["low"]):
            total += row["fixed"] + offset * row["slope"]
            offset += row["count"]
        return (-n - total / n) * (1 + 4 / n - 25 / n**2)
    finally:
        values.unpersist()


def gmeans(samples: DataFrame, alpha: float, most: int) -> Mixture:
    """K-means over all centroids, then every cluster that isn't normal gives way to two, until all are normal or there are ``most``.

    A split starts at mean +- axis * sqrt(2 ev / pi) of the first axis and is refined by 2-means; the test is along the
    line between the two refined centres. Clusters are tested in order, and those without room to split keep their centre.
    """
    model = _settled(samples, gaussian(samples).means)
    while len(model.weights) < most:
        means = model.means

        stats = _second_order_by(samples, lambda x, means=means: _closest(x, means))
        pairs = _two_means(samples, means, {c: _split_start(s) for c, s in stats.items()})
        centres: list[np.ndarray] = []
        for c in range(len(means)):
            split = c in pairs and len(centres) + 2 + len(means) - c - 1 <= most
            split = split and _line_ad(samples, means, c, *pairs[c]) >= AD_CRITICAL[alpha]
            centres += list(pairs[c]) if split else [means[c]]
        if len(centres) == len(means):
            break
        model = _settled(samples, centres)
    return model


def _split_start(stats: dict) -> tuple[np.ndarray, np.ndarray]:
    m, axis, values = _split_axis(stats)
    axis = axis * (-1 if axis[np.abs(axis).argmax()] < 0 else 1)
    step = axis * math.sqrt(2 * max(values[-1], 0.0) / math.pi)
    return m + step, m - step


def _two_means(samples: DataFrame, means: np.ndarray, pairs: dict[int, tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """2-means within each cluster, all clusters at once; clusters that don't fall into two have no pair."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def step(centres: dict, stats: dict) -> dict:
        out = {}
        for c, own in centres.items():
            if 2 * c not in stats or 2 * c + 1 not in stats:
                continue
            new = np.stack([stats[k]["s1"] / stats[k]["n"] for k in (2 * c, 2 * c + 1)])
            if np.abs(new - own).sum() <= 1e-10:
                found[c] = (new[1], new[0])
            else:
                out[c] = new
        return out

    # The second of a pair first: samples between both are its own.
    _lloyd(samples, {c: np.stack([b, a]) for c, (a, b) in pairs.items()}, step, lambda x: _closest(x, means))
    return found


def _line_ad(samples: DataFrame, means: np.ndarray, c: int, a: np.ndarray, b: np.ndarray) -> float:
    """The normality statistic of cluster c along the line through a and b."""
    way = (a - b) / np.linalg.norm(a - b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                yield pd.DataFrame({"v": x[_closest(x, means) == c] @ way})

    return normality_statistic(samples.select("x").mapInPandas(run, "v double"))


# ---- discriminative update


def mmie_stats(scored: dict[str, dict], truth: str, posterior: dict[str, float], weight: float = 1.0) -> dict[str, tuple[dict, dict]]:
    """(numerator, denominator) accumulators per model of one segment."""
    scaled = lambda acc, f: {k: v * f for k, v in acc.items()}
    return {m: (scaled(acc, weight * (m == truth)), scaled(acc, weight * posterior[m])) for m, acc in scored.items()}


def mmie_accumulate(samples: DataFrame, models: dict[str, Mixture], truth: str = "c", c: float = 2.0) -> dict[str, tuple[dict, dict]]:
    """(numerator, denominator) accumulators per model over all segments (utt_id); column ``truth`` names each segment's model.

    A segment's posterior is the softmax over models of c times its mean log score. Diagonal mixtures of one shape.
    """
    k, d = next(iter(models.values())).means.shape
    width = k * (1 + 2 * d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for (utt, target), part in batch.groupby(["utt_id", "truth"], sort=False):
                x = np.stack(part["x"].to_numpy())
                for name, model in models.items():
                    g = model.posteriors(x)
                    rows.append([utt, target, name, len(x), float(model.score(x).sum()), np.concatenate([g.sum(0), np.ravel(g.T @ x), np.ravel(g.T @ (x * x))])])
            yield pd.DataFrame(rows, columns=["utt_id", "truth", "model_id", "n", "llh", "acc"])

    def weigh(segment: pd.DataFrame) -> pd.DataFrame:
        names = segment["model_id"].tolist()
        scores = c * segment["llh"].to_numpy() / segment["n"].to_numpy()
        p = np.exp(scores - scores.max())
        made = mmie_stats({m: {"acc": np.array(a)} for m, a in zip(names, segment["acc"], strict=True)}, segment["truth"].iloc[0], dict(zip(names, p / p.sum(), strict=True)))
        return pd.DataFrame([[m, den, pair[den]["acc"]] for m, pair in made.items() for den in (0, 1)], columns=["model_id", "den", "acc"])

    kind = samples.schema["utt_id"].dataType.simpleString()
    summed = lambda rows, *by: rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in ("n", "llh") if n in rows.columns], F.array(*[F.sum(F.col("acc")[i]) for i in range(width)]).alias("acc"))
    parts = samples.select("utt_id", F.col(truth).alias("truth"), "x").mapInPandas(run, f"utt_id {kind}, truth string, model_id string, n long, llh double, acc array<double>")
    segments = summed(parts, "utt_id", "truth", "model_id")
    sides = segments.groupBy("utt_id").applyInPandas(weigh, "model_id string, den int, acc array<double>")
    out: dict = {}
    for row in summed(sides, "model_id", "den").collect():
        acc = np.array(row["acc"])
        out.setdefault(row["model_id"], [None, None])[row["den"]] = {"occ": acc[:k], "s1": acc[k : k + k * d].reshape(k, d), "s2": acc[k + k * d :].reshape(k, d)}
    if not out:
        raise TrainingError("no samples")
    return {m: tuple(pair) for m, pair in out.items()}


def extended_update(model: Mixture, num: dict, den: dict, e: float = 2.0, tries: int = 100) -> Mixture:
    """Extended Baum-Welch for diagonal mixtures: D starts at E d / 2, grows by 1.1 until variances are positive, then doubles."""
    means, covs = model.means.copy(), model.covs.copy()
    for k in range(len(model.weights)):
        n, d = num["occ"][k], den["occ"][k]
        s1, s2 = num["s1"][k] - den["s1"][k], num["s2"][k] - den["s2"][k]

        def at(big: float, n=n, d=d, s1=s1, s2=s2, k=k) -> tuple[np.ndarray, np.ndarray]:
            mass = n - d + big
            m = (s1 + big * model.means[k]) / mass
            return m, (s2 + big * (model.covs[k] + model.means[k] ** 2)) / mass - m**2

        big = max(e * d / 2, 1e-6)
        for _ in range(tries):
            if n - d + big > 0 and (at(big)[1] > 0).all():
                means[k], covs[k] = at(2 * big)
                break
            big *= 1.1
    return Mixture(model.weights, means, covs, model.name)


def extended_weights(model: Mixture, num: dict, den: dict, iterations: int = 50, least: float = 1e-6) -> Mixture:
    """New weights from numerator and denominator masses: w <- n + (k - d / w0) w with k the largest d / w0, normalised once, floored."""
    n, ratio = num["occ"], den["occ"] / model.weights
    k, w = ratio.max() - ratio, model.weights.copy()
    for _ in range(iterations):
        w = n + k * w
    return Mixture(np.maximum(w / w.sum(), least), model.means, model.covs, model.name)


# ---- scoring of trials and segments


def score_frames(frames: DataFrame, models: dict[str, Mixture]) -> DataFrame:
    """(utt_id, frame_idx, model_id, score): every frame by every model, one vectorised pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                for name, model in models.items():
                    yield pd.DataFrame({"utt_id": batch["utt_id"], "frame_idx": batch["frame_idx"], "model_id": name, "score": model.score(x)})

    kind = frames.schema["utt_id"].dataType.simpleString()
    return frames.select("utt_id", "frame_idx", "x").mapInPandas(run, f"utt_id {kind}, frame_idx long, model_id string, score double")


def segment_posteriors(scores: DataFrame) -> DataFrame:
    """(utt_id, model_id, mean, p, best): softmax of mean log scores over models, and the best model of the segment."""
    means = scores.groupBy("utt_id", "model_id").agg(F.avg("score").alias("mean"))
    part = Window.partitionBy("utt_id")
    top = F.max("mean").over(part)
    rows = means.withColumn("_e", F.exp(F.col("mean") - top))
    best = F.first("model_id").over(part.orderBy(F.desc("mean"), "model_id"))
    return rows.select("utt_id", "model_id", "mean", (F.col("_e") / F.sum("_e").over(part)).alias("p"), best.alias("best"))


def llr_trials(trials: DataFrame, scores: DataFrame, ubm: str = "ubm") -> DataFrame:
    """(model_id, utt_id, llr): mean log ratio of the model and the background model, for each trial."""
    sums = scores.groupBy("utt_id", "model_id").agg(F.sum("score").alias("s"), F.count("*").alias("t"))
    back = sums.filter(F.col("model_id") == ubm).select("utt_id", F.col("s").alias("b"))
    return trials.join(sums, ["utt_id", "model_id"]).join(back, "utt_id").select("model_id", "utt_id", ((F.col("s") - F.col("b")) / F.col("t")).alias("llr"))


def fast_llr(trials: DataFrame, frames: DataFrame, models: dict[str, Mixture], ubm: Mixture, top: int) -> DataFrame:
    """As llr_trials, but by the background model's best components of each frame, the same ones in the speaker's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                back = ubm.log_parts(x)
                best = np.argsort(-back, axis=1)[:, :top]
                fold = lambda parts: np.logaddexp.reduce(np.take_along_axis(parts, best, 1), axis=1)
                base = fold(back)
                for name, model in models.items():
                    yield pd.DataFrame({"utt_id": batch["utt_id"], "model_id": name, "d": fold(model.log_parts(x)) - base})

    kind = frames.schema["utt_id"].dataType.simpleString()
    rows = frames.select("utt_id", "x").mapInPandas(run, f"utt_id {kind}, model_id string, d double")
    return trials.join(rows, ["utt_id", "model_id"]).groupBy("model_id", "utt_id").agg(F.avg("d").alias("llr"))
