"""Codebooks of token models with mixture emissions: allocation, training by alignments or expected counts, interpolation.

An utterance is aligned by the chain of its words' token models. Statistics are vectors of fixed length per token: a task
adds up its utterances before it gives any row, and one small exchange adds up tasks. Models travel with the function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strideframe.errors import AlignmentError, CodebookError, TrainingError
from strideframe.operators.gaussians import MLE_FLOOR, Mixture, mle_update
from strideframe.operators.hmm import Hmm, chain, forward_backward, linear_path, topology, viterbi


@dataclass
class Codebook:
    """Token models, and the mixture that those with weights only share."""

    models: dict[str, Hmm]
    shared: Mixture | None = None
    origin: str = field(default="", compare=False)

    def __getitem__(self, token: str) -> Hmm:
        if token not in self.models:
            raise CodebookError(f"no model of {token!r}")
        return self.models[token]

    def interpolate(self, other: Codebook, alpha: float) -> Codebook:
        """alpha * other + (1 - alpha) * self, model by model, with their mixtures."""
        mix = lambda a, b: alpha * np.asarray(b) + (1 - alpha) * np.asarray(a)
        out = {}
        for token, m in self.models.items():
            o = other[token]
            shared = None if m.shared is None else m.shared.interpolate(o.shared, alpha)
            out[token] = Hmm(
                mix(m.pi, o.pi), mix(m.a, o.a), None if m.symbols is None else mix(m.symbols, o.symbols),
                None if m.mixtures is None else [p.interpolate(q, alpha) for p, q in zip(m.mixtures, o.mixtures, strict=True)],
                shared, None if m.shared_weights is None else mix(m.shared_weights, o.shared_weights), m.name,
            )
        return Codebook(out, None if self.shared is None else self.shared.interpolate(other.shared, alpha), self.origin)


def continuous(alphabet: dict[str, int], start: Mixture, kind: str = "LINEAR") -> Codebook:
    """A model per token with so many states, each with its own copy of the start mixture."""
    made = {t: Hmm(_first(n), topology(n, kind), mixtures=[Mixture(start.weights, start.means, start.covs)] * n, name=t) for t, n in alphabet.items()}
    return Codebook(made)


def semicontinuous(alphabet: dict[str, int], shared: Mixture, kind: str = "LINEAR") -> Codebook:
    """A model per token whose states have weights of their own over one shared mixture."""
    made = {t: Hmm(_first(n), topology(n, kind), shared=shared, shared_weights=np.tile(shared.weights, (n, 1)), name=t) for t, n in alphabet.items()}
    return Codebook(made, shared)


def _first(n: int) -> np.ndarray:
    pi = np.zeros(n)
    pi[0] = 1.0
    return pi


def component_posteriors(model: Hmm, state: int, x: np.ndarray) -> np.ndarray:
    """(frames, components) probabilities of a state's components given its frames."""
    if model.mixtures is not None:
        return model.mixtures[state].posteriors(x)
    parts = model.shared.log_parts(x) - np.log(model.shared.weights)
    e = np.exp(parts - parts.max(1, keepdims=True)) * model.shared_weights[state]
    return e / np.maximum(e.sum(1, keepdims=True), 1e-300)


def occupation(models: Sequence[Hmm], x: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(frames, states) probabilities over a chain of models, summed transitions, and the log score. mode: linear, viterbi or expected."""
    pi, a, places = chain(models)
    n = len(places)
    if len(x) < n:
        raise AlignmentError(f"{len(x)} frames for {n} states")
    if mode == "linear":
        path, score = linear_path(len(x), n), 0.0
    else:
        each = {id(m): m.log_emissions(x) for m in models}
        b = np.column_stack([each[id(models[k])][:, s] for k, s in places])
        if mode == "expected":
            return forward_backward(pi, a, b)
        path, score = viterbi(pi, a, b, forced=True)
    gamma, xi = np.zeros((len(x), n)), np.zeros((n, n))
    gamma[np.arange(len(x)), path] = 1.0
    np.add.at(xi, (path[:-1], path[1:]), 1.0)
    return gamma, xi, score


def _layout(model: Hmm) -> tuple[int, int, int, tuple]:
    """States, components, width and the shape of second moments."""
    m = model.mixtures[0] if model.mixtures is not None else model.shared
    k, d = m.means.shape
    return len(model.pi), k, d, (k, d) if m.diagonal else (k, d, d)


def _moments(g: np.ndarray, x: np.ndarray, diagonal: bool) -> list[np.ndarray]:
    second = g.T @ (x * x) if diagonal else np.einsum("nk,ni,nj->kij", g, x, x, optimize=True)
    return [g.sum(0), np.ravel(g.T @ x), np.ravel(second)]


def _collect(sums: dict[str, np.ndarray], book: Codebook, tokens: list[str], x: np.ndarray, mode: str) -> float:
    """Add one utterance to the vectors of its tokens (and of the shared mixture, under the empty name)."""
    gamma, xi, score = occupation([book[t] for t in tokens], x, mode)
    at = 0
    for token in tokens:
        model = book[token]
        n = len(model.pi)
        own = gamma[:, at : at + n]
        parts = [own[0] if at == 0 else np.zeros(n), np.ravel(xi[at : at + n, at : at + n])]
        pooled = None
        for s in range(n):
            g = own[:, s : s + 1] * component_posteriors(model, s, x)
            if model.mixtures is not None:
                parts += _moments(g, x, model.mixtures[s].diagonal)
            else:
                parts.append(g.sum(0))
                pooled = g if pooled is None else pooled + g
        v = np.concatenate([np.ravel(p) for p in parts])
        sums[token] = sums[token] + v if token in sums else v
        if pooled is not None:
            w = np.concatenate(_moments(pooled, x, book.shared.diagonal))
            sums[""] = sums[""] + w if "" in sums else w
        at += n
    return score


def statistics(frames: DataFrame, turns: DataFrame, lexicon: dict[str, Sequence[str]], book: Codebook, mode: str) -> tuple[dict[str, np.ndarray], float, int]:
    """Summed vectors per token, the log score and the number of utterances used. turns: (utt_id, words).

    Utterances without a turn, without words, or with fewer frames than states are left out.
    """
    packed = frames.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("s"))
    rows = packed.join(turns.select("utt_id", "words"), "utt_id").select("words", F.transform("s", lambda p: p["x"]).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        score, used = 0.0, 0
        for batch in batches:
            for words, x in zip(batch["words"], batch["x"], strict=True):
                tokens = [t for w in words for t in lexicon[w]]
                if not tokens or len(x) < sum(len(book[t].pi) for t in tokens):
                    continue
                score += _collect(sums, book, tokens, np.stack(x).astype(float), mode)
                used += 1
        for token, v in sums.items():
            yield pd.DataFrame({"token": token, "i": np.arange(len(v)), "v": v})
        yield pd.DataFrame({"token": [None, None], "i": [0, 1], "v": [score, float(used)]})

    total = rows.mapInPandas(run, "token string, i int, v double").groupBy("token", "i").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in total:
        out.setdefault(r["token"], {})[r["i"]] = r["v"]
    summary = out.pop(None, {0: 0.0, 1: 0.0})
    return {t: np.array([v for _, v in sorted(values.items())]) for t, values in out.items()}, summary[0], int(summary[1])


def update(book: Codebook, sums: dict[str, np.ndarray], floor: float = MLE_FLOOR) -> Codebook:
    """New parameters from summed vectors; what has no mass stays as it is."""
    shared = book.shared
    if shared is not None and "" in sums:
        k, d = shared.means.shape
        shape = (k, d) if shared.diagonal else (k, d, d)
        v = sums[""]
        shared = mle_update(shared, {"occ": v[:k], "s1": v[k : k + k * d].reshape(k, d), "s2": v[k + k * d :].reshape(shape)}, floor=floor)
    out = {}
    for token, m in book.models.items():
        if token not in sums:
            out[token] = Hmm(m.pi, m.a, m.symbols, m.mixtures, shared if m.shared is not None else None, m.shared_weights, m.name)
            continue
        v = sums[token]
        n, k, d, shape = _layout(m)
        pi, xi, rest = v[:n], v[n : n + n * n].reshape(n, n), v[n + n * n :]
        mass = xi.sum(1, keepdims=True)
        a = np.where(mass > 0, xi / np.where(mass > 0, mass, 1.0), m.a)
        start = pi / pi.sum() if pi.sum() > 0 else m.pi
        if m.mixtures is not None:
            size = k + k * d + int(np.prod(shape))
            made = []
            for s, old in enumerate(m.mixtures):
                w = rest[s * size : (s + 1) * size]
                acc = {"occ": w[:k], "s1": w[k : k + k * d].reshape(k, d), "s2": w[k + k * d :].reshape(shape)}
                made.append(mle_update(old, acc, floor=floor) if acc["occ"].sum() > 0 else old)
            out[token] = Hmm(start, a, mixtures=made, name=m.name)
        else:
            w = rest.reshape(n, k)
            total = w.sum(1, keepdims=True)
            out[token] = Hmm(start, a, shared=shared, shared_weights=np.where(total > 0, w / np.where(total > 0, total, 1.0), m.shared_weights), name=m.name)
    return Codebook(out, shared, book.origin)


def train(frames: DataFrame, turns: DataFrame, lexicon: dict[str, Sequence[str]], book: Codebook, steps: str | Sequence[str] = ("linear", "viterbi")) -> tuple[Codebook, list[float]]:
    """One update per step (linear, viterbi or expected); also the log score before each. The frames should be persisted by the caller."""
    scores = []
    for mode in [steps] if isinstance(steps, str) else steps:
        if mode not in ("linear", "viterbi", "expected"):
            raise ValueError(f"unknown step {mode!r}")
        sums, score, used = statistics(frames, turns, lexicon, book, mode)
        if not used:
            raise TrainingError("no utterance has a turn and enough frames")
        scores.append(score)
        book = update(book, sums)
    return book, scores


def parameters(spark, book: Codebook) -> DataFrame:
    """(token, state, k, dim, w, mu, var) of the diagonals of all models."""
    rows = []
    for token, m in sorted(book.models.items()):
        for s in range(len(m.pi)):
            mix = m.mixtures[s] if m.mixtures is not None else Mixture(m.shared_weights[s], m.shared.means, m.shared.covs)
            var = mix.variances()
            rows += [(token, s, k, i, float(mix.weights[k]), float(mix.means[k, i]), float(var[k, i])) for k in range(len(mix.weights)) for i in range(mix.means.shape[1])]
    return spark.createDataFrame(rows, "token string, state int, k int, dim int, w double, mu double, var double")
