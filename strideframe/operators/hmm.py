"""Hidden Markov models: alignment, counts and re-estimation. Counts are grouped sums; only the recurrences run per utterance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.errors import AlignmentError
from strideframe.operators.gaussians import LOG_FLOOR, Mixture

TOPOLOGIES = ("LINEAR", "LEFT_TO_RIGHT", "BAKIS", "ERGODIC")


def topology(n: int, kind: str) -> np.ndarray:
    """Row-stochastic transitions: next state; any later; at most two on; any."""
    if kind not in TOPOLOGIES:
        raise ValueError(f"topology must be one of {TOPOLOGIES}")
    a = np.zeros((n, n))
    for i in range(n):
        to = {"LINEAR": range(i, min(n, i + 2)), "LEFT_TO_RIGHT": range(i, n), "BAKIS": range(i, min(n, i + 3)), "ERGODIC": range(n)}[kind]
        a[i, list(to)] = 1 / len(to)
    return a


@dataclass
class Hmm:
    """Start and transition probabilities, and emissions: a (states, symbols) matrix, mixtures, or a shared mixture's weights."""

    pi: np.ndarray
    a: np.ndarray
    symbols: np.ndarray | None = None
    mixtures: list[Mixture] | None = None
    shared: Mixture | None = None
    shared_weights: np.ndarray | None = None
    name: str = ""

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        """(frames, states) log densities, floored."""
        if self.symbols is not None:
            with np.errstate(divide="ignore"):
                out = np.log(self.symbols.T[x.astype(int).ravel()])
        elif self.mixtures is not None:
            out = np.column_stack([m.score(x) for m in self.mixtures])
        else:
            parts = self.shared.log_parts(x) - np.log(self.shared.weights)
            top = parts.max(1, keepdims=True)
            with np.errstate(divide="ignore"):
                out = top + np.log(np.exp(parts - top) @ self.shared_weights.T)
        return np.maximum(out, LOG_FLOOR)

    def interpolate(self, other: Hmm, alpha: float) -> Hmm:
        """alpha * other + (1 - alpha) * self for start and transitions, and symbols if both have them."""
        mix = lambda p, q: alpha * q + (1 - alpha) * p
        return Hmm(mix(self.pi, other.pi), mix(self.a, other.a), None if self.symbols is None else mix(self.symbols, other.symbols), self.mixtures, self.shared, self.shared_weights, self.name)


def chain(models: Sequence[Hmm]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Start, transitions and (model, state) of models one after another; a last state stays or goes on with 0.5 each."""
    places = [(k, s) for k, m in enumerate(models) for s in range(len(m.pi))]
    n = len(places)
    a, pi, at = np.zeros((n, n)), np.zeros(n), 0
    for k, m in enumerate(models):
        size = len(m.pi)
        a[at : at + size, at : at + size] = m.a
        if k + 1 < len(models):
            last = at + size - 1
            a[last] = 0
            a[last, last] = a[last, last + 1] = 0.5
        at += size
    pi[: len(models[0].pi)] = models[0].pi
    return pi, a, places


def viterbi(pi: np.ndarray, a: np.ndarray, b: np.ndarray, forced: bool = False) -> tuple[list[int], float]:
    """Best path through log emissions b; ties go to the lowest state; forced: it ends in the last state."""
    t, n = b.shape
    if forced and t < n:
        raise AlignmentError(f"{t} frames for {n} states")
    with np.errstate(divide="ignore"):
        la, score = np.log(a), np.log(pi) + b[0]
    back = np.zeros((t, n), int)
    for i in range(1, t):
        through = score[:, None] + la
        back[i] = through.argmax(0)
        score = through.max(0) + b[i]
    end = n - 1 if forced else int(score.argmax())
    path = [end]
    for i in range(t - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1], float(score[end])


def viterbi_many(pi: np.ndarray, a: np.ndarray, bs: Sequence[np.ndarray], forced: bool = False) -> list[tuple[list[int], float]]:
    """viterbi for many utterances (of at least one frame, or as many as states if forced) that take each step together."""
    if not bs:
        return []
    n = len(pi)
    order = sorted(range(len(bs)), key=lambda u: -len(bs[u]))
    lengths = np.array([len(bs[u]) for u in order])
    if forced and lengths[-1] < n:
        raise AlignmentError(f"{lengths[-1]} frames for {n} states")
    b = np.zeros((lengths[0], len(bs), n))
    for k, u in enumerate(order):
        b[: len(bs[u]), k] = bs[u]
    with np.errstate(divide="ignore"):
        la, score = np.log(a), np.log(pi) + b[0]
    back = np.zeros(b.shape, np.int32)
    for i in range(1, lengths[0]):
        on = int(np.searchsorted(-lengths, -i, side="left"))  # the longest ones are still there
        through = score[:on, :, None] + la
        back[i, :on] = through.argmax(1)
        score[:on] = through.max(1) + b[i, :on]
    state = np.full(len(bs), n - 1) if forced else score.argmax(1)
    scores, rows = score[np.arange(len(bs)), state], np.arange(len(bs))
    paths = np.zeros((lengths[0], len(bs)), np.int64)
    for i in range(lengths[0] - 1, -1, -1):
        paths[i] = state
        inside = i < lengths
        state = np.where(inside, back[i, rows, state], state) if i else state
    out: list = [None] * len(bs)
    for k, u in enumerate(order):
        out[u] = (paths[: lengths[k], k].tolist(), float(scores[k]))
    return out


def linear_path(t: int, n: int) -> list[int]:
    """Frames spread evenly over states; rounding slack is carried on, the rest goes to the last state."""
    if t < n:
        raise AlignmentError(f"{t} frames for {n} states")
    width, slack, path = t / n, 0.0, []
    for s in range(n - 1):
        fields = int(width - slack + 0.5)
        slack = fields - (width - slack)
        path += [s] * fields
    return path + [n - 1] * (t - len(path))


def random_path(t: int, n: int, seed: int) -> list[int]:
    """Ordered random borders."""
    cuts = np.sort(np.random.default_rng(seed).choice(np.arange(1, t), n - 1, replace=False))
    return np.searchsorted(cuts, np.arange(t), side="right").tolist()


def forward_backward(pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gamma, summed xi, log likelihood) with scaling per frame."""
    t, n = b.shape
    top = b.max(1, keepdims=True)
    e = np.exp(b - top)
    alpha, beta, c = np.zeros((t, n)), np.ones((t, n)), np.zeros(t)
    for i in range(t):
        v = (pi if i == 0 else alpha[i - 1] @ a) * e[i]
        c[i] = v.sum()
        alpha[i] = v / c[i]
    for i in range(t - 2, -1, -1):
        beta[i] = a @ (e[i + 1] * beta[i + 1]) / c[i + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    xi = np.zeros((n, n))
    for i in range(t - 1):
        xi += alpha[i][:, None] * a * (e[i + 1] * beta[i + 1])[None] / c[i + 1]
    return gamma, xi, float(np.log(c).sum() + top.sum())


def _x(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf.sort_values("frame_idx")["x"].to_numpy())


#: Utterances that take Viterbi's steps together, and frames in all that they may have.
TOGETHER, TOGETHER_FRAMES = 64, 1 << 16


def align(frames: DataFrame, model: Hmm, forced: bool = False) -> DataFrame:
    """(utt_id, frame_idx, state, score): Viterbi per utterance. Utterances too short for a forced end give nothing."""
    kind = frames.schema["utt_id"].dataType.simpleString()
    packed = frames.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("s"))
    rows = packed.select("utt_id", F.transform("s", lambda p: p["frame_idx"]).alias("t"), F.transform("s", lambda p: p["x"]).alias("x"))
    least = len(model.pi) if forced else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["x"].map(len) >= least]
            sizes = batch["x"].map(len).to_numpy()
            at = 0
            while at < len(batch):
                upto = at + 1
                while upto < len(batch) and upto - at < TOGETHER and sizes[at : upto + 1].sum() <= TOGETHER_FRAMES:
                    upto += 1
                own = batch.iloc[at:upto]
                found = viterbi_many(model.pi, model.a, [model.log_emissions(np.stack(x)) for x in own["x"]], forced)
                yield pd.DataFrame({
                    "utt_id": np.repeat(own["utt_id"].to_numpy(), sizes[at:upto]), "frame_idx": np.concatenate(own["t"].to_list()),
                    "state": np.concatenate([p for p, _ in found]), "score": np.repeat([v for _, v in found], sizes[at:upto]),
                })
                at = upto

    return rows.mapInPandas(run, f"utt_id {kind}, frame_idx long, state int, score double")


def linear_align(frames: DataFrame, states: int) -> DataFrame:
    """(utt_id, frame_idx, state) of the even alignment, by arithmetic on the frame count alone."""
    n = F.count("*").over(Window.partitionBy("utt_id"))
    # Cumulated borders of the rounding scheme: floor(k * T / N + 0.5).
    state = F.lit(0)
    for k in range(1, states):
        state = state + (F.col("frame_idx") >= F.floor(F.lit(k) * n / states + 0.5)).cast("int")
    return frames.withColumn("_n", n).filter(F.col("_n") >= states).select("utt_id", "frame_idx", state.alias("state"))


def transition_counts(paths: DataFrame, state: str = "state") -> DataFrame:
    """(i, j, n) over neighbouring frames of all utterances."""
    to = F.lead(state).over(Window.partitionBy("utt_id").orderBy("frame_idx"))
    return paths.select(F.col(state).alias("i"), to.alias("j")).filter("j IS NOT NULL").groupBy("i", "j").agg(F.count("*").alias("n"))


def start_counts(paths: DataFrame, state: str = "state") -> DataFrame:
    return paths.filter("frame_idx = 0").groupBy(F.col(state).alias("i")).agg(F.count("*").alias("n"))


def normalise(counts: DataFrame) -> DataFrame:
    """(i, j, p): counts over their row's sum."""
    return counts.select("i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("p"))


def emission_counts(paths: DataFrame, symbol: str, state: str = "state", gamma: Column | None = None) -> DataFrame:
    """(state, symbol, n): hard or weighted counts."""
    return paths.groupBy(F.col(state).alias("state"), F.col(symbol).alias("symbol")).agg(F.sum(F.lit(1.0) if gamma is None else gamma).alias("n"))


def _expected_counts(model: Hmm):
    """A function from one utterance to its start, transition and emission counts and log likelihood, numbered."""
    n, m = model.symbols.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _x(pdf)
        gamma, xi, llh = forward_backward(model.pi, model.a, model.log_emissions(x))
        emit = np.zeros((n, m))
        np.add.at(emit.T, x.astype(int).ravel(), gamma)
        values = np.concatenate([gamma[0], xi.ravel(), emit.ravel(), [llh]])
        return pd.DataFrame({"i": np.arange(len(values)), "v": values})

    return run


def baum_welch(frames: DataFrame, model: Hmm, iterations: int = 1) -> tuple[Hmm, list[float]]:
    """Re-estimated discrete model and the log likelihood before each step: per-utterance counts, summed in the plan."""
    scores = []
    n, m = model.symbols.shape
    for _ in range(iterations):
        now = model
        rows = frames.select("utt_id", "frame_idx", "x").groupBy("utt_id").applyInPandas(_expected_counts(now), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(n + n * n + n * m + 1)
        for r in rows:
            total[r["i"]] = r["v"]
        pi, xi, emit = total[:n], total[n : n + n * n].reshape(n, n), total[n + n * n : -1].reshape(n, m)
        keep = lambda new, old: np.where(new.sum(1, keepdims=True) > 0, new / np.where(new.sum(1, keepdims=True) > 0, new.sum(1, keepdims=True), 1), old)
        scores.append(float(total[-1]))
        model = Hmm(pi / pi.sum(), keep(xi, now.a), keep(emit, now.symbols), name=model.name)
    return model, scores


def meta_align(frames: DataFrame, turns: DataFrame, lexicon: dict[str, Sequence[str]], models: dict[str, Hmm]) -> DataFrame:
    """(utt_id, seg_idx, token, start_frame, n_frames, q): forced alignment of each turn's token models, cut back to tokens."""
    kind = frames.schema["utt_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        columns = ["utt_id", "seg_idx", "token", "start_frame", "n_frames", "q"]
        if not len(words) or not len(pdf):
            return pd.DataFrame(columns=columns)
        tokens = [t for w in words["words"].iloc[0] for t in lexicon[w]]
        own = [models[t] for t in tokens]
        pi, a, places = chain(own)
        x = _x(pdf)
        if len(x) < len(places):
            return pd.DataFrame(columns=columns)
        each = {t: models[t].log_emissions(x) for t in set(tokens)}
        b = np.column_stack([each[tokens[k]][:, s] for k, s in places])
        path, _ = viterbi(pi, a, b, forced=True)
        rows, at = [], 0
        for k, token in enumerate(tokens):
            q = [places[s][1] for s in path if places[s][0] == k]
            rows.append((key[0], k, token, at, len(q), q))
            at += len(q)
        return pd.DataFrame(rows, columns=columns)

    left, right = frames.select("utt_id", "frame_idx", "x").groupBy("utt_id"), turns.select("utt_id", "words").groupBy("utt_id")
    return left.cogroup(right).applyInPandas(run, f"utt_id {kind}, seg_idx int, token string, start_frame long, n_frames int, q array<int>")


def expand_alignment(alignment: DataFrame) -> DataFrame:
    """Segments back to frames: (utt_id, frame_idx, token, state)."""
    rows = alignment.select("utt_id", "token", "start_frame", F.posexplode("q").alias("k", "state"))
    return rows.select("utt_id", (F.col("start_frame") + F.col("k")).alias("frame_idx"), "token", "state")


def isolated_words(frames: DataFrame, words: dict[str, Hmm | Sequence[Hmm]], n: int = 1) -> DataFrame:
    """(utt_id, rank, word, score): forced alignment of every word's model, the best n. The vocabulary is a parameter.

    A word may be several models in a row, as silence, the word and silence.
    """
    kind = frames.schema["utt_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _x(pdf)
        found = []
        for word, models in words.items():
            own = [models] if isinstance(models, Hmm) else list(models)
            pi, a, places = chain(own)
            if len(places) <= len(x):
                each = [m.log_emissions(x) for m in own]
                found.append((-viterbi(pi, a, np.column_stack([each[k][:, s] for k, s in places]), True)[1], word))
        return pd.DataFrame([(key[0], k + 1, w, -s) for k, (s, w) in enumerate(sorted(found)[:n])], columns=["utt_id", "rank", "word", "score"])

    return frames.select("utt_id", "frame_idx", "x").groupBy("utt_id").applyInPandas(run, f"utt_id {kind}, rank int, word string, score double")


def propagate_up(counts: DataFrame, parents: DataFrame, levels: int) -> DataFrame:
    """(uid, n): each token's counts added to all its ancestors. parents: (uid, parent_uid), depth at most ``levels``."""
    total, moving = counts.select("uid", "n"), counts.select("uid", "n")
    for _ in range(levels):
        moving = moving.join(parents, "uid").filter("parent_uid IS NOT NULL").groupBy(F.col("parent_uid").alias("uid")).agg(F.sum("n").alias("n"))
        total = total.union(moving)
    return total.groupBy("uid").agg(F.sum("n").alias("n"))


def interpolate_down(child: float, parent: float, mass: float, rho: float) -> float:
    """Parent's share rho / (rho + mass) of a statistic."""
    r = rho / (rho + mass)
    return r * parent + (1 - r) * child


def log_floor(p: float) -> float:
    return max(math.log(p), LOG_FLOOR) if p > 0 else LOG_FLOOR
