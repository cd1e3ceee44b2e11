"""Token models with mixture emissions, stored model files, order and level operators against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.errors import CodebookError, InvalidFormatError, TrainingError
from strideframe.functions.vectors import longest_palindromes
from strideframe.operators import acoustic as ac, agreement as ag, dsp, frames as fr, gaussians as gm, hmm, levels as lv, order, transforms as tr
from strideframe.operators.gaussians import Mixture
from strideframe.sources import binary as bn, stored as st, text as tx

LEXICON = {"ab": ["a", "b"], "ba": ["b", "a"]}


def mixture(seed, k=2, d=2, full=False):
    rng = np.random.default_rng(seed)
    w = rng.uniform(0.5, 1, k)
    covs = rng.uniform(0.5, 2, (k, d))
    if full:
        a = rng.normal(size=(k, d, d))
        covs = np.einsum("kij,klj->kil", a, a) + np.eye(d)
    return Mixture(w / w.sum(), rng.normal(size=(k, d)), covs)


def books():
    shared = mixture(5)
    continuous = ac.Codebook({t: hmm.Hmm(np.array([0.7, 0.3]), hmm.topology(2, "ERGODIC") * [[0.8, 1.2], [1.1, 0.9]], mixtures=[mixture(i), mixture(i + 10)], name=t) for i, t in enumerate("ab")})
    semi = ac.Codebook({t: hmm.Hmm(np.array([0.6, 0.4]), hmm.topology(2, "ERGODIC"), shared=shared, shared_weights=np.array([[0.3, 0.7], [0.8, 0.2]]), name=t) for t in "ab"}, shared)
    return continuous, semi


def all_paths(models, x):
    """Occupation, transitions and log score by listing every path."""
    pi, a, places = hmm.chain(models)
    n, b = len(places), np.column_stack([np.exp(models[k].log_emissions(x))[:, s] for k, s in places])
    gamma, xi, total = np.zeros((len(x), n)), np.zeros((n, n)), 0.0
    for path in itertools.product(range(n), repeat=len(x)):
        p = pi[path[0]] * b[0, path[0]]
        for t in range(1, len(x)):
            p *= a[path[t - 1], path[t]] * b[t, path[t]]
        total += p
        for t, s in enumerate(path):
            gamma[t, s] += p
        for i, j in zip(path, path[1:]):
            xi[i, j] += p
    return gamma / total, xi / total, np.log(total)


@pytest.mark.parametrize("kind", [0, 1])
def test_expected_occupation(kind):
    book = books()[kind]
    x = np.random.default_rng(3).normal(size=(6, 2))
    models = [book["a"], book["b"]]
    gamma, xi, score = ac.occupation(models, x, "expected")
    g, e, s = all_paths(models, x)
    assert np.allclose(gamma, g) and np.allclose(xi, e) and np.isclose(score, s)


@pytest.mark.parametrize("kind", [0, 1])
@pytest.mark.parametrize("mode", ["linear", "viterbi", "expected"])
def test_training_step(spark, kind, mode):
    """One distributed step equals sums and quotients written out over all utterances."""
    book, rng = books()[kind], np.random.default_rng(7)
    data = {u: rng.normal(size=(rng.integers(5, 12), 2)) for u in range(6)}
    turns = {u: ["ab"] if u % 2 else ["ba", "ab"] for u in data} | {4: [], 9: ["ab"]}
    data[5] = data[5][:2]  # too short for its turn
    frames = spark.createDataFrame([(u, t, row.tolist()) for u, x in data.items() for t, row in enumerate(x)], "utt_id long, frame_idx long, x array<double>")
    made, scores = ac.train(frames, spark.createDataFrame(list(turns.items()), "utt_id long, words array<string>"), LEXICON, book, [mode])
    occ, s1, s2, moves, starts, pool, total = {}, {}, {}, {}, {}, [0.0, 0.0, 0.0], 0.0
    for u, x in data.items():
        tokens = [t for w in turns[u] for t in LEXICON[w]]
        if not tokens or len(x) < 2 * len(tokens):
            continue
        gamma, xi, score = ac.occupation([book[t] for t in tokens], x, mode)
        total += score
        for i, t in enumerate(tokens):
            moves[t] = moves.get(t, 0) + xi[2 * i : 2 * i + 2, 2 * i : 2 * i + 2]
            starts[t] = starts.get(t, 0) + (gamma[0, :2] if i == 0 else 0)
            for s in range(2):
                m = book[t]
                p = m.mixtures[s].posteriors(x) if kind == 0 else np.exp(m.shared.log_parts(x)) / m.shared.weights * m.shared_weights[s]
                p = p / p.sum(1, keepdims=True) * gamma[:, [2 * i + s]]
                occ[t, s] = occ.get((t, s), 0) + p.sum(0)
                s1[t, s] = s1.get((t, s), 0) + p.T @ x
                s2[t, s] = s2.get((t, s), 0) + p.T @ (x * x)
                pool = [pool[0] + p.sum(0), pool[1] + p.T @ x, pool[2] + p.T @ (x * x)]
    assert np.isclose(scores[0], total)
    for t in "ab":
        rows = moves[t].sum(1, keepdims=True)
        assert np.allclose(made[t].a, np.where(rows > 0, moves[t] / np.where(rows > 0, rows, 1), book[t].a))
        for s in range(2):
            if kind == 0:
                mean = s1[t, s] / occ[t, s][:, None]
                assert np.allclose(made[t].mixtures[s].means, mean)
                assert np.allclose(made[t].mixtures[s].covs, np.maximum(s2[t, s] / occ[t, s][:, None] - mean**2, gm.MLE_FLOOR))
                assert np.allclose(made[t].mixtures[s].weights, occ[t, s] / occ[t, s].sum())
            else:
                assert np.allclose(made[t].shared_weights[s], occ[t, s] / occ[t, s].sum())
    if kind == 1:
        assert np.allclose(made.shared.means, pool[1] / pool[0][:, None]) and made["a"].shared is made.shared


def test_training_raises_the_score(spark):
    rng = np.random.default_rng(11)
    rows = [(u, t, (rng.normal(size=2) * 0.3 + [2 * (t // 5 % 2), t // 10]).tolist()) for u in range(8) for t in range(20)]
    frames = spark.createDataFrame(rows, "utt_id long, frame_idx long, x array<double>").persist()
    turns = frames.select("utt_id").distinct().withColumn("words", F.array(F.lit("ab")))
    start = ac.continuous({"a": 2, "b": 2}, gm.gaussian(frames))
    _, scores = ac.train(frames, turns, LEXICON, start, ["linear", "expected", "expected", "viterbi", "viterbi"])
    assert scores[2] > scores[1] and scores[4] >= scores[3]
    with pytest.raises(TrainingError):
        ac.train(frames, turns.limit(0), LEXICON, start, "viterbi")
    with pytest.raises(CodebookError):
        start["x"]
    mixed = start.interpolate(ac.continuous({"a": 2, "b": 2}, Mixture([1.0], [[1.0, 1.0]], [[1.0, 1.0]])), 0.25)
    assert np.allclose(mixed["a"].mixtures[0].means, 0.25 + 0.75 * start["a"].mixtures[0].means)


@pytest.mark.parametrize("forced", [False, True])
def test_viterbi_of_many(forced):
    """Steps taken together give each utterance's own path and score."""
    rng = np.random.default_rng(8)
    for n in (1, 3, 4):
        a = rng.random((n, n)) * (rng.random((n, n)) > 0.2) + np.eye(n)
        a /= a.sum(1, keepdims=True)
        pi = np.full(n, 1 / n)
        bs = [np.log(rng.choice([0.1, 0.2, 0.5], (rng.integers(n, 15), n))) for _ in range(12)]
        assert hmm.viterbi_many(pi, a, bs, forced) == [hmm.viterbi(pi, a, b, forced) for b in bs]
    assert hmm.viterbi_many(np.ones(1), np.ones((1, 1)), []) == []
    with pytest.raises(Exception, match="frames"):
        hmm.viterbi_many(np.ones(2), np.ones((2, 2)), [np.zeros((1, 2))], True)


# ---- stored files

@pytest.mark.parametrize("full", [False, True])
def test_stored_mixtures(full):
    m = mixture(2, 3, 4, full)
    for n, back in (st.decode_mixture(st.encode_mixture(m, 9)), (9, st.parse_mixture_text(st.mixture_text(m)))):
        assert n == 9 and np.array_equal(back.means, m.means) and np.array_equal(back.weights, m.weights) and np.allclose(back.covs, m.covs)
    data = st.encode_mixture(m)
    assert len(data) == 16 + 3 * (4 + 8 * (1 + 4 + (10 if full else 4)))
    for bad in (data[:-1], b"", b"\0" * 16):
        with pytest.raises(InvalidFormatError):
            st.decode_mixture(bad)
    with pytest.raises(InvalidFormatError):
        st.parse_mixture_text("fd = 2 nd = 1 diagonal: true\n1 2")
    acc = {"n": 5, "occ": np.array([1.0, 2, 3]), "s1": m.means, "s2": m.covs}
    back = st.decode_accumulator(st.encode_accumulator(acc))
    assert back["n"] == 5 and all(np.allclose(back[k], acc[k]) for k in ("occ", "s1", "s2"))


def test_stored_codebooks():
    for book in books():
        back = st.decode_codebook(st.encode_codebook(book), ["a", "b"])
        assert set(back.models) == {"a", "b"} and np.allclose(back["a"].a, book["a"].a) and np.allclose(back["b"].pi, book["b"].pi)
        x = np.random.default_rng(1).normal(size=(4, 2))
        assert np.allclose(back["b"].log_emissions(x), book["b"].log_emissions(x))
    discrete = hmm.Hmm(np.array([1.0, 0]), hmm.topology(2, "LINEAR"), symbols=np.array([[0.2, 0.8], [0.5, 0.5]]))
    assert np.array_equal(st.decode_hmm(st.encode_hmm(discrete, 3))[1].symbols, discrete.symbols)
    with pytest.raises(InvalidFormatError):
        st.decode_hmm(st.encode_hmm(books()[1]["a"], 0))
    axes = np.random.default_rng(4).normal(size=(2, 3))
    assert np.allclose(st.decode_axes(st.encode_axes(axes))[0], axes, atol=1e-6)
    assert [a.shape for a in st.decode_axes(st.encode_axes(axes, axes[:1], width=3), several=True)] == [(2, 3), (1, 3)]
    n, mean, var = st.decode_normalisation(st.encode_normalisation(4, [1.0, 2.0], [3.0, 4.0]))
    assert (n, mean.tolist(), var.tolist()) == (4, [1, 2], [3, 4])


def test_arpa_round_trip():
    rows = [(1, ["a"], 0.5, 0.25), (1, ["b"], 0.25, None), (2, ["a", "b"], 0.125, None)]
    back = tx.parse_arpa(tx.arpa_text(rows))
    assert [(n, w) for n, w, _, _ in back] == [(n, w) for n, w, _, _ in rows]
    assert np.allclose([r[2] for r in back], [r[2] for r in rows]) and np.isclose(back[0][3], 0.25) and back[1][3] is None


# ---- order, frames, agreement

@pytest.mark.parametrize("per", [3, 1000])
def test_total_before(spark, per):
    rng = random.Random(5)
    keys = rng.sample(range(-500, 500), 200)
    rows = [(k, f"k{k:05d}", rng.randrange(9)) for k in keys]
    df = spark.createDataFrame(rows, "k long, s string, v long")
    for key, at in (("k", 0), ("s", 1)):
        found = {r[key]: r["before"] for r in order.total_before(df, key, "v", per_part=per).collect()}
        assert found == {r[at]: sum(q[2] for q in rows if q[at] < r[at]) for r in rows}
    assert order.total_before(df.limit(0), "k", "v").count() == 0


def test_errors_in_plans(spark):
    frames = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("b", 0, [1.0, 2.0])], "utt_id string, frame_idx long, x array<double>")
    with pytest.raises(Exception, match="different widths"):
        fr.concat(frames).collect()
    decisions = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 2, 1)], "utt_id string, frame_idx long, keep int")
    with pytest.raises(Exception, match="more decisions"):
        fr.vad_filter(frames.filter("utt_id = 'a'"), decisions).collect()
    ratings = spark.createDataFrame([(1, "r", 1.0)], "subject_id long, rater_id string, rating double")
    assert ag.add_rater(ratings, "s", ratings.select("subject_id", "rating")).count() == 2
    with pytest.raises(Exception, match="there already"):
        ag.add_rater(ratings, "r", ratings).collect()


def test_split_runs_over_blocks(spark):
    frames = spark.range(100).select(F.lit("u").alias("utt_id"), F.col("id").alias("frame_idx"), F.array(F.col("id").cast("double")).alias("x"))
    runs = spark.createDataFrame([(0, "a", 30), (1, "b", 0), (2, "a", 5), (3, "c", 200)], "ord int, out string, n_frames long")
    found = sorted((r["out"], r["frame_idx"], r["x"][0]) for r in fr.split_runs(frames, runs, block=8).collect())
    assert found == sorted([("a", i, i) for i in range(30)] + [("a", i - 30, i) for i in range(30, 35)] + [("c", i - 35, i) for i in range(35, 100)])


@pytest.mark.parametrize("distance", list(ag.METRICS))
@pytest.mark.parametrize("on", ["index", "value"])
def test_alpha(spark, distance, on):
    rng = random.Random(2)
    rows = [(s, f"r{r}", float(rng.choice([1, 2, 4, 7]))) for s in range(15) for r in range(rng.randrange(1, 5))]
    found = ag.alpha(spark.createDataFrame(rows, "subject_id long, rater_id string, rating double"), ag.METRICS[distance], on).first()[0]
    by = {}
    for s, _, v in rows:
        by.setdefault(s, []).append(v)
    by = {s: v for s, v in by.items() if len(v) > 1}
    classes = sorted({v for vs in by.values() for v in vs})
    value = (lambda v: classes.index(v) + 1) if on == "index" else (lambda v: v)
    d = {"nominal": lambda a, b: float(a != b), "interval": lambda a, b: (a - b) ** 2, "ratio": lambda a, b: ((a - b) / (a + b)) ** 2}[distance]
    do = sum(d(value(a), value(b)) / (len(v) - 1) for v in by.values() for a, b in itertools.combinations(v, 2))
    every = [v for vs in by.values() for v in vs]
    de = sum(d(value(a), value(b)) for a, b in itertools.combinations(every, 2))
    assert np.isclose(found, 1 - (len(every) - 1) * do / de)


def test_palindromes_by_every_centre():
    rng = random.Random(1)
    for _ in range(500):
        x = [rng.choice("ab") for _ in range(rng.randrange(25))]
        found = []
        for c in range(len(x)):
            for gap in (0, 1):
                r = 0
                while c - r - gap >= 0 and c + r < len(x) and x[c - r - gap] == x[c + r]:
                    r += 1
                found.append((c - r + 1 - gap, 2 * r - 1 + gap))
        assert longest_palindromes(x) == sorted((p for p in found if p[1] >= 2), key=lambda p: (-p[1], p[0]))


# ---- numeric kernels

def test_spline_and_sinc():
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.uniform(0.5, 2, 12))
    y = rng.normal(size=12)
    h = np.diff(x)
    system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    m = np.concatenate([[0], np.linalg.solve(system, 6 * np.diff(np.diff(y) / h)), [0]])
    t = np.linspace(x[0], x[-1], 50)
    k = np.clip(np.searchsorted(x, t) - 1, 0, 10)
    a, b = (x[k + 1] - t) / h[k], (t - x[k]) / h[k]
    assert np.allclose(dsp.natural_spline(x, y)(t), a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6)
    s = rng.normal(size=700)
    assert np.allclose(dsp.sinc_shift(0.3, 50)(s), [dsp.sinc_at(s, i + 0.3, 50) for i in range(699)])


def clouds(spark, centres, n=120, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.2, (n, len(c))) for c in centres])
    rows = [(i % 7, i, v.tolist(), i // n) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "utt_id long, frame_idx long, x array<double>, c long")


def test_one_python_pass(spark):
    _, df = clouds(spark, [[0, 0], [3, 3]])
    seen = []
    real = gm.vector_sums

    def watch(samples, *a, **k):
        seen.append(samples)
        return real(samples, *a, **k)

    gm.vector_sums = watch
    try:
        stats = gm.second_order(df, "c")
    finally:
        gm.vector_sums = real
    assert len(seen) == 1 and {k[0] for k in stats} == {0, 1}


def test_sums_by_group(spark):
    x, df = clouds(spark, [[0, 0, 1], [3, 3, 2]], n=50)
    for (c,), s in gm.second_order(df.repartition(5), "c").items():
        own = x[50 * c : 50 * c + 50]
        assert s["n"] == 50 and np.allclose(s["s1"], own.sum(0)) and np.allclose(s["s2"], own.T @ own)
    with pytest.raises(TrainingError):
        gm.second_order(df.limit(0))


def test_full_covariance_step(spark):
    x, df = clouds(spark, [[0, 0], [2, 1]])
    m = mixture(1, 2, 2, full=True)
    acc = gm.accumulate(df, m)
    dense = np.array([[w * np.exp(-0.5 * (v - mu) @ np.linalg.inv(c) @ (v - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, mu, c in zip(m.weights, m.means, m.covs)] for v in x])
    g = dense / dense.sum(1, keepdims=True)
    assert np.allclose(acc["occ"], g.sum(0)) and np.isclose(acc["llh"], np.log(dense.sum(1)).sum())
    assert np.allclose(acc["s2"], np.einsum("nk,ni,nj->kij", g, x, x))
    new = gm.mle_update(m, acc)
    mean = (g.T @ x) / g.sum(0)[:, None]
    assert np.allclose(new.means, mean) and np.allclose(new.covs[0], np.einsum("n,ni,nj->ij", g[:, 0], x - mean[0], x - mean[0]) / g[:, 0].sum(), atol=1e-9)


@pytest.mark.parametrize("way", ["lbg", "hierarchical", "gmeans"])
def test_clusters_are_found(spark, way):
    centres = [[0.0, 0.0], [8.0, 0.5], [0.5, 9.0], [9.0, 9.5]]
    _, df = clouds(spark, centres)
    df = df.persist()
    model = {"lbg": lambda: gm.lbg(df, 4), "hierarchical": lambda: gm.hierarchical(df, 4), "gmeans": lambda: gm.gmeans(df, 0.0001, 4)}[way]()
    df.unpersist()
    assert len(model.weights) == 4 and np.allclose(model.weights, 0.25, atol=0.02)
    assert np.allclose(sorted(model.means.tolist()), sorted(centres), atol=0.15)


def test_transforms_solve_their_problems(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    c = np.arange(300) % 3
    x[c == 1] += [1, 0, 2, 0]
    x[c == 2] += [0, 3, 0, 1]
    df = spark.createDataFrame([(int(k), i, v.tolist(), int(k)) for i, (k, v) in enumerate(zip(c, x))], "utt_id long, frame_idx long, x array<double>, c long")
    within = sum(np.cov(x[c == k].T, bias=True) for k in range(3)) / 3
    between = sum(np.outer(d, d) for k in range(3) for d in [x[c == k].mean(0) - x.mean(0)]) / 3
    lda = tr.lda(df)
    assert len(lda.axes) == 2
    for v, value in zip(lda.axes, lda.values):
        assert np.allclose(between @ v, value * within @ v, atol=1e-8)
    pca = tr.pca(df)
    assert np.allclose(np.cov(x.T, bias=True), (pca.axes.T * pca.values) @ pca.axes)
    sparse = tr.sparse_pca(df, 3)
    assert np.allclose(sparse.values, np.linalg.svd(x - x.mean(0), compute_uv=False)[:3] ** 2) and np.allclose(np.abs(sparse.axes), np.abs(pca.axes[:3]))
    w = (c[:, None] == c[None]).astype(float)
    span = lambda v: v.T @ v
    assert np.allclose(span(tr.nap(df, 2).axes), span(tr.nap_kernel(x, w, 2)))
    for b, n in tr.mnap(df, 1, 2).items():
        assert np.allclose(span(n.axes), span(tr.nap_kernel(x[:, 2 * b : 2 * b + 2], w, 1)))


def test_thresholds(spark):
    values = np.concatenate([np.random.default_rng(1).normal(1, 0.3, 200), np.random.default_rng(2).normal(6, 1, 100)])
    df = spark.createDataFrame([(0, i, [float(v)]) for i, v in enumerate(values)], "utt_id long, frame_idx long, x array<double>").persist()
    assert np.isclose(lv.energy_threshold(df), values.mean())
    found = [lv.energy_threshold(df, s) for s in ("CLUSTER", "EM1", "EM5")]
    assert all(1.8 < t < 4.5 for t in found)
    assert lv.energy_threshold(df.limit(1)) == 0.0
    with pytest.raises(ValueError):
        lv.energy_threshold(df, "NONE")
    one = Mixture([0.5, 0.5], [[0.0], [1.0]], [[1.0], [1.0]])
    assert abs(lv.decision_boundary(one) - 0.5) < 2e-4


def test_sinks(spark, tmp_path):
    frames = spark.createDataFrame([("u", 0, [1.5, 2.0]), ("u", 1, [0.25, -1.0]), ("v", 0, [3.0, 4.0])], "utt_id string, frame_idx long, x array<double>")
    kept = []
    out = bn.tee(frames, lambda d: bn.write_files(bn.to_files(d), f"file://{tmp_path}/a"), lambda d: kept.append(d.count()))
    assert kept == [3] and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["u", "v"]
    assert sorted(map(tuple, out.select("utt_id", "frame_idx", F.col("x")[0]).collect())) == sorted(map(tuple, bn.read_frames(spark, f"{tmp_path}/a").select("utt_id", "frame_idx", F.col("x")[0]).collect()))
    audio = bn.audio_from_array(spark, [0.1] * 5, 8000, "m").select("utt_id", "samples")
    entries = spark.createDataFrame([(0, "m"), (1, "gone"), (2, "m")], "pos int, utt_id string")
    blocks = {r["block_idx"]: r["samples"] for r in bn.list_audio(audio, entries, 3).collect()}
    assert blocks == {0: [0.1] * 3, 1: [0.1, 0.1, 0.0], 2: [0.1] * 3, 3: [0.1, 0.1, 0.0]}
