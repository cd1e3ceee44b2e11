"""Kernels against closed forms, brute force and invariants."""

import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strideframe.errors import AlignmentError, InvalidFormatError, LanguageModelError
from strideframe.functions import weights as W
from strideframe.functions.vectors import pairwise_sum, parse_selection
from strideframe.operators import decode as dc, dsp, gaussians as gm, hmm, lexicon as lx, spectral as sp, transforms as tr
from strideframe.plans import catalog
from strideframe.sources import binary, text

RNG = np.random.default_rng(3)


def test_sine_has_one_peak():
    x = np.sin(2 * np.pi * 1000 / 16000 * np.arange(400))[None]
    assert sp.power_spectrum()(x).argmax() == 32
    assert sp.fft_size(512) == 1024 and sp.power_spectrum()(x).shape == (1, 257)


def test_dct_is_orthonormal_and_dht_its_own_inverse():
    d = np.array(W.dct_matrix(16))
    h = np.array(W.dht_matrix(16))
    assert np.allclose(d @ d.T, np.eye(16)) and np.allclose(h @ h, 16 * np.eye(16))


def test_acf_matches_loops():
    x = RNG.normal(size=(2, 12))
    loops = np.array([[sum(r[i] * r[(i + k) % 12] for i in range(12)) for k in range(12)] for r in x])
    assert np.allclose(sp.circular_acf(x), loops)
    linear = np.array([[sum(r[i] * r[i + k] for i in range(12 - k)) for k in range(12)] for r in x])
    assert np.allclose(sp.linear_acf()(x), linear / linear[:, :1])


def test_f0_of_a_tone():
    x = np.sin(2 * np.pi * 200 / 16000 * np.arange(800))[None]
    assert abs(sp.f0_candidates(16000)(sp.linear_acf()(x))[0, 0] - 200) < 3


def test_levinson_solves_normal_equations():
    x = RNG.normal(size=200)
    r = np.array([[x[: 200 - k] @ x[k:] for k in range(5)]])
    a, _ = sp.levinson(r, 4)
    toeplitz = np.array([[r[0, abs(i - j)] for j in range(4)] for i in range(4)])
    assert np.allclose(a[0, 1:], np.linalg.solve(toeplitz, -r[0, 1:]))


def test_all_dtmf_keys():
    for key, lo, hi in sp.dtmf_tones(sp.DTMF_KEYS):
        n = np.arange(400)
        x = 0.3 * (np.sin(2 * np.pi * lo / 8000 * n) + np.sin(2 * np.pi * hi / 8000 * n))
        assert sp.dtmf_keys(sp.power_spectrum()(x[None]), 8000 / 512) == [key]
    assert sp.dtmf_keys(np.zeros((1, 257)), 8000 / 512) == ["-"]


def test_mel_bank_rows_sum_to_one():
    bank = sp.mel_bank(257, 31.25)
    assert np.allclose(bank.sum(1), 1) and len(sp.mel_bank(257, 31.25, arg=30)) == 30
    assert sp.vtln(1.0, 300, 5000)(1000.0) == 1000.0


def _gain(b, a, f):
    z = np.exp(-1j * np.pi * f * np.arange(len(b)))
    return abs((b @ z) / (a @ np.exp(-1j * np.pi * f * np.arange(len(a)))))


def test_butterworth_has_half_power_at_the_cut():
    for kind, cut, inside, outside in (("low", 0.3, 0.01, 0.9), ("high", 0.3, 0.9, 0.01)):
        b, a = dsp.butterworth(4, cut, kind)
        assert abs(_gain(b, a, cut) - math.sqrt(0.5)) < 1e-6 and abs(_gain(b, a, inside) - 1) < 1e-3 and _gain(b, a, outside) < 1e-2
    b, a = dsp.butterworth(2, (0.2, 0.5), "band")
    assert abs(_gain(b, a, 0.2) - math.sqrt(0.5)) < 1e-6 and abs(_gain(b, a, 0.5) - math.sqrt(0.5)) < 1e-6
    b, a = dsp.butterworth(2, (0.2, 0.5), "stop")
    assert _gain(b, a, 0.33) < 0.2 and abs(_gain(b, a, 0.01) - 1) < 1e-2


def test_iir_matches_recurrence():
    x = RNG.normal(size=50)
    y = dsp.iir([0.5, 0.1], [1.0, -0.3, 0.2])(x)
    for n in range(2, 50):
        assert abs(y[n] - (0.5 * x[n] + 0.1 * x[n - 1] + 0.3 * y[n - 1] - 0.2 * y[n - 2])) < 1e-9


def test_band_pass_keeps_all_with_all_bands():
    x = RNG.normal(size=300)
    assert np.allclose(dsp.band_pass([(0, 500)], 1000, 64)(x), x)


def test_spline_goes_through_knots_and_lines_stay_lines():
    at = dsp.natural_spline([0, 2, 5, 9], [1, 5, 11, 19])
    assert np.allclose(at(np.array([0, 2, 5, 9, 3.5])), [1, 5, 11, 19, 8])


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 4), st.integers(2, 6), st.integers(0, 10**6))
def test_viterbi_and_forward_against_brute_force(n, t, seed):
    rng = np.random.default_rng(seed)
    pi, a, b = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n), np.log(rng.random((t, n)))
    path_score = lambda p: math.log(pi[p[0]]) + sum(math.log(a[i, j]) for i, j in itertools.pairwise(p)) + sum(b[k, s] for k, s in enumerate(p))
    paths = list(itertools.product(range(n), repeat=t))
    path, score = hmm.viterbi(pi, a, b)
    assert abs(score - max(map(path_score, paths))) < 1e-9 and abs(path_score(path) - score) < 1e-9
    gamma, xi, llh = hmm.forward_backward(pi, a, b)
    assert abs(llh - np.logaddexp.reduce([path_score(p) for p in paths])) < 1e-9
    assert np.allclose(gamma.sum(1), 1) and abs(xi.sum() - (t - 1)) < 1e-9


def test_forced_alignment_needs_frames():
    with pytest.raises(AlignmentError):
        hmm.viterbi(np.array([1.0, 0, 0]), hmm.topology(3, "LINEAR"), np.zeros((2, 3)), forced=True)
    assert hmm.linear_path(10, 4) == [0] * 3 + [1] * 2 + [2] * 3 + [3] * 2
    assert all(np.allclose(hmm.topology(4, k).sum(1), 1) for k in hmm.TOPOLOGIES)


def test_beam_search_finds_the_best_sequence():
    b = np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]])
    models = {t: hmm.Hmm(np.array([1.0]), np.array([[1.0]]), symbols=b[i : i + 1]) for i, t in enumerate("abc")}
    follow = {None: {"ab": 0.5, "c": 0.5}}
    graph = dc.Graph({"ab": ["a", "b"], "c": ["c"]}, models, follow)
    found = dc.beam_search(graph, np.array([[0], [1], [2], [0], [1]]), n_best=2, penalty=0.5)
    assert found[0][0] == ["ab", "c", "ab"] and found[0][1] >= found[1][1]
    fixed = dc.Graph({"ab": ["a", "b"], "c": ["c"]}, models, dc.fixed_sequences([["c", "ab"]]))
    assert dc.beam_search(fixed, np.array([[2], [0], [1]]))[0][0] == ["c", "ab"]


def test_tree_factors_add_up():
    tree = lx.LexicalTree({"a": ["x", "y"], "b": ["x", "z"], "c": ["w"]}, {"a": 0.2, "b": 0.3, "c": 0.5})

    def walk(node, total):
        for c in node.children:
            if c.word:
                assert abs(total + c.f - math.log({"a": 0.2, "b": 0.3, "c": 0.5}[c.word])) < 1e-12
            walk(c, total + c.f)

    walk(tree.root, 0.0)
    assert len(tree.leaves()) == 3 and len(tree.bfs()) == tree.size()


def test_lexical_tree_holds_the_whole_lexicon(spark, sf_dir):
    rows = sorted(catalog.queries()["lexical_tree"](spark, sf_dir).collect(), key=lambda r: r["i"])
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'").select("text").collect()
    words = {w for r in texts for w in re.split(r"[ \n]+", r["text"] or "") if w}
    assert len(words) > 200 and max(map(len, words)) > 4
    tree = lx.LexicalTree({w: list(w) for w in words}, dict.fromkeys(words, 1 / len(words)))
    assert [r["i"] for r in rows] == list(range(tree.size()))
    for r, n in zip(rows, tree.dfs(), strict=True):
        assert (r["token"], r["word"]) == (n.token or "", n.word or "") and abs(r["f"] - n.f) < 2e-6


def test_mixture_parts():
    m = gm.Mixture([0.4, 0.6], [[0, 1], [1, 0]], [[1, 2], [2, 1]])
    full = gm.Mixture([0.4, 0.6], m.means, np.array([np.diag(c) for c in m.covs]))
    x = RNG.normal(size=(20, 2))
    assert np.allclose(m.score(x), full.score(x)) and np.allclose(m.posteriors(x).sum(1), 1)
    assert m.marginalize([1]).means.tolist() == [[1], [0]] and len(m.supervector(True, True, True)) == 10
    drawn = m.draw(4000, 1)
    assert np.allclose(drawn.mean(0), [0.6, 0.4], atol=0.1)


def test_em_never_gets_worse(spark):
    x = np.concatenate([RNG.normal(0, 1, (150, 2)), RNG.normal(3, 1, (150, 2))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    model, scores = gm.em(df, gm.Mixture([0.5, 0.5], [[-1, 0], [1, 1]], [[1, 1], [1, 1]]), 4)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(scores)) and abs(model.weights.sum() - 1) < 1e-9
    acc = gm.accumulate(df, model)
    halves = gm.merge(gm.accumulate(df.filter("x[0] < 1"), model), gm.accumulate(df.filter("x[0] >= 1"), model))
    assert all(np.allclose(acc[k], halves[k]) for k in acc)


def _gmeans_loops(x, limit, most):
    nearest = lambda cs: np.array([[((r - c) ** 2).sum() for c in cs] for r in x]).argmin(1)

    def lloyd(cs):
        while True:
            k = nearest(cs)
            new = np.array([x[k == i].mean(0) for i in range(len(cs))])
            if np.linalg.norm(new - cs, axis=1).sum() <= 1e-10:
                return new
            cs = new

    def normality(v):
        n, z = len(v), np.sort((v - v.mean()) / v.std())
        f = [0.5 * math.erfc(-q / math.sqrt(2)) for q in z]
        return (-n - sum((2 * i + 1) * (math.log(f[i]) + math.log1p(-f[n - 1 - i])) for i in range(n)) / n) * (1 + 4 / n - 25 / n**2)

    cs = lloyd(x.mean(0)[None])
    while len(cs) < most:
        k, out = nearest(cs), []
        for i, c in enumerate(cs):
            own = x[k == i]
            values, axes = np.linalg.eigh(np.cov(own.T, bias=True))
            step = axes[:, -1] * math.sqrt(2 * values[-1] / math.pi)
            a, b, last = c + step, c - step, None
            while last is None or np.abs(a - last).sum() > 1e-10:
                left, last = ((own - a) ** 2).sum(1) < ((own - b) ** 2).sum(1), a
                a, b = own[left].mean(0), own[~left].mean(0)
            fits = len(out) + 2 + len(cs) - i - 1 <= most
            out += [a, b] if fits and normality(own @ (a - b) / np.linalg.norm(a - b)) >= limit else [c]
        if len(out) == len(cs):
            break
        cs = lloyd(np.array(out))
    return cs


def test_gmeans_against_loops(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.6, (n, 2)) for m, n in (((0, 0), 260), ((4, 0), 60), ((2, 3), 90))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    for most in (3, 6):
        found, expected = gm.gmeans(df, 0.05, most), _gmeans_loops(x, gm.AD_CRITICAL[0.05], most)
        assert len(found.means) == len(expected)
        assert np.allclose(found.means[np.lexsort(found.means.T)], expected[np.lexsort(expected.T)])


def test_ad_ranking_splits_the_least_normal(spark):
    rng = np.random.default_rng(9)
    wide, twin = rng.normal((0, 40), (6, 0.1), (200, 2)), np.concatenate([rng.normal((c, 0), 0.3, (100, 2)) for c in (-3, 3)])
    df = spark.createDataFrame([(r.tolist(),) for r in np.concatenate([wide, twin])], "x array<double>")
    v = spark.createDataFrame([(float(q),) for q in wide[:, 0]], "v double")
    assert abs(gm.normality_statistic(v.repartition(3)) - gm.anderson_darling(v, "v").first()["a2"]) < 1e-3
    means = gm.hierarchical(df, 3, "AD_STATISTIC").means
    assert sorted(np.round(means[:, 1] / 40).tolist()) == [0, 0, 1]
    assert np.ptp(means[np.abs(means[:, 1]) < 20][:, 0]) > 5


def test_mmie_takes_every_segment(spark):
    rng = np.random.default_rng(11)
    models = {m: gm.Mixture([0.6, 0.4], rng.normal(size=(2, 3)), rng.uniform(0.5, 2, (2, 3))) for m in "ab"}
    segments = [(u, "ab"[u % 2], rng.normal(size=(4 + u, 3))) for u in range(5)]
    df = spark.createDataFrame([(u, t, r.tolist()) for u, t, x in segments for r in x], "utt_id long, c string, x array<double>").repartition(3)
    found = gm.mmie_accumulate(df, models)
    for name, m in models.items():
        num, den = {}, {}
        for _, truth, x in segments:
            scores = {n: math.exp(2 * q.score(x).mean()) for n, q in models.items()}
            g = m.posteriors(x)
            for key, v in (("occ", g.sum(0)), ("s1", g.T @ x), ("s2", g.T @ x**2)):
                num[key] = num.get(key, 0) + v * (truth == name)
                den[key] = den.get(key, 0) + v * scores[name] / sum(scores.values())
        for side, expected in zip(found[name], (num, den), strict=True):
            assert all(np.allclose(side[key], expected[key]) for key in expected)
        assert np.allclose(gm.extended_update(m, *found[name]).means, gm.extended_update(m, num, den).means)


def test_mmie_step_reads_all_labels(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole.filter("label < 2").write.parquet(str(tmp_path / "embeddings.parquet"))
    step = catalog.queries()["mmie_step"]
    assert step(spark, sf_dir).collect() != step(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name", ["kmeans", "lbg", "hier_clustering", "gmeans", "em", "em_full"])
def test_clusters_see_all_dimensions(spark, tmp_path, name):
    """Vectors of two groups that differ in the last dimension only."""
    x = np.random.default_rng(12).normal(0, 0.1, (240, 64))
    x[::2, -1] += 5
    rows = [(i, r.tolist(), i // 2 % 3) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalog.queries()[name](spark, str(tmp_path)).collect()
    if name == "em_full":
        assert max(r["i"] for r in found) == max(r["j"] for r in found) == 63
        return
    assert max(r["dim"] for r in found) == 63
    if name != "em":
        means = [r["mu"] for r in found if r["dim"] == 63]
        assert min(means) < 0.5 and max(means) > 4.5


def test_transforms(spark):
    x = RNG.normal(size=(300, 3)) @ np.diag([3.0, 1.0, 0.2])
    df = spark.createDataFrame([(0, i, r.tolist(), i % 2) for i, r in enumerate(x)], "utt_id long, frame_idx long, x array<double>, c int")
    p = tr.pca(df)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert np.allclose(p.values, values) and np.allclose(p.axes @ p.axes.T, np.eye(3))
    a = np.array([r["x"] for r in p.apply(df).orderBy("frame_idx").collect()])
    b = np.array([r["x"] for r in p.apply_batches(df).orderBy("frame_idx").collect()])
    assert np.allclose(a, b) and np.allclose(a, (x - x.mean(0)) @ p.axes.T)
    n = tr.nap(df, 1)
    moved = np.array([r["x"] for r in n.apply(df).collect()])
    assert np.allclose(moved @ n.axes.T, 0)
    assert len(tr.lda(df).axes) == 1


@pytest.mark.parametrize("n", [5, 8, 4500])
def test_sparse_pca_of_any_number_of_samples(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8)) * np.arange(1, 9)
    p = tr.sparse_pca(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(p.mean, x.mean(0)) and np.allclose(p.values, s[:3] ** 2) and np.allclose(p.axes, tr.canonical(vt[:3]))


def test_sparse_pca_query_takes_all_vectors(spark, sf_dir):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], float)
    axes = tr.canonical(np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:5])
    found = {(r["k"], r["dim"]): r["v"] for r in catalog.queries()["sparse_pca"](spark, sf_dir).collect()}
    assert all(abs(found[k, i] - axes[k, i]) < 1e-4 for k in range(5) for i in range(64))


def test_windows_and_selection():
    assert abs(W.hamming(5)[2] - 1) < 1e-12 and W.hann(5)[0] == 0 and W.rectangular(3) == [1, 1, 1]
    assert abs(sum(v * j for v, j in zip(W.regression(5, 1), range(-2, 3))) - 1) < 1e-12
    assert parse_selection("0,3-5,1") == [0, 3, 4, 5, 1] and pairwise_sum([0.1] * 10) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        parse_selection("a-3")


def test_binary_round_trips():
    x = RNG.normal(size=(5, 3))
    assert np.allclose(binary.decode_frames(binary.encode_frames(x, True), True), x)
    assert np.allclose(binary.decode_frames(binary.encode_frames(x, header=False), width=3), x, atol=1e-6)
    c, y, z = binary.decode_samples(binary.encode_samples([1, 2, 3, 4, 5], [0] * 5, x))
    assert c.tolist() == [1, 2, 3, 4, 5] and np.allclose(z, x, atol=1e-6) and y.sum() == 0
    with pytest.raises(InvalidFormatError):
        binary.decode_frames(b"\x03\0\0\0abc")
    with pytest.raises(InvalidFormatError):
        binary.parse_text_frames("1 2\n3")
    assert binary.parse_text_frames("@x\n1,2\n3\t4") == {"x": [[1, 2], [3, 4]]}
    assert binary.decode_labels(b"0110").tolist() == [0, 1, 1, 0]


def test_audio_codecs():
    s = np.array([-1, -0.5, 0, 0.5, 1.0])
    assert np.allclose(binary.decode_audio(binary.to_wav(s, 16000), binary.AUDIO_FORMATS["wav/16"]), s, atol=1e-4)
    u = binary.decode_audio(bytes([0xFF, 0x7F, 0x80, 0x00]), binary.AUDIO_FORMATS["ulaw/8"])
    assert np.allclose(u, [0, 0, 32124 / 32767, -32124 / 32767])
    a = binary.decode_audio(bytes([0xD5, 0x55]), binary.AUDIO_FORMATS["alaw/8"])
    assert np.allclose(a, [8 / 32767, -8 / 32767])
    assert binary.parse_audio_format("r:8,8000,0,1") == (8, 8000, "unsigned", True, 0)


ARPA = "\\data\\\nngram 1=2\nngram 2=1\n\n\\1-grams:\n-1.0 a -0.5\n-0.3 b\n\n\\2-grams:\n-0.2 a b\n\\end\\\n"


def test_arpa_and_bigram(spark):
    rows = text.parse_arpa(ARPA)
    assert [r[:2] for r in rows] == [(1, ["a"]), (1, ["b"]), (2, ["a", "b"])]
    with pytest.raises(LanguageModelError):
        text.parse_arpa("\\data\\\nngram 1=1\nngram 2=1\nngram 3=1\n")
    grams = spark.createDataFrame(rows, "n int, words array<string>, p double, backoff double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "z")], "w1 string, w2 string")
    p = {(r["w1"], r["w2"]): r["p"] for r in lx.bigram(pairs, grams).collect()}
    assert p["a", "b"] == pytest.approx(10**-0.2) and p["a", "a"] == pytest.approx(10**-1.5) and p["b", "z"] == pytest.approx(0.001)


def test_normal_functions():
    assert gm.quantile(0.5) == 0 and gm.cdf(0) == 0.5 and gm.cdf(gm.quantile(0.9)) == pytest.approx(0.9)


def test_beam_search_sums_as_the_exact_search():
    """The same sums in the same order, so that paths of like score are told apart the same way: scores equal to the last bit."""
    words = {"ab": ["a", "b"], "cab": ["c", "a", "b"], "ba": ["b", "a"]}
    b = np.array([[0.5, 0.2, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])
    models = {t: hmm.Hmm(np.array([1.0, 0]), hmm.topology(2, "LINEAR"), symbols=np.roll(b, i, axis=1)) for i, t in enumerate("abc")}
    even = dict.fromkeys(words, 1 / 3)
    follow = {None: even, "ab": {"ab": 0.2, "cab": 0.5, "ba": 0.3}, "cab": even, "ba": even}
    graph, rng = dc.Graph(words, models, follow), np.random.default_rng(0)
    for _ in range(40):
        seen = rng.integers(0, 5, 30)
        now = {(None, w, 0, 0): (math.log(p) + np.log(models[words[w][0]].symbols[0, seen[0]]), ()) for w, p in even.items()}
        for o in seen[1:]:
            new = {}
            for (before, w, k, s), (score, said) in now.items():
                moves = [((before, w, k, j), np.log(models[words[w][k]].a[s, j]), said) for j in (0, 1) if models[words[w][k]].a[s, j] > 0]
                if s == 1 and k + 1 < len(words[w]):
                    moves.append(((before, w, k + 1, 0), 0.0, said))
                elif s == 1:
                    moves += [((w, v, 0, 0), math.log(0.5) + math.log(p), (*said, w)) for v, p in follow[w].items()]
                for to, cost, h in moves:
                    if to not in new or score + cost > new[to][0]:
                        new[to] = (score + cost, h)
            now = {(w0, w, k, s): (v + np.log(models[words[w][k]].symbols[s, o]), h) for (w0, w, k, s), (v, h) in new.items()}
        best = max(v + math.log(0.5) for (_, w, k, s), (v, h) in now.items() if s == 1 and k + 1 == len(words[w]))
        assert dc.beam_search(graph, seen[:, None].astype(float), beam=60, width=200.0, penalty=0.5)[0][1] == best


def test_magnitudes_of_bins_that_cancel_out():
    """The samples' alternating sum is zero: what is left there is summed term by term, as in SQL, not the fast transform's rounding."""
    x = np.array([[-37.742000000000004, -33.162, 29.578000000000003, 11.937999999999995, -35.242000000000004, -2.8019999999999996, 6.037500000000001,
                   -2.602499999999999, -41.7125, -0.7124999999999986, 1.3075000000000045, -47.3925, 44.057500000000005, 41.0175, 0, 0]])
    x = np.vstack([x, x + 1, np.zeros(16)])
    angle = 2 * np.pi * np.arange(16)[:, None] * np.arange(257) / 512
    plain = [np.hypot(sum(v * np.cos(a) for v, a in zip(row, angle, strict=True)), sum(v * np.sin(a) for v, a in zip(row, angle, strict=True))) for row in x]
    plain = np.array([20 * np.log10(np.maximum(m / max(m.sum(), 1e-300), 1e-300)) for m in plain])
    assert plain[0].min() < -330 and np.allclose(sp.magnitude_spectrum(log=True)(x), plain, atol=1e-4)


def test_gmeans_takes_few_passes(spark, monkeypatch):
    """Most steps move only samples near a border, which the driver holds; the result is that of the loops."""
    rng = np.random.default_rng(12)
    x = rng.uniform(-1, 1, (1500, 4)) * (3, 2, 1, 1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    passes, sums = [], gm.vector_sums
    monkeypatch.setattr(gm, "vector_sums", lambda *a, **k: passes.append(1) or sums(*a, **k))
    monkeypatch.setattr(gm, "NEAR_BYTES", 300 * 4 * 8, raising=False)
    found, expected = gm.gmeans(df, 0.05, 4), _gmeans_loops(x, gm.AD_CRITICAL[0.05], 4)
    assert len(expected) > 2 and np.allclose(found.means[np.lexsort(found.means.T)], expected[np.lexsort(expected.T)])
    assert len(passes) <= 15, len(passes)
