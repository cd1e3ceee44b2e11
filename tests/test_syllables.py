"""Syllable nuclei against a frame-by-frame simulation of a detector that reads its input as it comes."""

import math

import numpy as np
import pytest

from strideframe.operators import syllables as sy


class Reader:
    """Looks at all frames so far each time one more arrives, forgets those before a found nucleus's right minimum."""

    def __init__(self, x, o):
        self.x, self.o, self.begin, self.seen = x, o, 0, 0

    def extreme(self, band, i, sign):
        near = range(max(0, i - self.o.context), min(len(self.x), i + self.o.context + 1))
        return all(sign * self.x[i][band] >= sign * self.x[j][band] for j in near)

    def find(self, band, factor, search):
        e = lambda i: self.x[i][band]
        for i in range(search, self.seen):
            if e(i) <= self.o.significance or not self.extreme(band, i, 1):
                continue
            left = right = None
            for j in range(i, self.begin, -1):
                if e(j) < (1 - factor) * e(i) and self.extreme(band, j, -1):
                    left = j
                    break
                if e(j) > e(i):
                    break
            for j in range(i, len(self.x)):
                if e(j) < (1 - factor) * e(i) and self.extreme(band, j, -1):
                    right = j
                    break
                if e(j) > e(i):
                    break
            if left is None or right is None or right + sy.GUARD > self.seen:
                continue
            a = next(j for j in range(i, left - 1, -1) if e(j) < (e(i) + e(left)) / 2)
            b = next(j for j in range(i, right + 1) if e(j) < (e(i) + e(right)) / 2)
            if b - a >= self.o.width:
                own = [e(j) for j in range(a, b + 1)]
                return (left, a, i, b, right, band, max(own), sum(own))
        return None

    def run(self):
        out = []
        while self.seen < len(self.x):
            self.seen += 1
            low, son, fric = (self.find(b, self.o.factor, self.begin) for b in range(3))
            apart = lambda p, q: p[1] > q[3] or p[3] < q[1]
            best = None
            if son and (not fric or apart(son, fric) or fric[7] < son[7]):
                best = son
            if low and (not son or apart(low, son)):
                best = low
            if not best:
                continue
            if not out or best[1] - out[-1][3] >= self.o.distance:
                one = self.find(best[5], self.o.soft_factor, self.begin)
                two = self.find(best[5], self.o.soft_factor, one[4]) if one and one[4] < best[4] else None
                out += [one, two] if two else [best]
            self.begin = best[4]
            self.seen -= 1  # what is left is looked at again before more is read
        return out


def energies(seed, n=150):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = np.stack([np.abs(np.sin(t / p + s)) * (1 + 0.3 * np.sin(t / 11)) + 0.05 * rng.random(n) for p, s in zip(rng.uniform(2, 7, 3), rng.uniform(0, 6, 3))], 1)
    return x * rng.uniform(0.5, 1.5, 3)


@pytest.mark.parametrize("seed", range(25))
def test_against_a_reader(seed):
    o = sy.Options(0.2, 0.5 + 0.1 * (seed % 3), 0.2, 2 + seed % 3, seed % 4, 1 + seed % 2)
    x = energies(seed)
    found = [(n.start_min, n.start, n.peak, n.stop, n.stop_min, n.band, n.max_energy, n.sum_energy) for n in sy.detect(x, o)]
    expected = Reader(x.tolist(), o).run()
    assert len(found) == len(expected) and all(np.allclose(a, b) for a, b in zip(found, expected))
    assert seed % 3 or found


def test_short_and_flat_input():
    for x in (np.zeros((0, 3)), np.ones((1, 3)), np.ones((50, 3)), energies(1, 6)):
        assert sy.detect(x) == []


def test_features(spark):
    x = energies(3)
    bands = spark.createDataFrame([("u", i, row.tolist()) for i, row in enumerate(x)] + [("v", 0, [0.0, 0.0, 0.0])], "utt_id string, frame_idx long, x array<double>")
    rows = sy.nucleus_features(sy.syllable_nuclei(bands), 100.0, 160).orderBy("nucleus").collect()
    nuclei = sy.detect(x)
    assert [r["peak"] for r in rows] == [n.peak for n in nuclei] and len(nuclei) > 3
    for k, (r, n) in enumerate(zip(rows, nuclei)):
        a, b = nuclei[k - 1] if k else None, nuclei[k + 1] if k + 1 < len(nuclei) else None
        rates = [200 / abs(n.peak - o.peak) for o in (a, b) if o]
        assert math.isclose(r["tempo"], sum(rates) / len(rates)) and list(r["positions"]) == [160 * v for v in (n.start_min, n.start, n.peak, n.stop, n.stop_min)]
        size = lambda o: o.stop - o.start if o else 0
        assert math.isclose(r["duration_contrast"], (2 * size(n) - size(a) - size(b)) / 10) and math.isclose(r["seconds"], size(n) / 100)
        assert math.isclose(r["sum_contrast"], sum(n.sum_energy / o.sum_energy for o in (a, b) if o) - 2, abs_tol=1e-9)


def test_bands_of_tones(spark):
    t = np.arange(8000) / 16000
    audio = spark.createDataFrame([(str(hz), np.sin(2 * np.pi * hz * t).tolist()) for hz in (200, 1000, 4000)], "utt_id string, samples array<double>")
    top = {r["utt_id"]: int(np.argmax(r["x"])) for r in sy.band_energies(audio, 16000, 400, 160).filter("frame_idx = 20").collect()}
    assert top == {"200": sy.LOW, "1000": sy.SONORANT, "4000": sy.FRICATIVE}
