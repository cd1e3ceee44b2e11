"""Model files of the recipe tools: mixtures, hidden Markov models, codebooks, normalisation and nuisance projections, accumulators.

Everything is little-endian. Files hold one model each and are small, so they are read and written on the driver; tables
(``sources.models``) are what plans work with.
"""

from __future__ import annotations

import numpy as np

from strideframe.errors import InvalidFormatError
from strideframe.operators.acoustic import Codebook
from strideframe.operators.gaussians import Mixture
from strideframe.operators.hmm import Hmm

# Codes of the kinds of states, and of diagonal and full covariances.
CONTINUOUS, SHARED, DISCRETE = b"c", b"s", b"d"
DIAGONAL, FULL = 0, 1


class Cursor:
    """Values one after another from bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str, count: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize * count
        if self.at + size > len(self.data):
            raise InvalidFormatError(f"{size} bytes wanted at {self.at} of {len(self.data)}")
        out = np.frombuffer(self.data, kind, count, self.at)
        self.at += size
        return out

    def int(self, kind: str = "<i4") -> int:
        return int(self.take(kind)[0])

    def byte(self) -> bytes:
        return self.take("u1").tobytes()


def _bytes(kind: str, values) -> bytes:
    return np.asarray(values, kind).tobytes()


def packed(c: np.ndarray) -> np.ndarray:
    """Lower triangle by rows."""
    return c[np.tril_indices(len(c))]


def unpacked(v: np.ndarray, d: int) -> np.ndarray:
    c = np.zeros((d, d))
    c[np.tril_indices(d)] = v
    return c + np.tril(c, -1).T


def encode_mixture(m: Mixture, number: int = 0) -> bytes:
    """int id, dimensions, components, kind; then per component int id and doubles: weight, mean, covariance."""
    k, d = m.means.shape
    out = [_bytes("<i4", [number, d, k, DIAGONAL if m.diagonal else FULL])]
    for i in range(k):
        out += [_bytes("<i4", [i]), _bytes("<f8", [m.weights[i], *m.means[i], *(m.covs[i] if m.diagonal else packed(m.covs[i]))])]
    return b"".join(out)


def decode_mixture(source: bytes | Cursor) -> tuple[int, Mixture]:
    c = source if isinstance(source, Cursor) else Cursor(source)
    number, d, k, kind = (c.int() for _ in range(4))
    if kind not in (DIAGONAL, FULL) or d < 1 or k < 1:
        raise InvalidFormatError("not a mixture")
    size = d if kind == DIAGONAL else d * (d + 1) // 2
    rows = [(c.int(), c.take("<f8", 1 + d + size))[1] for _ in range(k)]
    covs = [r[1 + d :] if kind == DIAGONAL else unpacked(r[1 + d :], d) for r in rows]
    return number, Mixture([r[0] for r in rows], [r[1 : 1 + d] for r in rows], covs)


def mixture_text(m: Mixture) -> str:
    """A head line, then three lines per component."""
    k, d = m.means.shape
    lines = [f"fd = {d} nd = {k} diagonal: {str(m.diagonal).lower()}"]
    numbers = lambda v: " ".join(repr(float(x)) for x in v)
    for i in range(k):
        cov = m.covs[i] if m.diagonal else packed(m.covs[i])
        lines += [f"apr = {float(m.weights[i])!r}", f"mue = {numbers(m.means[i])}", f"cov = {numbers(cov)}"]
    return "\n".join(lines) + "\n"


def parse_mixture_text(text: str) -> Mixture:
    """What mixture_text writes; line breaks and names don't matter, the order of values does."""
    values = []
    for field in text.replace("=", " ").replace(":", " ").split():
        if field in ("true", "false"):
            values.append(field == "true")
            continue
        try:
            values.append(float(field))
        except ValueError:
            continue
    if len(values) < 3 or not isinstance(values[2], bool):
        raise InvalidFormatError("not a mixture")
    d, k, diagonal = int(values[0]), int(values[1]), values[2]
    width = 1 + d + (d if diagonal else d * (d + 1) // 2)
    rows = np.array(values[3:], float)
    if len(rows) != k * width:
        raise InvalidFormatError(f"{len(rows)} values for {k} components of {width}")
    rows = rows.reshape(k, width)
    return Mixture(rows[:, 0], rows[:, 1 : 1 + d], rows[:, 1 + d :] if diagonal else [unpacked(r, d) for r in rows[:, 1 + d :]])


def encode_hmm(m: Hmm, number: int, shared: int = 0) -> bytes:
    """int id, short states, float start and transitions; then the states, each behind its code."""
    n = len(m.pi)
    out = [_bytes("<i4", [number]), _bytes("<i2", [n]), _bytes("<f4", m.pi), _bytes("<f4", np.ravel(m.a))]
    for s in range(n):
        if m.symbols is not None:
            row = m.symbols[s]
            out += [DISCRETE, _bytes("<i4", [len(row)]), _bytes("<f8", np.arange(len(row))), _bytes("<i4", [len(row)]), _bytes("<f8", row)]
        elif m.mixtures is not None:
            out += [CONTINUOUS, encode_mixture(m.mixtures[s], s)]
        else:
            row = m.shared_weights[s]
            out += [SHARED, _bytes("<i4", [len(row)]), _bytes("<f8", row), _bytes("<i4", [shared])]
    return b"".join(out)


def decode_hmm(source: bytes | Cursor, shared: dict[int, Mixture] | None = None) -> tuple[int, Hmm]:
    c = source if isinstance(source, Cursor) else Cursor(source)
    number, n = c.int(), c.int("<i2")
    pi, a = c.take("<f4", n).astype(float), c.take("<f4", n * n).astype(float).reshape(n, n)
    symbols, mixtures, weights, pool = [], [], [], None
    for _ in range(n):
        kind = c.byte()
        if kind == DISCRETE:
            c.take("<f8", c.int())
            symbols.append(c.take("<f8", c.int()))
        elif kind == CONTINUOUS:
            mixtures.append(decode_mixture(c)[1])
        elif kind == SHARED:
            weights.append(c.take("<f8", c.int()))
            pool = c.int()
            if pool not in (shared or {}):
                raise InvalidFormatError(f"no shared mixture {pool}")
        else:
            raise InvalidFormatError(f"unknown kind of state {kind!r}")
    return number, Hmm(pi, a, np.array(symbols) if symbols else None, mixtures or None, shared[pool] if pool is not None else None, np.array(weights) if weights else None)


def encode_codebook(book: Codebook, tokens: list[str] | None = None) -> bytes:
    """Shared mixtures, then models numbered by their place in ``tokens`` (by name if not given)."""
    names = tokens or sorted(book.models)
    pools = [book.shared] if book.shared is not None else []
    out = [_bytes("<i4", [len(pools)]), *(encode_mixture(m, i) for i, m in enumerate(pools)), _bytes("<i4", [len(names)])]
    return b"".join([*out, *(encode_hmm(book[t], i) for i, t in enumerate(names))])


def decode_codebook(data: bytes, tokens: list[str]) -> Codebook:
    c = Cursor(data)
    pools = dict(decode_mixture(c) for _ in range(c.int()))
    models = {}
    for _ in range(c.int()):
        number, m = decode_hmm(c, pools)
        m.name = tokens[number]
        models[m.name] = m
    return Codebook(models, next(iter(pools.values()), None))


def encode_normalisation(n: int, means, variances) -> bytes:
    """long samples, int dimensions, doubles: means, variances, deviations."""
    v = np.asarray(variances, float)
    return _bytes("<i8", [n]) + _bytes("<i4", [len(v)]) + _bytes("<f8", [*means, *v, *np.sqrt(v)])


def decode_normalisation(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(samples, means, variances)."""
    c = Cursor(data)
    n, d = c.int("<i8"), c.int()
    values = c.take("<f8", 3 * d)
    return n, values[:d], values[d : 2 * d]


def encode_axes(*blocks: np.ndarray, width: int | None = None) -> bytes:
    """One projection: int rows and columns, floats. Several: int width and count, then each of them."""
    one = lambda v: _bytes("<i4", np.shape(v)) + _bytes("<f4", np.ravel(v))
    return one(blocks[0]) if width is None else _bytes("<i4", [width, len(blocks)]) + b"".join(map(one, blocks))


def decode_axes(data: bytes, several: bool = False) -> list[np.ndarray]:
    c = Cursor(data)
    count = (c.int(), c.int())[1] if several else 1
    out = []
    for _ in range(count):
        r, d = c.int(), c.int()
        out.append(c.take("<f4", r * d).astype(float).reshape(r, d))
    return out


def encode_accumulator(acc: dict) -> bytes:
    """int kind, dimensions, components; then per component int kind and dimensions, long count, doubles: mass, first and second moments."""
    k, d = acc["s1"].shape
    kind = DIAGONAL if acc["s2"].ndim == 2 else FULL
    out = [_bytes("<i4", [kind, d, k])]
    for i in range(k):
        second = acc["s2"][i] if kind == DIAGONAL else packed(acc["s2"][i])
        out += [_bytes("<i4", [kind, d]), _bytes("<i8", [acc["n"]]), _bytes("<f8", [acc["occ"][i], *acc["s1"][i], *second])]
    return b"".join(out)


def decode_accumulator(data: bytes) -> dict:
    c = Cursor(data)
    kind, d, k = c.int(), c.int(), c.int()
    if kind not in (DIAGONAL, FULL):
        raise InvalidFormatError("not an accumulator")
    size = d if kind == DIAGONAL else d * (d + 1) // 2
    rows, n = [], 0
    for _ in range(k):
        c.take("<i4", 2)
        n = c.int("<i8")
        rows.append(c.take("<f8", 1 + d + size))
    second = np.array([r[1 + d :] if kind == DIAGONAL else unpacked(r[1 + d :], d) for r in rows])
    return {"n": n, "occ": np.array([r[0] for r in rows]), "s1": np.array([r[1 : 1 + d] for r in rows]), "s2": second}
