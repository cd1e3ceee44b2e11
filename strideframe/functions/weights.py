"""Window and regression weights, computed once on the driver and passed as literals."""

from __future__ import annotations

import math


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) if n > 1 else 1.0 for i in range(n)]


def hann(n: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) if n > 1 else 1.0 for i in range(n)]


def rectangular(n: int) -> list[float]:
    return [1.0] * n


def triangular(n: int) -> list[float]:
    """Rising 2i/n + 2/n over the first half, falling 2(n/2 - 1 - i)/n over the second."""
    half = n // 2
    return [2 * i / n + 2 / n for i in range(half)] + [2 * (half - 1 - i) / n for i in range(n - half)]


WINDOWS = {"hamm": hamming, "hann": hann, "rect": rectangular, "tri": triangular}


def regression(context: int, order: int) -> list[float]:
    """Weights of the slope of the given order over an odd context, scaled by their squares."""
    if context < 3 or context % 2 == 0:
        raise ValueError("the context must be odd and at least 3")
    c2 = context * context
    rho = {
        1: lambda j: float(j),
        2: lambda j: j * j - (c2 - 1) / 12,
        3: lambda j: j**3 - (3 * c2 - 7) * j / 20,
    }
    if order not in rho:
        raise ValueError("the order must be 1, 2 or 3")
    raw = [rho[order](j) for j in range(-(context // 2), context // 2 + 1)]
    power = sum(r * r for r in raw)
    return [r / power for r in raw]


def dct_matrix(n: int, scale: bool = True) -> list[list[float]]:
    """DCT-II rows; scaled ones are orthonormal."""
    rows = [[math.cos(math.pi * (i + 0.5) * k / n) for i in range(n)] for k in range(n)]
    if scale:
        rows = [[v * math.sqrt((1 if k == 0 else 2) / n) for v in r] for k, r in enumerate(rows)]
    return rows


def dht_matrix(n: int) -> list[list[float]]:
    """Hartley rows: cosine plus sine."""
    return [[math.cos(2 * math.pi * i * k / n) + math.sin(2 * math.pi * i * k / n) for i in range(n)] for k in range(n)]
