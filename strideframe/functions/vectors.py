"""Vector arithmetic on array columns: built-in higher-order functions only, so nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def literal(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    """Sum of the elements, 0 of none."""
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def add(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda p, q: p + weight * q)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def divide(a: Column, b: Column) -> Column:
    """Elementwise; null where the divisor is 0."""
    return F.zip_with(a, b, lambda p, q: F.try_divide(p, q))


def shift(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda p: p + by)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda p: p * by)


def interpolate(a: Column, b: Column, alpha: Column | float) -> Column:
    """alpha * a + (1 - alpha) * b."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(a, b, lambda p, q: alpha * p + (1.0 - alpha) * q)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda p: F.transform(b, lambda q: p * q))


def norm1(a: Column) -> Column:
    return total(F.transform(a, lambda p: F.abs(p)))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sum_to_one(a: Column) -> Column:
    """a over its sum; null elements if the sum is 0."""
    return let(total(a), lambda s: F.transform(a, lambda p: F.try_divide(p, s)))


def argmax(a: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def euclidean(a: Column, b: Column) -> Column:
    return norm2(subtract(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return norm1(subtract(a, b))


def top_values(a: Column, n: int) -> Column:
    """The n largest, in descending order."""
    return F.slice(F.sort_array(a, asc=False), 1, n)


def top_positions(a: Column, n: int) -> Column:
    """0-based positions of the n largest, ties by position."""
    ranked = F.array_sort(F.transform(a, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.slice(F.transform(ranked, lambda s: s["i"]), 1, n)


def select(x: Column, dims: Sequence[int]) -> Column:
    """Pick, reorder or repeat dimensions."""
    return F.array(*[F.get(x, F.lit(d)) for d in dims])


def parse_selection(spec: str) -> list[int]:
    """``0,3-8,1`` to dimension numbers."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        if not low.isdigit() or (dash and not high.isdigit()):
            raise ValueError(f"bad selection {spec!r}")
        out += range(int(low), int(high or low) + 1)
    return out


def matvec(rows: Sequence[Sequence[float]], x: Column) -> Column:
    """A constant matrix times x."""
    return F.array(*[dot(literal(r), x) for r in rows])


def packed_index(i: int, j: int) -> int:
    """Place of (i, j) in a packed lower triangle."""
    i, j = max(i, j), min(i, j)
    return i * (i + 1) // 2 + j


def pairwise_sum(values: Sequence[float]) -> float:
    """Sum by halves, for small lists of very different sizes."""
    if len(values) < 3:
        return float(sum(values))
    mid = len(values) // 2
    return pairwise_sum(values[:mid]) + pairwise_sum(values[mid:])


def mirror_radii(x: Sequence) -> tuple[list[int], list[int]]:
    """How far the sequence mirrors around each element and before each element, in linear time.

    The reach of what was found farthest right is used for every centre under it: a centre starts from the radius of its
    mirror image, as far as that lies within, and only grows beyond.
    """
    found = []
    for gap in (0, 1):
        radii, left, right = [0] * len(x), 0, -1
        for c in range(len(x)):
            r = 0 if c > right else min(radii[left + right - c + gap] if left + right - c + gap < len(x) else 0, right - c + 1)
            while c - r - gap >= 0 and c + r < len(x) and x[c - r - gap] == x[c + r]:
                r += 1
            radii[c] = r
            if c + r - 1 > right:
                left, right = c - r + 1 - gap, c + r - 1
        found.append(radii)
    return found[0], found[1]


def longest_palindromes(x: Sequence, least: int = 2) -> list[tuple[int, int]]:
    """Maximal palindromes (start, length), longest first, then by start."""
    odd, even = mirror_radii(x)
    rows = [(c - r + 1, 2 * r - 1) for c, r in enumerate(odd)] + [(c - r, 2 * r) for c, r in enumerate(even)]
    return sorted((p for p in rows if p[1] >= least), key=lambda p: (-p[1], p[0]))


def palindromes(x: Column, least: int = 2) -> Column:
    """Maximal palindromes (start, length) of an array of strings, longest first; null for empty arrays. Batches of rows, linear in each."""
    import pandas as pd

    def run(rows):
        return rows.map(lambda v: None if v is None or not len(v) else [{"start": a, "length": n} for a, n in longest_palindromes(list(v), least)])

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}  # types, not their names
    return F.pandas_udf(run, "array<struct<start:int,length:int>>")(x)
