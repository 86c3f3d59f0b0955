"""Tail probabilities as column expressions: incomplete beta, Student's t of a correlation, normal tail; and the exact rank-sum tail of small samples."""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients of the gamma function for g = 7, fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fractions, which settle long before.
STEPS = 300
#: Rank-sum tails are exact up to this many rows in the smaller sample, without ties.
EXACT = 8


def _bound(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """Of x of a half or more."""
    t = x + 6.5
    series = sum((F.lit(c) / (x + float(i)) for i, c in enumerate(LANCZOS[1:])), F.lit(LANCZOS[0]))
    return (x - 0.5) * F.log(t) - t + F.lit(math.log(2 * math.pi) / 2) + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    start = F.struct(F.lit(1.0).alias("c"), (1 / away(1 - (a + b) * x / (a + 1))).alias("d"), (1 / away(1 - (a + b) * x / (a + 1))).alias("h"))

    def half(s: Column, top: Column) -> Column:
        d, c = 1 / away(1 + top * s["d"]), away(1 + top / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _bound(half(s, even), lambda t: half(t, odd))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, for a and b of a half or more and x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct = x < (a + 1) / (a + b + 2)
    # one fraction a row: the side on which it settles
    p, q, v = F.when(direct, a).otherwise(b), F.when(direct, b).otherwise(a), F.when(direct, x).otherwise(1 - x)
    side = _bound(F.struct(p.alias("p"), q.alias("q"), v.alias("v")), lambda s: _fraction(s["p"], s["q"], s["v"]) / s["p"])
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_bound(front * side, lambda r: F.when(direct, r).otherwise(1 - r)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided, by Student's t with n - 2 degrees of freedom; NaN without any, 0 for a correlation of 1."""
    left = F.greatest(F.lit(0.0), 1 - r * r)
    half = F.greatest(F.lit(0.5), (n - 2) / F.lit(2.0))
    return F.when((n <= 2) | F.isnan(r), F.lit(float("nan"))).otherwise(incomplete_beta(half, F.lit(0.5), left))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal: a series near 0, a continued fraction beyond 2."""
    x = F.abs(z)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda s, k: _bound(s["t"] * x * x / (2 * k + 1), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s"))), lambda s: s["s"])
    density = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))
    down = F.sequence(F.lit(120), F.lit(1), F.lit(-1))
    tail = F.when(x < 2, 0.5 - density * terms).otherwise(density / (x + F.aggregate(down, F.lit(0.0), lambda s, k: k / (x + s))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_upper(p: Column) -> Column:
    """The z whose upper tail is p, for p from 1e-300 to a half: Newton's steps on the tail's logarithm."""
    start = F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(2 * p)))

    def step(z: Column, _: Column) -> Column:
        density = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))
        return _bound(normal_tail(z), lambda tail: F.greatest(F.lit(0.0), z + (F.log(tail) - F.log(p)) * tail / density))

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)


@lru_cache(maxsize=256)
def rank_sum_counts(a: int, b: int) -> tuple[int, ...]:
    """How many of the choices of a of a + b ranks have U = 0, 1, ... a * b: the product of (1 - q^(b+i)) over (1 - q^i)."""
    counts = [1] + [0] * (a * b)
    for i in range(1, a + 1):
        for u in range(a * b, b + i - 1, -1):
            counts[u] -= counts[u - b - i]
        for u in range(i, a * b + 1):
            counts[u] += counts[u - i]
    return tuple(counts)


def exact_rank_sum_tail(n_a: Column, n_b: Column, u: Column) -> Column:
    """P(U >= u) without ties, where the smaller sample has at most EXACT rows; null otherwise."""

    def tail(a: pa.Array, b: pa.Array, u: pa.Array) -> pa.Array:
        out = []
        for x, y, v in zip(a.to_pylist(), b.to_pylist(), u.to_pylist(), strict=True):
            small, large = (min(x, y), max(x, y)) if x is not None and y is not None else (0, 0)
            counts = rank_sum_counts(small, large) if 0 < small <= EXACT and v is not None else ()
            out.append(sum(counts[math.ceil(v) :]) / sum(counts) if counts else None)
        return pa.array(out, pa.float64())

    return F.arrow_udf(tail, "double")(n_a.cast("int"), n_b.cast("int"), u.cast("double"))
