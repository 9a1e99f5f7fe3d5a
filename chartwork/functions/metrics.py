"""Dissimilarities of two array columns of known length, unrolled so that they stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _terms(a: str, b: str, dim: int):
    return [(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k in range(dim)]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts) if parts else F.lit(0.0)


def euclid(a: str, b: str, dim: int) -> Column:
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in _terms(a, b, dim)]))


def dot(a: str, b: str, dim: int) -> Column:
    return _sum([x * y for x, y in _terms(a, b, dim)])


def dot_distance(a: str, b: str, dim: int) -> Column:
    """-ln(a.b), null where the product is not positive: such pairs have no distance."""
    d = dot(a, b, dim)
    return F.when(d > 0, -F.ln(d))


def manhattan(a: str, b: str) -> Column:
    """L1 of arrays that may differ in length; the shorter is padded by zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, v: s + v)


def cumulative(x: str) -> Column:
    """Cumulative distribution of a row's non-negative part: the per-row half of the Wasserstein distance."""
    mass = F.transform(F.col(x), lambda v: F.greatest(v, F.lit(0.0)))
    total = F.aggregate(mass, F.lit(0.0), lambda s, v: s + v)
    run = F.aggregate(mass, F.array().cast("array<double>"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + v)))
    return F.when(total > 0, F.transform(run, lambda v: v / total))


def wasserstein(cdf_a: str, cdf_b: str) -> Column:
    """W1 of two rows from their cumulative distributions."""
    return F.aggregate(F.zip_with(cdf_a, cdf_b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def wrapped(delta: Column, period: float) -> Column:
    """The image of a difference that is nearest to zero."""
    r = F.pmod(delta, F.lit(float(period)))
    return F.when(r > period / 2, r - period).otherwise(r)


def periodic(a: str, b: str, periods: list[float]) -> Column:
    return F.sqrt(_sum([F.pow(wrapped(x - y, p), 2) for (x, y), p in zip(_terms(a, b, len(periods)), periods, strict=True)]))


def sphere(a: str, b: str, periods: list[float]) -> Column:
    """Great-circle distance of hyperspherical angles: each coordinate is a phase of its period."""
    angle = lambda v, p: F.pmod(v, F.lit(float(p))) / p * (2 * math.pi)
    pairs = [(angle(x, p), angle(y, p)) for (x, y), p in zip(_terms(a, b, len(periods)), periods, strict=True)]
    cosine, sines = F.lit(0.0), F.lit(1.0)
    for x, y in pairs:
        cosine = cosine + sines * F.cos(x) * F.cos(y)
        sines = sines * F.sin(x) * F.sin(y)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine + sines)))


def stretch(a: str, b: str, unit: list[float], alpha: float) -> Column:
    """Euclid with the component along ``unit`` weighted by 1 + alpha (squared)."""
    terms = _terms(a, b, len(unit))
    along = _sum([(x - y) * F.lit(float(u)) for (x, y), u in zip(terms, unit, strict=True)])
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in terms]) + alpha * along * along)


def metric(name: str, a: str, b: str, dim: int) -> Column:
    """A metric without further parameters by name."""
    return {"euclid": euclid, "dot": dot_distance, "l1": lambda a, b, dim: manhattan(a, b)}[name](a, b, dim)
