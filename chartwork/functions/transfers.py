"""Transfer functions of a distance, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass(frozen=True)
class Transfer:
    """A transfer by family name and parameters; ``column`` builds its expression, JVM-side but for ``gamma``."""

    family: str
    params: tuple[float, ...] = ()

    def column(self, x: Column | str) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        x = x.cast("double")
        p = self.params
        if self.family == "identity":
            return x
        if self.family == "sigmoid":
            return 1 - 1 / (1 + F.pow(x / p[0], 2))
        if self.family == "compress":
            return 1 - 1 / (1 + x / p[0])
        if self.family == "xsigmoid":
            return _xsigmoid(x, *p)
        if self.family == "gamma":
            return _gamma(x, *p)
        if self.family == "imq":
            return _imq(x, p[0])
        if self.family == "asinh":
            return F.asinh(x / p[0]) / (2 * math.asinh(1))
        if self.family == "twoscale":
            s, a, b, wide = p
            tail = lambda v: F.asinh(v / wide) / (2 * math.asinh(1))
            return F.when(x <= s, _xsigmoid(x, s, a, b)).otherwise(tail(x) - tail(F.lit(s)) + 0.5)
        if self.family == "multiscale":
            total = F.lit(0.0)
            for s in p:
                total = total + _imq(x, s)
            return total / len(p)
        if self.family == "warp":
            s, a_hi, b_hi, a_lo, b_lo = p
            high = _xsigmoid(x, s, a_hi, b_hi)
            g = (F.pow(1 - high, -a_lo / b_lo) - 1) / (2 ** (a_lo / b_lo) - 1)
            return F.when(x == 0, 0.0).otherwise(s * F.pow(g, 1 / a_lo))
        raise ValueError(f"unknown transfer {self.family}")


    def slope(self, x: Column | str) -> Column:
        """The derivative, JVM-side for all families; null at 0 for ``warp``, which has none there."""
        x = F.col(x) if isinstance(x, str) else x
        x = x.cast("double")
        p = self.params
        if self.family == "identity":
            return F.when(x.isNotNull(), F.lit(1.0))
        if self.family == "sigmoid":
            return 2 * x / (p[0] * p[0]) / F.pow(1 + F.pow(x / p[0], 2), 2)
        if self.family == "compress":
            return 1 / (p[0] * F.pow(1 + x / p[0], 2))
        if self.family == "xsigmoid":
            return _xsigmoid_slope(x, *p)
        if self.family == "gamma":
            s, n = p
            z = F.pow(x / s, 2) / 2
            return F.when((x == 0) & F.lit(n > 1), 0.0).otherwise(F.pow(z, n / 2 - 1) * F.exp(-z) * x / (s * s * math.gamma(n / 2)))
        if self.family == "imq":
            return _imq_slope(x, p[0])
        if self.family == "asinh":
            return 1 / (2 * math.asinh(1) * p[0] * F.sqrt(1 + F.pow(x / p[0], 2)))
        if self.family == "twoscale":
            s, a, b, wide = p
            return F.when(x <= s, _xsigmoid_slope(x, s, a, b)).otherwise(Transfer("asinh", (wide,)).slope(x))
        if self.family == "multiscale":
            total = F.lit(0.0)
            for s in p:
                total = total + _imq_slope(x, s)
            return total / len(p)
        if self.family == "warp":
            s, a_hi, b_hi, a_lo, b_lo = p
            left, ratio = 1 - _xsigmoid(x, s, a_hi, b_hi), a_lo / b_lo
            g = (F.pow(left, -ratio) - 1) / (2**ratio - 1)
            rise = ratio * F.pow(left, -ratio - 1) * _xsigmoid_slope(x, s, a_hi, b_hi) / (2**ratio - 1)
            return F.when(x != 0, s / a_lo * F.pow(g, 1 / a_lo - 1) * rise)
        raise ValueError(f"unknown transfer {self.family}")

    def values(self, x: np.ndarray) -> np.ndarray:
        """``column`` over an array, for tasks that hold distances as arrays."""
        p = self.params
        if self.family == "identity":
            return x
        if self.family == "sigmoid":
            return 1 - 1 / (1 + (x / p[0]) ** 2)
        if self.family == "compress":
            return 1 - 1 / (1 + x / p[0])
        if self.family == "xsigmoid":
            return _xsigmoid(x, *p)
        if self.family == "gamma":
            return lower_gamma(p[1] / 2, (x / (p[0] * math.sqrt(2))) ** 2)
        if self.family == "imq":
            return 1 - (p[0] / math.sqrt(3)) / np.sqrt(p[0] * p[0] / 3 + x * x)
        if self.family == "asinh":
            return np.arcsinh(x / p[0]) / (2 * math.asinh(1))
        if self.family == "twoscale":
            tail = Transfer("asinh", (p[3],))
            return np.where(x <= p[0], _xsigmoid(x, *p[:3]), tail.values(x) - tail.values(np.float64(p[0])) + 0.5)
        if self.family == "multiscale":
            return sum(Transfer("imq", (s,)).values(x) for s in p) / len(p)
        if self.family == "warp":
            s, a_hi, b_hi, a_lo, b_lo = p
            g = ((1 - _xsigmoid(x, s, a_hi, b_hi)) ** (-a_lo / b_lo) - 1) / (2 ** (a_lo / b_lo) - 1)
            return np.where(x == 0, 0.0, s * g ** (1 / a_lo))
        raise ValueError(f"unknown transfer {self.family}")

    def slopes(self, x: np.ndarray) -> np.ndarray:
        """``slope`` over an array: of the families that arrays are asked for."""
        p = self.params
        if self.family == "identity":
            return np.ones_like(x)
        if self.family == "sigmoid":
            return 2 * x / (p[0] * p[0]) / (1 + (x / p[0]) ** 2) ** 2
        if self.family == "compress":
            return 1 / (p[0] * (1 + x / p[0]) ** 2)
        if self.family == "asinh":
            return 1 / (2 * math.asinh(1) * p[0] * np.sqrt(1 + (x / p[0]) ** 2))
        raise ValueError(f"no slopes of arrays for {self.family}")

    def checked(self, x: Column | str) -> Column:
        """(f, slope) as one struct; an error unless x is at least 0 and both are finite and at least 0."""
        x = F.col(x) if isinstance(x, str) else x
        f, slope = self.column(x), self.slope(x)
        good = (x >= 0) & (f >= 0) & (f < float("inf")) & (slope >= 0) & (slope < float("inf"))
        return F.when(good, F.struct(f.alias("f"), slope.alias("slope"))).otherwise(F.raise_error(F.concat(F.lit("no transfer of "), x.cast("string"))))


def _xsigmoid_slope(x: Column, s: float, a: float, b: float) -> Column:
    c = 2 ** (a / b) - 1
    return b * c / s * F.pow(x / s, a - 1) * F.pow(1 + c * F.pow(x / s, a), -b / a - 1)


def _imq_slope(x: Column, s: float) -> Column:
    c = s / math.sqrt(3)
    return c * x / F.pow(c * c + x * x, 1.5)


def _xsigmoid(x: Column | np.ndarray, s: float, a: float, b: float) -> Column | np.ndarray:
    if isinstance(x, np.ndarray):
        return 1 - (1 + (2 ** (a / b) - 1) * (x / s) ** a) ** (-b / a)
    return 1 - F.pow(1 + (2 ** (a / b) - 1) * F.pow(x / s, a), -b / a)


def _imq(x: Column, s: float) -> Column:
    c = s / math.sqrt(3)
    return 1 - c / F.sqrt(c * c + x * x)


def _gamma(x: Column, s: float, n: float) -> Column:
    """P(n/2, (x / (s sqrt 2))^2); closed for even n, else by a vectorised series or continued fraction."""
    z = F.pow(x / (s * math.sqrt(2)), 2)
    if n % 2 == 0:
        total, term = F.lit(0.0), F.lit(1.0)
        for k in range(int(n) // 2):
            term = term * z / k if k else F.lit(1.0)
            total = total + term
        return 1 - F.exp(-z) * total

    @F.pandas_udf(DoubleType())
    def p(z: pd.Series) -> pd.Series:
        return pd.Series(lower_gamma(n / 2, z.to_numpy()))

    return p(z)


def lower_gamma(a: float, z: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    z = np.asarray(z, dtype=float)
    scale = np.exp(a * np.log(np.maximum(z, 1e-300)) - z - math.lgamma(a))
    term = np.full_like(z, 1 / a)
    total = term.copy()
    for k in range(1, 200):
        term = term * z / (a + k)
        total += term
    small = scale * total
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for k in range(1, 200):
        step = -k * (k - a)
        b = b + 2
        d = 1 / np.where(step * d + b == 0, 1e-300, step * d + b)
        c = np.where(b + step / c == 0, 1e-300, b + step / c)
        h = h * d * c
    return np.where(z == 0, 0.0, np.where(z < a + 1, small, 1 - scale * h))


# Names by which a transfer is asked for, with the number of its parameters
NAMES = {"identity": (0, 0), "imq": (0, 1), "asinh": (0, 1), "twoscale": (3, 4), "ts": (3, 4), "multiscale": (2, 99), "multi": (2, 99), "ms": (2, 99), "sigmoid": (1, 1), "compress": (1, 1), "xsigmoid": (3, 3), "gamma": (2, 2), "warp": (5, 5)}


def parse_transfer(spec: str | None) -> Transfer:
    """A transfer from text such as ``asinh,0.5``, ``ts,5,8,1`` or bare numbers: one is a sigmoid, two gamma, three xsigmoid, five warp."""
    parts = [p.strip().lower() for p in (spec or "identity").split(",") if p.strip()] or ["identity"]
    try:
        numbers = tuple(float(p) for p in parts)
        family = {1: "sigmoid", 2: "gamma", 3: "xsigmoid", 5: "warp"}.get(len(numbers))
    except ValueError:
        family, numbers = parts[0], tuple(float(p) for p in parts[1:])
    if family not in NAMES or not NAMES[family][0] <= len(numbers) <= NAMES[family][1]:
        raise ValueError(f"not a transfer: {spec!r}")
    family = {"ts": "twoscale", "ms": "multiscale", "multi": "multiscale"}.get(family, family)
    if any(not math.isfinite(x) or x <= 0 for x in numbers):
        raise ValueError(f"parameters must be positive: {spec!r}")
    if family in ("imq", "asinh") and not numbers:
        numbers = (1.0,)
    if family == "twoscale" and len(numbers) == 3:
        numbers = (*numbers, numbers[0])
    if family == "xsigmoid" and numbers[1] < 1:
        raise ValueError("the exponent a must be at least 1")
    return Transfer(family, numbers)
