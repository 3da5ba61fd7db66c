"""Log densities and masses as column expressions, so they stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

_SHIFT = 8


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, to about 1e-11: Stirling's series at x + 8, and the
    recurrence back to x."""
    z = x + _SHIFT
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    rising = reduce(lambda a, b: a * b, (x + i for i in range(_SHIFT)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


_NEEDS = {
    "normal": ("mu", "sigma"), "lognormal": ("mu", "sigma"), "cauchy": ("mu", "gamma"), "studentt": ("df", "mu", "sigma"), "exponential": ("rate",),
    "gamma": ("alpha", "rate"), "beta": ("alpha", "beta"), "chisquared": ("df",), "poisson": ("rate",), "binomial": ("n", "p"), "betabinomial": ("n", "alpha", "beta"),
}
_WHOLE = ("poisson", "binomial", "betabinomial")


def log_density(kind: str, x: Column, **given: Column | float) -> Column:
    """ln density (or mass) at ``x``; minus infinity outside the support, null for a null."""
    if kind not in _NEEDS or set(given) != set(_NEEDS[kind]):
        raise ValueError(f"{kind} needs {_NEEDS.get(kind, 'a known name')}")
    p = {k: (v if isinstance(v, Column) else F.lit(float(v))).cast("double") for k, v in given.items()}
    x = x.cast("double")
    inside = F.lit(True)
    if kind in ("normal", "lognormal"):
        at = x if kind == "normal" else F.log(x)
        out = -((at - p["mu"]) ** 2) / (2 * p["sigma"] ** 2) - F.log(p["sigma"]) - 0.5 * math.log(2 * math.pi)
        if kind == "lognormal":
            inside, out = x > 0, out - at
    elif kind == "cauchy":
        out = -F.log(p["gamma"] * math.pi * (1 + ((x - p["mu"]) / p["gamma"]) ** 2))
    elif kind == "studentt":
        half = (p["df"] + 1) / 2
        out = log_gamma(half) - log_gamma(p["df"] / 2) - 0.5 * F.log(p["df"] * math.pi) - F.log(p["sigma"]) - half * F.log1p(((x - p["mu"]) / p["sigma"]) ** 2 / p["df"])
    elif kind == "exponential":
        inside, out = x >= 0, F.log(p["rate"]) - p["rate"] * x
    elif kind in ("gamma", "chisquared"):
        a, r = (p["alpha"], p["rate"]) if kind == "gamma" else (p["df"] / 2, F.lit(0.5))
        inside, out = x > 0, a * F.log(r) - log_gamma(a) + (a - 1) * F.log(x) - r * x
    elif kind == "beta":
        inside, out = (x > 0) & (x < 1), (p["alpha"] - 1) * F.log(x) + (p["beta"] - 1) * F.log(1 - x) - log_beta(p["alpha"], p["beta"])
    elif kind == "poisson":
        inside, out = x >= 0, x * F.log(p["rate"]) - p["rate"] - log_gamma(x + 1)
    else:
        n = p["n"]
        inside = (x >= 0) & (x <= n)
        if kind == "binomial":
            out = log_choose(n, x) + x * F.log(p["p"]) + (n - x) * F.log(1 - p["p"])
        else:
            out = log_choose(n, x) + log_beta(x + p["alpha"], n - x + p["beta"]) - log_beta(p["alpha"], p["beta"])
    if kind in _WHOLE:
        inside = inside & (x == F.floor(x))
    return F.when(x.isNull(), F.lit(None)).when(inside, out).otherwise(float("-inf"))
