"""Cumulative distributions of the eleven families, vectorised over Arrow batches (Spark has none).

Two functions do the work: the regularised incomplete gamma and beta integrals, each by the series
or continued fraction that converges where it is used. Sums of whole-number families are integrals
too, except for the beta-binomial one, which is added up."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from credograph.functions.densities import _NEEDS, _WHOLE
from credograph.functions.potentials import clamp

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_integral(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for a > 0 and x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    with np.errstate(all="ignore"):
        front = np.where(x > 0, np.exp(a * np.log(np.maximum(x, _TINY)) - x - _lgamma(a)), 0.0)
        rounds = int(min(max(200, 12 * math.sqrt(float(np.nanmax(a, initial=1.0))) + 60), 20_000))
        term = total = 1.0 / a
        for n in range(1, rounds):
            term = term * x / (a + n)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(b, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
        h = d
        for n in range(1, rounds):
            k = -n * (n - a)
            b = b + 2
            d, c = k * d + b, b + k / c
            d, c = 1 / np.where(np.abs(d) < _TINY, _TINY, d), np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        return np.clip(np.where(x < a + 1, front * total, 1 - front * h), 0.0, 1.0)


def beta_integral(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for a, b > 0 and x between 0 and 1."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(np.maximum(x, _TINY)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
        safe = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
        c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
        h = d
        rounds = int(min(max(200, 6 * math.sqrt(float(np.nanmax(a + b, initial=1.0)))), 20_000))
        for m in range(1, rounds):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / safe(1 + k * d), safe(1 + k / c)
                h = h * d * c
        part = np.where(x <= 0, 0.0, front * h)
    return np.clip(np.where(turn, 1 - part, part), 0.0, 1.0)


def _normal(z: np.ndarray) -> np.ndarray:
    half = gamma_integral(np.full_like(z, 0.5), z * z / 2) / 2
    return np.where(z < 0, 0.5 - half, 0.5 + half)


def _beta_binomial(x: float, n: float, a: float, b: float) -> float:
    if not all(map(math.isfinite, (x, n, a, b))):
        return math.nan
    k = np.arange(0, min(math.floor(x), int(n)) + 1)
    logs = math.lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + _lgamma(k + a) + _lgamma(n - k + b) - _lgamma(n + a + b) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b) if len(k) else np.zeros(0)
    return min(float(np.exp(logs).sum()), 1.0)


def probabilities(kind: str, x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """P(X <= x) for one family."""
    if kind == "normal":
        return _normal((x - p["mu"]) / p["sigma"])
    if kind == "lognormal":
        return np.where(x > 0, _normal((np.log(np.maximum(x, _TINY)) - p["mu"]) / p["sigma"]), 0.0)
    if kind == "cauchy":
        return 0.5 + np.arctan((x - p["mu"]) / p["gamma"]) / math.pi
    if kind == "studentt":
        t = (x - p["mu"]) / p["sigma"]
        tail = beta_integral(p["df"] / 2, np.full_like(t, 0.5), p["df"] / (p["df"] + t * t)) / 2
        return np.where(t > 0, 1 - tail, tail)
    if kind == "exponential":
        return np.where(x > 0, -np.expm1(-p["rate"] * np.maximum(x, 0)), 0.0)
    if kind == "gamma":
        return gamma_integral(p["alpha"], p["rate"] * x)
    if kind == "chisquared":
        return gamma_integral(p["df"] / 2, x / 2)
    if kind == "beta":
        return beta_integral(p["alpha"], p["beta"], x)
    k = np.floor(x)
    if kind == "poisson":
        return np.where(k < 0, 0.0, 1 - gamma_integral(np.maximum(k, 0) + 1, p["rate"]))
    if kind == "binomial":
        inside = np.clip(k, 0, np.maximum(p["n"] - 1, 0))
        return np.where(k < 0, 0.0, np.where(k >= p["n"], 1.0, beta_integral(np.maximum(p["n"] - inside, 1), inside + 1, 1 - p["p"])))
    return np.array([_beta_binomial(*v) for v in zip(k, p["n"], p["alpha"], p["beta"])])


def cumulative(kind: str, x: Column, **given: Column | float) -> Column:
    """P(X <= x); null for a null."""
    if kind not in _NEEDS or set(given) != set(_NEEDS[kind]):
        raise ValueError(f"{kind} needs {_NEEDS.get(kind, 'a known name')}")
    names = _NEEDS[kind]

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        known = frame.notna().all(axis=1).to_numpy()
        filled = frame.fillna(1.0)
        out = probabilities(kind, filled["x"].to_numpy(float), {c: filled[c].to_numpy(float) for c in names})
        return pd.Series(np.where(known, out, np.nan)).where(known, None)

    told = [(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(c) for c, v in ((c, given[c]) for c in names)]
    return run(F.struct(x.cast("double").alias("x"), *told))


def predicate_prior(kind: str, op: str, threshold: Column, **given: Column | float) -> Column:
    """The prior of the claim that a value of the family is ``op`` (<, <=, >, >=) the threshold, kept
    off 0 and 1. Whole-number families (but for the beta-binomial) count their steps."""
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"no prior for {op}")
    steps = kind in ("poisson", "binomial")
    at = threshold.cast("double")
    if steps:
        at = F.floor(at) if op in ("<=", ">") else F.ceil(at) - 1
    below = cumulative(kind, at, **given)
    return clamp(below if op in ("<", "<=") else 1 - below)
