import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credograph.operators import comparison as C

FAMILIES = {
    "normal": {"mu": 1.0, "sigma": 2.0}, "lognormal": {"mu": 0.5, "sigma": 0.6}, "cauchy": {"mu": 1.0, "gamma": 0.5}, "studentt": {"df": 4.0, "mu": 1.0, "sigma": 0.7}, "exponential": {"rate": 1.5},
    "gamma": {"alpha": 2.5, "rate": 1.5}, "beta": {"alpha": 2.0, "beta": 3.0}, "chisquared": {"df": 3.0},
}


def density(kind, x, p):
    with np.errstate(all="ignore"):
        if kind == "normal":
            return np.exp(-(((x - p["mu"]) / p["sigma"]) ** 2) / 2) / p["sigma"] / math.sqrt(2 * math.pi)
        if kind == "lognormal":
            return np.where(x > 0, np.exp(-(((np.log(x) - p["mu"]) / p["sigma"]) ** 2) / 2) / p["sigma"] / math.sqrt(2 * math.pi) / x, 0)
        if kind == "cauchy":
            return 1 / (math.pi * p["gamma"] * (1 + ((x - p["mu"]) / p["gamma"]) ** 2))
        if kind == "studentt":
            n = p["df"]
            return math.gamma((n + 1) / 2) / math.gamma(n / 2) / math.sqrt(n * math.pi) / p["sigma"] * (1 + ((x - p["mu"]) / p["sigma"]) ** 2 / n) ** (-(n + 1) / 2)
        if kind == "beta":
            a, b = p["alpha"], p["beta"]
            return np.where((x > 0) & (x < 1), x ** (a - 1) * (1 - x) ** (b - 1) * math.gamma(a + b) / math.gamma(a) / math.gamma(b), 0)
        a, r = {"exponential": lambda: (1.0, p["rate"]), "gamma": lambda: (p["alpha"], p["rate"]), "chisquared": lambda: (p["df"] / 2, 0.5)}[kind]()
        return np.where(x > 0, r**a * x ** (a - 1) * np.exp(-r * x) / math.gamma(a), 0)


@pytest.mark.parametrize("kind", FAMILIES)
def test_noise_equals_a_fine_sum(spark, kind):
    given = FAMILIES[kind]
    cases = [(v, m, s) for v in (-1.0, 0.3, 4.0) for m, s in ((0.0, 0.05), (0.4, 0.5), (0.0, 3.0)) if not (v == 4.0 and s == 0.05 and kind == "beta")]
    rows = spark.createDataFrame(cases, "v double, m double, s double")
    got = rows.select("v", "m", "s", C.noisy_log_density(kind, F.col("v"), F.col("m"), F.col("s"), **{k: F.lit(x) for k, x in given.items()}).alias("l")).collect()
    for r in got:
        # midpoints, 100,000 to a side of what matters
        x = np.linspace(r.v - r.m - 14 * r.s, r.v - r.m + 14 * r.s, 200_001)
        if kind not in ("normal", "cauchy", "studentt"):
            x = np.linspace(max(x[0], 0), max(x[-1], 1e-9) if kind != "beta" else min(max(x[-1], 1e-9), 1), 200_001)
        mid, step = (x[1:] + x[:-1]) / 2, x[1] - x[0]
        total = (density(kind, mid, given) * np.exp(-(((r.v - r.m - mid) / r.s) ** 2) / 2) / r.s / math.sqrt(2 * math.pi)).sum() * step
        if total > 1e-40:
            assert r.l == pytest.approx(math.log(total), abs=2e-5), (kind, r)


def test_counts_with_noise(spark):
    row = spark.range(1).select(
        C.noisy_log_density("binomial", F.lit(3.2), F.lit(0.0), F.lit(0.5), n=F.lit(10.0), p=F.lit(0.3)).alias("b"), C.noisy_log_density("poisson", F.lit(3.2), F.lit(0.1), F.lit(0.5), rate=F.lit(2.0)).alias("p"),
        C.noisy_log_density("poisson", F.lit(-900.0), F.lit(0.0), F.lit(0.5), rate=F.lit(2.0)).alias("none"),
    ).first()
    noise = lambda d: math.exp(-((d / 0.5) ** 2) / 2) / 0.5 / math.sqrt(2 * math.pi)
    assert row.b == pytest.approx(math.log(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) * noise(3.2 - k) for k in range(11))))
    assert row.p == pytest.approx(math.log(sum(math.exp(-2) * 2**k / math.factorial(k) * noise(3.1 - k) for k in range(54))))
    assert row.none == -math.inf


MODELS = "comparison string, hypothesis string, observable string, family string, params map<string,double>, symbols map<string,string>"


def test_comparison_of_segregation_models(spark):
    """295 of 395 under a ratio of three to one, against an even rival."""
    models = spark.createDataFrame([("c", "mendel", "k", "binomial", {"n": 395.0}, {"p": "theta"}), ("c", "even", "k", "betabinomial", {"n": 395.0, "alpha": 1.0, "beta": 1.0}, None), ("c", "odd", "k", "binomial", {"n": 395.0}, {"p": "lost"}), ("c", "twice", "k", "binomial", {"n": 395.0}, {"p": "t"}), ("c", "what", "k", "zipf", {}, None), ("e", "mendel", "k", "poisson", {"rate": 3.0}, None)], MODELS)
    bindings = spark.createDataFrame([("mendel", "theta", 0.75), ("twice", "t", 0.1), ("twice", "t", 0.2)], "hypothesis string, symbol string, value double")
    known, problems = C.bound(models, bindings)
    assert sorted(map(tuple, problems.collect())) == [("c", "odd", "unbound"), ("c", "twice", "unbound"), ("c", "what", "parameters")]
    seen = spark.createDataFrame([("c", "k", 295.0, None, None), ("c", "other", 1.0, None, None), ("c", "k", None, None, None), ("e", "k", 0.5, None, None)], "comparison string, observable string, value double, noise_mu double, noise_sigma double")
    found = C.likelihoods(known, seen)
    got = {(r.comparison, r.hypothesis): r for r in C.posteriors(found).collect()}
    even, mendel = math.log(1 / 396), math.lgamma(396) - math.lgamma(296) - math.lgamma(101) + 295 * math.log(0.75) + 100 * math.log(0.25)
    assert got["c", "even"].log_likelihood == pytest.approx(even, rel=1e-9) and got["c", "mendel"].log_likelihood == pytest.approx(mendel, rel=1e-9)
    assert got["c", "mendel"].posterior == pytest.approx(1 / (1 + math.exp(even - mendel))) and got["e", "mendel"].posterior is None
    cpt = {tuple(r.premises): list(r.cpt) for r in C.strategies(found).collect()}
    assert cpt[("mendel",)] == [0.5, 0.999] and cpt[("even",)][1] == pytest.approx(0.999 * math.exp(even - mendel)) and len(cpt) == 2
    sums = {r.comparison: r for r in C.summaries(found, known).collect()}
    assert sums["c"].diffuse and not sums["c"].warning and sums["e"].zero_support
    told = spark.createDataFrame([("c", "even", 0.0), ("c", "mendel", -20.0)], "comparison string, hypothesis string, log_likelihood double")
    sharp = {r.comparison: r for r in C.summaries(C.likelihoods(known, seen, told), known).collect()}
    assert sharp["c"].warning and sharp["c"].per_observation == pytest.approx(20.0)
    kinds = spark.createDataFrame([("c", "exhaustive_pairwise_complement"), ("e", "none")], "comparison string, exclusivity string")
    more = C.likelihoods(known, seen, spark.createDataFrame([("c", "third", -1.0)], told.schema))
    (one,) = C.exhaustive(more, kinds).collect()
    assert list(one.variables) == ["even", "mendel", "third"] and one.prior == 0.999
    old = spark.createDataFrame([("disjunction", ["third", "mendel", "even"])], "operator string, variables array<string>")
    assert C.exhaustive(more, kinds, old).count() == 0 and C.exhaustive(found, kinds).count() == 0
