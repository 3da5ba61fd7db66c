"""Comparison of models on observations, and what it says as factors.

``models``: comparison, hypothesis, observable, family, params (map of name to number), symbols (map
of parameter to symbol; may be null); ``bindings``: hypothesis, symbol, value, what a hypothesis says
its symbols are; ``observations``: comparison, observable, value, noise_mu, noise_sigma (null:
measured without error). Noise is normal and added to what the model predicts.

Without noise a likelihood is a density. With noise it is an integral or a sum over what may have been:
sums run over the support (up to 50 and ten deviations above the value where it has no end); integrals
of continuous families are sums over fixed nodes, between points set by the noise, the family
and both together; a normal one is normal again. Log likelihoods are added up in tasks before
they are shuffled.

Defined cases: a hypothesis without observations has log likelihood 0; an observation of null or of
another observable isn't one; a symbol without a value, or with two, makes the hypothesis a
problem row, and so does a family or parameter that isn't known; a comparison in which no hypothesis
can have happened has no factors and is a problem row; repeated rows of models count once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from credograph.functions.densities import _NEEDS as PARAMETERS, log_density
from credograph.functions.potentials import EPSILON, clamp
from credograph.sources.folders import cut

DISCRETE = ("poisson", "binomial", "betabinomial")
#: Fixed value: log likelihood ratio for an observation above which a diffuse rival is a warning.
LINDLEY = 5.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(12)
_OFFSETS = (-12, -7, -4, -2, -0.7, 0.7, 2, 4, 7, 12)


def log_sum_exp(terms: Column) -> Column:
    """ln of the sum of exp of an array, in one pass; terms of minus infinity add nothing."""
    low = F.lit(float("-inf"))
    zero = F.struct(low.alias("m"), F.lit(0.0).alias("s"))

    def add(acc: Column, t: Column) -> Column:
        top = F.greatest(acc["m"], t)
        grown = F.struct(top.alias("m"), (acc["s"] * F.exp(acc["m"] - top) + F.exp(t - top)).alias("s"))
        return F.when(t > low, grown).otherwise(acc)

    return F.aggregate(terms, zero, add, lambda acc: F.when(acc["s"] > 0, acc["m"] + F.log(acc["s"])).otherwise(low))


def _shape(kind: str, p: dict[str, Column]) -> tuple[Column, Column, float, float]:
    """Middle, spread and support of a continuous family."""
    inf = math.inf
    if kind in ("normal", "studentt"):
        return p["mu"], p["sigma"], -inf, inf
    if kind == "cauchy":
        return p["mu"], p["gamma"], -inf, inf
    if kind == "lognormal":
        return F.exp(p["mu"]), F.exp(p["mu"]) * F.least(p["sigma"], F.lit(1.5)), 0.0, inf
    if kind == "exponential":
        return 1 / p["rate"], 1 / p["rate"], 0.0, inf
    if kind == "gamma":
        return p["alpha"] / p["rate"], F.sqrt(p["alpha"]) / p["rate"], 0.0, inf
    if kind == "chisquared":
        return p["df"], F.sqrt(2 * p["df"]), 0.0, inf
    total = p["alpha"] + p["beta"]
    return p["alpha"] / total, F.sqrt(p["alpha"] * p["beta"] / (total + 1)) / total, 0.0, 1.0


def noisy_log_density(kind: str, value: Column, noise_mu: Column, noise_sigma: Column, **given: Column) -> Column:
    """ln of the density of ``value`` where normal noise is added to what the family gives."""
    noise = lambda x: log_density("normal", value - x, mu=noise_mu, sigma=noise_sigma)
    if kind == "normal":
        return log_density("normal", value, mu=given["mu"] + noise_mu, sigma=F.sqrt(given["sigma"] ** 2 + noise_sigma**2))
    if kind in DISCRETE:
        high = given["n"] if kind != "poisson" else F.greatest((value + 10 * noise_sigma).cast("long"), value.cast("long") + 50)
        support = F.when(high >= 0, F.sequence(F.lit(0).cast("long"), F.greatest(high.cast("long"), F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
        return log_sum_exp(F.transform(support, lambda x: log_density(kind, x, **given) + noise(x)))
    middle, spread, least, most = _shape(kind, given)
    named = {"c": value - noise_mu, "s": noise_sigma, "m": middle, "w": spread, **given}
    start = F.struct(*[c.cast("double").alias(k) for k, c in named.items()])
    # each step is made once and read often
    return _let(start, lambda o: _let(_points(o, least, most), lambda points: _integral(kind, o, points, {k: o[k] for k in given})))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _points(o: Column, least: float, most: float) -> Column:
    """Ends of the pieces of an integral, in order: around the noise's centre (c, s), the family's (m, w)
    and where the product of two normal curves of these would lie; closer and closer to an end
    of the support."""
    c, s, m, w = (o[k] for k in "csmw")
    both, width = (s * s * m + w * w * c) / (s * s + w * w), s * w / F.sqrt(s * s + w * w)
    around = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((c, s), (m, w), (both, width))])
    points = F.flatten(F.transform(around, lambda a: F.transform(F.array(*[F.lit(float(k)) for k in _OFFSETS]), lambda k: a["x"] + k * a["y"])))
    low, high = F.least(c + _OFFSETS[0] * s, m + _OFFSETS[0] * w), F.greatest(c + _OFFSETS[-1] * s, m + _OFFSETS[-1] * w)
    close = F.transform(F.array(*[F.lit(10.0**-k) for k in (1, 2, 3, 5, 8, 12)]), lambda k: k * F.least(s, w))
    if least > -math.inf:
        low, high, points = F.greatest(low, F.lit(least)), F.greatest(high, F.lit(least)), F.concat(points, F.transform(close, lambda k: least + k))
    if most < math.inf:
        low, high, points = F.least(low, F.lit(most)), F.least(high, F.lit(most)), F.concat(points, F.transform(close, lambda k: most - k))
    ends = F.array(low, high)
    return _let(ends, lambda e: F.array_sort(F.array_distinct(F.concat(e, F.filter(points, lambda x: (x > e[0]) & (x < e[1]))))))


def _integral(kind: str, o: Column, points: Column, given: dict[str, Column]) -> Column:
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(math.log(w / 2))).alias("w")) for x, w in zip(_NODES, _WEIGHTS)])
    scale = -F.log(o["s"]) - 0.5 * math.log(2 * math.pi)

    def within(a: Column, b: Column) -> Column:
        placed = F.transform(nodes, lambda n: F.struct(((a + b) / 2 + (b - a) / 2 * n["x"]).alias("x"), (n["w"] + F.log(b - a)).alias("w")))
        return F.transform(placed, lambda n: n["w"] + log_density(kind, n["x"], **given) - ((o["c"] - n["x"]) / o["s"]) ** 2 / 2 + scale)

    pieces = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return log_sum_exp(F.flatten(F.transform(pieces, lambda p: within(p["a"], p["b"]))))


def bound(models: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """comparison, hypothesis, observable, family, params with all symbols replaced; and comparison,
    hypothesis, problem of the models for which that can't be done."""
    own = models.dropDuplicates(["comparison", "hypothesis"])
    told = bindings.groupBy("hypothesis", "symbol").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    told = told.filter("n = 1 and value is not null").drop("n")
    asked = own.select("comparison", "hypothesis", F.explode("symbols").alias("name", "symbol")).join(told, ["hypothesis", "symbol"], "left")
    found = asked.groupBy("comparison", "hypothesis").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value")))).alias("known"), F.max(F.col("value").isNull()).alias("unbound"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    both = own.join(found, ["comparison", "hypothesis"], "left").withColumn("known", F.coalesce("known", none)).withColumn("params", F.coalesce("params", none))
    # a parameter told as a symbol isn't told as a number
    both = both.withColumn("params", F.map_concat(F.map_filter("params", lambda k, v: ~F.array_contains(F.map_keys("known"), k)), F.col("known")))
    needs = F.create_map(*[x for k, v in PARAMETERS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    named = F.array_sort(F.map_keys("params")) == F.element_at(needs, F.col("family"))
    problem = F.when(F.coalesce("unbound", F.lit(False)), "unbound").when(F.coalesce(~named, F.lit(True)), "parameters")
    both = cut(both.withColumn("problem", problem))
    return both.filter("problem is null").select("comparison", "hypothesis", "observable", "family", "params"), both.filter("problem is not null").select("comparison", "hypothesis", "problem")


def likelihoods(models: DataFrame, observations: DataFrame, precomputed: DataFrame | None = None) -> DataFrame:
    """comparison, hypothesis, log_likelihood, n_observations of bound models. Log likelihoods of
    ``precomputed`` (comparison, hypothesis, log_likelihood) are taken as they are."""
    seen = observations.filter("value is not null").select("comparison", "observable", F.col("value").cast("double").alias("value"), F.coalesce(F.col("noise_mu").cast("double"), F.lit(0.0)).alias("noise_mu"), F.col("noise_sigma").cast("double").alias("noise_sigma"))
    each = seen.join(models, ["comparison", "observable"])
    # every family on its own rows: no row pays for the others' expressions
    parts = []
    for kind, names in PARAMETERS.items():
        own = each.filter(F.col("family") == kind).select("comparison", "hypothesis", "value", "noise_mu", "noise_sigma", *[F.col("params")[p].alias(p) for p in names])
        given = {p: F.col(p) for p in names}
        noisy = noisy_log_density(kind, F.col("value"), F.col("noise_mu"), F.col("noise_sigma"), **given)
        parts.append(own.select("comparison", "hypothesis", F.when(F.col("noise_sigma") > 0, noisy).otherwise(log_density(kind, F.col("value") - F.col("noise_mu"), **given)).alias("l")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy("comparison", "hypothesis").agg(F.sum("l").alias("l"), F.count("*").alias("n"))
    out = models.select("comparison", "hypothesis").join(sums, ["comparison", "hypothesis"], "left").select("comparison", "hypothesis", F.coalesce("l", F.lit(0.0)).alias("log_likelihood"), F.coalesce("n", F.lit(0)).cast("long").alias("n_observations"))
    if precomputed is None:
        return out
    told = precomputed.groupBy("comparison", "hypothesis").agg(F.max("log_likelihood").alias("told"))
    both = out.join(told, ["comparison", "hypothesis"], "full_outer")
    return both.select("comparison", "hypothesis", F.coalesce("told", "log_likelihood").alias("log_likelihood"), F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"))


def _scaled(found: DataFrame) -> DataFrame:
    return found.withColumn("top", F.max("log_likelihood").over(Window.partitionBy("comparison")))


def strategies(found: DataFrame) -> DataFrame:
    """What a comparison says of each hypothesis, for ``lowering_graph``: strategy_id, type, premises,
    conclusion, cpt. The chance of the comparison's claim is 0.5 without the hypothesis, and with it its
    likelihood's share of the largest. Comparisons that nothing supports have no rows."""
    some = _scaled(found).filter(F.col("top") > float("-inf"))
    with_it = clamp((1 - EPSILON) * F.exp(F.col("log_likelihood") - F.col("top")))
    return some.select(F.concat_ws(">", "hypothesis", "comparison").alias("strategy_id"), F.lit("infer").alias("type"), F.array("hypothesis").alias("premises"), F.col("comparison").alias("conclusion"), F.array(F.lit(0.5), with_it).alias("cpt"))


def posteriors(found: DataFrame) -> DataFrame:
    """comparison, hypothesis, log_likelihood, n_observations, posterior from equal priors (null where
    nothing is supported)."""
    share = F.exp(F.col("log_likelihood") - F.col("top"))
    scaled = _scaled(found).withColumn("share", F.when(F.col("top") > float("-inf"), share))
    return scaled.select("comparison", "hypothesis", "log_likelihood", "n_observations", (F.col("share") / F.sum("share").over(Window.partitionBy("comparison"))).alias("posterior"))


def summaries(found: DataFrame, models: DataFrame) -> DataFrame:
    """comparison, max_log_ratio (among what is supported), per_observation, diffuse (a beta-binomial
    model is even over all counts), warning (both: a large ratio may come from the diffuse rival
    alone), zero_support."""
    diffuse = models.groupBy("comparison").agg(F.max(F.coalesce((F.col("family") == "betabinomial") & (F.col("params")["alpha"] == 1) & (F.col("params")["beta"] == 1), F.lit(False))).alias("diffuse"))
    real = F.when(F.col("log_likelihood") > float("-inf"), F.col("log_likelihood"))
    each = found.groupBy("comparison").agg((F.max(real) - F.min(real)).alias("span"), F.max("n_observations").alias("n"), F.max(real).isNull().alias("zero_support"))
    ratio = F.coalesce("span", F.lit(0.0))
    per = ratio / F.greatest(F.col("n"), F.lit(1))
    return each.join(diffuse, "comparison", "left").select("comparison", ratio.alias("max_log_ratio"), per.alias("per_observation"), F.coalesce("diffuse", F.lit(False)).alias("diffuse"), (F.coalesce("diffuse", F.lit(False)) & (per > LINDLEY)).alias("warning"), "zero_support")


def exhaustive(found: DataFrame, kinds: DataFrame, operators: DataFrame | None = None, qualifier: str = "local:package") -> DataFrame:
    """The disjunction of all hypotheses (operator_id, operator, variables, conclusion, prior) of each
    comparison that ``kinds`` (comparison, exclusivity) calls exhaustive_pairwise_complement and that has three or
    more, unless ``operators`` already has one over the same claims."""
    asked = kinds.filter("exclusivity = 'exhaustive_pairwise_complement'").select("comparison").distinct()
    each = found.join(asked, "comparison", "left_semi").groupBy("comparison").agg(F.array_sort(F.collect_set("hypothesis")).alias("variables")).filter(F.size("variables") >= 3)
    if operators is not None:
        known = operators.filter("operator = 'disjunction'").select(F.array_sort(F.array_distinct("variables")).alias("variables")).distinct()
        each = each.join(known, "variables", "left_anti")
    helper = F.concat(F.lit(f"{qualifier}::__compare_exhaustive_"), F.substring(F.sha2("comparison", 256), 1, 12))
    made = each.select("variables", helper.alias("conclusion"))
    name = F.concat(F.lit("lco_"), F.substring(F.sha2(F.concat_ws("|", F.lit("disjunction"), F.array_join("variables", "|"), "conclusion"), 256), 1, 16))
    return made.select(name.alias("operator_id"), F.lit("disjunction").alias("operator"), "variables", "conclusion", F.lit(1 - EPSILON).alias("prior"))
