"""What premises tell about conclusions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions.densities import log_gamma
from credograph.functions.potentials import entropy_bits

def conditional_information(rows: DataFrame, p1: str, p2: str, prior: str) -> Column:
    """Bits that a premise of the given prior tells about the conclusion of a soft entailment."""
    q, a, b = F.col(prior), F.col(p1), 1 - F.col(p2)
    return F.greatest(entropy_bits(q * a + (1 - q) * b) - q * entropy_bits(a) - (1 - q) * entropy_bits(b), F.lit(0.0))


def table_information(weights: Column, priors: Column) -> Column:
    """Bits that premises of the given priors tell about a conclusion with the chances ``weights``
    (bit i of the assignment: premise i). At most ``factor_graph.MOST_WIDE`` premises, as a table has."""
    mass = lambda x: F.aggregate(F.transform(priors, lambda p, i: F.when(F.call_function("shiftright", x, i).bitwiseAND(1) == 1, p).otherwise(1 - p)), F.lit(1.0), lambda a, b: a * b)
    cells = F.transform(weights, lambda w, x: F.struct(w.alias("w"), mass(x).alias("m")))
    sums = F.aggregate(cells, F.struct(F.lit(0.0).alias("on"), F.lit(0.0).alias("left")), lambda a, c: F.struct((a["on"] + c["m"] * c["w"]).alias("on"), (a["left"] + c["m"] * entropy_bits(c["w"])).alias("left")))
    return F.get(F.transform(F.array(sums), lambda s: F.greatest(entropy_bits(s["on"]) - s["left"], F.lit(0.0))), F.lit(0))


def log_likelihood(observations: DataFrame, key: str, value: str, rates: dict[str, float]) -> DataFrame:
    """Per key, Poisson log likelihoods of whole-number observations under each rate, and the
    posterior of the models from equal priors. Only sums are shuffled."""
    x = F.col(value)
    log_factorial = log_gamma(x + 1)
    sums = observations.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(log_factorial).alias("f"))
    logs = {m: F.col("s") * math.log(r) - F.col("n") * r - F.col("f") for m, r in rates.items()}
    top = F.array_max(F.array(*logs.values()))
    total = sum((F.exp(v - top) for v in logs.values()), F.lit(0.0))
    return sums.select(key, F.col("n").alias("n_observations"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), v.alias("log_likelihood"), (F.exp(v - top) / total).alias("posterior")) for m, v in logs.items()])))
