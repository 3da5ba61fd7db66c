"""From strategies to factors: parameters of each factor as columns, a row in, a row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions.potentials import EPSILON, clamp

SURE = 1 - EPSILON
#: Fixed value: how far two statements of one joint cell may differ.
TOLERANCE = 1e-6


def support(warrant: Column) -> tuple[Column, Column]:
    """p1 and p2 of a soft entailment: as sure as its warrant, else even."""
    return warrant * SURE + (1 - warrant) * 0.5, F.lit(0.5)


def deduction(base_rate: Column) -> Column:
    """Table of a conditional: the conclusion's base rate while a premise is false, else sure."""
    return F.array(F.coalesce(base_rate, F.lit(0.5)), F.lit(SURE))


def noisy_and(strength: Column) -> tuple[Column, Column]:
    """p1 and p2 of the soft entailment after the conjunction of the premises."""
    return strength, F.lit(SURE)


def infer(if_true: Column, if_false: Column, given: int) -> Column:
    """Table over the hypothesis (lowest bit) and ``given`` further premises: even unless all of
    the further ones hold."""
    return F.concat(F.array_repeat(F.lit(0.5), 2 * ((1 << given) - 1)), F.array(if_false, if_true))


def maxent_joint(a_given_b: Column, b_given_a: Column) -> dict[str, Column]:
    """The joint of largest entropy with both conditionals; cells by the values of a, then b."""
    only_a, only_b = 1 / b_given_a - 1, 1 / a_given_b - 1  # relative to the cell of both
    odds = 1 + only_a + only_b
    neither = F.exp((only_a * F.log(only_a) + only_b * F.log(only_b)) / odds)
    both = 1 / (odds + neither)
    return {"p00": neither * both, "p10": only_a * both, "p01": only_b * both, "p11": both}


def associate(rows: DataFrame, a_given_b: str, b_given_a: str, prior_a: str, prior_b: str) -> DataFrame:
    """``rows`` with cells p00, p10, p01, p11, weights w00 ... w11 (cells over the product of the
    marginals; over 1/4 where neither prior is known) and ``problem``: null, or why the given
    numbers fit no joint (cells and weights are then null)."""
    ab, ba = clamp(F.col(a_given_b)), clamp(F.col(b_given_a))
    untold = ab.isNull() | ba.isNull()
    free = F.col(prior_a).isNull() & F.col(prior_b).isNull()
    a = F.coalesce(F.col(prior_a), F.col(prior_b) * ab / ba)
    b = F.coalesce(F.col(prior_b), F.col(prior_a) * ba / ab)
    both = (ba * a + ab * b) / 2
    told = {"p00": 1 - a - b + both, "p10": a - both, "p01": b - both, "p11": both}
    problem = F.when(untold, "conditional").when(free, None).when(~((a > 0) & (a < 1) & (b > 0) & (b < 1)), "marginal").when(F.abs(ba * a - ab * b) > TOLERANCE, "inconsistent").when(F.least(*told.values()) < -TOLERANCE, "negative")
    most = maxent_joint(ab, ba)
    base = {"p00": (1 - a) * (1 - b), "p10": a * (1 - b), "p01": (1 - a) * b, "p11": a * b}
    cell = {k: F.when(free, most[k]).otherwise(F.greatest(told[k], F.lit(0.0))) for k in told}
    weight = {k: cell[k] / F.when(free, 0.25).otherwise(base[k]) for k in told}
    good = problem.isNull()
    return rows.select("*", problem.alias("problem"), *[F.when(good, v).alias(k) for k, v in cell.items()], *[F.when(good, v).alias(f"w{k[1:]}") for k, v in weight.items()])


def tree_weights(factors: DataFrame, hard: DataFrame) -> DataFrame:
    """factor, rho for tree-reweighted propagation. ``factors``: factor, variable (a row for each);
    ``hard``: variables with evidence. Factors of such variables only have 1, others share what a
    spanning tree of the free variables would hold."""
    marked = factors.join(hard.select("variable", F.lit(1).alias("is_hard")).distinct(), "variable", "left")
    each = marked.groupBy("factor").agg(F.max(F.col("is_hard").isNull()).alias("soft"))
    n = marked.filter("is_hard is null").agg(F.countDistinct("variable").alias("n_soft"))
    sizes = each.agg(F.count_if("soft").alias("f_soft")).crossJoin(n)  # one row each
    rho = F.when(~F.col("soft") | (F.col("f_soft") == 0) | (F.col("n_soft") <= 1), 1.0).otherwise(F.least(F.lit(1.0), (F.col("n_soft") - 1) / F.col("f_soft")))
    return each.crossJoin(F.broadcast(sizes)).select("factor", rho.alias("rho"))
