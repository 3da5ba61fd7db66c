"""Factor potentials and probabilities as column expressions over bits (0 or 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Fixed value: probabilities stay this far from 0 and 1.
EPSILON = 1e-3
KINDS = ("implication", "conjunction", "disjunction", "negation", "equivalence", "contradiction", "complement", "soft_entailment", "conditional", "pairwise")


def clamp(p: Column) -> Column:
    """``p`` in bounds; null stays null (an unknown prior is none)."""
    return F.when(p.isNotNull(), F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p)))


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy_bits(p: Column) -> Column:
    """Entropy of a yes-no variable; 0 at both ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def _index(bits: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.shiftleft(b.cast("int"), i) for i, b in enumerate(bits)))


def potential(kind: str, inputs: list[Column], conclusion: Column | None, p1: float = 1.0, p2: float = 1.0, weights: tuple[float, ...] = ()) -> Column:
    """Value of a factor. Deterministic kinds give 0 or 1: whether the conclusion equals the
    connective's value. ``soft_entailment`` takes p1 = P(c | premise) and p2 = P(not c | not
    premise); ``conditional`` and ``pairwise`` look ``weights`` up, the first input as lowest bit."""
    on = [b == 1 for b in inputs]
    if kind == "soft_entailment":
        return F.when(on[0], F.when(conclusion == 1, p1).otherwise(1 - p1)).otherwise(F.when(conclusion == 0, p2).otherwise(1 - p2))
    if kind in ("conditional", "pairwise"):
        cell = F.element_at(F.array(*map(F.lit, weights)), _index(inputs) + 1)
        return cell if kind == "pairwise" else F.when(conclusion == 1, cell).otherwise(1 - cell)
    if not on:
        raise ValueError(f"factor {kind} without inputs")
    every, some = reduce(lambda a, b: a & b, on), reduce(lambda a, b: a | b, on)
    truth = {"conjunction": every, "disjunction": some, "contradiction": ~every, "negation": ~on[0]}
    if len(on) > 1:
        truth |= {"implication": ~on[0] | on[1], "equivalence": on[0] == on[1], "complement": on[0] != on[1]}
    if kind not in truth:
        raise ValueError(f"unknown factor {kind} of {len(on)} inputs")
    return F.when((conclusion == 1) == truth[kind], 1.0).otherwise(0.0)
