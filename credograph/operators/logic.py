"""Formulas as columns over bits; formulas as rows are in ``formulas``. A formula is an atom's name or a tuple:
("not", f), ("and", f, ...), ("or", f, ...), ("implies", f, g), ("iff", f, g)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def atoms(formula) -> set[str]:
    return {formula} if isinstance(formula, str) else set().union(*map(atoms, formula[1:]))


def truth(formula, bit: dict[str, Column]) -> Column:
    """The formula as a boolean column over bits (0 or 1)."""
    if isinstance(formula, str):
        return bit[formula] == 1
    kind, parts = formula[0], [truth(f, bit) for f in formula[1:]]
    if kind == "not" and len(parts) == 1:
        return ~parts[0]
    if kind in ("and", "or") and parts:
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)
    if kind in ("implies", "iff") and len(parts) == 2:
        return ~parts[0] | parts[1] if kind == "implies" else parts[0] == parts[1]
    raise ValueError(f"unknown connective {kind} of {len(parts)} parts")


def event_probability(joint: DataFrame, formula) -> DataFrame:
    """One row: the probability mass of a joint table (bit columns, p) in which the formula holds."""
    held = truth(formula, {a: F.col(a) for a in atoms(formula)})
    return joint.agg(F.coalesce(F.sum(F.when(held, F.col("p"))), F.lit(0.0)).alias("p"))
