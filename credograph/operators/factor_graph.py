"""Factor graphs over yes-no variables as two relations.

``variables``: variable, prior (null: no unary factor), hard (null, or 0 or 1 where it was
observed). ``factors``: factor, kind, inputs (array), conclusion, p1, p2, weights (array). Every
inference method reads factors as dense tables: ``vars`` (inputs, then the conclusion) and ``pots``,
one value for each assignment, where variable i of ``vars`` is bit i of the assignment's number.

A factor's width is bounded by ``MOST_WIDE``, so rows stay small; variables may have any number of
factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions.potentials import EPSILON, KINDS, clamp, logit

MOST_WIDE = 16
_RELATIONS = ("implication", "equivalence", "contradiction", "complement")


def pot(x: Column, low: float, high: float) -> Column:
    """Value of the row's factor at assignment number ``x``; a deterministic factor gives ``high``
    where the conclusion equals the connective's value, else ``low``."""
    kind, n = F.col("kind"), F.size("inputs")
    some = x.bitwiseAND(F.call_function("shiftleft", F.lit(1), n) - 1)
    bit = lambda i: F.shiftright(x, i).bitwiseAND(1)
    last = F.call_function("shiftright", x, n).bitwiseAND(1)
    every = some == F.call_function("shiftleft", F.lit(1), n) - 1
    a, b = bit(0) == 1, bit(1) == 1
    truth = F.when(kind == "conjunction", every).when(kind == "disjunction", some != 0).when(kind == "contradiction", ~every).when(kind == "negation", ~a)
    truth = truth.when(kind == "implication", ~a | b).when(kind == "equivalence", a == b).when(kind == "complement", a != b)
    cell = F.get("weights", some)
    p1, p2 = F.col("p1"), F.col("p2")
    entailed = F.when(a, F.when(last == 1, p1).otherwise(1 - p1)).otherwise(F.when(last == 1, 1 - p2).otherwise(p2))
    return (
        F.when(kind == "soft_entailment", entailed).when(kind == "conditional", F.when(last == 1, cell).otherwise(1 - cell))
        .when(kind == "pairwise", F.get("weights", x)).when((last == 1) == truth, high).otherwise(low)
    )


def tables(factors: DataFrame, low: float = EPSILON, high: float = 1 - EPSILON) -> DataFrame:
    """factor, vars, pots. Cells of conditionals and the two parameters of a soft entailment are
    kept off 0 and 1; the weights of a pairwise factor are taken as they are. ``low`` and ``high``
    are the values of deterministic factors: 0 and 1 for message passing."""
    told = factors.withColumns({
        "p1": clamp(F.col("p1")), "p2": clamp(F.col("p2")),
        "weights": F.when(F.col("kind") == "conditional", F.transform("weights", clamp)).otherwise(F.col("weights")),
    })
    wide = F.size("inputs") + 1
    states = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.when(wide <= MOST_WIDE, wide).otherwise(F.raise_error(F.lit("factor too wide")).cast("int"))) - 1)
    return told.select("factor", F.concat("inputs", F.array("conclusion")).alias("vars"), F.transform(states, lambda x: pot(x, low, high)).alias("pots"))


def unary(variables: DataFrame) -> DataFrame:
    """variable, base (log odds of the unary factor; 0 without one), hard. Evidence takes the
    prior's place."""
    p = F.when(F.col("hard").isNotNull(), F.when(F.col("hard") == 1, 1 - EPSILON).otherwise(EPSILON)).otherwise(clamp(F.col("prior")))
    return variables.select("variable", F.coalesce(logit(p), F.lit(0.0)).alias("base"), F.col("hard").isNotNull().alias("fixed"))


def incidences(factors: DataFrame) -> DataFrame:
    """factor, pos, variable: inputs first, the conclusion last, each variable once."""
    each = factors.select("factor", F.posexplode(F.array_distinct(F.concat("inputs", F.array("conclusion")))).alias("pos", "variable"))
    return each.filter("variable is not null")


def observe(variables: DataFrame, evidence: DataFrame) -> DataFrame:
    """``variables`` with ``evidence`` (variable, value). Contradicting values of one variable, in
    the evidence, with earlier evidence or with a prior on the other side, raise an error; the prior of an observed variable goes."""
    told = evidence.groupBy("variable").agg(F.min("value").alias("low"), F.max("value").alias("value"))
    wrong = (F.col("low") != F.col("value")) | (F.col("hard") != F.col("value")) | F.when(F.col("value") == 1, F.col("prior") < 0.5).when(F.col("value") == 0, F.col("prior") > 0.5)
    both = variables.join(told, "variable", "full_outer")
    value = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("evidence contradicts itself: "), F.col("variable"))).cast("int")).otherwise(F.coalesce("value", "hard")).cast("int")
    return both.select("variable", F.when(value.isNull(), F.col("prior")).alias("prior"), value.alias("hard"))


def soften(variables: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """``variables`` after soft evidence (variable, pos, ratio): odds are multiplied in the order of
    ``pos`` and kept in bounds each time. A variable without a prior starts even."""
    told = likelihoods.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct("pos", "ratio"))).alias("r"))
    step = lambda p, x: clamp(p * x["ratio"] / (p * x["ratio"] + 1 - p))
    moved = F.aggregate("r", F.coalesce(clamp(F.col("prior")), F.lit(0.5)), step)
    return variables.join(told, "variable", "left").select("variable", F.when(F.col("r").isNull() | F.col("hard").isNotNull(), F.col("prior")).otherwise(moved).alias("prior"), "hard")


def merge(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], prefix: str = "b:", keep_evidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """One graph of two: a variable of both keeps the first graph's prior where it has one. Factors
    of the second get ``prefix``. ``keep_evidence`` False drops evidence, as the original merge does."""
    side = lambda v, s: v.select("variable", F.col("prior").alias(f"prior{s}"), F.col("hard").alias(f"hard{s}"))
    both = side(first[0], 1).join(side(second[0], 2), "variable", "full_outer")
    hard = F.coalesce("hard1", "hard2") if keep_evidence else F.lit(None).cast("int")
    variables = both.select("variable", F.when(hard.isNull(), F.coalesce("prior1", "prior2")).alias("prior"), hard.cast("int").alias("hard"))
    return variables, first[1].unionByName(second[1].withColumn("factor", F.concat(F.lit(prefix), "factor")))


def problems(variables: DataFrame, factors: DataFrame) -> DataFrame:
    """check_name, id of all that no method could take: unknown kinds, wrong numbers of inputs or
    weights, parameters out of bounds, unknown variables, a conclusion among its inputs."""
    kind, n, w = F.col("kind"), F.size("inputs"), F.col("weights")
    need = F.when(kind.isin("negation", "soft_entailment", "pairwise"), n != 1).when(kind.isin(*_RELATIONS), n != 2).when(kind.isin("conjunction", "disjunction", "conditional"), n < 1)
    bad_number = lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
    found = {
        "kind_unknown": kind.isNull() | ~kind.isin(*KINDS),
        "arity": need,
        "conclusion_in_inputs": F.array_contains("inputs", F.col("conclusion")),
        "parameters": F.when(kind == "soft_entailment", F.coalesce(F.col("p1") + F.col("p2") <= 1, F.lit(True))),
        "weights": F.when(kind == "conditional", F.coalesce(F.size(w) != F.call_function("shiftleft", F.lit(1), n), F.lit(True)))
        .when(kind == "pairwise", F.coalesce((F.size(w) != 4) | F.exists(w, bad_number) | (F.aggregate(w, F.lit(0.0), lambda a, x: a + x) <= 0), F.lit(True))),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in found.items()]))
    own = factors.select(F.explode(names).alias("check_name"), F.col("factor").cast("string").alias("id"))
    unknown = incidences(factors).join(variables, "variable", "left_anti").select(F.lit("variable_unknown").alias("check_name"), F.col("variable").alias("id")).distinct()
    return own.unionByName(unknown)


def summary(variables: DataFrame, factors: DataFrame) -> DataFrame:
    """part, kind, n: variables by how they are known, factors by kind."""
    known = F.when(F.col("hard").isNotNull(), "observed").when(F.col("prior").isNotNull(), "prior").otherwise("free")
    parts = [variables.select(F.lit("variable").alias("part"), known.alias("kind")), factors.select(F.lit("factor").alias("part"), "kind")]
    return reduce(DataFrame.unionByName, parts).groupBy("part", "kind").agg(F.count("*").alias("n"))
