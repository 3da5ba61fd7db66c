"""Named strategies to embedded operators: a row in, a row out.

Each template is an array of (operator, variables, conclusion). Helper claims get ids of the form
namespace:package::__role_hash, where the hash is of the strategy's own parts, so the same strategy
gives the same ids wherever it is formalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions import names

#: The types with a template, and the roles that helpers have by operator.
TEMPLATES = ("deduction", "support", "mathematical_induction", "elimination", "case_analysis", "abduction", "analogy", "extrapolation", "compare")
ROLES = {
    "conjunction": "conjunction_result", "disjunction": "disjunction_result", "equivalence": "equivalence_result",
    "contradiction": "contradiction_result", "complement": "complement_result", "implication": "implication_result",
}
FORMAL = "array<struct<operator:string,variables:array<string>,conclusion:string>>"


def _id(qualifier: str, kind: Column, parts: Column, conclusion: Column, role: str, index: Column) -> Column:
    payload = F.concat_ws("|", F.lit("local"), kind, parts, conclusion, F.lit(role), index.cast("string"))
    return F.concat(F.lit(f"{qualifier}::__{role}_"), F.substring(F.sha2(payload, 256), 1, 8))


def _op(operator: str, variables: Column, conclusion: Column) -> Column:
    return F.struct(F.lit(operator).alias("operator"), variables.alias("variables"), conclusion.alias("conclusion"))


def problem(kind: Column, premises: Column) -> Column:
    """Why the premises don't fit the template, or null."""
    n = F.size(premises)
    pairs = (n < 3) | ((n - 1) % 2 != 0)
    wrong = F.when(kind.isin("deduction", "support"), n < 1).when(kind.isin("mathematical_induction", "analogy", "extrapolation"), n != 2)
    wrong = wrong.when(kind.isin("elimination", "case_analysis"), pairs).when(kind == "abduction", ~n.isin(1, 2)).when(kind == "compare", n != 3)
    return F.when(~kind.isin(*TEMPLATES), "no template").when(wrong, "premises")


def formal(kind: Column, premises: Column, conclusion: Column, qualifier: str) -> Column:
    """The embedded operators of a named strategy. Premises that don't fit raise an error."""
    # an abduction without a second explanation is given one, which all later ids depend on
    other = _id(qualifier, kind, F.get(premises, F.lit(0)), conclusion, "alternative_explanation", F.lit(0))
    full = F.when((kind == "abduction") & (F.size(premises) == 1), F.concat(premises, F.array(other))).otherwise(premises)
    # spelled out once for all ids
    told = F.array(F.struct(full.alias("full"), names.listed(full).alias("listed")))
    return F.get(F.transform(told, lambda o: _formal(kind, premises, conclusion, qualifier, o["full"], o["listed"])), F.lit(0))


def _formal(kind: Column, premises: Column, conclusion: Column, qualifier: str, full: Column, listed: Column) -> Column:
    helper = lambda operator, index=0: _id(qualifier, kind, listed, conclusion, ROLES[operator], F.lit(index) if isinstance(index, int) else index)
    at = lambda i: F.get(full, F.lit(i) if isinstance(i, int) else i)
    conj = helper("conjunction")
    leads = lambda inputs: F.array(_op("conjunction", inputs, conj), _op("implication", F.array(conj, conclusion), helper("implication")))
    one = F.array(_op("implication", F.array(at(0), conclusion), helper("implication")))
    pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(full) - 1) / 2).cast("int") - 1))
    first, second = (lambda i: at(2 * i + 1)), (lambda i: at(2 * i + 2))
    cases = F.transform(pairs, first)
    covered = lambda inputs: F.array(_op("disjunction", inputs, helper("disjunction")), _op("equivalence", F.array(helper("disjunction"), at(0)), helper("equivalence")))
    against = F.transform(pairs, lambda i: _op("contradiction", F.array(first(i), second(i)), helper("contradiction", i)))
    gates = F.concat(F.array(at(0)), F.flatten(F.transform(pairs, lambda i: F.array(second(i), helper("contradiction", i)))))
    elimination = F.concat(covered(F.concat(cases, F.array(conclusion))), against, leads(gates))
    each = lambda i: F.array(_op("conjunction", F.array(first(i), second(i)), helper("conjunction", i)), _op("implication", F.array(helper("conjunction", i), conclusion), helper("implication", i)))
    case_analysis = F.concat(covered(cases), F.flatten(F.transform(pairs, each)))
    # the ids of an abduction's helpers come after its alternative was added to the premises
    union = helper("disjunction")
    abduction = F.array(_op("disjunction", F.array(conclusion, at(1)), union), _op("equivalence", F.array(union, at(0)), helper("equivalence")))
    match1, match2 = helper("equivalence", 0), helper("equivalence", 1)
    compare = F.array(_op("equivalence", F.array(at(0), at(2)), match1), _op("equivalence", F.array(at(1), at(2)), match2), _op("implication", F.array(match2, match1), conclusion))
    made = F.when(kind.isin("deduction", "support") & (F.size(full) == 1), one).when(kind.isin("deduction", "support", "mathematical_induction", "analogy", "extrapolation"), leads(full))
    made = made.when(kind == "elimination", elimination).when(kind == "case_analysis", case_analysis).when(kind == "abduction", abduction).when(kind == "compare", compare)
    why = problem(kind, premises)
    return F.when(why.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("can't formalise"), kind, why)).cast(FORMAL)).otherwise(made)


def fill(strategies: DataFrame, qualifier: str) -> DataFrame:
    """``strategies`` with the operators of named ones that have none (column ``formal``)."""
    named = F.col("formal").isNull() & F.col("type").isin(*TEMPLATES)
    made = strategies.filter(named).withColumn("formal", formal(F.col("type"), F.col("premises"), F.col("conclusion"), qualifier))
    return strategies.filter(~named).unionByName(made.select(*strategies.columns))


def helpers(strategies: DataFrame) -> DataFrame:
    """strategy_id, id, kind of the claims that formalising added."""
    each = strategies.filter("formal is not null").select("strategy_id", F.col("conclusion").alias("whole"), F.explode("formal").alias("f"))
    own = each.filter((F.col("f.conclusion") != F.col("whole")) & F.col("f.conclusion").contains("::__"))
    return own.select("strategy_id", F.col("f.conclusion").alias("id"), F.col("f.operator").alias("kind")).distinct()
