"""A whole reasoning graph to its factor graph, as joins and projections.

Relations (``pos`` is the order of declaration everywhere):

- ``claims``: id, label, helper (structural expression helper), prior (of the metadata, or null)
- ``operators``: operator_id, operator, variables, conclusion, pos, action_label, connective (its
  conclusion is a formula's truth variable)
- ``strategies``: strategy_id, type, premises, conclusion, cpt, p_a_given_b, p_b_given_a,
  sub_strategies, formal (array of operator, variables, conclusion), base_rate, prior (of a support's
  helper, if that is made here), pos, action_label. Named ones without formal get their template's
- ``priors``: id, prior (told for this run), and pos if a claim may have several
- ``reviews``: target_id, status, round, pos

The result is what ``factor_graph`` reads. Priors have the order: helper of an expression, none;
conclusion of an asserted relation, observed; told; metadata; none. Told priors of helpers, whose
label begins with two underscores, don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credograph.functions.potentials import EPSILON
from credograph.operators import formalize, lowering, reviews as review
from credograph.sources.folders import cut

SURE = 1 - EPSILON
#: Which operators relate claims, which don't mind the order of their variables.
RELATIONS = ("equivalence", "contradiction", "complement", "implication")
SYMMETRIC = ("equivalence", "contradiction", "complement", "disjunction", "conjunction")
#: Fixed value: named strategies whose implication is as sure as its helper.
SOFT_IMPLICATIONS = ("support",)



def admitted(rows: DataFrame, key: str, reviews: DataFrame | None) -> DataFrame:
    """Without a manifest all rows; else those without an action label and those whose latest
    review is accepted."""
    if reviews is None:
        return rows
    accepted = review.latest(reviews).filter("status = 'accepted'").select(F.col("target_id").alias(key))
    plain = F.col("action_label").isNull() | (F.col("action_label") == "")
    return rows.filter(plain).unionByName(rows.filter(~plain).join(accepted, key, "left_semi"))


def same_key(operator: Column, variables: Column) -> Column:
    """What two operators share that say the same."""
    return F.concat_ws("\u001f", operator, F.array_join(F.when(operator.isin(*SYMMETRIC), F.array_sort(F.array_distinct(variables))).otherwise(variables), "\u001e"))


def first_of_same(operators: DataFrame, *within: str) -> DataFrame:
    """``operators`` without later ones that say the same (in the same ``within``). Two that say it
    of different conclusions raise an error."""
    keys = [*within, "same"]
    marked = operators.withColumn("same", same_key(F.col("operator"), F.col("variables")))
    first = marked.groupBy(*keys).agg(F.min("pos").alias("pos"), F.count_distinct("conclusion").alias("n"), F.min("conclusion").alias("c"))
    checked = first.select(*keys, F.when(F.col("n") == 1, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("one relation with two conclusions: "), F.col("c"))).cast(first.schema["pos"].dataType)).alias("pos"))
    return marked.join(checked, [*keys, "pos"], "left_semi").drop("same")


def dropped(operators: DataFrame) -> DataFrame:
    """operator_id, operator, conclusion of operators that repeat an earlier one."""
    return operators.join(first_of_same(operators).select("operator_id"), "operator_id", "left_anti").select("operator_id", "operator", "conclusion")


def asserts(operators: DataFrame) -> Column:
    """Whether an operator's conclusion is a relation taken as true."""
    return F.col("operator").isin(*RELATIONS) & ~F.coalesce(F.col("connective"), F.lit(False))


def told_priors(claims: DataFrame, priors: DataFrame) -> DataFrame:
    """``priors`` but for helpers, which take none. Of several for a claim the one with the greatest
    ``pos`` counts (if there is that column; ties: the greatest prior)."""
    closed = claims.filter(F.col("helper") | F.coalesce(F.col("label").startswith("__"), F.lit(False))).select("id")
    return priors.join(closed, "id", "left_anti").groupBy("id").agg(F.max_by("prior", F.struct("pos", "prior") if "pos" in priors.columns else F.struct("prior")).alias("told"))


def claim_variables(claims: DataFrame, operators: DataFrame, told: DataFrame) -> DataFrame:
    """variable, prior, hard of all claims."""
    asserted = operators.filter(asserts(operators)).select(F.col("conclusion").alias("id"), F.lit(True).alias("asserted")).distinct()
    known = claims.join(asserted, "id", "left").join(told, "id", "left")
    prior = F.when(~F.col("helper"), F.coalesce("told", "prior"))
    hard = F.when(~F.col("helper") & F.col("asserted"), 1).cast("int")
    return known.select(F.col("id").alias("variable"), F.when(hard.isNull(), prior).cast("double").alias("prior"), hard.alias("hard"))


def _factors(rows: DataFrame, name: Column, kind, inputs, conclusion, p1=None, p2=None, weights=None) -> DataFrame:
    number = lambda c: (F.lit(None) if c is None else c).cast("double")
    table = (F.lit(None) if weights is None else weights).cast("array<double>")
    return rows.select(name.alias("factor"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), inputs.alias("inputs"), conclusion.alias("conclusion"), number(p1).alias("p1"), number(p2).alias("p2"), table.alias("weights"))


def expand(strategies: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Leaves: strategies that aren't composite, each once. Parts of composites are rows of
    ``strategies`` themselves; a part that isn't among ``known`` (all strategies, also those that
    reviews keep out) raises an error."""
    whole = strategies.filter(F.size(F.coalesce("sub_strategies", F.array().cast("array<string>"))) > 0)
    parts = whole.select("strategy_id", F.explode("sub_strategies").alias("part"))
    missing = parts.join((strategies if known is None else known).select(F.col("strategy_id").alias("part")), "part", "left_anti").agg(F.min("part").alias("part"))
    leaves = strategies.join(whole.select("strategy_id"), "strategy_id", "left_anti")
    # of rows with one id the first by pos stays
    leaves = leaves.withColumn("_k", F.row_number().over(Window.partitionBy("strategy_id").orderBy("pos", "conclusion", "type"))).filter("_k = 1").drop("_k")
    guard = missing.select(F.when(F.col("part").isNotNull(), F.raise_error(F.concat(F.lit("composite names a missing strategy: "), F.col("part"))).cast("boolean")).otherwise(True).alias("whole"))
    return leaves.crossJoin(F.broadcast(guard)).filter("whole").drop("whole")  # one row


def strategy_factors(strategies: DataFrame, claims: DataFrame, told: DataFrame, degraded: bool = False, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """factors; extra variables (conjunctions of premises; conclusions of formal operators); and
    claims that are no variables any more (helpers of deductions, supports and associations)."""
    leaves = cut(expand(strategies, known))
    kind, sid, premises, conclusion = F.col("type"), F.col("strategy_id"), F.col("premises"), F.col("conclusion")
    size = F.size("premises")
    named = lambda prefix: F.concat(F.lit(prefix), sid)
    even = F.array_repeat(F.lit(0.5), F.call_function("shiftleft", F.lit(1), size))
    infers = leaves.filter("type = 'infer'")
    cpt = F.coalesce("cpt", even)
    out, extra = [], []
    soft = leaves.filter("type = 'noisy_and'").withColumns({"p1": F.coalesce(F.get("cpt", F.lit(0)), F.lit(0.5)), "p2": F.lit(SURE), "m": named("_m_na_")})
    if degraded:
        more = infers.withColumns({"p1": F.element_at(cpt, -1), "p2": 1 - F.get(cpt, F.lit(0)), "m": named("_m_infer_")})
        soft = soft.unionByName(more)
    else:
        wrong = F.raise_error(F.concat(F.lit("wrong number of probabilities: "), sid)).cast("array<double>")
        out.append(_factors(infers, named("infer:"), "conditional", premises, conclusion, weights=F.when((kind == "infer") & (F.size(cpt) != F.size(even)), wrong).otherwise(cpt)))
    several = soft.filter(size > 1)
    out += [
        _factors(several, F.concat(F.col("m"), F.lit(":and")), "conjunction", premises, F.col("m")),
        _factors(soft, F.concat(F.col("m"), F.lit(":then")), "soft_entailment", F.when(size > 1, F.array("m")).otherwise(premises), conclusion, F.col("p1"), F.col("p2")),
    ]
    extra.append(several.select(F.col("m").alias("variable"), F.lit(None).cast("double").alias("prior")))
    # embedded operators
    each = leaves.filter(F.col("formal").isNotNull()).select(sid, kind, "base_rate", F.col("prior").alias("own"), F.posexplode("formal").alias("pos", "f")).select("strategy_id", "type", "base_rate", "own", "pos", "f.operator", "f.variables", "f.conclusion")
    each = cut(first_of_same(each, "strategy_id"))
    hint = claims.select(F.col("id").alias("conclusion"), F.col("prior").alias("meta"))
    then, own = F.get("variables", F.lit(1)), F.concat(F.lit("formal:"), sid, F.lit(":"), F.col("pos").cast("string"))
    implied = each.filter("operator = 'implication'")
    deduced = implied.filter("type = 'deduction'").withColumn("id", then).join(told, "id", "left")
    out.append(_factors(deduced, own, "conditional", F.slice("variables", 1, 1), then, weights=lowering.deduction(F.coalesce("base_rate", "told"))))
    backed = implied.filter(kind.isin(*SOFT_IMPLICATIONS)).join(hint, "conclusion", "left").join(told.withColumnRenamed("id", "conclusion"), "conclusion", "left")
    p1, p2 = lowering.support(F.coalesce("told", "meta", "own", F.lit(SURE)))
    out.append(_factors(backed, own, "soft_entailment", F.slice("variables", 1, 1), then, p1, p2))
    plain = each.filter((F.col("operator") != "implication") | ~kind.isin("deduction", *SOFT_IMPLICATIONS))
    out.append(_factors(plain, own, F.col("operator"), F.col("variables"), conclusion))
    extra.append(plain.select(F.col("conclusion").alias("variable"), F.when(F.col("operator").isin(*RELATIONS), SURE).alias("prior")))
    # associations
    pairs = leaves.filter("type = 'associate'").select(sid, conclusion, F.get("premises", F.lit(0)).alias("a"), F.get("premises", F.lit(1)).alias("b"), "p_a_given_b", "p_b_given_a")
    known = claims.join(told, "id", "left").select("id", F.coalesce("told", "prior").alias("known"))
    pairs = pairs.join(known.select(F.col("id").alias("a"), F.col("known").alias("prior_a")), "a", "left").join(known.select(F.col("id").alias("b"), F.col("known").alias("prior_b")), "b", "left")
    fitted = lowering.associate(pairs, "p_a_given_b", "p_b_given_a", "prior_a", "prior_b")
    bad = F.raise_error(F.concat(F.lit("association fits no joint: "), sid)).cast("array<double>")
    out.append(_factors(fitted, named("assoc:"), "pairwise", F.array("a"), F.col("b"), weights=F.when(F.col("problem").isNull(), F.array("w00", "w10", "w01", "w11")).otherwise(bad)))
    gone = deduced.select("conclusion").unionByName(backed.select("conclusion")).unionByName(pairs.select("conclusion")).select(F.col("conclusion").alias("variable")).distinct()
    factors = out[0]
    for more in out[1:]:
        factors = factors.unionByName(more)
    return factors, extra[0].unionByName(extra[1]), gone


def lower(claims: DataFrame, operators: DataFrame, strategies: DataFrame, priors: DataFrame, reviews: DataFrame | None = None, degraded: bool = False, qualifier: str = "local:package") -> tuple[DataFrame, DataFrame]:
    """variables and factors of the graph; with ``reviews``, of what they let pass."""
    operators = cut(first_of_same(admitted(operators, "operator_id", reviews)))
    every = strategies.select("strategy_id")
    strategies = formalize.fill(admitted(strategies, "strategy_id", reviews), qualifier)
    told = cut(told_priors(claims, priors))
    own = _factors(operators, F.concat(F.lit("op:"), "operator_id"), F.col("operator"), F.col("variables"), F.col("conclusion"))
    more, extra, gone = strategy_factors(strategies, claims, told, degraded, every)
    factors, extra, gone = cut(own.unionByName(more)), cut(extra), cut(gone)
    named = claim_variables(claims, operators, told).join(gone, "variable", "left_anti")
    # a relation inside a strategy is taken as sure where nothing else is known of it
    held = extra.groupBy("variable").agg(F.max("prior").alias("sure"))
    named = named.join(held, "variable", "left").select("variable", F.when(F.col("hard").isNull(), F.coalesce("prior", "sure")).alias("prior"), "hard")
    unnamed = factors.select(F.explode(F.concat("inputs", F.array("conclusion"))).alias("variable")).distinct().join(claims.select(F.col("id").alias("variable")), "variable", "left_anti")
    late = unnamed.join(held, "variable", "left").join(told.withColumnRenamed("id", "variable"), "variable", "left")
    return named.unionByName(late.select("variable", F.coalesce("told", "sure").alias("prior"), F.lit(None).cast("int").alias("hard"))), factors
