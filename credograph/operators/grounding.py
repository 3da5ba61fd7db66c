"""Quantified formulas grounded over finite domains, by joins, many at once.

``nodes``: claim, node, kind, name (of atoms), args (array, of atoms), children (array of nodes),
variable and domain (of the quantifiers forall and exists, which have one child); ``roots``: claim,
root; ``domains``: domain, pos, value (text).

A quantifier has an instance claim for each value of its domain, its id made of the claim it is
in, the variable and the value. A universal claim leads to each of its instances (a deduction each);
an existential one is the disjunction of its instances, or equivalent to the only one. The body of
an instance is grounded with the values of all variables bound so far, so quantifiers may stand
in one another, also below connectives: what is below becomes a claim of its own. A round goes one
node down in all formulas at once, so rounds follow the depth of formulas; instances are rows.

Defined cases: a variable bound again inside takes the inner value; an argument that no quantifier
binds stays as it is; a quantifier over an empty or unknown domain is a problem row, and so is a node
that isn't there; repeated nodes count once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions.names import quoted
from credograph.sources.folders import cut

QUANTIFIERS = ("forall", "exists")
#: Deeper formulas are taken to contain themselves.
DEEPEST = 200


def instance_id(qualifier: str, kind: Column, claim: Column, variable: Column, value: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", claim, variable, quoted(value)), 256), 1, 8)
    return F.concat(F.lit(f"{qualifier}::__"), kind, F.lit("_"), F.regexp_replace(variable, "[^A-Za-z0-9_]", "_"), F.lit("_"), digest)


def _part(claim: Column, node: Column) -> Column:
    """The claim of an inner node of a claim's body."""
    return F.concat(claim, F.lit("/"), node)


def ground(nodes: DataFrame, roots: DataFrame, domains: DataFrame, qualifier: str = "local:package") -> dict[str, DataFrame]:
    """instances (claim, within, source, kind, variable, value, bindings), deductions (premise,
    conclusion), operators (operator, variables, conclusion), atoms (claim, name, args) and problems
    (claim, node, problem). ``claim`` of an atom is the claim that says it; ``within`` is what an
    instance instantiates, ``source`` the formula it comes from."""
    own = cut(nodes.filter("claim is not null and node is not null").dropDuplicates(["claim", "node"]).withColumnRenamed("claim", "source"))
    members = cut(domains.filter("domain is not null and value is not null").groupBy("domain", "value").agg(F.min("pos").alias("pos")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    start = roots.filter("claim is not null").dropDuplicates(["claim"])
    # what is to be grounded: the claim it becomes, the formula and node, and the values bound
    todo = cut(start.select(F.col("claim").alias("says"), F.col("claim").alias("source"), F.col("root").alias("node"), none.alias("bound")))
    made: dict[str, list[DataFrame]] = {"instances": [], "deductions": [], "operators": [], "atoms": [], "problems": []}
    for depth in range(DEEPEST + 1):
        if todo.isEmpty():
            break
        at = cut(todo.join(own.withColumn("there", F.lit(True)), ["source", "node"], "left"))
        made["problems"].append(at.filter("there is null").select("source", "node", F.lit("missing").alias("problem")).distinct())
        bound = lambda x: F.coalesce(F.element_at("bound", x), x)
        made["atoms"].append(at.filter("kind = 'atom'").select(F.col("says").alias("claim"), "source", "name", F.transform(F.coalesce("args", F.array().cast("array<string>")), bound).alias("args")))
        wide = at.filter(F.col("kind").isin(*QUANTIFIERS))
        each = wide.join(members, "domain").withColumn("instance", instance_id(qualifier, F.col("kind"), F.col("says"), F.col("variable"), F.col("value")))
        each = cut(each.withColumn("inner", F.map_concat(F.map_filter("bound", lambda k, v: k != F.col("variable")), F.map_from_arrays(F.array("variable"), F.array("value")))))
        made["problems"].append(wide.join(members, "domain", "left_anti").select("source", "node", F.lit("empty domain").alias("problem")).distinct())
        made["instances"].append(each.select(F.col("instance").alias("claim"), F.col("says").alias("within"), "source", "kind", "variable", "value", F.col("inner").alias("bindings")))
        made["deductions"].append(each.filter("kind = 'forall'").select(F.col("says").alias("premise"), F.col("instance").alias("conclusion")))
        some = each.filter("kind = 'exists'").groupBy("says").agg(F.sort_array(F.collect_list(F.struct("pos", "value", "instance"))).alias("i"))
        made["operators"].append(some.select(F.when(F.size("i") == 1, "equivalence").otherwise("disjunction").alias("operator"), F.when(F.size("i") == 1, F.concat(F.array("says"), F.col("i.instance"))).otherwise(F.col("i.instance")).alias("variables"), F.when(F.size("i") > 1, F.col("says")).alias("conclusion")))
        joined = at.filter(~F.col("kind").isin("atom", *QUANTIFIERS))
        parts = F.transform("children", lambda c: _part(F.col("says"), c))
        made["operators"].append(joined.select(F.col("kind").alias("operator"), parts.alias("variables"), F.col("says").alias("conclusion")))
        below = joined.select("says", "source", F.explode(F.array_distinct("children")).alias("node"), "bound").select(_part(F.col("says"), F.col("node")).alias("says"), "source", "node", "bound")
        inside = each.select(F.col("instance").alias("says"), "source", F.get("children", F.lit(0)).alias("node"), F.col("inner").alias("bound"))
        todo = cut(below.unionByName(inside))
        if depth == DEEPEST:
            made["problems"].append(todo.select("source", "node", F.lit("too deep").alias("problem")).distinct())
    schemas = {"instances": "claim string, within string, source string, kind string, variable string, value string, bindings map<string,string>", "deductions": "premise string, conclusion string", "operators": "operator string, variables array<string>, conclusion string", "atoms": "claim string, source string, name string, args array<string>", "problems": "source string, node string, problem string"}
    found = {k: reduce(DataFrame.unionByName, v) if v else nodes.sparkSession.createDataFrame([], schemas[k]) for k, v in made.items()}
    return found | {"problems": found["problems"].distinct()}


def spelled(name: Column, args: Column) -> Column:
    """An atom as text: name(a, b), or its name alone."""
    return F.when(F.size(args) > 0, F.concat(name, F.lit("("), F.array_join(args, ", "), F.lit(")"))).otherwise(name)
