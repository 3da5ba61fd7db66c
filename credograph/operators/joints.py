"""Joint tables of named variables by several methods, side by side.

Exact tables come from elimination of all other variables, so the names may lie in different cliques
or components, of a graph of any size and small width. Propagation knows joints within one factor only,
mean field none but the product of beliefs. What a method can't tell becomes a row with the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from credograph.operators import exact, factor_graph, junction_tree, mean_field, message_passing
from credograph.sources.folders import cut

METHODS = ("exact", "junction_tree", "trw", "mean_field")
SCHEMA = "method string, assignment int, p double, basis string, problem string"
#: What each method's numbers rest on.
BASIS = {"exact": "exact_joint_distribution", "junction_tree": "calibrated_clique_marginal", "trw": "approximate_joint_distribution", "mean_field": "variational_joint_distribution"}


def _mask(names: list[str], scope: str, x: Column) -> Column:
    """The assignment of ``names`` (bit i: names[i]) in assignment ``x`` of the variables in ``scope``."""
    bit = lambda v: F.call_function("shiftright", x, (F.array_position(scope, v) - 1).cast("int")).bitwiseAND(1)
    return reduce(lambda a, b: a + b, [F.shiftleft(bit(v), i) for i, v in enumerate(names)]).cast("int")


def by_elimination(variables: DataFrame, factors: DataFrame, names: list[str], most: int = junction_tree.WIDEST) -> DataFrame:
    """assignment (bit i: names[i]), p. Raises ``TooWide`` where the others can't be eliminated."""
    spark = variables.sparkSession
    if len(names) > factor_graph.MOST_WIDE:
        raise junction_tree.TooWide(f"more than {factor_graph.MOST_WIDE} names")
    kept = spark.createDataFrame([(v,) for v in names], "variable string")
    left = junction_tree.reduced(junction_tree.log_tables(variables, factors), kept, most)
    held = left.agg(F.collect_list(F.struct("vars", "logs")).alias("f"))  # tables over the names only
    scope = F.array(*map(F.lit, names))
    cells = spark.range(1 << len(names)).select(F.col("id").cast("int").alias("assignment")).crossJoin(F.broadcast(held))  # one row
    index = lambda own: F.aggregate(F.transform(own, lambda v, j: F.call_function("shiftleft", F.call_function("shiftright", F.col("assignment"), (F.array_position(scope, v) - 1).cast("int")).bitwiseAND(1), j)), F.lit(0), lambda a, b: a + b)
    weighed = cut(cells.select("assignment", F.aggregate("f", F.lit(0.0), lambda a, t: a + F.get(t["logs"], index(t["vars"]))).alias("w")))
    top = weighed.agg(F.max("w")).first()[0]
    e = F.exp(F.col("w") - F.lit(top))
    total = weighed.agg(F.sum(e)).first()[0]
    return weighed.select("assignment", (e / F.lit(total)).alias("p"))


def within_a_factor(variables: DataFrame, factors: DataFrame, names: list[str], most_rounds: int = 200) -> DataFrame | None:
    """assignment, p from the smallest factor (ties: the least name) that holds all names, by
    tree-reweighted propagation; None if there is none, which is seen before anything is run."""
    from credograph.operators.lowering import tree_weights

    scope = F.concat("inputs", F.array("conclusion"))
    holds = factors.filter(F.size(F.array_except(F.array(*map(F.lit, names)), scope)) == 0)
    best = holds.orderBy(F.size("inputs"), "factor").select("factor").limit(1).collect()
    if not best:
        return None
    rho = cut(tree_weights(factor_graph.incidences(factors), variables.filter("hard is not null")))
    told = message_passing.run(variables, factors, most_rounds=most_rounds, threshold=1e-8, reweighted=True, rho=rho)[1]
    cells = message_passing.pseudo_joints(told.filter(F.col("factor") == best[0].factor))
    return cells.groupBy(_mask(names, "vars", F.col("assignment")).alias("assignment")).agg(F.sum("p").alias("p"))


def of_beliefs(beliefs: DataFrame, names: list[str]) -> DataFrame:
    """assignment, p as a product of the names' beliefs (variable, belief)."""
    spark = beliefs.sparkSession
    held = beliefs.filter(F.col("variable").isin(names)).agg(F.map_from_entries(F.collect_list(F.struct("variable", "belief"))).alias("b"))
    cells = spark.range(1 << len(names)).select(F.col("id").cast("int").alias("assignment")).crossJoin(F.broadcast(held))  # one row
    each = [F.when(F.shiftright("assignment", i).bitwiseAND(1) == 1, F.col("b")[v]).otherwise(1 - F.col("b")[v]) for i, v in enumerate(names)]
    return cells.select("assignment", reduce(lambda a, b: a * b, each).alias("p"))


def compared(variables: DataFrame, factors: DataFrame, names: list[str], methods: tuple[str, ...] = METHODS) -> DataFrame:
    """method, assignment (bit i: names[i]), p, basis, problem: the joint by each method, or one row
    that says why there is none."""
    if not names or len(set(names)) < len(names) or not all(isinstance(v, str) and v for v in names):
        raise ValueError("names must be some different, non-empty strings")
    if set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(set(methods) - set(METHODS))}")
    spark = variables.sparkSession
    known = {r.variable for r in variables.filter(F.col("variable").isin(names)).select("variable").distinct().collect()}  # as many as names
    missing = [v for v in names if v not in known]
    out = []
    for method in methods:
        found, problem = None, f"unknown variables: {missing}" if missing else None
        try:
            if problem is None and method == "exact":
                found = cut(exact.joint(variables, factors, names).select(F.col("assignment").cast("int").alias("assignment"), "p"))
            elif problem is None and method == "junction_tree":
                found = by_elimination(variables, factors, names)
            elif problem is None and method == "trw":
                found = within_a_factor(variables, factors, names)
                problem = None if found is not None else "no factor holds all names"
            elif problem is None:
                found = of_beliefs(mean_field.run(variables, factors)[0], names)
        except junction_tree.TooWide as e:
            problem = str(e)
        except Exception as e:
            if "a component of more than" not in str(e):
                raise
            problem = f"more than {exact.MOST_VARIABLES} variables in a component"
        if found is not None:
            out.append(found.select(F.lit(method).alias("method"), "assignment", "p", F.lit(BASIS[method]).alias("basis"), F.lit(None).cast("string").alias("problem")))
        else:
            out.append(spark.createDataFrame([(method, None, None, None, problem)], SCHEMA))
    return reduce(DataFrame.unionByName, out)


def entropy(joint: DataFrame) -> DataFrame:
    """One row: bits and effective_states of a joint (p)."""
    bits = F.coalesce(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))), F.lit(0.0))
    return joint.agg(bits.alias("bits")).select("bits", F.pow(F.lit(2.0), "bits").alias("effective_states"))
