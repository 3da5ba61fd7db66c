"""Loopy and tree-reweighted belief propagation over factor graphs of any size.

A row of the state is an end of a factor: what it last told its variable, as a probability. In each
round a variable's messages are added up (in log odds, so sums combine within tasks and a variable
with very many factors is no hot group), handed out by an ordinary join, and turned into new
messages within the factors, whose tables stay where they are. Rounds are damped, end when no belief
moves by ``threshold``, and are cut off from each other in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions.potentials import logit, sigmoid
from credograph.operators import factor_graph
from credograph.sources.folders import cut

_TINY = 1e-300
#: Factors that are held in partitions of their own.
_MANY = 20000


def _bit(x: Column, i: Column) -> Column:
    return F.call_function("shiftright", x, i).bitwiseAND(1)


def _massed(told: DataFrame) -> DataFrame:
    """With ``mass``, of each assignment: its potential times what the variables tell (told), over the largest."""
    logs = F.transform("logs", lambda w, x: w + F.aggregate(F.sequence(F.lit(0), F.size("told") - 1), F.lit(0.0), lambda a, i: a + _bit(x, i) * F.get("told", i)))
    weighed = told.withColumn("weighed", logs).withColumn("top", F.array_max("weighed"))
    return weighed.withColumn("mass", F.transform("weighed", lambda w: F.exp(w - F.col("top")))).drop("weighed", "top")


def _answers(told: Column) -> Column:
    """What a factor tells each of its variables, as log odds before reweighting."""
    side = lambda i, on: F.aggregate(F.sequence(F.lit(0), F.size("mass") - 1), F.lit(0.0), lambda a, x: a + F.when(_bit(x, i) == on, F.get("mass", x)).otherwise(0.0))
    return F.transform(told, lambda m, i: F.log(F.greatest(side(i, 1), F.lit(_TINY))) - F.log(F.greatest(side(i, 0), F.lit(_TINY))) - m)


def run(variables: DataFrame, factors: DataFrame, damping: float = 0.5, most_rounds: int = 100, threshold: float = 1e-6, reweighted: bool = False, rho: DataFrame | None = None, history: bool = False):
    """(beliefs, told, rounds, converged). ``beliefs``: variable, belief. ``told``: factor, vars,
    logs and the messages to it. Deterministic factors are strict. With ``reweighted``, a factor's
    logs are scaled by its ``rho`` (factor, rho) and observed variables tell what was observed."""
    base = cut(factor_graph.unary(variables))
    dense = factor_graph.tables(factors, 0.0, 1.0).select("factor", "vars", F.transform("pots", lambda p: F.log(F.greatest(p, F.lit(_TINY)))).alias("logs"))
    dense = dense.join(rho, "factor", "left") if rho is not None else dense.withColumn("rho", F.lit(1.0))
    # many factors stay where they are hashed to; few would cost a task a partition in every round
    dense = cut(dense)
    many = dense.count() > _MANY
    dense = dense.repartition("factor").persist() if many else dense.coalesce(1)
    ends = cut(dense.select("factor", F.posexplode("vars").alias("pos", "variable")).withColumn("p", F.lit(0.5)).withColumn("before", F.lit(0.0)))

    def totals(state: DataFrame) -> DataFrame:
        came = state.groupBy("variable").agg(F.sum(logit(F.col("p"))).alias("m"), F.max("before").alias("before"))
        sums = base.join(came, "variable", "left").select("variable", "base", "fixed", "before", (F.col("base") + F.coalesce("m", F.lit(0.0))).alias("total"))
        return cut(sums) if many else sums  # few are added up again sooner than written

    def inward(state: DataFrame, total: DataFrame) -> DataFrame:
        own = F.col("total") - logit(F.col("p"))
        v2f = F.when(F.col("fixed"), F.col("base")).otherwise(own) if reweighted else own
        told = state.join(total, "variable").groupBy("factor").agg(F.sort_array(F.collect_list(F.struct("pos", v2f.alias("m"), "p", "total"))).alias("e"))
        return told.join(dense, "factor")

    def outward(told: DataFrame) -> DataFrame:
        told = _massed(told.withColumn("told", F.col("e.m"))).withColumn("out", _answers(F.col("told")))
        new = F.arrays_zip("vars", F.col("e.p").alias("p"), F.col("e.total").alias("total"), F.transform("out", lambda x: sigmoid(x * F.col("rho"))).alias("q"))
        damped = F.transform(new, lambda x: F.struct(x["vars"].alias("variable"), (damping * x["q"] + (1 - damping) * x["p"]).alias("p"), x["total"].alias("before")))
        return told.select("factor", F.posexplode(damped).alias("pos", "x")).select("factor", "pos", "x.variable", "x.p", "x.before")

    total, seen, converged, k = totals(ends), [], False, 0
    told_by = lambda t, c: t.select("variable", sigmoid(F.col(c)).alias("belief"))
    for k in range(1, most_rounds + 1):
        if history:
            seen.append(told_by(total, "total").withColumn("round", F.lit(k - 1)))
        new = outward(inward(ends, total))
        # what is cut is run twice; of many factors it is then only what was shuffled
        ends = cut(new.repartition("variable") if many else new, k)
        total = totals(ends)
        moved = total.agg(F.max(F.abs(sigmoid(F.col("total")) - sigmoid(F.col("before"))))).first()[0]
        if moved is None or moved < threshold:
            converged = True
            break
    if history:
        seen.append(told_by(total, "total").withColumn("round", F.lit(k)))
    told = cut(inward(ends, total).select("factor", "vars", "logs", F.col("e.m").alias("told")))
    if many:
        dense.unpersist()
    found = (told_by(total, "total"), told, k, converged)
    return (*found, seen) if history else found


def loopy(variables: DataFrame, factors: DataFrame, **how) -> DataFrame:
    """variable, belief by loopy belief propagation."""
    return run(variables, factors, **how)[0]


def tree_reweighted(variables: DataFrame, factors: DataFrame, most_rounds: int = 200, threshold: float = 1e-8, **how) -> DataFrame:
    """variable, belief by tree-reweighted belief propagation with uniform weights."""
    from credograph.operators.lowering import tree_weights

    rho = cut(tree_weights(factor_graph.incidences(factors), variables.filter("hard is not null")))
    return run(variables, factors, most_rounds=most_rounds, threshold=threshold, reweighted=True, rho=rho, **how)[0]


def pseudo_joints(told: DataFrame) -> DataFrame:
    """factor, vars, assignment, p: a factor's table times what its variables last told it."""
    mass = _massed(told)
    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    return mass.select("factor", "vars", total.alias("total"), F.posexplode("mass").alias("assignment", "w")).select("factor", "vars", "assignment", (F.col("w") / F.col("total")).alias("p"))


def direction_changes(seen: DataFrame) -> DataFrame:
    """variable, n_changes: how often its belief (variable, round, belief) turned round."""
    from pyspark.sql import Window

    own = Window.partitionBy("variable").orderBy("round")
    step = seen.select("variable", "round", (F.col("belief") - F.lag("belief").over(own)).alias("d")).filter("d != 0")
    turned = step.select("variable", (F.col("d") * F.lag("d").over(own) < 0).cast("long").alias("t"))
    return turned.groupBy("variable").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_changes"))
