"""Mean field by coordinate ascent, and the bound it raises.

The original updates one variable after another. Variables that share no factor don't see each
other's updates, so they can go together: variables get classes so that neighbours never share one,
and a sweep updates class after class. This is a sequential order too, only another one; a sweep
takes as many joins as there are classes, whatever the size of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credograph.functions.potentials import EPSILON, logit, sigmoid
from credograph.operators import factor_graph
from credograph.sources.folders import apart, cut

#: How far beliefs and potentials stay from 0.
BOUND, FLOOR = 1e-6, 1e-10


def _held(p: Column) -> Column:
    return F.greatest(F.lit(BOUND), F.least(F.lit(1 - BOUND), p))


def classes(factors: DataFrame) -> DataFrame:
    """variable, class: numbers from 0 so that variables of one factor differ. In each round those
    that come first among their open neighbours (by hash) take the round's number."""
    ends = factor_graph.incidences(factors)
    pairs = cut(apart(ends).join(ends.select("factor", F.col("variable").alias("other")), "factor").filter("variable != other").select("variable", "other").distinct())
    open_ones, done, k = cut(ends.select("variable").distinct()), None, 0
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while not open_ones.isEmpty():
        near = apart(pairs).join(open_ones, "variable").join(apart(open_ones).withColumnRenamed("variable", "other"), "other")
        behind = near.filter(rank("other") < rank("variable")).select("variable").distinct()
        first = cut(apart(open_ones).join(behind, "variable", "left_anti").withColumn("class", F.lit(k)))
        done = first if done is None else done.unionByName(first)
        open_ones, k = cut(apart(open_ones).join(first, "variable", "left_anti")), k + 1
    return done if done is not None else open_ones.withColumn("class", F.lit(0))


def _start(variables: DataFrame) -> DataFrame:
    first = F.when(F.col("hard") == 1, 1 - EPSILON).when(F.col("hard") == 0, EPSILON).otherwise(F.coalesce("prior", F.lit(0.5)))
    base = F.when(F.col("hard").isNull() & F.col("prior").isNotNull(), logit(_held(F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col("prior"))))))
    return variables.select("variable", F.col("hard").isNotNull().alias("fixed"), F.coalesce(base, F.lit(0.0)).alias("base"), _held(first).alias("mu"))


def _cells(factors: DataFrame) -> DataFrame:
    """factor, vars, x, log: a row for each assignment of each factor."""
    dense = factor_graph.tables(factors, 0.0, 1.0)
    return dense.select("factor", "vars", F.posexplode("pots").alias("x", "pot")).select("factor", "vars", "x", F.log(F.greatest("pot", F.lit(FLOOR))).alias("log"))


def _weighted(cells: DataFrame, mu: DataFrame) -> DataFrame:
    """factor, x, vars, log, and ``q``: the chance of each variable's value in the assignment."""
    ends = cells.select("factor", "vars").distinct().select("factor", F.posexplode("vars").alias("pos", "variable")).join(apart(mu).select("variable", "mu"), "variable")
    held = ends.groupBy("factor").agg(F.sort_array(F.collect_list(F.struct("pos", "mu"))).alias("m"))
    bit = lambda i: F.call_function("shiftright", F.col("x"), i).bitwiseAND(1) == 1
    return apart(cells).join(held, "factor").withColumn("q", F.transform("m", lambda v: F.when(bit(v["pos"]), v["mu"]).otherwise(1 - v["mu"])))


def run(variables: DataFrame, factors: DataFrame, most_sweeps: int = 500, threshold: float = 1e-6) -> tuple[DataFrame, int, bool]:
    """(variable and belief; sweeps; converged)."""
    state, cells = cut(_start(variables)), cut(_cells(factors))
    turn = cut(classes(factors))
    count = (turn.agg(F.max("class")).first()[0] or 0) + 1 if not turn.isEmpty() else 0
    converged, sweep = count == 0, 0
    while not converged and sweep < most_sweeps:
        before = state
        for k in range(count):
            rows = _weighted(cells, state).select("x", "log", "q", F.posexplode("vars").alias("pos", "variable")).join(apart(turn).filter(F.col("class") == k).select("variable"), "variable")
            others = F.aggregate(F.filter("q", lambda v, i: i != F.col("pos")), F.lit(1.0), lambda a, v: a * v)
            sign = F.when(F.call_function("shiftright", F.col("x"), F.col("pos")).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
            pull = rows.groupBy("variable").agg(F.sum(sign * others * F.col("log")).alias("pull"))
            new = F.when(F.col("fixed") | F.col("pull").isNull(), F.col("mu")).otherwise(_held(sigmoid(F.col("base") + F.col("pull"))))
            state = cut(apart(state).join(pull, "variable", "left").select("variable", "fixed", "base", new.alias("mu")), sweep * count + k)
        sweep += 1
        moved = apart(state).join(before.select("variable", F.col("mu").alias("old")), "variable").agg(F.max(F.abs(F.col("mu") - F.col("old")))).first()[0]
        converged = moved is None or moved < threshold
    return state.select("variable", F.col("mu").alias("belief")), sweep, converged


def bound(variables: DataFrame, factors: DataFrame, beliefs: DataFrame) -> float:
    """The evidence lower bound at ``beliefs``; impossible assignments count nothing."""
    mu = beliefs.withColumnRenamed("belief", "mu")
    cells = _cells(factors).filter(F.col("log") > F.log(F.lit(FLOOR)) + 1e-9)
    expected = _weighted(cells, mu).agg(F.sum(F.aggregate("q", F.lit(1.0), lambda a, v: a * v) * F.col("log"))).first()[0] or 0.0
    m = _held(F.col("mu"))
    own = variables.join(mu, "variable").select("mu", F.when(F.col("hard").isNull(), _held(F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col("prior"))))).alias("p"), "prior")
    alone = F.when(F.col("prior").isNotNull() & F.col("p").isNotNull(), F.col("mu") * F.log("p") + (1 - F.col("mu")) * F.log(1 - F.col("p"))).otherwise(0.0)
    return expected + (own.agg(F.sum(alone - m * F.log(m) - (1 - m) * F.log(1 - m))).first()[0] or 0.0)
