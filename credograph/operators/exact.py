"""Exact posteriors by enumeration, each connected component of the factor graph on its own.

Components are found by Spark. A component of n variables has 2^n states; its states are dealt out
in blocks, so neither a component's states nor two components need to meet in one task. Weights are
added up in buckets of their size, in one pass and without a first one for the largest weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credograph.operators import factor_graph, graph
from credograph.sources.folders import apart, cut

MOST_VARIABLES = 26
_BUCKET = 256.0
_BLOCK = 12


def components(variables: DataFrame, factors: DataFrame) -> DataFrame:
    """variable, component, slot (its place in the component, by name)."""
    from pyspark.sql import Window

    each = factor_graph.incidences(factors)
    first = each.groupBy("factor").agg(F.min("variable").alias("parent"))
    edges = each.join(apart(first), "factor").filter("variable != parent").select(F.col("variable").alias("child"), "parent").distinct()
    joined = graph.components(edges).select(F.col("node").alias("variable"), "component")
    own = variables.select("variable").join(apart(joined), "variable", "left").select("variable", F.coalesce("component", "variable").alias("component"))
    size = own.groupBy("component").agg(F.count("*").alias("n"))
    too_large = F.raise_error(F.lit(f"a component of more than {MOST_VARIABLES} variables; use junction_tree or message_passing")).cast("bigint")
    sized = own.join(apart(size).select("component", F.when(F.col("n") <= MOST_VARIABLES, F.col("n")).otherwise(too_large).alias("n")), "component")
    return sized.withColumn("slot", F.row_number().over(Window.partitionBy("component").orderBy("variable")) - 1)


def states(variables: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """component, n, state, w (log weight of each assignment: slot i is bit i); and the slots."""
    slots = cut(components(variables, factors))
    base = factor_graph.unary(variables).join(apart(slots), "variable").groupBy("component", "n").agg(F.sort_array(F.collect_list(F.struct("slot", "base"))).alias("b"))
    dense = factor_graph.tables(factors).select("factor", "vars", F.transform("pots", lambda p: F.log(p)).alias("logs"))
    placed = dense.select("factor", F.posexplode("vars").alias("pos", "variable")).join(apart(slots), "variable")
    scoped = placed.groupBy("factor", "component").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "slot"))), lambda x: x["slot"]).alias("at")).join(apart(dense).select("factor", "logs"), "factor")
    held = apart(base).join(scoped.groupBy("component").agg(F.collect_list(F.struct("at", "logs")).alias("f")), "component", "left")
    # a row for each block of 2^12 states carries its component's factors; states are made within it
    low, high = F.least("n", F.lit(_BLOCK)).cast("int"), F.greatest(F.col("n") - _BLOCK, F.lit(0)).cast("int")
    two = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    blocks = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), two(high) - 1)).alias("block"), two(low).alias("wide")).repartition("component", "block")
    each = blocks.select("component", "n", "b", "f", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("wide") - 1), lambda i: i + F.col("block") * F.col("wide"))).alias("state"))
    bit = lambda i: F.call_function("shiftright", F.col("state"), i).bitwiseAND(1)
    index = lambda at: F.aggregate(F.transform(at, lambda s, j: F.call_function("shiftleft", bit(s), j)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    alone = F.aggregate("b", F.lit(0.0), lambda a, x: a + bit(x["slot"]) * x["base"])
    together = F.aggregate(F.coalesce("f", F.expr("cast(array() as array<struct<at:array<int>,logs:array<double>>>)")), F.lit(0.0), lambda a, f: a + F.get(f["logs"], index(f["at"]).cast("int")))
    return each.select("component", "n", "state", (alone + together).alias("w")), slots


def _mass(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums of exp(w), as multiples of exp of the largest bucket of each key."""
    bucket = F.ceil(F.col("w") / _BUCKET)
    e = F.exp(F.col("w") - bucket * _BUCKET)
    parts = rows.withColumn("bucket", bucket).withColumn("e", e).groupBy(*keys, "bucket").agg(*[F.sum(c * F.col("e")).alias(k) for k, c in sums.items()])
    tops = parts.groupBy(*keys).agg(F.max(F.when(F.greatest(*[F.col(k) for k in sums], F.lit(0.0)) > 0, F.col("bucket"))).alias("top"))
    scale = F.exp((F.col("bucket") - F.col("top")) * _BUCKET)
    return parts.join(apart(tops), keys).groupBy(*keys, "top").agg(*[F.sum(F.col(k) * scale).alias(k) for k in sums])


def marginals(variables: DataFrame, factors: DataFrame) -> DataFrame:
    """variable, belief, and log_z of its component."""
    every, slots = states(variables, factors)
    widest = slots.agg(F.max("n")).first()[0] or 0
    sums = {"z": F.lit(1.0)} | {f"s{i}": F.shiftright("state", i).bitwiseAND(1) for i in range(widest)}
    total = _mass(every, ["component"], sums)
    shares = F.array(*[F.col(f"s{i}") / F.col("z") for i in range(widest)]) if widest else F.array().cast("array<double>")
    # a unary factor is kept as log odds; its own share of log Z is added per variable
    p = F.when(F.col("hard").isNotNull(), F.lit(0.999)).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("prior"))))
    zero = variables.join(apart(slots), "variable").groupBy("component").agg(F.sum(F.when(F.coalesce(F.col("hard"), F.lit(0)) == 1, F.log(F.lit(0.001))).when(F.col("hard").isNotNull(), F.log(F.lit(0.999))).when(F.col("prior").isNotNull(), F.log(1 - p)).otherwise(0.0)).alias("zero"))
    found = total.select("component", shares.alias("share"), (F.log("z") + F.col("top") * _BUCKET).alias("log_z")).join(apart(zero), "component")
    return apart(slots).join(found, "component").select("variable", F.get("share", F.col("slot")).alias("belief"), (F.col("log_z") + F.col("zero")).alias("log_z"))


def joint(variables: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """assignment (bit i: names[i]) and p. Components without a name are left out; those with
    some are joined, as they don't depend on each other."""
    every, slots = states(variables, factors)
    wanted = slots.filter(F.col("variable").isin(names)).select("component", "slot", "variable").collect()  # as many as names
    missing = set(names) - {r.variable for r in wanted}
    if missing:
        raise KeyError(f"unknown variables: {sorted(missing)}")
    out = None
    for c in sorted({r.component for r in wanted}):
        own = [(names.index(r.variable), r.slot) for r in wanted if r.component == c]
        bits = F.lit(0).cast("bigint")
        for k, slot in own:
            bits = bits + F.shiftleft(F.shiftright("state", slot).bitwiseAND(1), k)
        part = _mass(every.filter(F.col("component") == c).withColumn("assignment", bits), ["assignment"], {"z": F.lit(1.0)})
        top = part.agg(F.max("top")).first()[0]
        part = part.select("assignment", (F.col("z") * F.exp((F.col("top") - F.lit(top)) * _BUCKET)).alias("z"))
        total = part.agg(F.sum("z")).first()[0]
        part = part.select("assignment", (F.col("z") / total).alias("p"))
        out = part if out is None else out.crossJoin(part.select(F.col("assignment").alias("a2"), F.col("p").alias("p2"))).select((F.col("assignment") + F.col("a2")).alias("assignment"), (F.col("p") * F.col("p2")).alias("p"))
    return out
