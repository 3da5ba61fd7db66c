"""How many assignments of claims a theory of deterministic operators leaves, and the joint of largest
entropy under given chances.

Counting runs on elimination: a claim that isn't counted takes whichever value fits, so its table keeps
the better of the two; counted claims are summed. Numbers are kept as logarithms, so a count may be
any power of two. Many groups are counted at once, each with its own copy of the claims' names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from credograph.operators import factor_graph, junction_tree

#: Fixed value: operators whose conclusion says that they hold.
RELATIONS = ("implication", "equivalence", "contradiction", "complement")
#: The logarithm that stands for impossible; sums of a million of them still do.
_NEVER = -1e6


def feasible(factors: DataFrame, claims: DataFrame, most: int = junction_tree.WIDEST) -> DataFrame:
    """group, n_claims, bits (log2 of the number of assignments that some assignment of all else
    fits; null if there is none), share of all assignments. ``factors``: group and the columns of a factor graph, deterministic kinds
    only; ``claims``: group, variable to be counted. A relation's conclusion holds; another's equals
    its operator. A counted claim in no operator is free; repeated claims count once."""
    counted = claims.filter("variable is not null").select(F.col("group"), "variable").distinct()
    sizes = claims.select("group").distinct().join(counted.groupBy("group").agg(F.count("*").alias("n_claims")), "group", "left").fillna(0, ["n_claims"])
    mark = F.md5(F.col("group").cast("string"))
    within = lambda v: F.concat(mark, F.lit(":"), v)
    asked = factors.join(sizes.select("group"), "group", "left_semi")
    named = asked.select("group", within(F.col("factor")).alias("factor"), "kind", F.transform("inputs", within).alias("inputs"), within(F.col("conclusion")).alias("conclusion"), "p1", "p2", "weights")
    deterministic = F.when(F.col("kind").isin("soft_entailment", "conditional", "pairwise"), F.raise_error(F.lit("only deterministic operators can be counted")).cast("string")).otherwise(F.col("kind"))
    named = named.withColumn("kind", deterministic)
    dense = factor_graph.tables(named.drop("group"), 0.0, 1.0)
    place = lambda v: (F.array_position(F.array_sort("vars"), v) - 1).cast("int")
    cells = dense.select("vars", F.posexplode("pots").alias("x", "p"))
    moved = F.transform("vars", lambda v, j: F.call_function("shiftleft", F.call_function("shiftright", F.col("x"), j).bitwiseAND(1), place(v)))
    turned = cells.select(F.array_sort("vars").alias("vars"), F.aggregate(moved, F.lit(0), lambda a, b: a + b).alias("x"), F.when(F.col("p") > 0, 0.0).otherwise(_NEVER).alias("w"))
    logs = turned.groupBy("vars", "x").agg(F.sum("w").alias("w")).groupBy("vars").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("c")).select("vars", F.col("c.w").alias("logs"))
    holds = named.filter(F.col("kind").isin(*RELATIONS)).select(F.array("conclusion").alias("vars"), F.array(F.lit(_NEVER), F.lit(0.0)).alias("logs")).distinct()
    free = counted.select(F.array(within(F.col("variable"))).alias("vars"), F.array(F.lit(0.0), F.lit(0.0)).alias("logs"))
    kept = counted.select(within(F.col("variable")).alias("variable"))
    mark_of = lambda c: F.substring(c, 1, 32)

    def summed(rows: DataFrame) -> DataFrame:
        """mark, log_total of the connected parts: what tasks sum of a group, and the rest in rounds."""
        own = junction_tree.within(rows.select(mark_of(F.col("vars")[0]).alias("part"), "vars", "logs"), most=most)
        rest = junction_tree.totals(own.filter(F.size("vars") > 0).select("vars", "logs"), most)
        return own.filter(F.size("vars") == 0).select(F.col("part").alias("mark"), F.col("logs")[0].alias("log_total")).unionByName(rest.select(mark_of("variable").alias("mark"), "log_total"))

    every = logs.unionByName(holds).unionByName(free)
    own = junction_tree.within(every.select(mark_of(F.col("vars")[0]).alias("part"), "vars", "logs"), kept.select(mark_of("variable").alias("part"), "variable"), most, largest=True)
    left = junction_tree.reduced(own.filter(F.size("vars") > 0).select("vars", "logs"), kept, most, largest=True)
    sums = summed(left)
    # parts without a counted claim must be possible too
    alone = summed(logs.unionByName(holds)).select("mark", (F.col("log_total") < _NEVER / 2).alias("never"))
    never = alone.groupBy("mark").agg(F.max("never").alias("never"))
    total = sums.groupBy("mark").agg(F.sum("log_total").alias("t"))
    both = sizes.withColumn("mark", mark).join(total, "mark", "left").join(never, "mark", "left")
    fits = ~F.coalesce("never", F.lit(False)) & (F.coalesce("t", F.lit(0.0)) > _NEVER / 2)
    bits = F.when(fits, F.coalesce("t", F.lit(0.0)) / F.log(F.lit(2.0)))
    return both.select("group", F.col("n_claims").cast("long").alias("n_claims"), bits.alias("bits"), F.when(fits, F.pow(F.lit(2.0), bits - F.col("n_claims"))).otherwise(0.0).alias("share"))


#: Claims of a group that has a joint table.
MOST_CLAIMS = 16
#: Cells of the joints that move together in a task.
_CELLS = 1 << 20


def _fitted(frames: Iterator[pd.DataFrame], rounds: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Each constraint in turn moves the table as little as makes it hold; rounds end when none moves."""
    for frame in frames:
        rows, alike = [], {}
        for i, (claims, told) in enumerate(zip(frame["claims"], frame["told"])):
            claims = list(claims)
            shape = (len(claims), *((claims.index(c["claim"]), None if c["given"] is None else claims.index(c["given"])) for c in told))
            alike.setdefault(shape, []).append(i)
        # groups whose rows have the same shape move together; each stops by itself
        for (n, *ends), members in alike.items():
            step = max(1, _CELLS >> n)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                values = np.array([[float(c["value"]) for c in frame["told"].iloc[i]] for i in some]).reshape(len(some), len(ends))
                found = _fit(n, ends, values, rounds, threshold)
                rows += [(frame["group"].iloc[i], list(frame["claims"].iloc[i]), p.tolist(), int(used), bool(gap < threshold), float(gap)) for i, p, used, gap in zip(some, *found)]
        yield pd.DataFrame(rows, columns=["group", "claims", "cells", "rounds", "converged", "gap"])


def _fit(n: int, ends: list[tuple], values: np.ndarray, rounds: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joints, rounds and last moves of groups with the same claims; ``values`` has a row for each group."""
    x = np.arange(1 << n)
    on = [(x >> i & 1).astype(bool) for i in range(n)]
    masks = [(on[a], np.ones(len(x), bool) if b is None else on[b]) for a, b in ends]
    joints, used, gaps = np.full((len(values), len(x)), 1.0 / len(x)), np.zeros(len(values), int), np.zeros(len(values))
    left, p = np.arange(len(values)), joints.copy()
    for k in range(1, rounds + 1):
        moved, told = np.zeros(len(left)), values[left]
        for j, (a, b) in enumerate(masks):
            q = told[:, j]
            yes, no = p[:, a & b].sum(axis=1), p[:, ~a & b].sum(axis=1)
            some = yes + no > 0
            moved = np.where(some, np.maximum(moved, np.abs(yes / np.where(some, yes + no, 1.0) - q)), moved)
            soft = some & (q > 0) & (q < 1) & (yes > 0) & (no > 0)
            step = np.log(np.where(soft, q * no, 1.0) / np.where(soft, (1 - q) * yes, 1.0))[:, None]
            change = np.where(a & b, np.exp(step * (1 - q[:, None])), np.where(b, np.exp(-step * q[:, None]), 1.0))
            sure = (some & ~soft & np.isin(q, (0.0, 1.0)))[:, None]
            p = np.where(soft[:, None], p * change, np.where(sure & b & (a != (q[:, None] >= 1)), 0.0, p))
            total = p.sum(axis=1, keepdims=True)
            p = np.where(some[:, None] & (total > 0), p / np.where(total > 0, total, 1.0), p)
        joints[left], used[left], gaps[left] = p, k, moved
        going = moved >= threshold
        if not going.any():
            break
        left, p = left[going], p[going]
    return joints, used, gaps


def largest_entropy(told: DataFrame, rounds: int = 5000, threshold: float = 1e-10) -> DataFrame:
    """group, claims (in order), cells (bit i: claims[i]), rounds, converged, gap, bits: the joint of
    largest entropy in which every row of ``told`` (group, claim, given, value) holds: the chance of the claim,
    under ``given`` where that isn't null. Without a joint that fits, it doesn't converge and ``gap`` says
    by how much. Groups of more than ``MOST_CLAIMS`` claims raise an error."""
    good = told.filter("group is not null and claim is not null and value is not null").select("group", "claim", "given", F.col("value").cast("double").alias("value"))
    names = good.select("group", F.explode(F.array_compact(F.array("claim", "given"))).alias("v")).distinct().groupBy("group").agg(F.array_sort(F.collect_list("v")).alias("claims"))
    wide = F.when(F.size("claims") <= MOST_CLAIMS, F.col("claims")).otherwise(F.raise_error(F.lit("too many claims for a joint table")).cast("array<string>"))
    rows = good.distinct().groupBy("group").agg(F.array_sort(F.collect_list(F.struct("claim", "given", "value"))).alias("told")).join(names.select("group", wide.alias("claims")), "group")
    kind = told.schema["group"].dataType.simpleString()
    found = rows.select("group", "claims", "told").mapInPandas(lambda frames: _fitted(frames, rounds, threshold), f"`group` {kind}, claims array<string>, cells array<double>, rounds int, converged boolean, gap double")
    return found.withColumn("bits", -F.aggregate("cells", F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0)))
