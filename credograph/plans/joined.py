"""Queries on joints, counts of assignments, largest entropy, and approximate methods, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credograph.operators import feasibility, joints, mean_field, message_passing
from credograph.plans import beliefs, modeling
from credograph.plans.checks import _name
from credograph.sources import tables as T


def joint_methods(spark, sf_dir):
    """Two nations, which share no factor, by three methods."""
    found = joints.compared(*beliefs.regions(spark, sf_dir), ["n0", "n5"], ("exact", "junction_tree", "trw"))
    return found.withColumn("p", F.round("p", 6))


def joint_entropy(spark, sf_dir):
    found = joints.entropy(joints.by_elimination(*beliefs.regions(spark, sf_dir), ["n0", "n5"]))
    return found.select(F.round("bits", 5).alias("bits"), F.round("effective_states", 5).alias("effective_states"))


def feasible_assignments(spark, sf_dir):
    """How many ways a nation's suppliers can be right, if of two neighbours by key one isn't, and the
    first implies the last. A nation with one supplier has one free claim."""
    s = T.table(spark, sf_dir, "supplier")
    from pyspark.sql import Window

    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = s.select("s_nationkey", "s_suppkey", F.lead("s_suppkey").over(order).alias("next"), F.row_number().over(order).alias("i"), F.last("s_suppkey").over(whole).alias("last"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("p1", "double"), ("p2", "double"), ("weights", "array<double>"))]
    group = F.col("s_nationkey").alias("group")
    factor = lambda rows, name, kind, other: rows.select(group, _name(name, "s_suppkey").alias("factor"), F.lit(kind).alias("kind"), F.array(_name("s", "s_suppkey"), _name("s", other)).alias("inputs"), _name(f"h{name}", "s_suppkey").alias("conclusion"), *none)
    factors = factor(own.filter("next is not null"), "x", "contradiction", "next").unionByName(factor(own.filter("i = 1 and last != s_suppkey"), "y", "implication", "last"))
    found = feasibility.feasible(factors, s.select(group, _name("s", "s_suppkey").alias("variable")))
    return found.select(F.col("group").alias("nation"), "n_claims", F.round("bits", 6).alias("bits"))


def largest_entropy(spark, sf_dir):
    """Per part, the joint of two claims with both conditionals, and of a third with a chance alone."""
    p = modeling._pairs(spark, sf_dir).select("p_partkey", "ab", "ba")
    row = lambda claim, given, v: F.struct(F.lit(claim).alias("claim"), F.lit(given).cast("string").alias("given"), v.alias("value"))
    told = p.select(F.col("p_partkey").alias("group"), F.inline(F.array(row("a", "b", F.col("ab")), row("b", "a", F.col("ba")), row("c", None, F.lit(0.3)))))
    found = feasibility.largest_entropy(told)
    return found.select(F.col("group").alias("p_partkey"), F.array_join("claims", ",").alias("claims"), *[F.round(F.col("cells")[i], 6).alias(f"p{i}") for i in range(8)], "converged")


def reweighted_beliefs(spark, sf_dir):
    """Tree-reweighted propagation on a forest, where it is exact."""
    found = message_passing.tree_reweighted(*beliefs.regions(spark, sf_dir), threshold=1e-10)
    return found.select("variable", F.round("belief", 5).alias("belief"))


def mean_field_beliefs(spark, sf_dir):
    """Each supplier's claim and its customer's, tied by one factor."""
    s = T.table(spark, sf_dir, "supplier")
    share = F.round((F.col("s_acctbal") + 1000) / 11000 * 0.4 + 0.55, 6)
    a, b = _name("a", "s_suppkey"), _name("b", "s_suppkey")
    variables = s.select(F.inline(F.array(F.struct(a.alias("variable"), F.lit(0.3).alias("prior")), F.struct(b.alias("variable"), F.lit(0.6).alias("prior"))))).withColumn("hard", F.lit(None).cast("int"))
    factors = s.select(_name("f", "s_suppkey").alias("factor"), F.lit("soft_entailment").alias("kind"), F.array(a).alias("inputs"), b.alias("conclusion"), share.alias("p1"), F.lit(0.8).alias("p2"), F.lit(None).cast("array<double>").alias("weights"))
    found, _, _ = mean_field.run(variables, factors, threshold=1e-9)
    return found.select("variable", F.round("belief", 5).alias("belief"))


_PAIR = beliefs._REGIONS + """, o AS (SELECT *, p * 0.9 / m1 AS f1, p * 0.1 / m0 AS f0 FROM m JOIN w USING (r)),
j AS (SELECT x + 2 * y AS assignment, CASE WHEN a.r = b.r THEN a.q * CASE WHEN x = 1 THEN a.f1 ELSE 1 - a.f1 END * CASE WHEN y = 1 THEN b.f1 ELSE 1 - b.f1 END + (1 - a.q) * CASE WHEN x = 1 THEN a.f0 ELSE 1 - a.f0 END * CASE WHEN y = 1 THEN b.f0 ELSE 1 - b.f0 END
  ELSE (a.q * CASE WHEN x = 1 THEN a.f1 ELSE 1 - a.f1 END + (1 - a.q) * CASE WHEN x = 1 THEN a.f0 ELSE 1 - a.f0 END) * (b.q * CASE WHEN y = 1 THEN b.f1 ELSE 1 - b.f1 END + (1 - b.q) * CASE WHEN y = 1 THEN b.f0 ELSE 1 - b.f0 END) END AS p
  FROM o a, o b, range(2) s(x), range(2) t(y) WHERE a.n = 'n0' AND b.n = 'n5')"""
_S = "(SELECT s_suppkey AS k, round((s_acctbal + 1000)::double / 11000 * 0.4::double + 0.55::double, 6) AS q FROM supplier)"

SQL: dict[str, str] = {
    "joint_methods": _PAIR + """ SELECT 'exact' AS method, assignment::int AS assignment, round(p, 6) AS p, 'exact_joint_distribution' AS basis, NULL::varchar AS problem FROM j
UNION ALL SELECT 'junction_tree', assignment::int, round(p, 6), 'calibrated_clique_marginal', NULL FROM j UNION ALL SELECT 'trw', NULL, NULL, NULL, 'no factor holds all names'""",
    "joint_entropy": _PAIR + " SELECT round(-sum(p * log2(p)), 5) AS bits, round(pow(2, -sum(p * log2(p))), 5) AS effective_states FROM j",
    "feasible_assignments": """WITH RECURSIVE s AS (SELECT s_nationkey AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
w(g, i, n, first, last, ways) AS (SELECT g, i, n, x, x, 1.0::double FROM s, range(2) t(x) WHERE i = 1
  UNION ALL SELECT g, i + 1, n, first, x, sum(ways) FROM w, range(2) t(x) WHERE i < n AND NOT (last = 1 AND x = 1) GROUP BY g, i, n, first, x)
SELECT g AS nation, n AS n_claims, round(log2(sum(ways)), 6) AS bits FROM w WHERE i = n AND (n = 1 OR first = 0 OR last = 1) GROUP BY g, n""",
    "largest_entropy": f"""SELECT p_partkey, 'a,b,c' AS claims, {", ".join(f"round({('s', 'u', 'v', '1')[i % 4]} / z * {0.7 if i < 4 else 0.3}::double, 6) AS p{i}" for i in range(8))}, true AS converged FROM (SELECT *, 1 + u + v + s AS z FROM ({modeling._MAXENT.format(modeling._PAIRS)}))""",
    "reweighted_beliefs": beliefs.SQL["exact_posterior"],
    "mean_field_beliefs": f"""WITH RECURSIVE w(k, q, a, b, i) AS (SELECT k, q, 0.3::double, 0.6::double, 0 FROM {_S} UNION ALL
  SELECT k, q, a2, 1 / (1 + exp(-(ln(0.6) - ln(0.4) + a2 * (ln(q) - ln(1 - q)) + (1 - a2) * (ln(0.2) - ln(0.8))))), i + 1 FROM (
    SELECT *, 1 / (1 + exp(-(ln(0.3) - ln(0.7) + b * (ln(q) - ln(0.2)) + (1 - b) * (ln(1 - q) - ln(0.8))))) AS a2 FROM w WHERE i < 200))
SELECT 'a' || k AS variable, round(a, 5) AS belief FROM w WHERE i = 200 UNION ALL SELECT 'b' || k, round(b, 5) FROM w WHERE i = 200""",
}
ROWS_ONLY = ()
