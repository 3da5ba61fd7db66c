import itertools
import math

import pytest
from pyspark.sql import functions as F

from credograph.functions import potentials
from credograph.operators import exact, graph, message_passing, priors, trace

TRUTH = {
    "implication": lambda a, b: not a or b, "conjunction": lambda a, b: a and b, "disjunction": lambda a, b: a or b,
    "equivalence": lambda a, b: a == b, "contradiction": lambda a, b: not (a and b), "complement": lambda a, b: a != b,
}


@pytest.mark.parametrize("kind", TRUTH)
def test_potentials(spark, kind):
    rows = spark.createDataFrame(list(itertools.product((0, 1), repeat=3)), "a int, b int, c int")
    got = rows.select("a", "b", "c", potentials.potential(kind, [F.col("a"), F.col("b")], F.col("c")).alias("p")).collect()
    assert all(r.p == float(bool(TRUTH[kind](r.a, r.b)) == bool(r.c)) for r in got)


def test_unknown_potential():
    with pytest.raises(ValueError):
        potentials.potential("maybe", [], None)


def test_exact_and_propagated_beliefs_agree_on_a_tree(spark):
    own, links = {"a": 0.3, "b": 0.8, "c": 0.5, "d": 0.6}, (("a", "c", 0.9, 0.7), ("b", "c", 0.8, 0.6), ("c", "d", 0.95, 0.5))
    variables = spark.createDataFrame([(v, p, None) for v, p in own.items()], "variable string, prior double, hard int")
    factors = spark.createDataFrame([(f"{m}>{c}", "soft_entailment", [m], c, p1, p2, None) for m, c, p1, p2 in links], "factor string, kind string, inputs array<string>, conclusion string, p1 double, p2 double, weights array<double>")
    found = {r.variable: r.belief for r in exact.marginals(variables, factors).collect()}
    total, mass = 0.0, dict.fromkeys(own, 0.0)
    for bits in itertools.product((0, 1), repeat=4):
        x = dict(zip(own, bits))
        w = math.prod(p if x[v] else 1 - p for v, p in own.items())
        for m, c, p1, p2 in links:
            p = p1 if x[m] else 1 - p2
            w *= p if x[c] else 1 - p
        total += w
        for v in mass:
            mass[v] += w * x[v]
    assert found == pytest.approx({v: m / total for v, m in mass.items()}, abs=1e-9)
    assert {r.variable: r.belief for r in message_passing.loopy(variables, factors, damping=1.0).collect()} == pytest.approx(found, abs=1e-9)


def test_cycle_and_patterns(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert sorted(r.node for r in graph.cycles(edges).collect()) == ["a", "b", "c"]
    assert [r.node for r in graph.leaves(edges).collect()] == ["d"]
    with pytest.raises(ValueError):
        priors.matches(F.col("x"), "a*b")


def test_broken_links(spark):
    events = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", None)], "trace_id long, seq long, actor string, reason string")
    chain = trace.hash_chain(events).select("trace_id", "seq", "prev_hash")
    good = events.join(chain, ["trace_id", "seq"])
    assert trace.broken_links(good).count() == 0
    assert trace.broken_links(good.withColumn("prev_hash", F.lit("bad"))).count() == 3
