"""Small things whose order or count has to be defined."""

import itertools

from credograph.operators import factor_graph, lowering_graph, message_passing
from tests.core.test_beliefs import FACTORS, VARIABLES


def test_repeated_told_priors_and_strategies_have_an_order(spark):
    claims = spark.createDataFrame([("a", "a", False, None), ("h", "__h", False, None)], "id string, label string, helper boolean, prior double")
    rows = [("a", 0.2, 1), ("a", 0.9, 2), ("a", 0.5, 2), ("h", 0.4, 1)]
    for order in itertools.permutations(rows, 4):
        told = lowering_graph.told_priors(claims, spark.createDataFrame(list(order), "id string, prior double, pos int").coalesce(1)).collect()
        assert [(r.id, r.told) for r in told] == [("a", 0.9)]
        if order[0][0] == "h":
            break
    strategies = [("s", "infer", "late", None, 2), ("s", "infer", "first", None, 1), ("t", "infer", "x", None, 1)]
    for order in (strategies, strategies[::-1]):
        frame = spark.createDataFrame(order, "strategy_id string, type string, conclusion string, sub_strategies array<string>, pos int").coalesce(1)
        assert sorted((r.strategy_id, r.conclusion) for r in lowering_graph.expand(frame).collect()) == [("s", "first"), ("t", "x")]


def test_direction_changes(spark):
    seen = [("v", k, b) for k, b in enumerate((0.1, 0.3, 0.2, 0.2, 0.4))] + [("w", 0, 0.5), ("w", 1, 0.6)] + [("u", 0, 0.5)]
    got = {r.variable: r.n_changes for r in message_passing.direction_changes(spark.createDataFrame(seen, "variable string, round int, belief double")).collect()}
    assert got == {"v": 2, "w": 0}


def test_summary(spark):
    variables = spark.createDataFrame([("a", 0.2, None), ("b", None, 1), ("c", None, None), ("d", 0.3, None)], VARIABLES)
    factors = spark.createDataFrame([("f", "negation", ["a"], "b", None, None, None), ("g", "negation", ["a"], "c", None, None, None)], FACTORS)
    got = {(r.part, r.kind): r.n for r in factor_graph.summary(variables, factors).collect()}
    assert got == {("variable", "prior"): 2, ("variable", "observed"): 1, ("variable", "free"): 1, ("factor", "negation"): 2}
