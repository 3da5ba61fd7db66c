import itertools

import math

import pytest
from pyspark.sql import functions as F

from credograph.functions.cumulative import cumulative
from credograph.functions.densities import log_density
from credograph.operators import graph, trace


def test_densities(spark):
    row = spark.range(1).select(
        log_density("binomial", F.lit(295), n=395, p=0.75).alias("b"), log_density("betabinomial", F.lit(295), n=395, alpha=1, beta=1).alias("bb"),
        log_density("exponential", F.lit(-1), rate=2).alias("out"), log_density("poisson", F.lit(1.5), rate=2).alias("half"), log_density("normal", F.lit(None), mu=0, sigma=1).alias("none"),
        cumulative("normal", F.lit(1.0), mu=0, sigma=1).alias("cdf"), cumulative("normal", F.lit(None).cast("double"), mu=0, sigma=1).alias("null_cdf"),
    ).first()
    want = math.lgamma(396) - math.lgamma(296) - math.lgamma(101) + 295 * math.log(0.75) + 100 * math.log(0.25)
    assert row.b == pytest.approx(want, rel=1e-9)
    assert row.bb == pytest.approx(math.log(1 / 396), rel=1e-9)
    assert row.out == row.half == -math.inf and row.none is None and row.null_cdf is None
    assert row.cdf == pytest.approx(0.5 * math.erfc(-1 / math.sqrt(2)))
    with pytest.raises(ValueError):
        log_density("normal", F.lit(1), mu=0)


def test_retry_ring_and_components(spark):
    ring = spark.createDataFrame([("a", "b", "retry"), ("b", "a", "retry")], "event_id string, parent_event_id string, kind string")
    with pytest.raises(RuntimeError):
        trace.retry_chains(ring, 1, 3)
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, "retry" if i % 2 else "x") for i in range(9)], "event_id string, parent_event_id string, kind string")
    assert {r.event_id: r.n_retries for r in trace.retry_chains(chain, 2).collect()} == {"5": 3, "7": 4}
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(1, 8)] + [("x", "y")], "child string, parent string")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {**{str(i): "1" for i in range(1, 9)}, "x": "x", "y": "x"}
    with pytest.raises(Exception, match="too wide"):
        graph.moral_edges(spark.createDataFrame([(1, i) for i in range(5)], "factor int, variable int"), most=4).collect()


def test_moral_edges_take_tasks_by_their_input(spark, monkeypatch):
    monkeypatch.setattr(graph, "_ROWS", 10)
    found = graph.moral_edges(spark.createDataFrame([(i // 4, i % 7) for i in range(200)], "factor int, variable int"))
    assert found.rdd.getNumPartitions() == 20
    assert {tuple(r) for r in found.collect()} == {(a, b) for f in range(50) for a, b in itertools.combinations(sorted({i % 7 for i in range(4 * f, 4 * f + 4)}), 2)}
