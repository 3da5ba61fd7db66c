import itertools
import math
import random

import pandas as pd
import pytest

from credograph.operators import coarsen, graph
from tests.core.test_beliefs import FACTORS, VARIABLES, loops, value

EDGES = "child string, parent string"


def closure(edges):
    reach = {}
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            for x, y in edges:
                if x == todo[0] and y not in seen:
                    seen.add(y)
                    todo.append(y)
            todo.pop(0)
        reach[a] = seen
    return reach


def test_strong_components_equal_mutual_reach(spark):
    rnd = random.Random(2)
    edges = []
    for g in range(12):
        n = rnd.randint(2, 9)
        edges += [(f"g{g}-{rnd.randrange(n)}", f"g{g}-{rnd.randrange(n)}") for _ in range(rnd.randint(1, 2 * n))]
    edges += [(f"ring{i}", f"ring{(i + 1) % 12}") for i in range(12)] + [("ring3", "tail"), ("head", "ring5"), ("self", "self"), (None, "x"), ("x", None)]
    known = [e for e in edges if None not in e]
    reach = closure(known)
    nodes = {x for e in known for x in e}
    want = {v: min([v, *(u for u in nodes if u in reach.get(v, ()) and v in reach.get(u, ()))]) for v in nodes}
    frame = spark.createDataFrame(edges, EDGES)
    assert dict(map(tuple, graph.strong_components(frame).collect())) == want
    assert {r.node for r in graph.cycles(frame).collect()} == {v for v in nodes if v in reach.get(v, ())}
    assert graph.strong_components(frame.limit(0)).count() == 0


def test_surrogates_of_rings(spark):
    edges, exports, want = [], [], set()
    for n in (1, 2, 3, 7):
        edges += [(f"r{n}-{i}", f"r{n}-{(i + 1) % n}") for i in range(n)] + [(f"r{n}-0", f"x{n}"), (f"x{n}", f"y{n}")]
        exports += [f"x{n}", f"y{n}"]
        want |= {(f"r{n}-{1 % n}", f"x{n}"), (f"x{n}", f"y{n}")}
    # an export on a ring supports itself: no surrogate; two rings in a row: the first one's
    edges += [("e", "f"), ("f", "e"), ("a1", "a2"), ("a2", "a1"), ("a2", "b1"), ("b1", "b2"), ("b2", "b1"), ("b2", "z"), ("leaf", "w")]
    exports += ["e", "z", "w"]
    want |= {("a1", "z"), ("leaf", "w")}
    got = coarsen.coarse(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(x,) for x in exports], "node string"))
    assert {tuple(r) for r in got.collect()} == want


def test_helpers_are_no_surrogates(spark):
    edges = spark.createDataFrame([("c", "h"), ("h", "c"), ("c", "x")], EDGES)
    exports, helpers = spark.createDataFrame([("x",)], "node string"), spark.createDataFrame([("h",)], "node string")
    assert [tuple(r) for r in coarsen.coarse(edges, exports, helpers).collect()] == [("c", "x")]


def chances(variables, factors, premises, conclusion):
    """By all assignments."""
    names = [v for v, _, _ in variables]
    cells = [[0.0, 0.0] for _ in range(1 << len(premises))]
    for bits in itertools.product((0, 1), repeat=len(names)):
        x, w = dict(zip(names, bits)), 1.0
        for v, prior, _ in variables:
            if prior is not None and v not in premises and v != conclusion:
                p = min(max(prior, 0.001), 0.999)
                w *= p if x[v] else 1 - p
        w *= math.prod(value(f, x) for f in factors)
        cells[sum(x[p] << i for i, p in enumerate(premises))][x[conclusion]] += w
    return [b / (a + b) for a, b in cells]


def test_contraction_equals_enumeration_for_targets_that_share_a_graph(spark):
    for seed in range(2):
        variables, factors = loops(seed, 8)
        targets = [(1, ["v0", "v3"], "v5"), (2, ["v5"], "v0"), (3, ["v1", "v2", "v4"], "v7"), (4, [], "v6")]
        frame = coarsen.contract(spark.createDataFrame(variables, VARIABLES), spark.createDataFrame(factors, FACTORS), spark.createDataFrame(targets, "target int, premises array<string>, conclusion string"))
        got = {r.target: r.weights for r in frame.collect()}
        for t, premises, conclusion in targets:
            assert got[t] == pytest.approx(chances(variables, factors, premises, conclusion), abs=1e-9)


def test_contraction_of_what_is_not_connected(spark):
    variables = spark.createDataFrame([("a", 0.2, None), ("b", None, None), ("c", 0.3, None)], VARIABLES)
    factors = spark.createDataFrame([("f", "soft_entailment", ["c"], "b", 0.9, 0.8, None)], FACTORS)
    targets = spark.createDataFrame([(1, ["a"], "b"), (2, ["b"], "a"), (3, ["c", "c"], "b")], "target int, premises array<string>, conclusion string")
    got = {r.target: [round(x, 9) for x in r.weights] for r in coarsen.contract(variables, factors, targets).collect()}
    assert got == {1: [round(0.3 * 0.9 + 0.7 * 0.2, 9)] * 2, 2: [0.5, 0.5], 3: [0.2, 0.9, 0.2, 0.9]}
    with pytest.raises(Exception, match="own premise"):
        coarsen.contract(variables, factors, spark.createDataFrame([(1, ["b"], "b")], "target int, premises array<string>, conclusion string")).collect()


def test_deep_parts_are_contracted_without_rounds(spark, monkeypatch):
    from credograph.operators import junction_tree

    rounds, plain = [], junction_tree._round
    monkeypatch.setattr(junction_tree, "_round", lambda *a, **k: rounds.append(plain(*a, **k)) or rounds[-1])
    n = 10
    variables = [(f"v{i}", 0.3 if i % 3 == 0 else None, None) for i in range(n + 1)]
    factors = [(f"f{i}", "soft_entailment", [f"v{i}"], f"v{i + 1}", 0.9, 0.7, None) for i in range(n)]
    targets = spark.createDataFrame([(1, ["v0"], f"v{n}")], "target int, premises array<string>, conclusion string")
    got = coarsen.contract(spark.createDataFrame(variables, VARIABLES), spark.createDataFrame(factors, FACTORS), targets).first()
    assert got.weights == pytest.approx(chances(variables, factors, ["v0"], f"v{n}"), abs=1e-9)
    assert rounds == [None, None]


def test_cycles_are_sought_among_what_reaches_an_unreached_export(spark, monkeypatch):
    """Here the ring before x; the export y has a leaf, and the cycle after it reaches no orphan."""
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r0", "x"), ("x", "y"), ("l", "y"), ("y", "c0"), ("c0", "c1"), ("c1", "c0"), ("o", "o")]
    seen, own = [], graph.strong_components
    monkeypatch.setattr(graph, "strong_components", lambda edges: seen.append({(r.child, r.parent) for r in edges.collect()}) or own(edges))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = {tuple(r) for r in coarsen.coarse(frame(ring, "child string, parent string"), frame([("x",), ("y",), ("o",)], "node string")).collect()}
    assert got == {("r1", "x"), ("x", "y"), ("l", "y")}
    assert seen and all(edges <= {*ring[:4], ("o", "o")} for edges in seen)


def test_batches_to_and_from_python_are_bounded(spark):
    """A worker's memory followed the rows of its task: ten thousand parts came at once, and small tables went back by their numbers alone."""
    from credograph.operators import junction_tree

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    targets = spark.createDataFrame([(1, ["a"], "b")], "target int, premises array<string>, conclusion string")
    factors = spark.createDataFrame([("f", "soft_entailment", ["a"], "b", 0.9, 0.8, None)], FACTORS)
    coarsen.contract(spark.createDataFrame([("a", None, None), ("b", None, None)], VARIABLES), factors, targets).collect()

    def rows(frames):
        for frame in frames:
            yield frame.iloc[:1].assign(n=len(frame))[["n"]]

    wide = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 1000) AS x")
    assert wide.mapInPandas(rows, "n int").agg({"n": "max"}).first()[0] * 1000 < 5 << 20
    sent = [len(frame) for frame in junction_tree.chunks(((i, ["v"], [0.0, 1.0]) for i in range(50_000)), ["part", "vars", "logs"], 2)]
    assert sum(sent) == 50_000 and max(sent) < 20_000
    made = [{"target": i, "premises": [], "conclusion": "b", "f": None} for i in range(100)]
    assert [len(frame) for frame in coarsen._chances(iter([pd.DataFrame(made)]))] == [100]
