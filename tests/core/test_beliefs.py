import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from credograph.functions.potentials import EPSILON
from credograph.operators import exact, factor_graph, junction_tree, message_passing

FACTORS = "factor string, kind string, inputs array<string>, conclusion string, p1 double, p2 double, weights array<double>"
VARIABLES = "variable string, prior double, hard int"


def value(factor, bits, strict=False):
    """A factor's potential by its definition."""
    _, kind, inputs, conclusion, p1, p2, weights = factor
    on, c = [bits[v] for v in inputs], bits[conclusion]
    bound = lambda p: min(max(p, EPSILON), 1 - EPSILON)
    if kind == "soft_entailment":
        p1, p2 = bound(p1), bound(p2)
        return (p1 if c else 1 - p1) if on[0] else (1 - p2 if c else p2)
    if kind == "conditional":
        cell = bound(weights[sum(b << i for i, b in enumerate(on))])
        return cell if c else 1 - cell
    if kind == "pairwise":
        return weights[on[0] | c << 1]
    truth = {
        "conjunction": lambda: all(on), "disjunction": lambda: any(on), "negation": lambda: not on[0], "contradiction": lambda: not all(on),
        "implication": lambda: not on[0] or on[1], "equivalence": lambda: on[0] == on[1], "complement": lambda: on[0] != on[1],
    }[kind]()
    holds = bool(truth) == bool(c)
    return float(holds) if strict else (1 - EPSILON if holds else EPSILON)


def brute(variables, factors, strict=False):
    names = [v for v, _, _ in variables]
    total, on = 0.0, dict.fromkeys(names, 0.0)
    for bits in itertools.product((0, 1), repeat=len(names)):
        x, w = dict(zip(names, bits)), 1.0
        for v, prior, hard in variables:
            if hard is not None or prior is not None:
                p = (1 - EPSILON if hard else EPSILON) if hard is not None else min(max(prior, EPSILON), 1 - EPSILON)
                w *= p if x[v] else 1 - p
        w *= math.prod(value(f, x, strict) for f in factors)
        total += w
        for v in names:
            on[v] += w * x[v]
    return {v: s / total for v, s in on.items()}, math.log(total)


def frames(spark, variables, factors):
    return spark.createDataFrame(variables, VARIABLES), spark.createDataFrame(factors, FACTORS)


def gallery():
    """One small tree for each kind, with priors known, unknown and observed."""
    variables, factors = [], []
    for i, (kind, n, how) in enumerate([("implication", 2, (None, None, None)), ("conjunction", 3, (None, None, None)), ("disjunction", 2, (None, None, None)), ("negation", 1, (None, None, None)), ("equivalence", 2, (None, None, None)), ("contradiction", 2, (None, None, None)), ("complement", 2, (None, None, None)), ("soft_entailment", 1, (0.9, 0.7, None)), ("conditional", 2, (None, None, [0.1, 0.6, 0.0, 0.95])), ("pairwise", 1, (None, None, [1.2, 0.4, 0.3, 2.0]))]):
        for j in range(n + 1):
            variables.append((f"{kind}-{j}", [0.3, None, 0.8, 1.0][(i + j) % 4], None))
        factors.append((f"f{i}", kind, [f"{kind}-{j}" for j in range(n)], f"{kind}-{n}", *how))
    variables[2] = (variables[2][0], None, 1)
    variables[8] = (variables[8][0], None, 0)
    return variables, factors


def loops(seed, n=8, wide=3):
    rnd = random.Random(seed)
    variables = [(f"v{i}", rnd.choice([None, rnd.random()]), None) for i in range(n)]
    factors = []
    for k in range(n):
        kind = rnd.choice(["soft_entailment", "conditional", "pairwise", "conjunction", "disjunction", "implication"])
        m = {"soft_entailment": 1, "pairwise": 1, "implication": 2}.get(kind, rnd.randint(1, wide - 1))
        own = rnd.sample([v for v, _, _ in variables], m + 1)
        weights = [rnd.uniform(0.1, 0.9) for _ in range(1 << m)] if kind == "conditional" else [rnd.uniform(0.5, 1.5) for _ in range(4)] if kind == "pairwise" else None
        factors.append((f"f{k}", kind, own[:-1], own[-1], *((0.8, 0.7) if kind == "soft_entailment" else (None, None)), weights))
    return variables, factors


def by_component(variables, factors, **how):
    """Brute force over the connected parts."""
    root = {v: v for v, _, _ in variables}

    def find(v):
        return v if root[v] == v else find(root[v])

    for f in factors:
        for v in f[2]:
            root[find(v)] = find(f[3])
    out = {}
    for r in {find(v) for v in root}:
        own = [x for x in variables if find(x[0]) == r]
        beliefs, z = brute(own, [f for f in factors if find(f[3]) == r], **how)
        out |= {v: (p, z) for v, p in beliefs.items()}
    return out


def test_every_kind_by_every_exact_way(spark):
    variables, factors = gallery()
    v, f = frames(spark, variables, factors)
    want = by_component(variables, factors)
    got = {r.variable: r for r in exact.marginals(v, f).collect()}
    assert all(got[k].belief == pytest.approx(p, abs=1e-9) and got[k].log_z == pytest.approx(z, abs=1e-9) for k, (p, z) in want.items())
    tree = {r.variable: r.belief for r in junction_tree.marginals(v, f).collect()}
    assert all(tree[k] == pytest.approx(p, abs=1e-9) for k, (p, _) in want.items())
    strict = by_component(variables, factors, strict=True)
    beliefs, told, _, converged = message_passing.run(v, f, damping=1.0)
    assert converged
    assert all(r.belief == pytest.approx(strict[r.variable][0], abs=1e-5) for r in beliefs.collect())
    assert factor_graph.problems(v, f).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_loops(spark, seed):
    variables, factors = loops(seed)
    variables[0] = (variables[0][0], None, 1)
    v, f = frames(spark, variables, factors)
    want = {k: p for k, (p, _) in by_component(variables, factors).items()}
    found = junction_tree.cliques(v, f)
    assert 1 <= junction_tree.width(found) <= 7
    tree = {r.variable: r.belief for r in junction_tree.marginals(v, f).collect()}
    got = {r.variable: r.belief for r in exact.marginals(v, f).collect()}
    assert tree == pytest.approx(want, abs=1e-9) and got == pytest.approx(want, abs=1e-9)
    names = [factors[0][2][0], factors[0][3]]
    one = {r.assignment: r.p for r in exact.joint(v, f, names).collect()}
    other = {r.assignment: r.p for r in junction_tree.joint(junction_tree.calibrate(found), names).collect()}
    assert one == pytest.approx(other, abs=1e-9) and sum(one.values()) == pytest.approx(1)
    with pytest.raises(junction_tree.TooWide):
        junction_tree.cliques(v, f, most=0)


def plain_bp(variables, factors, damping, rounds, rho=None):
    """Synchronous message passing in dictionaries."""
    hard = {v: h for v, _, h in variables if h is not None}
    base = {v: (1 - EPSILON if h else EPSILON) if h is not None else 0.5 if p is None else min(max(p, EPSILON), 1 - EPSILON) for v, p, h in variables}
    norm = lambda a, b: b / (a + b)
    f2v = {(i, v): 0.5 for i, f in enumerate(factors) for v in [*f[2], f[3]]}

    def product(v, skip=None):
        a, b = 1 - base[v], base[v]
        for (i, u), p in f2v.items():
            if u == v and i != skip:
                a, b = a * (1 - p), b * p
        return norm(a, b)

    for _ in range(rounds):
        v2f = {(v, i): base[v] if rho is not None and v in hard else product(v, i) for i, v in f2v}
        new = {}
        for i, v in f2v:
            own = [*factors[i][2], factors[i][3]]
            out = [0.0, 0.0]
            for bits in itertools.product((0, 1), repeat=len(own)):
                x = dict(zip(own, bits))
                w = value(factors[i], x, strict=True)
                for u in own:
                    if u != v:
                        w *= v2f[u, i] if x[u] else 1 - v2f[u, i]
                out[x[v]] += w
            r = 1 if rho is None else rho[i]
            new[i, v] = norm(out[0] ** r, out[1] ** r)
        f2v = {k: damping * new[k] + (1 - damping) * p for k, p in f2v.items()}
    return {v: product(v) for v, _, _ in variables}


def test_loopy_and_reweighted_rounds(spark):
    variables, factors = loops(5, n=6)
    variables[1] = (variables[1][0], None, 0)
    v, f = frames(spark, variables, factors)
    got = {r.variable: r.belief for r in message_passing.loopy(v, f, most_rounds=3, threshold=0.0).collect()}
    assert got == pytest.approx(plain_bp(variables, factors, 0.5, 3), abs=1e-9)
    rho = min(1.0, 4 / 6)
    got = {r.variable: r.belief for r in message_passing.tree_reweighted(v, f, most_rounds=3, threshold=0.0).collect()}
    assert got == pytest.approx(plain_bp(variables, factors, 0.5, 3, [rho] * 6), abs=1e-9)


def test_unknown_prior_is_no_factor(spark):
    v, f = frames(spark, [("a", 0.9, None), ("b", None, None), ("lone", None, None)], [("f", "pairwise", ["a"], "b", None, None, [1.0, 1.0, 1.0, 1.0])])
    beliefs, told, rounds, _ = message_passing.run(v, f, damping=1.0)
    assert {r.variable: round(r.belief, 9) for r in beliefs.collect()} == {"a": 0.9, "b": 0.5, "lone": 0.5}
    z = {r.variable: r.log_z for r in exact.marginals(v, f).collect()}
    assert z["lone"] == pytest.approx(math.log(2)) and z["a"] == pytest.approx(math.log(2))
    assert message_passing.pseudo_joints(told).agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_evidence_and_checks(spark):
    v, f = frames(spark, [("a", 0.9, None), ("b", None, None), ("c", 0.2, None)], [("f1", "negation", ["a", "b"], "c", None, None, None), ("f2", "maybe", [], "a", None, None, None), ("f3", "soft_entailment", ["a"], "a", 0.4, 0.5, None), ("f4", "pairwise", ["a"], "x", None, None, [0.0, 0.0, 0.0, 0.0]), ("f5", "conditional", ["a"], "b", None, None, [0.1])])
    found = {(r.check_name, r.id) for r in factor_graph.problems(v, f).collect()}
    assert found == {("arity", "f1"), ("kind_unknown", "f2"), ("parameters", "f3"), ("conclusion_in_inputs", "f3"), ("weights", "f4"), ("weights", "f5"), ("variable_unknown", "x")}
    seen = factor_graph.observe(v, spark.createDataFrame([("a", 1), ("b", 0)], "variable string, value int"))
    assert {(r.variable, r.prior, r.hard) for r in seen.collect()} == {("a", None, 1), ("b", None, 0), ("c", 0.2, None)}
    for wrong in ([("b", 1), ("b", 0)], [("c", 1)]):
        with pytest.raises(Exception, match="contradicts"):
            factor_graph.observe(v, spark.createDataFrame(wrong, "variable string, value int")).collect()
    soft = factor_graph.soften(v, spark.createDataFrame([("b", 1, 3.0), ("b", 2, 1e9), ("b", 3, 0.5)], "variable string, pos int, ratio double"))
    assert {r.variable: r.prior for r in soft.collect()}["b"] == pytest.approx(0.999 * 0.5 / (0.999 * 0.5 + 0.001))
    both, all_factors = factor_graph.merge((seen, f), (v.withColumn("variable", F.concat("variable", F.lit("2"))), f))
    assert both.count() == 6 and all_factors.count() == 10 and both.filter("hard is not null").count() == 2


def test_rows_made_of_a_small_table_are_not_broadcast(spark):
    from credograph.plans import beliefs

    found = exact.marginals(*beliefs.gallery(spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_size_estimates_do_not_grow_from_round_to_round(spark):
    """Estimated sizes whose digits doubled in each round held the driver up."""
    v, f = frames(spark, *loops(5, n=6))
    found = message_passing.tree_reweighted(v, f, most_rounds=11, threshold=0.0)
    shown = found._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert not re.search(r"E\+\d{3}", shown)
