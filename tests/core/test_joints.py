import itertools
import math
import random

import numpy as np
import pytest

from credograph.operators import exact, feasibility, inference, joints, junction_tree, router
from tests.core.test_beliefs import FACTORS, VARIABLES, brute, frames, loops, value


def table(variables, factors, names):
    own = [v for v, _, _ in variables]
    cells = [0.0] * (1 << len(names))
    for bits in itertools.product((0, 1), repeat=len(own)):
        x, w = dict(zip(own, bits)), 1.0
        for v, prior, hard in variables:
            if hard is not None or prior is not None:
                p = (0.999 if hard else 0.001) if hard is not None else min(max(prior, 0.001), 0.999)
                w *= p if x[v] else 1 - p
        w *= math.prod(value(f, x) for f in factors)
        cells[sum(x[v] << i for i, v in enumerate(names))] += w
    return [c / sum(cells) for c in cells]


def test_joints_side_by_side(spark):
    variables, factors = loops(3, 7)
    variables.append(("far", 0.2, None))
    v, f = frames(spark, variables, factors)
    names = ["v5", "far", "v0", "v2"]
    got = {}
    for r in joints.compared(v, f, names, ("exact", "junction_tree", "trw")).collect():
        got.setdefault(r.method, {})[r.assignment] = (r.p, r.basis, r.problem)
    want = table(variables, factors, names)
    for method in ("exact", "junction_tree"):
        assert [got[method][i][0] for i in range(16)] == pytest.approx(want, abs=1e-9)
    assert got["trw"] == {None: (None, None, "no factor holds all names")}
    beliefs = spark.createDataFrame([("v0", 0.2), ("v1", 0.7), ("v2", 0.5)], "variable string, belief double")
    assert {r.assignment: r.p for r in joints.of_beliefs(beliefs, ["v1", "v0"]).collect()} == pytest.approx({0: 0.24, 1: 0.56, 2: 0.06, 3: 0.14})
    pair = [factors[0][3], factors[0][2][0]]
    by = {r.assignment: r.p for r in joints.within_a_factor(v, f, pair, most_rounds=3).collect()}
    assert sum(by.values()) == pytest.approx(1) and len(by) == 4
    lost = joints.compared(v, f, ["v0", "nobody"]).collect()
    assert len(lost) == 4 and all("nobody" in r.problem for r in lost)
    with pytest.raises(ValueError):
        joints.compared(v, f, ["v0", "v0"])
    bits = joints.entropy(joints.by_elimination(v, f, names)).first()
    assert bits.bits == pytest.approx(-sum(p * math.log2(p) for p in want))


def test_joint_across_a_long_chain(spark):
    """Ends of a chain of 30, which no enumeration and no single clique holds."""
    n, p = 30, 0.9
    variables = [(f"c{i:02}", 0.3 if i == 0 else None, None) for i in range(n)]
    factors = [(f"f{i}", "soft_entailment", [f"c{i:02}"], f"c{i + 1:02}", p, p, None) for i in range(n - 1)]
    v, f = frames(spark, variables, factors)
    got = {r.method: r for r in joints.compared(v, f, ["c00", "c29"], ("exact",)).collect()}
    assert "more than 26" in got["exact"].problem
    same = (1 + (2 * p - 1) ** (n - 1)) / 2
    cells = {r.assignment: r.p for r in joints.by_elimination(v, f, ["c00", "c29"]).collect()}
    assert [cells[i] for i in range(4)] == pytest.approx([0.7 * same, 0.3 * (1 - same), 0.7 * (1 - same), 0.3 * same], abs=1e-9)
    assert router.infer(v, f)[1] == "junction_tree"


OPS = {"conjunction": all, "disjunction": any, "negation": lambda x: not x[0], "implication": lambda x: not x[0] or x[1], "equivalence": lambda x: x[0] == x[1], "contradiction": lambda x: not all(x), "complement": lambda x: x[0] != x[1]}


def test_feasible_assignments_equal_enumeration(spark):
    rnd = random.Random(4)
    rows, claims, want = [], [], {}
    for g in range(15):
        names = [f"v{i}" for i in range(6)]
        own, relations = [], feasibility.RELATIONS
        for k in range(rnd.randint(0, 5)):
            kind = rnd.choice(list(OPS))
            n = 1 if kind == "negation" else 2
            inputs = rnd.sample(names, n)
            out = f"h{k}" if kind in relations else rnd.choice([v for v in names if v not in inputs])
            own.append((g, f"f{k}", kind, inputs, out, None, None, None))
        counted = rnd.sample(names, rnd.randint(0, 4))
        fits = set()
        for bits in itertools.product((False, True), repeat=6):
            x = dict(zip(names, bits))
            if all(OPS[k]([x[v] for v in i]) == (True if k in relations else x[c]) for _, _, k, i, c, *_ in own):
                fits.add(tuple(x[v] for v in counted))
        want[g] = (len(counted), len(fits))
        rows += own
        claims += [(g, v) for v in counted] or [(g, None)]
    frame = spark.createDataFrame(rows, "group int, " + FACTORS)
    got = {r.group: (r.n_claims, 0 if r.bits is None else round(2**r.bits), r.share) for r in feasibility.feasible(frame, spark.createDataFrame(claims, "group int, variable string")).collect()}
    assert {g: x[:2] for g, x in got.items()} == want
    assert all(x[2] == pytest.approx(n / 2**k) for x, (k, n) in zip([got[g] for g in want], want.values()))
    with pytest.raises(Exception, match="deterministic"):
        feasibility.feasible(spark.createDataFrame([(1, "f", "conditional", ["a"], "b", None, None, [0.1, 0.2])], frame.schema), spark.createDataFrame([(1, "a")], "group int, variable string")).collect()


def test_counts_beyond_any_table(spark):
    """No two neighbours of 40 hold: Fibonacci's number 42."""
    rows = [(1, f"f{i:02}", "contradiction", [f"v{i:02}", f"v{i + 1:02}"], f"h{i:02}", None, None, None) for i in range(39)]
    got = feasibility.feasible(spark.createDataFrame(rows, "group int, " + FACTORS), spark.createDataFrame([(1, f"v{i:02}") for i in range(40)], "group int, variable string")).first()
    a, b = 1, 1
    for _ in range(40):
        a, b = b, a + b
    assert got.bits == pytest.approx(math.log2(b), abs=1e-9)


def test_counts_beyond_a_double(spark):
    """No two neighbours of 1500 hold: about 2^1041 ways, which no double holds."""
    n = 1500
    rows = [(1, f"f{i:04}", "contradiction", [f"v{i:04}", f"v{i + 1:04}"], f"h{i:04}", None, None, None) for i in range(n - 1)]
    got = feasibility.feasible(spark.createDataFrame(rows, "group int, " + FACTORS), spark.createDataFrame([(1, f"v{i:04}") for i in range(n)], "group int, variable string")).first()
    a, b = 1, 1
    for _ in range(n):
        a, b = b, a + b
    assert b > 2**1024 and got.bits == pytest.approx(math.log2(b), abs=1e-8)


def test_largest_entropy(spark):
    told = [("two", "a", "b", 0.4), ("two", "b", "a", 0.7), ("free", "a", None, 0.25), ("free", "b", None, 0.5), ("bad", "a", None, 0.2), ("bad", "a", None, 0.8), (None, "a", None, 0.1)]
    rnd = random.Random(7)
    names = "abcde"
    p = [rnd.random() for _ in range(32)]
    p = [x / sum(p) for x in p]
    on = lambda v: [x >> names.index(v) & 1 for x in range(32)]
    mass = lambda *vs: sum(q for i, q in enumerate(p) if all(on(v)[i] for v in vs))
    constraints = [("a", None), ("b", "a"), ("c", "a"), ("c", None), ("d", "c"), ("e", "d"), ("a", "e")]
    told += [("five", c, g, mass(c, g) / mass(g) if g else mass(c)) for c, g in constraints]
    got = {r.group: r for r in feasibility.largest_entropy(spark.createDataFrame(told, "group string, claim string, given string, value double")).collect()}
    ratio10, ratio01 = (1 - 0.7) / 0.7, (1 - 0.4) / 0.4
    scale = math.exp((ratio10 * math.log(ratio10) + ratio01 * math.log(ratio01)) / (1 + ratio10 + ratio01))
    p11 = 1 / (1 + ratio10 + ratio01 + scale)
    assert list(got["two"].cells) == pytest.approx([scale * p11, ratio10 * p11, ratio01 * p11, p11], abs=1e-8)
    assert list(got["free"].cells) == pytest.approx([0.375, 0.125, 0.375, 0.125]) and got["free"].bits == pytest.approx(1 + 2 - 0.75 * math.log2(3))
    assert not got["bad"].converged and got["bad"].gap > 0.1 and set(got) == {"two", "free", "bad", "five"}
    five = list(got["five"].cells)
    for _, c, g, q in told[-7:]:
        assert sum(x for i, x in enumerate(five) if on(c)[i] and (g is None or on(g)[i])) / (sum(x for i, x in enumerate(five) if on(g)[i]) if g else 1) == pytest.approx(q, abs=1e-8)
    # at the largest entropy, log p is a combination of the constraints: no move that keeps them helps
    entropy = -sum(x * math.log(x) for x in five)
    for seed in range(20):
        r = random.Random(seed)
        features = [[1.0] * 32] + [[(on(g)[i] if g else 1) * (on(c)[i] - q) for i in range(32)] for _, c, g, q in told[-7:]]
        move = [r.uniform(-1, 1) for _ in range(32)]
        basis = []
        for f in features:
            for b in basis:
                d = sum(x * y for x, y in zip(f, b))
                f = [x - d * y for x, y in zip(f, b)]
            n = math.sqrt(sum(x * x for x in f))
            basis.append([x / n for x in f])
        for b in basis:
            d = sum(x * y for x, y in zip(move, b))
            move = [x - d * y for x, y in zip(move, b)]
        other = [x + 1e-4 * m for x, m in zip(five, move)]
        assert min(other) > 0 and -sum(x * math.log(x) for x in other) <= entropy + 1e-12


def test_information_of_a_table(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.6, 0.4, 0.95], [0.3, 0.8]), (2, [0.5, 0.5], [0.4]), (3, [0.7], [])], "k int, w array<double>, p array<double>")
    got = {r.k: r.bits for r in rows.select("k", inference.table_information(rows.w, rows.p).alias("bits")).collect()}
    h = lambda p: -p * math.log2(p) - (1 - p) * math.log2(1 - p)
    mass = [(0.3 if x & 1 else 0.7) * (0.8 if x & 2 else 0.2) for x in range(4)]
    w = [0.1, 0.6, 0.4, 0.95]
    assert got[1] == pytest.approx(h(sum(m * q for m, q in zip(mass, w))) - sum(m * h(q) for m, q in zip(mass, w)))
    assert got[2] == pytest.approx(0, abs=1e-12) and got[3] == pytest.approx(0, abs=1e-12)


def test_galileo_and_blocks(spark):
    """The published beliefs of the falling-bodies graph, and block graphs against enumeration."""
    names = ["daily", "aristotle", "medium", "a_pred", "m_pred", "faster", "slower", "vacuum", "e1", "e2", "contra"]
    variables = [(v, 0.9 if v == "daily" else None, 1 if v in ("e1", "e2", "contra") else None) for v in names]
    links = [("aristotle", "a_pred"), ("medium", "m_pred"), ("aristotle", "faster"), ("aristotle", "slower"), ("medium", "vacuum")]
    factors = [(f"{a}>{b}", "conditional", [a], b, None, None, [0.5, 0.999]) for a, b in links]
    factors += [("1", "equivalence", ["a_pred", "daily"], "e1", None, None, None), ("2", "equivalence", ["m_pred", "daily"], "e2", None, None, None), ("3", "contradiction", ["faster", "slower"], "contra", None, None, None)]
    v, f = frames(spark, variables, factors)
    got = {r.variable: r.belief for r in junction_tree.marginals(v, f).collect()}
    assert got == pytest.approx(brute(variables, factors)[0], abs=1e-9)
    assert got == pytest.approx({r.variable: r.belief for r in exact.marginals(v, f).collect()}, abs=1e-9)
    assert [round(got[k], 3) for k in ("daily", "aristotle", "medium", "vacuum")] == [0.964, 0.010, 0.642, 0.821]
    for n in (5, 20):
        variables, factors = [], []
        for i in range(1, n + 1):
            variables += [(f"a{i}", 0.7, None), (f"c{i}", 0.6, None), (f"h{i}", None, None)]
            factors.append((f"b{i}", "conditional", [f"a{i}", f"h{i}"], f"c{i}", None, None, [0.6, 0.6, 0.6, 0.999]))
            if i % 5 == 0 and i < n:
                variables.append((f"l{i}", None, None))
                factors.append((f"k{i}", "implication", [f"c{i}", f"c{i + 1}"], f"l{i}", None, None, None))
        v, f = frames(spark, variables, factors)
        got = {r.variable: r.belief for r in junction_tree.marginals(v, f).collect()}
        if n == 5:
            assert got == pytest.approx(brute(variables, factors)[0], abs=1e-9)
        else:
            # a link that nothing else holds says nothing: each block is alike
            assert all(got[f"a{i}"] == pytest.approx(got["a1"], abs=1e-3) for i in range(2, n + 1))


def test_parts_are_summed_in_a_pass_as_by_rounds(spark, monkeypatch):
    """Small parts in a task, others by rounds: the same counts, of long chains too."""
    rows = [(g, f"f{g}-{i}", "contradiction", [f"v{i:03}", f"v{i + 1:03}"], f"h{i:03}", None, None, None) for g, n in ((1, 20), (2, 3)) for i in range(n - 1)]
    claims = [(g, f"v{i:03}") for g, n in ((1, 20), (2, 3)) for i in range(n)]
    count = lambda: {r.group: r.bits for r in feasibility.feasible(spark.createDataFrame(rows, "group int, " + FACTORS), spark.createDataFrame(claims, "group int, variable string")).collect()}
    fib = [1, 2]
    while len(fib) < 21:
        fib.append(fib[-1] + fib[-2])
    want = {1: math.log2(fib[20]), 2: math.log2(fib[3])}
    rounds, once = [], junction_tree._round
    monkeypatch.setattr(junction_tree, "_round", lambda *a, **k: rounds.append(1) or once(*a, **k))
    assert count() == pytest.approx(want, abs=1e-9) and len(rounds) <= 3
    monkeypatch.setattr(junction_tree, "_PART", 100)
    assert count() == pytest.approx(want, abs=1e-9) and len(rounds) > 3


def test_entropy_groups_of_one_shape_stop_by_themselves():
    ends, values = [(0, 1), (1, 0)], [[0.4, 0.7], [0.9, 0.2], [0.5, 0.5]]
    together = feasibility._fit(2, ends, np.array(values), 5000, 1e-10)
    for i, v in enumerate(values):
        alone = feasibility._fit(2, ends, np.array([v]), 5000, 1e-10)
        assert list(together[0][i]) == pytest.approx(list(alone[0][0]), abs=1e-15) and together[1][i] == alone[1][0]
    assert len(set(together[1])) > 1
