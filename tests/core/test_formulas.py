import itertools
import random

from pyspark.sql import functions as F

from credograph.functions.names import quoted
from credograph.operators import formulas, grounding

NODES = "claim string, node string, kind string, atom string, children array<string>"
ROOTS = "claim string, root string"
OPS = {
    "negation": lambda x: not x[0], "conjunction": all, "disjunction": any, "implication": lambda x: not x[0] or x[1],
    "equivalence": lambda x: x[0] == x[1], "contradiction": lambda x: not (x[0] and x[1]), "complement": lambda x: x[0] != x[1],
}


def corpus(seed=1, n=20, atoms=8):
    rnd = random.Random(seed)
    nodes, roots = [], []
    for i in range(n):
        c, names = f"f{i:02}", [f"a{j}" for j in rnd.sample(range(atoms), rnd.randint(1, 7 if i % 5 == 0 else 3))]
        own = []
        for j, a in enumerate(names):
            nodes.append((c, f"x{j}", "atom", a, []))
            own.append(f"x{j}")
        for j in range(rnd.randint(1, 7)):
            kind = rnd.choice(list(OPS))
            k = 1 if kind == "negation" else rnd.randint(2, 3) if kind in ("conjunction", "disjunction") else 2
            nodes.append((c, f"n{j}", kind, None, [rnd.choice(own[-4:]) for _ in range(k)]))
            own.append(f"n{j}")
        roots.append((c, own[-1]))
    return nodes, roots


def read(nodes, roots):
    """Each claim's atoms (those its root holds) and value."""
    by = {(c, n): (k, a, p) for c, n, k, a, p in nodes}

    def value(c, n, bits):
        k, a, parts = by[c, n]
        return bits[a] if k == "atom" else bool(OPS[k]([value(c, p, bits) for p in parts]))

    def atoms(c, n):
        k, a, parts = by[c, n]
        return {a} if k == "atom" else set().union(*(atoms(c, p) for p in parts))

    return {c: (sorted(atoms(c, root)), lambda bits, c=c, root=root: value(c, root, bits)) for c, root in roots}


def settings(names):
    for bits in itertools.product((False, True), repeat=len(names)):
        yield dict(zip(names, bits))


def frames(spark, nodes, roots):
    return spark.createDataFrame(nodes, NODES).repartition(3), spark.createDataFrame(roots, ROOTS)


def test_truth_words_and_forms(spark):
    nodes, roots = corpus()
    known = read(nodes, roots)
    found, problems = formulas.tables(*frames(spark, nodes, roots))
    assert problems.count() == 0
    rows = {r.claim: r for r in found.collect()}
    assert set(rows) == set(known)
    for c, (atoms, value) in known.items():
        assert list(rows[c].atoms) == atoms
        for bits in settings(atoms):
            x = sum(bits[a] << i for i, a in enumerate(atoms))
            assert (rows[c].words[x >> 6] >> (x & 63)) & 1 == value(bits)
    literal = lambda s, bits: not bits[s[1:]] if s.startswith("~") else bits[s]
    for r in formulas.normal_forms(found).collect():
        atoms, value = known[r.claim]
        for bits in settings(atoms):
            assert any(all(literal(s, bits) for s in t) for t in r.dnf) == all(any(literal(s, bits) for s in t) for t in r.cnf) == value(bits)
    made, tops = formulas.negation_normal(*frames(spark, nodes, roots))
    again = read([tuple(x) for x in made.select("claim", "node", "kind", "atom", "children").collect()], [tuple(x) for x in tops.collect()])
    for c, (atoms, value) in known.items():
        for bits in settings(atoms):
            assert again[c][1](bits) == value(bits)
    inner = made.filter("kind = 'negation'").select("claim", F.explode("children").alias("node")).join(made, ["claim", "node"])
    assert {r.kind for r in made.select("kind").distinct().collect()} <= {"atom", "negation", "conjunction", "disjunction"} and inner.filter("kind != 'atom'").count() == 0


def test_findings_equal_brute_force(spark):
    nodes, roots = corpus(5, 20, 6)
    known = read(nodes, roots)
    want, classes = set(), {}
    for c, (atoms, value) in sorted(known.items()):
        table = tuple(value(b) for b in settings(atoms))
        if not any(table) or all(table):
            want.add((c, None, "tautology" if all(table) else "unsatisfiable"))
        else:
            first = classes.setdefault((tuple(atoms), table), c)
            if first != c:
                want.add((c, first, "equivalent"))
    for a, b in itertools.combinations(sorted(classes.values()), 2):
        (x, f), (y, g) = known[a], known[b]
        if set(x) & set(y):
            both = [(f(s), g(s)) for s in settings(sorted({*x, *y}))]
            if (True, True) not in both:
                want.add((a, b, "incompatible"))
            elif (True, False) not in both:
                want.add((a, b, "entails" if (False, True) in both else "equivalent"))
            elif (False, True) not in both:
                want.add((b, a, "entails"))
    for c, _, k, _, parts in nodes:
        if k in ("conjunction", "disjunction") and len(set(parts)) < len(parts):
            want.add((c, None, "redundant_operand"))
    assert {tuple(r) for r in formulas.findings(*frames(spark, nodes, roots)).collect()} == want
    assert {f for _, _, f in want} >= {"incompatible", "entails", "redundant_operand"}


def test_malformed_and_unsupported(spark):
    nodes = [("ring", "a", "negation", None, ["b"]), ("ring", "b", "negation", None, ["a"]), ("gone", "r", "negation", None, ["x"]), ("one", "x", "atom", "p", []), ("one", "r", "conjunction", None, ["x"]), ("odd", "r", "forall", None, []), (None, "r", "atom", "p", [])]
    nodes += [("wide", f"x{i}", "atom", f"p{i}", []) for i in range(17)] + [("wide", "r", "conjunction", None, [f"x{i}" for i in range(17)])] + [("ok", "r", "atom", "p", None)]
    roots = [("ring", "a"), ("gone", "r"), ("one", "r"), ("odd", "r"), ("wide", "r"), ("none", None), ("ok", "r")]
    found, problems = formulas.tables(*frames(spark, nodes, roots))
    assert dict(map(tuple, problems.collect())) == {"ring": "malformed", "gone": "malformed", "none": "malformed", "one": "unsupported", "odd": "unsupported", "wide": "unsupported"}
    assert [r.claim for r in found.collect()] == ["ok"]
    assert formulas.findings(*frames(spark, nodes[:0], roots[:0])).count() == 0


def test_nested_quantifiers(spark):
    schema = "claim string, node string, kind string, name string, args array<string>, children array<string>, variable string, domain string"
    nodes = [
        ("c", "r", "conjunction", None, None, ["q", "p"], None, None), ("c", "q", "forall", None, None, ["e"], "x", "d"), ("c", "e", "exists", None, None, ["b"], "x", "one"),
        ("c", "b", "atom", "likes", ["x", "y"], None, None, None), ("c", "p", "atom", "known", [], None, None, None), ("bad", "r", "exists", None, None, ["gone"], "x", "d"), ("empty", "r", "forall", None, None, ["r"], "x", "none"),
    ]
    domains = [("d", 1, "u"), ("d", 2, "it's"), ("one", 1, "z"), ("d", 1, "u"), (None, 1, "n")]
    found = grounding.ground(spark.createDataFrame(nodes, schema), spark.createDataFrame([("c", "r"), ("bad", "r"), ("empty", "r")], ROOTS), spark.createDataFrame(domains, "domain string, pos int, value string"))
    instances = {(r.within, r.value): r for r in found["instances"].collect() if r.source == "c"}
    assert {(w.split("_")[2] if "_" in w else w, v) for w, v in instances} == {("c/q", "u"), ("c/q", "it's"), ("forall", "z")}
    inner = [r for r in instances.values() if r.value == "z"]
    assert len(inner) == 2 and all(r.bindings == {"x": "z"} and r.kind == "exists" for r in inner)
    assert {(r.premise, r.conclusion) for r in found["deductions"].collect()} == {("c/q", r.claim) for r in instances.values() if r.kind == "forall"}
    operators = {(r.operator, tuple(r.variables), r.conclusion) for r in found["operators"].collect() if "bad" not in (r.conclusion, *r.variables)}
    assert operators == {("conjunction", ("c/q", "c/p"), "c")} | {("equivalence", (r.within, r.claim), None) for r in inner}
    assert sorted((r.claim, r.name, tuple(r.args)) for r in found["atoms"].collect()) == sorted([("c/p", "known", ())] + [(r.claim, "likes", ("z", "y")) for r in inner])
    assert sorted(map(tuple, found["problems"].collect())) == [("bad", "gone", "missing"), ("empty", "r", "empty domain")]


def test_quoting_equals_pythons(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\tline\nend\r", "", "é日"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [(r.t, r.q) for r in frame.select("t", quoted(frame.t).alias("q")).collect()] == [(t, repr(t)) for t in texts]
