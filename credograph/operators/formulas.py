"""Formulas as a relation, many at once: truth tables, findings, normal forms.

``nodes``: claim, node, kind, atom (of atoms), children (array of nodes); ``roots``: claim, root. Kinds
are atom, negation, conjunction and disjunction (two or more parts), implication, equivalence,
contradiction (not both) and complement (either, not both).

A formula over k atoms has a truth table of 2^k bits in 64-bit words: atoms are numbered by name,
and bit x of the table is the formula's value where atom i has bit i of x. Tables are made from the
atoms up; a round makes all nodes whose parts are done, in all formulas. A table over fewer than
six atoms repeats itself in its word.

Defined cases: a formula with an unknown kind, a wrong number of parts, or more than ``MOST_ATOMS``
atoms is unsupported; one whose nodes are missing or contain themselves is malformed; neither has
a table. Repeated nodes count once; null rows are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from credograph.sources.folders import cut

MOST_ATOMS = 16
#: Bit x of word i is bit i of x.
_WORDS = (-0x5555555555555556, -0x3333333333333334, -0x0F0F0F0F0F0F0F10, -0x00FF00FF00FF0100, -0x0000FFFF00010000, -0x100000000)
PARTS = {"negation": (1, 1), "conjunction": (2, None), "disjunction": (2, None), "implication": (2, 2), "equivalence": (2, 2), "contradiction": (2, 2), "complement": (2, 2)}


def _once(nodes: DataFrame) -> DataFrame:
    return nodes.filter("claim is not null and node is not null").dropDuplicates(["claim", "node"])


def _under(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of ``nodes`` that each claim's root holds, and (node null) parts that aren't there."""
    own = nodes.select("claim", "node", "children")
    front = found = cut(roots.filter("root is not null").select("claim", F.col("root").alias("node")).distinct())
    while not front.isEmpty():
        step = front.join(own, ["claim", "node"]).select("claim", F.explode("children").alias("node")).distinct()
        front = cut(step.join(found, ["claim", "node"], "left_anti"))
        found = cut(found.unionByName(front))
    return found


def _supported(n: DataFrame) -> Column:
    kind, parts = F.col("kind"), F.size(F.coalesce("children", F.array().cast("array<string>")))
    fits = F.when(kind == "atom", F.col("atom").isNotNull() & (parts == 0))
    for name, (least, most) in PARTS.items():
        fits = fits.when(kind == name, (parts >= least) & (parts <= (most or 2**31 - 1)))
    return F.coalesce(fits, F.lit(False))


def _combined(kind: Column, t: Column) -> Column:
    """The table of a node of ``kind`` from its parts' tables ``t``."""
    pair = lambda f: F.zip_with(t[0], t[1], f)
    fold = lambda f: F.aggregate(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), t[0], lambda a, b: F.zip_with(a, b, f))
    both, either = (lambda x, y: x.bitwiseAND(y)), (lambda x, y: x.bitwiseOR(y))
    differ = lambda x, y: x.bitwiseXOR(y)
    return (
        F.when(kind == "negation", F.transform(t[0], F.bitwise_not)).when(kind == "conjunction", fold(both)).when(kind == "disjunction", fold(either))
        .when(kind == "implication", pair(lambda x, y: F.bitwise_not(x).bitwiseOR(y))).when(kind == "equivalence", pair(lambda x, y: F.bitwise_not(differ(x, y))))
        .when(kind == "contradiction", pair(lambda x, y: F.bitwise_not(both(x, y)))).when(kind == "complement", pair(differ))
    )


def tables(nodes: DataFrame, roots: DataFrame, most: int = MOST_ATOMS) -> tuple[DataFrame, DataFrame]:
    """claim, atoms (in order), words of every formula that has a table; and claim, problem
    (unsupported or malformed) of the others."""
    nodes, roots = _once(nodes), roots.filter("claim is not null").dropDuplicates(["claim"])
    used = cut(_under(nodes, roots).join(nodes.withColumn("there", F.lit(True)), ["claim", "node"], "left"))
    missing = used.filter("there is null").select("claim").unionByName(roots.filter("root is null").select("claim")).distinct()
    atoms = used.filter("kind = 'atom' and atom is not null").select("claim", "atom").distinct()
    counted = atoms.groupBy("claim").agg(F.count("*").alias("k"))
    bad = used.filter("there").filter(~_supported(used)).select("claim").unionByName(counted.filter(F.col("k") > most).select("claim")).distinct().join(missing, "claim", "left_anti")
    good = cut(used.join(missing.unionByName(bad), "claim", "left_anti").join(counted, "claim").select("claim", "node", "kind", "atom", "children", "k"))
    slots = atoms.withColumn("slot", F.row_number().over(Window.partitionBy("claim").orderBy("atom")) - 1)
    n_words = F.call_function("shiftleft", F.lit(1), F.greatest(F.col("k") - 6, F.lit(0)).cast("int"))
    low = F.get(F.array(*map(F.lit, _WORDS)), F.col("slot"))
    high = lambda w: -F.call_function("shiftright", w, (F.col("slot") - 6)).bitwiseAND(1).cast("bigint")
    words = F.transform(F.sequence(F.lit(0), n_words - 1), lambda w: F.when(F.col("slot") < 6, low).otherwise(high(w)))
    done = cut(good.filter("kind = 'atom'").join(slots, ["claim", "atom"]).select("claim", "node", words.alias("t")))
    level, todo = done, cut(good.filter("kind != 'atom'").select("claim", "node", "kind", "children"))
    finished = [done]
    while not todo.isEmpty() and not level.isEmpty():
        every = reduce(DataFrame.unionByName, finished).withColumnRenamed("node", "part")
        each = todo.select("claim", "node", "kind", F.size("children").alias("n"), F.posexplode("children").alias("i", "part")).join(every, ["claim", "part"])
        ready = each.groupBy("claim", "node", "kind", "n").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("p")).filter(F.size("p") == F.col("n"))
        level = cut(ready.select("claim", "node", "kind", F.col("p.t").alias("p")).select("claim", "node", _combined(F.col("kind"), F.col("p")).alias("t")))
        finished.append(level)
        todo = cut(todo.join(level, ["claim", "node"], "left_anti"))
    whole = reduce(DataFrame.unionByName, finished).withColumnRenamed("node", "root")
    named = slots.groupBy("claim").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "atom"))), lambda x: x["atom"]).alias("atoms"))
    found = cut(roots.join(whole, ["claim", "root"]).join(named, "claim").select("claim", "atoms", F.col("t").alias("words")))
    rest = roots.select("claim").join(found, "claim", "left_anti").join(bad, "claim", "left_anti").select("claim", F.lit("malformed").alias("problem"))
    return found, bad.select("claim", F.lit("unsupported").alias("problem")).unionByName(rest)


def redundant_operands(nodes: DataFrame) -> DataFrame:
    """claim, node, repeated: conjunctions and disjunctions that hold a part twice."""
    own = _once(nodes).filter(F.col("kind").isin("conjunction", "disjunction")).select("claim", "node", F.explode("children").alias("part"))
    twice = own.groupBy("claim", "node", "part").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("claim", "node").agg(F.sort_array(F.collect_list("part")).alias("repeated"))


def _bits(words, k: int) -> np.ndarray:
    """A table as booleans with one axis for each atom."""
    bits = np.unpackbits(np.asarray(words, np.int64).view(np.uint8), bitorder="little")[: 1 << k]
    return bits.astype(bool).reshape((2,) * k, order="F")


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How the formulas of a row relate. Only the atoms that they share matter: a formula's own atoms
    are decided for it (some value fits) or against it (all values fit)."""
    for frame in frames:
        rows = []
        for a, b, own, other, x, y in zip(*(frame[c] for c in ("subject", "other", "atoms", "atoms2", "words", "words2"))):
            own, other = list(own), list(other)
            shared = [v for v in own if v in set(other)]
            f, g = _bits(x, len(own)), _bits(y, len(other))
            apart = tuple(i for i, v in enumerate(own) if v not in shared)
            apart2 = tuple(i for i, v in enumerate(other) if v not in shared)
            f_some, f_all, g_some, g_all = f.any(axis=apart), f.all(axis=apart), g.any(axis=apart2), g.all(axis=apart2)
            forth, back = not (f_some & ~g_all).any(), not (g_some & ~f_all).any()
            if not (f_some & g_some).any():
                rows.append((a, b, "incompatible"))
            elif forth and back:
                rows.append((a, b, "equivalent"))
            elif forth:
                rows.append((a, b, "entails"))
            elif back:
                rows.append((b, a, "entails"))
        yield pd.DataFrame(rows, columns=["subject", "other", "finding"])


def compared(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """subject, other, finding of ``pairs`` (subject, other) of formulas with tables: incompatible,
    equivalent, or entails (subject entails other)."""
    side = lambda name, more: found.select(F.col("claim").alias(name), F.col("atoms").alias(f"atoms{more}"), F.col("words").alias(f"words{more}"))
    kind = found.schema["claim"].dataType.simpleString()
    return pairs.join(side("subject", ""), "subject").join(side("other", "2"), "other").mapInPandas(_compared, f"subject {kind}, other {kind}, finding string")


def findings(nodes: DataFrame, roots: DataFrame, pairwise: bool = True) -> DataFrame:
    """subject, other, finding. Alone: unsatisfiable, tautology, unsupported, malformed,
    redundant_operand. Pairs of other formulas that share an atom: incompatible, equivalent, entails.

    Formulas with the same table over the same atoms are a class: its members are equivalent to the
    one of the least name, and only that one is compared with others."""
    found, problems = tables(nodes, roots)
    alone = lambda rows, finding: rows.select(F.col("claim").alias("subject"), F.lit(None).cast(rows.schema["claim"].dataType).alias("other"), F.lit(finding).alias("finding"))
    never, always = F.forall("words", lambda w: w == 0), F.forall("words", lambda w: w == -1)
    out = alone(found.filter(never), "unsatisfiable").unionByName(alone(found.filter(always), "tautology"))
    out = out.unionByName(problems.select(F.col("claim").alias("subject"), F.lit(None).cast(found.schema["claim"].dataType).alias("other"), F.col("problem").alias("finding")))
    out = out.unionByName(alone(redundant_operands(nodes).select("claim").distinct(), "redundant_operand"))
    if not pairwise:
        return out
    some = found.filter(~never & ~always)
    first = cut(some.groupBy("atoms", "words").agg(F.min("claim").alias("claim")))
    alike = some.withColumnRenamed("claim", "subject").join(first.withColumnRenamed("claim", "other"), ["atoms", "words"]).filter("subject != other").select("subject", "other", F.lit("equivalent").alias("finding"))
    held = first.select("claim", F.explode("atoms").alias("atom"))
    pairs = held.withColumnRenamed("claim", "subject").join(held.withColumnRenamed("claim", "other"), "atom").filter("subject < other").select("subject", "other").distinct()
    return out.unionByName(alike).unionByName(compared(pairs, first))


def negation_normal(nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The formulas with negations at atoms only, as nodes and roots again: node n becomes n+ where
    it counts as it is, and n- where it is denied. One pass; nodes that no root holds are left out."""
    kind = F.col("kind")
    rows = _once(nodes).select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("sign"))
    here = rows["sign"]
    there = F.when(here == "+", "-").otherwise("+")
    part = lambda i, sign: F.concat(F.get("children", F.lit(i)), sign)
    all_of = lambda sign: F.transform("children", lambda c: F.concat(c, sign))
    own = F.concat("node", "sign")
    dual = lambda a, b: F.when(here == "+", a).otherwise(b)
    equal = F.when(kind == "equivalence", here == "+").otherwise(here == "-")  # a complement is a denied equivalence
    halves = F.when(equal, F.array(F.concat(own, F.lit("1")), F.concat(own, F.lit("2")))).otherwise(F.array(F.concat(own, F.lit("3")), F.concat(own, F.lit("4"))))
    struct = lambda node, k, children: F.struct(node.alias("node"), k.alias("kind"), children.alias("children"))
    plain = (
        F.when(kind == "conjunction", struct(own, dual(F.lit("conjunction"), F.lit("disjunction")), all_of(here))).when(kind == "disjunction", struct(own, dual(F.lit("disjunction"), F.lit("conjunction")), all_of(here)))
        .when(kind == "contradiction", struct(own, dual(F.lit("disjunction"), F.lit("conjunction")), all_of(there)))
        .when(kind == "implication", struct(own, dual(F.lit("disjunction"), F.lit("conjunction")), F.array(part(0, there), part(1, here))))
        .when(kind == "atom", struct(own, dual(F.lit("atom"), F.lit("negation")), dual(F.array().cast("array<string>"), F.array(F.concat("node", F.lit("+"))))))
        .when(kind == "negation", struct(own, F.lit("same"), F.array(part(0, there)))).when(kind.isin("equivalence", "complement"), struct(own, F.lit("disjunction"), halves))
    )
    two = lambda n, a, b: struct(F.concat(own, F.lit(n)), F.lit("conjunction"), F.array(part(0, F.lit(a)), part(1, F.lit(b))))
    inner = F.when(kind.isin("equivalence", "complement"), F.when(equal, F.array(two("1", "+", "+"), two("2", "-", "-"))).otherwise(F.array(two("3", "+", "-"), two("4", "-", "+")))).otherwise(F.array().cast("array<struct<node:string,kind:string,children:array<string>>>"))
    made = cut(rows.select("claim", "atom", F.inline(F.concat(F.array(plain), inner))).select("claim", "node", "kind", F.when(F.col("kind") == "atom", F.col("atom")).alias("atom"), "children"))
    start = roots.select("claim", F.concat("root", F.lit("+")).alias("root"))
    # a negation stands for its part: chains of them are followed by doubling
    same = cut(made.filter("kind = 'same'").select("claim", "node", F.col("children")[0].alias("to")))
    while True:
        on = same.select("claim", F.col("node").alias("to"), F.col("to").alias("further"))
        new = cut(same.join(on, ["claim", "to"], "left").select("claim", "node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        same = new.select("claim", "node", "to")
        if new.filter("moved and node != to").isEmpty():
            break
    stands = same.select("claim", F.col("node").alias("part"), "to")
    each = made.filter("kind != 'same'").select("claim", "node", "kind", "atom", F.posexplode_outer("children").alias("i", "part")).join(stands, ["claim", "part"], "left")
    out = each.groupBy("claim", "node", "kind").agg(F.first("atom").alias("atom"), F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("i", F.coalesce("to", "part").alias("c"))))).alias("p"))
    out = out.select("claim", "node", "kind", "atom", F.col("p.c").alias("children"))
    top = start.join(same.select("claim", F.col("node").alias("root"), "to"), ["claim", "root"], "left").select("claim", F.coalesce("to", "root").alias("root"))
    return out.join(_under(out, top), ["claim", "node"], "left_semi"), top


def _primes(table: np.ndarray) -> list[tuple[int, int]]:
    """The prime implicants of a truth table (one axis an atom) as (care, value) masks."""
    k, found = table.ndim, []
    # a cube for each choice of 0, 1 or either for every atom: true if the whole cube is
    cubes = table.astype(bool)
    for axis in range(k):
        lower, upper = np.take(cubes, 0, axis), np.take(cubes, 1, axis)
        cubes = np.stack([lower, upper, lower & upper], axis)
    free = cubes.copy()
    for axis in range(k):
        wider = np.take(cubes, [2], axis)
        keep = np.ones([3 if i == axis else 1 for i in range(k)], bool)
        keep[tuple(2 if i == axis else 0 for i in range(k))] = False
        free &= ~(np.broadcast_to(wider, cubes.shape) & np.broadcast_to(keep, cubes.shape))
    for cube in np.argwhere(free):
        found.append((sum(1 << i for i, c in enumerate(cube) if c != 2), sum(1 << i for i, c in enumerate(cube) if c == 1)))
    return sorted(found)


#: Atoms of a formula whose prime implicants are listed: 3^n cubes are looked at.
MOST_LISTED = 10


def _forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for claim, atoms, words in zip(frame["claim"], frame["atoms"], frame["words"]):
            atoms, table = list(atoms), _bits(words, len(atoms))
            said = lambda care, value, no: [a if (value >> i & 1) != no else f"~{a}" for i, a in enumerate(atoms) if care >> i & 1]  # noqa: E731, B023
            rows.append((claim, [said(*p, 0) for p in _primes(table)], [said(*p, 1) for p in _primes(~table)]))
        yield pd.DataFrame(rows, columns=["claim", "dnf", "cnf"])


def normal_forms(found: DataFrame) -> DataFrame:
    """claim, dnf, cnf of formulas with tables over at most ``MOST_LISTED`` atoms: all prime implicants
    as lists of literals (``~`` denies), and all prime implicates. No list at all means false for
    dnf and true for cnf; one empty list means the other."""
    kind = found.schema["claim"].dataType.simpleString()
    return found.filter(F.size("atoms") <= MOST_LISTED).mapInPandas(_forms, f"claim {kind}, dnf array<array<string>>, cnf array<array<string>>")
