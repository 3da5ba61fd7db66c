"""Queries on formulas, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credograph.operators import formulas, grounding
from credograph.plans.checks import _name
from credograph.sources import tables as T

#: Formulas over x and y by a supplier's key, modulo their number; inner nodes first, the root last.
SHAPES = (
    (("r", "implication", ("x", "y")),),
    (("n", "negation", ("x",)), ("r", "disjunction", ("n", "y"))),
    (("n", "negation", ("y",)), ("r", "conjunction", ("x", "n"))),
    (("r", "equivalence", ("x", "y")),),
    (("r", "conjunction", ("x", "y")),),
    (("n", "negation", ("y",)), ("r", "disjunction", ("y", "n"))),
    (("n", "negation", ("x",)), ("r", "conjunction", ("x", "n"))),
    (("r", "conjunction", ("x", "x")),),
    (("d", "complement", ("x", "y")), ("r", "negation", ("d",))),
    (("r", "conjunction", ("x", "gone")),),
    (("r", "negation", ("x", "y")),),
)


def _formulas(spark, sf_dir):
    """A formula of each supplier about its nation (x) and its class of balance (y)."""
    s = T.table(spark, sf_dir, "supplier")
    key, shape = F.col("s_suppkey"), F.col("s_suppkey") % len(SHAPES)
    none, no_atom = F.array().cast("array<string>"), F.lit(None).cast("string")
    row = lambda node, kind, atom, children: F.struct(F.lit(node).alias("node"), F.lit(kind).alias("kind"), atom.alias("atom"), children.alias("children"))
    atoms = [row("x", "atom", _name("n", "s_nationkey"), none), row("y", "atom", _name("q", F.floor(F.col("s_acctbal") / 2500)), none)]
    shaped = [F.array(*atoms, *[row(n, k, no_atom, F.array(*map(F.lit, c))) for n, k, c in x]) for x in SHAPES]
    return s.select(key.alias("claim"), F.inline(F.element_at(F.array(*shaped), (shape + 1).cast("int")))), s.select(key.alias("claim"), F.lit("r").alias("root"))


def formula_findings(spark, sf_dir):
    return formulas.findings(*_formulas(spark, sf_dir))


def formula_normal_forms(spark, sf_dir):
    found, _ = formulas.tables(*_formulas(spark, sf_dir))
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.array_join(x, "&"))), "|")
    return formulas.normal_forms(found).select("claim", text("dnf").alias("dnf"), text("cnf").alias("cnf"), (F.size("dnf") > 0).alias("can_hold"), (F.size("cnf") > 0).alias("can_fail"))


def formula_negation_normal(spark, sf_dir):
    """The normal forms' own truth tables: the same as the formulas'."""
    nodes, roots = _formulas(spark, sf_dir)
    found, _ = formulas.tables(nodes, roots)
    fit = roots.join(found.select("claim"), "claim", "left_semi")
    again, _ = formulas.tables(*formulas.negation_normal(nodes.join(found.select("claim"), "claim", "left_semi"), fit))
    return again.select("claim", F.array_join("atoms", ",").alias("atoms"), F.col("words")[0].bitwiseAND(15).alias("word"))


def _quantified(spark, sf_dir):
    """For each nation: for all of its suppliers s there is a size z so that rich(s) leads to sold(s, z).
    For each brand: all its parts are fit or old."""
    nation, s, p = (T.table(spark, sf_dir, x) for x in ("nation", "supplier", "part"))
    none, no = F.array().cast("array<string>"), F.lit(None).cast("string")
    row = lambda node, kind, name=no, args=none, children=none, variable=no, domain=no: F.struct(F.lit(node).alias("node"), F.lit(kind).alias("kind"), name.alias("name"), args.alias("args"), children.alias("children"), variable.alias("variable"), domain.alias("domain"))
    texts = lambda *x: F.array(*map(F.lit, x))
    first = nation.select(_name("nation", "n_nationkey").alias("claim"), F.inline(F.array(
        row("a", "forall", children=texts("e"), variable=F.lit("s"), domain=_name("suppliers", "n_nationkey")), row("e", "exists", children=texts("i"), variable=F.lit("z"), domain=F.lit("sizes")),
        row("i", "implication", children=texts("r", "t")), row("r", "atom", F.lit("rich"), texts("s")), row("t", "atom", F.lit("sold"), texts("s", "z")),
    )))
    brand = p.select(F.col("p_brand").alias("brand")).distinct()
    second = brand.select(F.col("brand").alias("claim"), F.inline(F.array(
        row("a", "forall", children=texts("o"), variable=F.lit("p"), domain=F.col("brand")), row("o", "disjunction", children=texts("f", "g")), row("f", "atom", F.lit("fit"), texts("p", "it")), row("g", "atom", F.lit("old")),
    )))
    domains = s.select(_name("suppliers", "s_nationkey").alias("domain"), F.col("s_suppkey").alias("pos"), _name("s", "s_suppkey").alias("value"))
    domains = domains.unionByName(p.select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("value")))
    domains = domains.unionByName(T.table(spark, sf_dir, "region").select(F.lit("sizes").alias("domain"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("value")))
    nodes = first.unionByName(second)
    return nodes, nodes.select("claim").distinct().withColumn("root", F.lit("a")), domains


def grounded_instances(spark, sf_dir):
    found = grounding.ground(*_quantified(spark, sf_dir))["instances"]
    return found.select("claim", "within", "source", "kind", "variable", "value")


def grounded_deductions(spark, sf_dir):
    return grounding.ground(*_quantified(spark, sf_dir))["deductions"]


def grounded_operators(spark, sf_dir):
    return grounding.ground(*_quantified(spark, sf_dir))["operators"].select("operator", F.array_join("variables", ",").alias("variables"), "conclusion")


def grounded_atoms(spark, sf_dir):
    return grounding.ground(*_quantified(spark, sf_dir))["atoms"].select("claim", "source", grounding.spelled(F.col("name"), F.col("args")).alias("atom"))


_BIT = "CASE k WHEN 0 THEN x = 0 OR y = 1 WHEN 1 THEN x = 0 OR y = 1 WHEN 2 THEN x = 1 AND y = 0 WHEN 3 THEN x = y WHEN 4 THEN x = 1 AND y = 1 WHEN 5 THEN true WHEN 6 THEN false WHEN 7 THEN x = 1 WHEN 8 THEN x = y END"
#: With each formula its atoms, and its value for both values of x and y (an atom it lacks changes nothing).
_F = f"""f AS (SELECT s_suppkey AS claim, s_suppkey % 11 AS k, 'n' || s_nationkey AS ax, 'q' || floor(s_acctbal / 2500)::bigint AS ay, s_suppkey % 11 NOT IN (6, 7, 9, 10) AS has_y, s_suppkey % 11 NOT IN (5, 9, 10) AS has_x FROM supplier),
b AS (SELECT *, {_BIT} AS v FROM f, range(2) r1(x), range(2) r2(y) WHERE k < 9),
t AS (SELECT claim, any_value(k) AS k, any_value(ax) AS ax, any_value(ay) AS ay, any_value(has_x) AS has_x, any_value(has_y) AS has_y, list(v ORDER BY x, y) AS v FROM b GROUP BY claim),
c AS (SELECT *, CASE WHEN has_x THEN ax END AS a1, CASE WHEN has_y THEN ay END AS a2, min(claim) OVER (PARTITION BY CASE WHEN has_x THEN ax END, CASE WHEN has_y THEN ay END, v) AS first FROM t WHERE k NOT IN (5, 6))"""
_INSTANCE = "'local:package::__' || {kind} || '_' || {v} || '_' || substr(sha256({within} || '|' || {v} || '|' || chr(39) || {value} || chr(39)), 1, 8)"
_G = f"""a AS (SELECT *, {_INSTANCE.format(kind="'forall'", v="'s'", within="within", value="value")} AS claim FROM (SELECT 'nation' || s_nationkey AS within, 's' || s_suppkey AS value, s_suppkey AS pos FROM supplier)),
e AS (SELECT *, {_INSTANCE.format(kind="'exists'", v="'z'", within="within", value="value")} AS claim FROM (SELECT a.claim AS within, a.within AS source, a.value AS s, r_name AS value, r_regionkey AS pos FROM a, region)),
p AS (SELECT *, {_INSTANCE.format(kind="'forall'", v="'p'", within="within", value="value")} AS claim FROM (SELECT DISTINCT p_brand AS within, p_name AS value FROM part))"""

SQL: dict[str, str] = {
    "formula_findings": f"""WITH {_F},
pairs AS (SELECT m.claim AS a, o.claim AS b, bool_or(p.v AND q.v) AS met, bool_or(p.v AND NOT q.v) AS only_a, bool_or(q.v AND NOT p.v) AS only_b
  FROM c m JOIN c o ON m.claim < o.claim AND m.first = m.claim AND o.first = o.claim AND (m.a1 = o.a1 OR m.a2 = o.a2) JOIN b p ON p.claim = m.claim JOIN b q ON q.claim = o.claim
    AND (m.ax != o.ax OR p.x = q.x) AND (m.ay != o.ay OR p.y = q.y) GROUP BY ALL)
SELECT claim AS subject, NULL::bigint AS other, CASE k WHEN 5 THEN 'tautology' ELSE 'unsatisfiable' END AS finding FROM f WHERE k IN (5, 6)
UNION ALL SELECT claim, NULL, CASE k WHEN 7 THEN 'redundant_operand' WHEN 9 THEN 'malformed' ELSE 'unsupported' END FROM f WHERE k IN (7, 9, 10)
UNION ALL SELECT claim, first, 'equivalent' FROM c WHERE claim != first
UNION ALL SELECT CASE WHEN met AND only_a THEN b ELSE a END, CASE WHEN met AND only_a THEN a ELSE b END, CASE WHEN NOT met THEN 'incompatible' WHEN NOT only_a AND NOT only_b THEN 'equivalent' ELSE 'entails' END FROM pairs WHERE NOT (met AND only_a AND only_b)""",
    "formula_normal_forms": """WITH f AS (SELECT s_suppkey AS claim, s_suppkey % 11 AS k, 'n' || s_nationkey AS x, 'q' || floor(s_acctbal / 2500)::bigint AS y FROM supplier WHERE s_suppkey % 11 < 9)
SELECT claim, CASE WHEN k IN (0, 1) THEN y || '|~' || x WHEN k = 2 THEN x || '&~' || y WHEN k IN (3, 8) THEN x || '&' || y || '|~' || x || '&~' || y WHEN k = 4 THEN x || '&' || y WHEN k = 7 THEN x ELSE '' END AS dnf,
  CASE WHEN k IN (0, 1) THEN '~' || x || '&' || y WHEN k = 2 THEN x || '|~' || y WHEN k IN (3, 8) THEN x || '&~' || y || '|~' || x || '&' || y WHEN k = 4 THEN x || '|' || y WHEN k = 7 THEN x ELSE '' END AS cnf, k != 6 AS can_hold, k != 5 AS can_fail FROM f""",
    "formula_negation_normal": """SELECT s_suppkey AS claim, CASE k WHEN 5 THEN y WHEN 6 THEN x WHEN 7 THEN x ELSE x || ',' || y END AS atoms, [13, 13, 2, 9, 8, 15, 0, 10, 9][k + 1]::bigint AS word
FROM (SELECT s_suppkey, s_suppkey % 11 AS k, 'n' || s_nationkey AS x, 'q' || floor(s_acctbal / 2500)::bigint AS y FROM supplier) WHERE k < 9""",
    "grounded_instances": f"WITH {_G} SELECT claim, within, within AS source, 'forall' AS kind, 's' AS variable, value FROM a UNION ALL SELECT claim, within, source, 'exists', 'z', value FROM e UNION ALL SELECT claim, within, within, 'forall', 'p', value FROM p",
    "grounded_deductions": f"WITH {_G} SELECT within AS premise, claim AS conclusion FROM a UNION ALL SELECT within, claim FROM p",
    "grounded_operators": f"WITH {_G} SELECT 'disjunction' AS operator, string_agg(claim, ',' ORDER BY pos, value) AS variables, within AS conclusion FROM e GROUP BY within UNION ALL SELECT 'implication', claim || '/r,' || claim || '/t', claim FROM e UNION ALL SELECT 'disjunction', claim || '/f,' || claim || '/g', claim FROM p",
    "grounded_atoms": f"WITH {_G} SELECT claim || '/r' AS claim, source, 'rich(' || s || ')' AS atom FROM e UNION ALL SELECT claim || '/t', source, 'sold(' || s || ', ' || value || ')' FROM e UNION ALL SELECT claim || '/f', within, 'fit(' || value || ', it)' FROM p UNION ALL SELECT claim || '/g', within, 'old' FROM p",
}
ROWS_ONLY = ()
