"""Queries on comparison of models, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credograph.operators import comparison
from credograph.plans.checks import _name
from credograph.sources import tables as T

#: Hypothesis, its family and parameters; text stands for a symbol that each hypothesis binds.
MODELS = (
    ("cauchy", {"mu": 4.0, "gamma": 2.0}), ("chisquared", {"df": 4.0}), ("exponential", {"rate": "r"}), ("gamma", {"alpha": 3.0, "rate": "r"}),
    ("lognormal", {"mu": 1.0, "sigma": 0.8}), ("normal", {"mu": "m", "sigma": 3.0}), ("studentt", {"df": 3.0, "mu": 4.0, "sigma": 2.5}),
)
COUNTS = (("poisson", {"rate": 9.0}), ("binomial", {"n": 30.0, "p": 0.3}), ("betabinomial", {"n": 30.0, "alpha": 1.0, "beta": 1.0}))
SYMBOLS = {"exponential": {"r": 0.2}, "gamma": {"r": 0.5}, "normal": {"m": 4.5}}
NOISE = 0.6


def _models(spark, sf_dir):
    """For each nation, models of its suppliers' balances and of a count made of them; and what the
    hypotheses bind."""
    nation = T.table(spark, sf_dir, "nation")
    def row(family, given, what):
        texts = lambda kind: [x for k, v in given.items() if isinstance(v, kind) for x in (F.lit(k), F.lit(v))]
        numbers, symbols = texts(float), texts(str)
        return F.struct(_name(what, "n_nationkey").alias("comparison"), F.concat(_name(f"{family}-", "n_nationkey")).alias("hypothesis"), F.lit(what).alias("observable"), F.lit(family).alias("family"), F.create_map(*numbers).cast("map<string,double>").alias("params"), F.create_map(*symbols).cast("map<string,string>").alias("symbols"))

    models = nation.select(F.inline(F.array(*[row(f, p, "balance") for f, p in MODELS], *[row(f, p, "count") for f, p in COUNTS])))
    bindings = nation.select(F.inline(F.array(*[F.struct(_name(f"{h}-", "n_nationkey").alias("hypothesis"), F.lit(s).alias("symbol"), F.lit(v).alias("value")) for h, own in SYMBOLS.items() for s, v in own.items()])))
    return comparison.bound(models, bindings)


def _observed(spark, sf_dir):
    """Every other supplier's balance is measured with an error; so is every third's count."""
    s, noise = T.table(spark, sf_dir, "supplier"), lambda k: F.when(F.col("s_suppkey") % k == 0, NOISE)
    balance = s.select(_name("balance", "s_nationkey").alias("comparison"), F.lit("balance").alias("observable"), (F.col("s_acctbal") / 1000).alias("value"), noise(2).alias("noise_mu"), noise(2).alias("noise_sigma"))
    count = s.select(_name("count", "s_nationkey").alias("comparison"), F.lit("count").alias("observable"), F.floor(F.abs(F.col("s_acctbal")) / 500).cast("double").alias("value"), F.lit(0.0).alias("noise_mu"), noise(3).alias("noise_sigma"))
    return balance.unionByName(count)


def _found(spark, sf_dir):
    models, _ = _models(spark, sf_dir)
    return comparison.likelihoods(models, _observed(spark, sf_dir)), models


def comparison_posteriors(spark, sf_dir):
    found = comparison.posteriors(_found(spark, sf_dir)[0])
    return found.withColumns({"log_likelihood": F.when(F.col("log_likelihood") > float("-inf"), F.round("log_likelihood", 4)), "posterior": F.round("posterior", 4)})


def comparison_factors(spark, sf_dir):
    found = comparison.strategies(_found(spark, sf_dir)[0])
    return found.select("strategy_id", F.col("premises")[0].alias("premise"), "conclusion", F.col("cpt")[0].alias("without"), F.round(F.col("cpt")[1], 4).alias("with"))


def comparison_warnings(spark, sf_dir):
    return comparison.summaries(*_found(spark, sf_dir)).withColumns({"max_log_ratio": F.round("max_log_ratio", 3), "per_observation": F.round("per_observation", 3)})


def _sql() -> str:
    """Likelihoods by family; those with noise by Simpson's rule over what may have been."""
    ln = lambda x: f"CASE WHEN {x} > 0 THEN ln({x}) END"
    density = {
        "cauchy": "1 / (2 * pi() * (1 + ((x - 4) / 2) ** 2))", "chisquared": "CASE WHEN x > 0 THEN x * exp(-x / 2) / 4 ELSE 0 END", "exponential": "CASE WHEN x >= 0 THEN 0.2 * exp(-0.2 * x) ELSE 0 END",
        "gamma": "CASE WHEN x > 0 THEN x * x * exp(-0.5 * x) / 16 ELSE 0 END", "lognormal": "CASE WHEN x > 0 THEN exp(-pow((ln(CASE WHEN x > 0 THEN x ELSE 1 END) - 1) / 0.8, 2) / 2) / (0.8 * sqrt(2 * pi()) * CASE WHEN x > 0 THEN x ELSE 1 END) ELSE 0 END",
        "normal": "exp(-pow((x - 4.5) / 3, 2) / 2) / (3 * sqrt(2 * pi()))", "studentt": "0.367552596947861::double * pow(1 + ((x - 4) / 2.5) ** 2 / 3, -2) / 2.5",
    }
    choose = "lgamma(31) - lgamma(i + 1) - lgamma(31 - i)"
    mass = {"poisson": "i * ln(9) - 9 - lgamma(i + 1)", "binomial": f"CASE WHEN i <= 30 THEN {choose} + i * ln(0.3) + (30 - i) * ln(0.7) END", "betabinomial": "CASE WHEN i <= 30 THEN -ln(31) END"}
    bell = lambda d: f"exp(-pow({d}, 2) / 2) / sqrt(2 * pi())"
    parts = []
    for f, _ in MODELS:
        whole = f in ("cauchy", "normal", "studentt")
        least = "v - 0.6 - 6.6" if whole else "greatest(v - 0.6 - 6.6, 0)"
        d = density[f]
        noisy = f"list_sum(list_transform(range(0, 2001), lambda j: (CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * ({d.replace('x', '(lo + j * h)').replace('e(lo + j * h)p', 'exp')}) * {bell('(v - 0.6 - lo - j * h) / 0.6')} / 0.6)) * h / 3"
        clean = d.replace("x", "v").replace("evp", "exp")
        parts.append(f"SELECT 'balance' || n AS comparison, '{f}-' || n AS hypothesis, {ln(f'CASE WHEN k % 2 = 0 THEN {noisy} ELSE {clean} END')} AS l FROM (SELECT *, {least} AS lo, (greatest(v - 0.6 + 6.6, {least} + 0.1) - ({least})) / 2000 AS h FROM s)")
    for f, _ in COUNTS:
        top = "greatest((c + 6)::bigint, c + 50)" if f == "poisson" else "30"
        noisy = f"list_sum(list_transform(range(0, ({top}) + 1), lambda i: exp({mass[f]}) * {bell('(c - i) / 0.6')} / 0.6))"
        parts.append(f"SELECT 'count' || n, '{f}-' || n, CASE WHEN k % 3 = 0 THEN ln({noisy}) ELSE {mass[f].replace('i ', 'c ').replace('(i', '(c').replace('- i', '- c')} END FROM s")
    return f"""WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_acctbal::double / 1000 AS v, floor(abs(s_acctbal) / 500)::bigint AS c FROM supplier), each AS ({' UNION ALL '.join(parts)}),
named AS (SELECT 'balance' || n_nationkey AS comparison, f || '-' || n_nationkey AS hypothesis FROM nation, (VALUES {', '.join(f"('{f}')" for f, _ in MODELS)}) t(f)
  UNION ALL SELECT 'count' || n_nationkey, f || '-' || n_nationkey FROM nation, (VALUES {', '.join(f"('{f}')" for f, _ in COUNTS)}) t(f)),
sums AS (SELECT comparison, hypothesis, CASE WHEN count(l) < count(e) THEN NULL ELSE coalesce(sum(l), 0) END AS l, count(e) AS n_observations FROM named LEFT JOIN (SELECT *, 1 AS e FROM each) USING (comparison, hypothesis) GROUP BY ALL),
tops AS (SELECT *, max(l) OVER (PARTITION BY comparison) AS top FROM sums)"""


SQL: dict[str, str] = {
    "comparison_posteriors": f"{_sql()} SELECT comparison, hypothesis, round(l, 4) AS log_likelihood, n_observations, round(coalesce(exp(l - top), CASE WHEN top IS NOT NULL THEN 0 END) / sum(exp(l - top)) OVER (PARTITION BY comparison), 4) AS posterior FROM tops",
    "comparison_factors": f"""{_sql()} SELECT hypothesis || '>' || comparison AS strategy_id, hypothesis AS premise, comparison AS conclusion, 0.5::double AS without, round(least(greatest(coalesce(0.999 * exp(l - top), 0), 0.001), 0.999), 4) AS "with" FROM tops WHERE top IS NOT NULL""",
    "comparison_warnings": f"""{_sql()} SELECT comparison, round(r, 3) AS max_log_ratio, round(r / greatest(n, 1), 3) AS per_observation, diffuse, diffuse AND r / greatest(n, 1) > 5 AS warning, zero_support
FROM (SELECT comparison, coalesce(max(l) - min(l), 0) AS r, max(n_observations) AS n, comparison LIKE 'count%' AS diffuse, max(l) IS NULL AS zero_support FROM sums GROUP BY comparison)""",
}
ROWS_ONLY = ()
