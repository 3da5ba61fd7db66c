"""What a reasoning graph lacks, as rows. The relations are those of ``lowering_graph``; claims also
have type, content, exported, reviewable helpers and background where a function says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from credograph.operators import graph

#: Kinds of notes; order of severities; the kinds' order in a report by its mode.
NOTES = ("note", "setting", "context")
SEVERITIES = ("error", "warning", "info")
_KINDS = {
    "auto": (
        "compile_error",
        "validation_error",
        "validation_warning",
        "structural_hole",
        "focus_weakness",
        "prior_hole",
        "belief_regression",
        "support_weak",
        "orphaned_claim",
        "background_only_claim",
        "possible_duplicate_claim",
        "stale_artifact",
        "focus_low_posterior",
        "unreviewed_warrant",
        "prior_without_justification",
        "rejected_warrant",
        "blocked_warrant_path",
        "focus_unsupported",
        "large_belief_drop",
        "overstrong_strategy_without_provenance",
        "claim_with_evidence_but_no_focus_connection",
    ),
    "formalize": (
        "compile_error",
        "validation_error",
        "validation_warning",
        "structural_hole",
        "prior_hole",
        "support_weak",
        "orphaned_claim",
        "background_only_claim",
        "possible_duplicate_claim",
        "focus_weakness",
        "belief_regression",
        "stale_artifact",
        "prior_without_justification",
        "unreviewed_warrant",
        "rejected_warrant",
        "focus_low_posterior",
        "blocked_warrant_path",
        "overstrong_strategy_without_provenance",
        "focus_unsupported",
        "large_belief_drop",
        "claim_with_evidence_but_no_focus_connection",
    ),
    "explore": (
        "compile_error",
        "focus_weakness",
        "support_weak",
        "structural_hole",
        "validation_error",
        "validation_warning",
        "belief_regression",
        "possible_duplicate_claim",
        "orphaned_claim",
        "background_only_claim",
        "prior_hole",
        "focus_low_posterior",
        "rejected_warrant",
        "unreviewed_warrant",
        "stale_artifact",
        "prior_without_justification",
        "focus_unsupported",
        "claim_with_evidence_but_no_focus_connection",
        "blocked_warrant_path",
        "large_belief_drop",
        "overstrong_strategy_without_provenance",
    ),
    "verify": (
        "compile_error",
        "validation_error",
        "support_weak",
        "prior_hole",
        "belief_regression",
        "validation_warning",
        "structural_hole",
        "focus_weakness",
        "possible_duplicate_claim",
        "orphaned_claim",
        "background_only_claim",
        "focus_low_posterior",
        "prior_without_justification",
        "stale_artifact",
        "rejected_warrant",
        "unreviewed_warrant",
        "overstrong_strategy_without_provenance",
        "large_belief_drop",
        "blocked_warrant_path",
        "focus_unsupported",
        "claim_with_evidence_but_no_focus_connection",
    ),
    "publish": (
        "compile_error",
        "validation_error",
        "validation_warning",
        "structural_hole",
        "prior_hole",
        "orphaned_claim",
        "support_weak",
        "background_only_claim",
        "belief_regression",
        "focus_weakness",
        "possible_duplicate_claim",
        "stale_artifact",
        "prior_without_justification",
        "unreviewed_warrant",
        "rejected_warrant",
        "focus_low_posterior",
        "blocked_warrant_path",
        "overstrong_strategy_without_provenance",
        "focus_unsupported",
        "large_belief_drop",
        "claim_with_evidence_but_no_focus_connection",
    ),
}
RANKS = {mode: {k: i for i, k in enumerate(kinds)} for mode, kinds in _KINDS.items()}


def _each(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select(F.explode(column).alias("id")).distinct().withColumn(name, F.lit(True))


def roles(knowledges: DataFrame, strategies: DataFrame, operators: DataFrame) -> DataFrame:
    """id, role: note, question, structural (an operator's conclusion), derived (a strategy's),
    independent (a premise or an operator's variable), background, or orphaned; the first that
    fits. ``knowledges``: id, type. Embedded operators count with the others."""
    inner = strategies.filter("formal is not null").select(F.explode("formal").alias("f")).select("f.variables", "f.conclusion")
    ops = operators.select("variables", "conclusion").unionByName(inner)
    marks = [
        ops.select(F.col("conclusion").alias("id")).distinct().withColumn("structural", F.lit(True)), strategies.select(F.col("conclusion").alias("id")).filter("id is not null").distinct().withColumn("derived", F.lit(True)),
        _each(strategies.select("premises").unionByName(ops.select(F.col("variables").alias("premises"))), "premises", "independent"), _each(strategies, "background", "background"),
    ]
    marked = reduce(lambda a, b: a.join(b, "id", "left"), marks, knowledges)
    role = F.when(F.col("type").isin(*NOTES), "note").when(F.col("type") == "question", "question")
    for name in ("structural", "derived", "independent", "background"):
        role = role.when(F.col(name), name)
    return marked.select("id", role.otherwise("orphaned").alias("role"))


def holes(claims: DataFrame, roles_of: DataFrame, records: DataFrame) -> DataFrame:
    """id of independent claims without a prior, of their own or recorded."""
    known = records.select(F.col("knowledge_id").alias("id")).distinct()
    return claims.filter("prior is null").join(roles_of.filter("role = 'independent'"), "id", "left_semi").join(known, "id", "left_anti").select("id")


def deltas(variables: DataFrame, beliefs: DataFrame) -> DataFrame:
    """variable, prior, belief, delta of variables whose prior takes part (none observed)."""
    known = variables.filter("prior is not null and hard is null").select("variable", "prior")
    return known.join(beliefs, "variable").select("variable", "prior", "belief", (F.col("belief") - F.col("prior")).alias("delta"))


def belief_drops(before: DataFrame, after: DataFrame, at_least: float = 0.2) -> DataFrame:
    """variable, before, after, drop where a belief fell by ``at_least``."""
    both = before.withColumnRenamed("belief", "before").join(after.withColumnRenamed("belief", "after"), "variable")
    return both.withColumn("drop", F.col("before") - F.col("after")).filter(F.col("drop") >= at_least)


def low_posteriors(goals: DataFrame, beliefs: DataFrame, least: float) -> DataFrame:
    """id, problem, belief of goals (id) whose belief is missing or under ``least``."""
    both = goals.join(beliefs.withColumnRenamed("variable", "id"), "id", "left")
    problem = F.when(F.col("belief").isNull(), "missing_belief").when(F.col("belief") < least, "low_posterior")
    return both.select("id", problem.alias("problem"), "belief").filter("problem is not null")


def unreached(edges: DataFrame, goals: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (id) from which no goal is reached: evidence without a connection to the focus."""
    found = graph.reaching(edges, goals.withColumnRenamed("id", "node"))
    return claims.select("id").join(found.withColumnRenamed("node", "id"), "id", "left_anti")


def ranked(rows: DataFrame, mode: str = "auto") -> DataFrame:
    """``rows`` (kind, severity, label) with ``rank``: kinds in the mode's order (unknown ones last),
    then severities, then labels."""
    table = RANKS.get(mode, RANKS["auto"])
    place = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    severe = F.create_map(*[F.lit(x) for pair in zip(SEVERITIES, range(3)) for x in pair])
    key = F.struct(F.coalesce(F.element_at(place, F.col("kind")), F.lit(len(table))).alias("k"), F.coalesce(F.element_at(severe, F.col("severity")), F.lit(9)).alias("s"), "label")
    return rows.withColumn("rank_key", key)


def gate(reviews: DataFrame, reachable: DataFrame) -> DataFrame:
    """target_id, status of targets (target_id) in ``reachable`` whose latest review doesn't accept."""
    from credograph.operators.reviews import latest

    return latest(reviews).filter("status != 'accepted'").join(reachable, "target_id", "left_semi").select("target_id", "status")
