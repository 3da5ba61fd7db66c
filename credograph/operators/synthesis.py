"""What speaks against each reviewed item, and how much is at risk.

``items``: target_id, premises, conclusion. ``findings``: finding, kind, severity, target_ids (array).
A finding touches an item by equal ids, never by a part of an id. ``deltas``: claim, delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def related(items: DataFrame, findings: DataFrame) -> DataFrame:
    """target_id, finding, kind, severity, of_premise, of_target for each finding that touches the
    item's own id, a premise or the conclusion; one row each, however often it does."""
    part = lambda c, name: F.transform(c, lambda x: F.struct(x.alias("id"), F.lit(name).alias("part")))
    ids = F.concat(part(F.array("target_id"), "target"), part(F.coalesce("premises", F.array().cast("array<string>")), "premise"), part(F.array("conclusion"), "conclusion"))
    touched = findings.select("finding", "kind", "severity", F.explode(F.array_distinct("target_ids")).alias("id"))
    both = items.select("target_id", F.inline(ids)).join(touched, "id")
    has = lambda name: F.max(F.col("part") == name)
    return both.groupBy("target_id", "finding", "kind", "severity").agg(has("premise").alias("of_premise"), has("target").alias("of_target"))


def risks(items: DataFrame, findings: DataFrame, deltas: DataFrame) -> DataFrame:
    """target_id, n_findings, chain (premises without prior, a blocked path and a moved conclusion,
    counted), delta of the conclusion (null if unknown), risk (high, medium, low)."""
    any_of = lambda c: F.max(c.cast("int"))
    hole, blocked = (F.col("kind") == "prior_hole") & F.col("of_premise"), (F.col("kind") == "blocked_warrant_path") & F.col("of_target")
    own = related(items, findings).groupBy("target_id").agg(F.count("*").alias("n"), F.count_if(hole).alias("holes"), any_of(blocked).alias("blocked"), any_of(F.col("severity") == "error").alias("error"), any_of(F.col("severity") == "warning").alias("warning"))
    rows = items.select("target_id", "conclusion").join(own, "target_id", "left").join(deltas.select(F.col("claim").alias("conclusion"), "delta"), "conclusion", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    moved = F.coalesce(F.abs("delta"), F.lit(0.0))
    rows = rows.select("target_id", zero("n").alias("n_findings"), (zero("holes") + zero("blocked") + (moved > 0.05).cast("int")).alias("chain"), "delta", moved.alias("moved"), zero("error").alias("error"), zero("warning").alias("warning"))
    risk = F.when((F.col("error") == 1) | (F.col("moved") > 0.2) | (F.col("chain") >= 3), "high").when((F.col("warning") == 1) | (F.col("moved") > 0.1) | (F.col("chain") >= 2), "medium").otherwise("low")
    return rows.select("target_id", "n_findings", "chain", "delta", risk.alias("risk"))


def ungrounded(decisions: DataFrame) -> DataFrame:
    """trace_id, seq, problem of decisions (trace_id, seq, reason, inputs as an array of texts) without
    a reason, or whose reason shares no word with their inputs; without inputs any reason will do."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    reason, inputs = F.coalesce(F.col("reason"), F.lit("")), F.coalesce("inputs", F.array().cast("array<string>"))
    problem = F.when(F.size(words(reason)) == 0, "no_reason").when((F.size(inputs) > 0) & ~F.arrays_overlap(words(reason), words(F.array_join(inputs, " "))), "no_shared_word")
    return decisions.select("trace_id", "seq", problem.alias("problem")).filter("problem is not null")
