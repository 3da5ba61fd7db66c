"""Resolution of several prior records for one claim, and checks on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def matches(source: Column, pattern: str) -> Column:
    """A pattern is a name, a name's beginning before ``*`` at its end, or ``*`` alone."""
    if "*" in pattern[:-1]:
        raise ValueError(f"a star is allowed at the end only: {pattern}")
    return F.lit(True) if pattern == "*" else source.startswith(pattern[:-1]) if pattern.endswith("*") else source == pattern


def resolve(records: DataFrame, policy: str, sources: list[str] = (), cutoff: datetime | None = None) -> DataFrame:
    """The winning record of each knowledge_id. ``latest``: the newest; ``source``: the newest of
    the first pattern alone; ``explicit_priority``: the newest of the first pattern that matches.
    Records after ``cutoff`` don't count; one without a time counts as older than all others; of
    equal ones the first (least pos) wins. Winners are
    picked by an aggregate, which combines within tasks, so a claim with many records is no burden."""
    if cutoff is not None:
        records = records.filter(F.col("created_at") <= F.lit(cutoff))
    tier = F.lit(0)
    if policy != "latest":
        wanted = list(sources)[:1] if policy == "source" else list(sources)
        tier = F.coalesce(*[F.when(matches(F.col("source_id"), p), i) for i, p in enumerate(wanted)])
    ranked = records.withColumn("tier", tier).filter("tier is not null")
    best = F.min_by(F.struct("value", "source_id", "created_at"), F.struct("tier", -F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp_ltz")), F.lit(-(1 << 62))), "pos"))
    return ranked.groupBy("knowledge_id").agg(best.alias("w")).select("knowledge_id", "w.*")


def dissent(records: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Claims whose records differ by more than ``threshold``."""
    spread = records.groupBy("knowledge_id").agg(F.count("*").alias("n_records"), (F.max("value") - F.min("value")).alias("spread"))
    return spread.filter((F.col("n_records") >= 2) & (F.col("spread") > threshold))


def uncovered(claims: DataFrame, records: DataFrame) -> DataFrame:
    """Claims (knowledge_id) without a record."""
    return claims.join(records, "knowledge_id", "left_anti")
