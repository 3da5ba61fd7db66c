"""Review rounds: the latest status of a target, gates, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest(reviews: DataFrame) -> DataFrame:
    """target_id and the status of its highest round; of equal rounds the first (least ``pos``, or
    least status where there is none) counts."""
    first = F.col("pos") if "pos" in reviews.columns else F.col("status")
    return reviews.groupBy("target_id").agg(F.min_by("status", F.struct(-F.col("round"), first)).alias("status"), F.max("round").alias("round"))


def gate(targets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Targets whose latest status is accepted; targets without a label pass as well."""
    accepted = latest(reviews).filter("status = 'accepted'").select("target_id")
    return targets.filter("label is null").unionByName(targets.filter("label is not null").join(accepted, "target_id", "left_semi"))


def status_counts(reviews: DataFrame) -> DataFrame:
    """Number of targets by latest status."""
    return latest(reviews).groupBy("status").agg(F.count("*").alias("n_targets"))


def risk(rows: DataFrame, delta: str, chain: str) -> DataFrame:
    """``rows`` with a risk level by the size of a belief's change and the length of its chain."""
    size = F.abs(delta)
    level = F.when((size > 0.2) | (F.col(chain) >= 3), "high").when((size > 0.1) | (F.col(chain) >= 2), "medium").otherwise("low")
    return rows.withColumn("risk", level)
