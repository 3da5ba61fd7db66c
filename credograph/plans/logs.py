"""Queries on event logs in files, each with DuckDB's SQL. The files are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from credograph.operators import trace
from credograph.plans.checks import _name
from credograph.sources import event_logs, tables as T
from credograph.sources.folders import shared_dir

#: What is wrong with a customer's line, by its key; all others are good.
FAULTS = {3: "json decode", 5: "unknown kind", 7: "missing"}


def _written(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A log for each nation: its customers in order of their keys are the events. Every eleventh line
    by key has a fault; nations of region 1 have manifests without a name; and some roots are wrong."""
    # a small file is one split, but its lines take long to write: dealt out to all tasks
    c, n = T.table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism, "c_custkey"), T.table(spark, sf_dir, "nation")
    fault = F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") % 9)
    own = c.select(
        "c_nationkey", "c_custkey", fault.alias("fault"), _name("e", "c_custkey").alias("event_id"), F.col("c_custkey").alias("seq"), F.timestamp_seconds(F.col("c_custkey") * 3600).alias("ts"),
        F.when(F.col("c_acctbal") < 0, "retry").otherwise("decision").alias("kind"), F.col("c_mktsegment").alias("actor"), F.concat(F.lit('{"name":'), trace.json_text(F.col("c_name")), F.lit("}")).alias("inputs_json"),
        F.lit(None).cast("string").alias("outputs_json"), F.col("c_name").alias("reason"), F.concat(F.lit('[{"claim_id":"c","relation":"uses","review_id":"'), _name("r", F.col("c_custkey") % 7), F.lit('"}]')).alias("refs_json"),
        *[F.lit(None).cast("string").alias(x) for x in ("parent_event_id", "tool", "error")],
    )
    skip = ("c_nationkey", "c_custkey", "fault")
    good = trace.payload(own, skip)
    line = F.when(F.col("fault") == 3, F.concat(good, F.lit("}}"))).when(F.col("fault") == 5, F.regexp_replace(good, '"kind":"[a-z]+"', '"kind":"guess"')).when(F.col("fault") == 7, F.regexp_replace(good, '"actor":"[A-Z]+",', "")).otherwise(good)
    kept = own.filter(F.coalesce(~F.col("fault").isin(*FAULTS), F.lit(True)))
    roots = trace.events_root(kept.withColumn("trace_id", F.col("c_nationkey")), "c_custkey", (*skip, "trace_id"))
    header = n.select("n_nationkey", _name("log", "n_nationkey").alias("trace_id"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("arm_id")).join(roots.withColumnRenamed("trace_id", "key"), F.col("n_nationkey").cast("string") == F.col("key"), "left")
    header = header.select("n_nationkey", F.lit("1").alias("schema_version"), "arm_id", F.lit("s").alias("session_id"), "trace_id", F.timestamp_seconds(F.lit(0)).alias("created_at"), F.when(F.col("n_nationkey") % 4 == 0, "forged").otherwise(F.coalesce("root", F.lit(""))).alias("events_root"), F.lit(None).cast("string").alias("signature"))
    whole = header.withColumn("manifest_hash", F.lit(""))
    rows = whole.select(F.col("n_nationkey").alias("log"), F.lit(-1).cast("long").alias("at"), trace.payload(whole, ("n_nationkey",)).alias("value"))
    rows = rows.unionByName(own.select(F.col("c_nationkey").alias("log"), F.col("c_custkey").alias("at"), line.alias("value")))
    place = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    rows.repartition("log").sortWithinPartitions("log", "at").select("log", "value").write.partitionBy("log").text(place)
    found = event_logs.read(spark, place, "*.txt", "*.none")
    log = F.regexp_extract("file", r"/log=(\d+)/", 1).cast("int").alias("log")
    return {k: v.withColumn("log", log) for k, v in found.items()}


def log_issues(spark, sf_dir):
    found = _written(spark, sf_dir)["issues"]
    return found.select("log", F.regexp_replace("location", r"line:\d+", "line").alias("location"), "message").groupBy("log", "location", "message").agg(F.count("*").alias("n"))


def log_events(spark, sf_dir):
    found = _written(spark, sf_dir)["events"]
    return found.select("log", "event_id", "seq", F.unix_seconds("ts").alias("seconds"), "kind", "actor", "reason", F.col("refs")[0]["review_id"].alias("review_id"))


def log_references(spark, sf_dir):
    known = T.table(spark, sf_dir, "region").select(_name("r", "r_regionkey").alias("review_id"))
    return event_logs.unresolved_references(_written(spark, sf_dir)["events"], known).select("event_id", "seq", "place", "claim_id", "review_id")


def log_roots(spark, sf_dir):
    found = _written(spark, sf_dir)
    log = F.regexp_extract("file", r"/log=(\d+)/", 1).cast("int").alias("log")
    return event_logs.manifest_mismatches(found["manifests"].drop("log"), found["events"].drop("log")).select(log, "field", "declared")


_C = "(SELECT *, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 9 END AS fault FROM customer)"

SQL: dict[str, str] = {
    "log_issues": f"""SELECT c_nationkey AS log, CASE fault WHEN 3 THEN 'line' WHEN 5 THEN 'line.kind' ELSE 'line.actor' END AS location, CASE fault WHEN 3 THEN 'json decode' WHEN 5 THEN 'unknown kind' ELSE 'missing' END AS message, count(*) AS n FROM {_C} WHERE fault IN (3, 5, 7) GROUP BY ALL
UNION ALL SELECT n_nationkey, 'manifest.arm_id', 'must not be null', 1 FROM nation WHERE n_regionkey = 1""",
    "log_events": f"SELECT c_nationkey AS log, 'e' || c_custkey AS event_id, c_custkey AS seq, c_custkey * 3600 AS seconds, CASE WHEN c_acctbal < 0 THEN 'retry' ELSE 'decision' END AS kind, c_mktsegment AS actor, c_name AS reason, 'r' || c_custkey % 7 AS review_id FROM {_C} WHERE coalesce(fault, 0) NOT IN (3, 5, 7)",
    "log_references": f"SELECT 'e' || c_custkey AS event_id, c_custkey AS seq, 0 AS place, 'c' AS claim_id, 'r' || c_custkey % 7 AS review_id FROM {_C} WHERE coalesce(fault, 0) NOT IN (3, 5, 7) AND 'r' || c_custkey % 7 NOT IN (SELECT 'r' || r_regionkey FROM region)",
    "log_roots": "SELECT n_nationkey AS log, 'events_root' AS field, 'forged' AS declared FROM nation WHERE n_nationkey % 4 = 0 AND n_regionkey != 1",
}
ROWS_ONLY = ()
