"""The relations that the engine works on, as views of the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prior_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knowledge_id, source_id, value, created_at, pos: one record for each order of a customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("knowledge_id"), F.col("o_orderpriority").alias("source_id"), F.when(F.col("o_totalprice").isNotNull(), F.least(F.col("o_totalprice") / 1e6, F.lit(0.999))).alias("value"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("pos"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, status, round, pos: a review for each line of an order."""
    status = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "F", "accepted").otherwise("unreviewed")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target_id"), status.alias("status"), F.col("l_linenumber").alias("round"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


def conversation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.col("role").alias("actor"), F.col("text").alias("reason"))


def strategy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: suppliers and customers in nations, nations in regions."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    supplier = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent"))
    customer = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    return nation.unionByName(supplier).unionByName(customer)
