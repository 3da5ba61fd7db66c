"""Folders and tables that every executor can read, and small helpers on them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from credograph.sources.folders import shared_dir

#: Rows of an Arrow batch at most. Spark's own default, 10,000, makes batches of long texts large.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session sends at most ``BATCH_ROWS`` rows at once to Python,
    unless it is set to fewer, so that memory stays bounded when texts are long."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends here and a lost
    executor costs only the tasks that it was running."""
    return stored(df, new_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a finished intermediate table through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one job, in a folder that ``close`` removes when all who read them
    are done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, new_path(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        return stored(df, f"{self.path}/{self.made}-{name}")

    def close(self) -> None:
        delete(self.spark, self.path)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until it is none of ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_key(df: DataFrame, id_col: str) -> Column:
    """A 64-bit key of an id: whole numbers themselves, others by hash; null stays null."""
    own = F.col(id_col)
    whole = isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return own.cast("long") if whole else F.when(own.isNotNull(), F.xxhash64(own))
