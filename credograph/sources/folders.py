"""The folder that driver and executors share, and the end of long lineages there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rounds after which rows are read back from a table.
_ROUNDS = 4
#: Bytes of an Arrow batch of nested rows. As Python objects they take about ten times as much; Spark's own 64 MB would be most of a worker.
_BATCH = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or the one that the session
    was given by ``setCheckpointDir``.

    A local session without either (tests, a laptop) gets a temporary folder, which it keeps; on
    a cluster this is an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="credograph-")
        found = _OWN[app]
    return found.rstrip("/")


def cut(df: DataFrame, k: int = 0) -> DataFrame:
    """``df`` without its lineage: written to the shared folder, so a lost executor costs only the
    tasks it was running, and plans don't grow from round to round.

    ``k`` is the number of a round that joins the rows of the round before with rows made of them. A
    join's size is taken to be the product of its sides', and a checkpoint keeps what was taken, so the
    number's digits would double each round. A table's size is known: each ``_ROUNDS``-th round is one."""
    spark = df.sparkSession
    if k % _ROUNDS == _ROUNDS - 1:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session sends at most about ``_BATCH`` bytes at once to Python, unless it
    is set to fewer, so that a worker's memory doesn't follow the number of rows of its task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    told = conf.get(name, "64m").rstrip("b")
    if not (told.isdigit() and 0 < int(told) <= _BATCH):
        conf.set(name, _BATCH)
    return df


def apart(df: DataFrame) -> DataFrame:
    """``df`` to be joined by shuffles. Rows made of a small table are taken to be as small as it is, and
    would all be sent to the driver to be broadcast."""
    return df.hint("merge")
