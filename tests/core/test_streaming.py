import random

from credograph.operators import trace
from credograph.streaming import event_log


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(t, s) for t in range(6) for s in range(12) if rng.random() > 0.25]
    frames = [spark.createDataFrame([r for r in rows if low <= r[1] < low + 4], "trace_id long, seq long") for low in (0, 4, 8)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = event_log.sequence_gaps(spark.readStream.schema("trace_id long, seq long").parquet(source))
        done = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert done.awaitTermination(90)
    want = trace.sequence_gaps(spark.createDataFrame(rows, "trace_id long, seq long"))
    ordered = lambda df: sorted(tuple(r) for r in df.collect())
    assert ordered(spark.read.parquet(out)) == ordered(want) != []
