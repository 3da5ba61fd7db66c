"""The gap check of event logs on a stream: state is one number for each log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _gaps(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seqs = sorted(s for part in parts for s in part["seq"].dropna().astype("int64"))
    last = state.get[0] if state.exists else -1
    found = []
    for seq in seqs:
        if seq != last + 1:
            found.append((key[0], seq, last + 1))
        last = seq
    if seqs:
        state.update((last,))
    yield pd.DataFrame(found, columns=["trace_id", "seq", "expected"]).astype({"seq": "int64", "expected": "int64"})


def sequence_gaps(events: DataFrame) -> DataFrame:
    """trace_id, seq, expected of events that don't follow the one before them, as
    ``trace.sequence_gaps`` finds them in a closed log. ``events`` is a stream whose micro-batches
    hold each log in order; within a micro-batch numbers are sorted. Memory follows one log's numbers of one
    micro-batch. Events without a number are ignored."""
    kind = events.schema["trace_id"].dataType.simpleString()
    picked = events.select("trace_id", events["seq"].cast("long").alias("seq")).where("trace_id is not null")
    return picked.groupBy("trace_id").applyInPandasWithState(_gaps, f"trace_id {kind}, seq long, expected long", "last long", "append", GroupStateTimeout.NoTimeout)
