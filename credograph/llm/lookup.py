"""Tables of 64-bit keys and values that tasks search without a shuffle of what they search for.

The pairs are dealt to shards by key and each shard is written to the shared folder as sorted
arrays. Tasks memory-map the arrays and search a batch of keys at once. A shard has about ``size``
pairs however many there are, so a task holds one shard and the searching tasks hold none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credograph.llm import files


class Table:
    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there (null is not), and its value or 0."""
        there = keys.is_valid().to_numpy(zero_copy_only=False)
        own = keys.fill_null(0).to_numpy(zero_copy_only=False)
        found, values = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
        shard = np.mod(own, self.shards)
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for s, at in zip(names.tolist(), np.split(order, first[1:])):
            sorted_keys = files.mapped(f"{self.folder}/keys-{s}", np.int64)
            if len(sorted_keys):
                place = np.minimum(np.searchsorted(sorted_keys, own[at]), len(sorted_keys) - 1)
                hit = sorted_keys[place] == own[at]
                found[at] = hit
                values[at[hit]] = files.mapped(f"{self.folder}/values-{s}", np.int64)[place[hit]]
        found &= there
        return found, np.where(found, values, 0)


def write(rows: DataFrame, folder: str, size: int = 1 << 20) -> Table:
    """``rows`` has distinct keys in column key (bigint, not null) and values in column value."""
    rows = rows.select(F.col("key").cast("long"), F.col("value").cast("long"))
    # an odd number, so that ids with a common factor spread too
    shards = int(rows.count()) // size | 1
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            key, value, shard = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for s in np.unique(shard).tolist():
                parts.setdefault(s, []).append((key[shard == s], value[shard == s]))
        for s, own in parts.items():
            key, value = (np.concatenate(x) for x in zip(*own))
            order = np.argsort(key)
            files.write_array(f"{folder}/keys-{s}", key[order])
            files.write_array(f"{folder}/values-{s}", value[order])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32())], names=["shard"])

    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    made = {r.shard for r in dealt.mapInArrow(run, "shard int").collect()}  # one number a shard
    for s in set(range(shards)) - made:
        files.write_array(f"{folder}/keys-{s}", np.zeros(0, np.int64))
        files.write_array(f"{folder}/values-{s}", np.zeros(0, np.int64))
    return Table(folder, shards)
