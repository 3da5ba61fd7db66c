"""Sum-of-squares online packing of documents into sequences of at most ``size`` tokens.

Every Spark partition is packed on its own while it is read, so nothing is shuffled. A document
(its ids and an end id) is cut into full sequences and one rest; the rest goes into the fill
level that makes the sum of squared counts of partly filled sequences smallest. The counts are
an array by level. Sequences still open at the end of a partition are poured into full ones,
and what then remains is cut into sequences whose lengths are powers of two, which need no
padding: at most 11 for each partition.

``sequence_id`` is the partition's number times 2^40 plus a counter, so it is the same whenever
the same input partitions are read. Memory: the open sequences' piece lists of one partition.

Defined cases: a null text counts as empty and yields its end id alone; repeated rows are packed
separately; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from credograph.llm.shared import small_batches
from credograph.llm.tokens import encoder, release

_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Open sequences by fill level. ``place`` and ``finish`` return closed sequences, each a
    list of pieces (document, start, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def level(self, length: int) -> int:
        """The level with least growth of the sum of squares if a piece is put there."""
        count = self.count
        new = count[length:].copy()  # counts at level + length
        new[-1] = 0
        gain = 2 * (new - count[: self.size + 1 - length])
        gain[-1] -= 1  # a full sequence leaves the array
        gain += 1
        gain[0] = 2 * int(count[length]) + 1 if length < self.size else 0
        gain[1:][count[1 : len(gain)] == 0] = np.iinfo(np.int64).max
        gain[1:] += gain[1:] < np.iinfo(np.int64).max
        # ties go to the fuller level
        return len(gain) - 1 - int(np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> list[list]:
        length = len(piece[2])
        if length == self.size:
            return [[piece]]
        at = self.level(length)
        if at:
            self.count[at] -= 1
            own = self.open[at].pop()
        else:
            own = []
        own.append(piece)
        if at + length == self.size:
            return [own]
        self.count[at + length] += 1
        self.open[at + length].append(own)
        return []

    def finish(self) -> Iterator[list]:
        rest, room = [], self.size
        left = int((self.count * np.arange(self.size + 1)).sum())
        for level in range(self.size, 0, -1):
            for own in self.open[level]:
                for doc, start, ids in own:
                    while len(ids):
                        if not rest:
                            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                        n = min(room, len(ids))
                        rest.append((doc, start, ids[:n]))
                        start, ids, room, left = start + n, ids[n:], room - n, left - n
                        if not room:
                            yield rest
                            rest = []


def _pack(path: str, id_col: str, text_col: str, end_id: int, size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(path), Packer(size)
        sequence = TaskContext.get().partitionId() << 40
        kind = None
        out: list[list] = [[] for _ in range(len(_COLUMNS) + 1)]

        def closed(sequences) -> None:
            nonlocal sequence
            for own in sequences:
                offset = 0
                for (doc, total), start, ids in own:
                    for column, x in zip(out, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)):
                        column.append(x)
                    offset += len(ids)
                sequence += 1

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(x, pa.int64()) for x in out[1:])], names=[id_col, *_COLUMNS])
            for x in out:
                x.clear()
            return done

        for b in batches:
            kind = b.schema.field(id_col).type
            ids_of, texts = b.column(b.schema.names.index(id_col)), b.column(b.schema.names.index(text_col))
            for doc, own in zip(ids_of, tokens.encode_all(texts)):
                ids = np.append(own, np.int32(end_id))
                key = (doc.as_py(), len(ids))
                for k in range(0, len(ids), size):
                    closed(packer.place((key, k, ids[k : k + size])))
                if len(out[0]) >= rows:
                    yield batch()
        if kind is not None:
            for one in packer.finish():
                closed([one])
                if len(out[0]) >= rows:
                    yield batch()
            yield batch()
        del tokens
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    own = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = own.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{c}` bigint" for c in _COLUMNS)
    return own.mapInArrow(_pack(tokenizer_path, id_col, text_col, end_id, size, 4096), schema)
