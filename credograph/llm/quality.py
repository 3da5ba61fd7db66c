"""Quality rules: fixed counts of a text, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams: one of trusted texts and one of
the raw corpus, both counted in Spark over all their documents. A text's score is the mean over
its n-grams of log(trusted / raw). The threshold is where scores of trusted and of distrusted
labelled documents that pass the fixed rules part best, found on a fixed grid of scores; it is
one number for all documents, so a verdict depends on the text and the model alone.

What is gathered is bounded by the number of buckets and of grid cells. Texts find their labels in
sorted arrays of the shared folder (``lookup``), so neither texts are shuffled nor labels sent out,
however many there are.

Defined cases: null texts have no words and no lines; a text without n-grams scores 0; without
trusted documents every score is 0 and without labels of both kinds the threshold is minus
infinity; repeated rows count each; a document with labels of both kinds is not trusted; labels
without id or verdict tell nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from credograph.llm import lookup
from credograph.llm.shared import delete, id_key, new_path, small_batches
from credograph.llm.spans import BLANKS, NEWLINE, Group, groups, hash_spans, mix, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOW, _HIGH, _CELLS = -4.0, 4.0, 8000


def grams(g: Group, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of a group, and the document of each. Blanks count alike and digits
    count alike; none reaches over a document's end."""
    data = np.where(BLANKS[g.data], np.uint8(32), g.data)
    data = np.where((data >= 48) & (data <= 57), np.uint8(48), data).astype(np.uint64)
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = data[:m].copy()
    for k in range(1, n):
        h = (h << np.uint64(8)) | data[k : m + k]
    doc = np.repeat(np.arange(g.n), np.diff(g.bounds))
    same = doc[:m] == doc[n - 1 :]
    return (mix(h[same]) & np.uint64(buckets - 1)).astype(np.int64), doc[:m][same]


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags)))
    return run[bounds[1:]] - run[bounds[:-1]]


def rules(g: Group) -> dict[str, np.ndarray]:
    """The fixed counts of each document of a group."""
    starts, ends, first = g.spans(BLANKS)
    n_words = np.diff(first)
    points = np.concatenate(([0], np.cumsum((g.data & 0xC0) != 0x80)))
    in_word = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
    # lines with a word; a line is told by its bytes
    line_start, line_end, first_line = g.spans(NEWLINE)
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    own_line = np.repeat(np.arange(g.n), np.diff(first_line))[full]
    lines = hash_spans(g.data, line_start, line_end)[full] if len(line_start) else np.zeros(0, np.uint64)
    distinct = np.unique(mix(lines + mix(own_line.astype(np.uint64))), return_index=True)[1]
    n_lines = np.bincount(own_line, minlength=g.n)
    dup = n_lines - np.bincount(own_line[distinct], minlength=g.n)
    # words in windows of three that occur twice or more in their document
    h = hash_spans(g.data, starts, ends)
    own = np.repeat(np.arange(g.n), n_words)
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        at = np.flatnonzero(own[:-2] == own[2:])
        key = mix(windows(h, 3)[at] + mix(own[at].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        np.add.at(again, hit, 1)
        np.add.at(again, hit + 3, -1)
    repeat = np.cumsum(again)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": in_word[first[1:]] - in_word[first[:-1]],
        "n_symbols": _per_doc(_SYMBOL[g.data], g.bounds),
        "n_dup_lines": dup,
        "n_repeat_words": _per_doc(repeat, first),
    }


def failed(r: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (r["n_words"] < 50) | (100 * r["n_repeat_words"] > 50 * r["n_words"])


class Ratio:
    """log(trusted / raw) by bucket, and the threshold of a text's mean."""

    def __init__(self, n: int, weights: np.ndarray, threshold: float = float("-inf")):
        self.n, self.weights, self.threshold = n, weights, threshold

    def scores(self, g: Group) -> np.ndarray:
        codes, doc = grams(g, self.n, len(self.weights))
        total = np.bincount(doc, minlength=g.n)
        return np.bincount(doc, self.weights[codes], g.n) / np.maximum(total, 1)


def _texts(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[Group]:
    return groups(batch.column(batch.schema.names.index("t")), limit=limit)


def _sums(docs: DataFrame, work, cells: int) -> np.ndarray:
    """Adds up in each task what ``work`` counts in (group of texts, their labels: -1 none, 0, 1)
    as an array of ``cells`` counts, and then over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            work(batch, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(cells, np.int64)
    for cell, k in docs.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[cell] = k
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, buckets: int = 1 << 15, shard: int = 1 << 20) -> Ratio:
    """Learn from all ``docs`` as raw corpus and from all ``labels`` (id, good as 0 or 1), which
    are kept in files of about ``shard`` of them."""
    spark = docs.sparkSession
    told = labels.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "good").filter("id is not null and good is not null")
    told = told.groupBy(id_key(told, "id").alias("key")).agg(F.min(F.col("good") == 1).cast("long").alias("value"))
    folder = new_path(spark, "labels")
    table = lookup.write(told, folder, shard)
    docs = small_batches(docs).select(id_key(docs, id_col).alias("k"), F.col(text_col).cast("string").alias("t")).filter("t is not null")

    def labelled(batch: pa.RecordBatch) -> np.ndarray:
        found, good = table.find(batch.column(batch.schema.names.index("k")))
        return np.where(found, good, -1)

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        good = labelled(batch)
        for g in _texts(batch):
            codes, doc = grams(g, n, buckets)
            total[:buckets] += np.bincount(codes, minlength=buckets)
            total[buckets:] += np.bincount(codes[good[g.first : g.first + g.n][doc] == 1], minlength=buckets)

    raw, trusted = _sums(docs, count, 2 * buckets).reshape(2, buckets)
    if not trusted.sum():
        delete(spark, folder)
        return Ratio(n, np.zeros(buckets))
    share = lambda c: (c + 1.0) / (c.sum() + buckets)
    model = Ratio(n, np.log(share(trusted)) - np.log(share(raw)))
    sent = spark.sparkContext.broadcast(model)

    def place(batch: pa.RecordBatch, total: np.ndarray) -> None:
        good = labelled(batch)
        some = np.flatnonzero(good >= 0)
        good = good[some]
        for g in groups(batch.column(batch.schema.names.index("t")).take(pa.array(some)), limit=1 << 21):
            cell = np.clip((sent.value.scores(g) - _LOW) / (_HIGH - _LOW) * _CELLS, 0, _CELLS).astype(np.int64)
            np.add.at(total, (cell * 2 + good[g.first : g.first + g.n])[~failed(rules(g))], 1)

    cells = _sums(docs, place, 2 * (_CELLS + 1)).reshape(-1, 2)
    delete(spark, folder)
    return Ratio(n, model.weights, best_cut(cells))


def best_cut(table: np.ndarray) -> float:
    """The grid score from which on texts are kept: most distrusted below it and trusted from
    it on, in shares of their kinds; of equal ones the middle."""
    bad, good = table.sum(axis=0)
    if not bad or not good:
        return float("-inf")
    below = np.concatenate((np.zeros((1, 2)), np.cumsum(table, axis=0)))
    value = below[:, 0] / bad - below[:, 1] / good
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return _LOW + float(best[len(best) // 2]) / _CELLS * (_HIGH - _LOW)


_RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _verdicts(model, fields: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio: Ratio = model.value
        for batch in batches:
            parts = []
            for g in _texts(batch):
                r = rules(g)
                score = ratio.scores(g)
                parts.append([*(r[c] for c in _RULES), failed(r), ~failed(r) & (score >= ratio.threshold), score])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2 + [np.zeros(0)]
            passed = [batch.column(batch.schema.names.index(f)) for f in fields]
            yield pa.RecordBatch.from_arrays([*passed, *map(pa.array, columns)], names=names)

    return run


def judge(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its counts, base_failed, kept, and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    names = [id_col, *_RULES, "base_failed", "kept", "score"]
    schema = T.StructType([own.schema.fields[0], *(T.StructField(c, T.LongType()) for c in _RULES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(_verdicts(sent, [id_col], names), schema)
