"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

Counts are made in two passes. The first counts words; their sorted 64-bit hashes are the
vocabulary, and a word's place there is its number. The second counts pairs of numbers, which are
told apart by a 64-bit hash of both. Both are added up within each task first, then dealt out to
shards, one to a partition, and each shard is written as sorted hash arrays to the shared folder.
Scoring tasks memory-map these arrays and search them for all words of a group of documents at
once.

A pair's shard follows from its first word, so what a context needs (its total and how many
pairs occur once, twice or more often) is added up there; pairs of words with more than a
shard's share of the tokens are spread over all shards. The number of shards grows with the
tokens, so a task holds a bounded number of pairs however large the corpus is.

The text's end is a token of its own and also the first word's context. Words that were not
learned have the probability that the discounts of the continuation counts leave for them.

Defined cases: a null or empty text is its end alone; repeated rows count each; with nothing to
learn from every token has probability 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credograph.llm import files
from credograph.llm.shared import new_path, small_batches
from credograph.llm.spans import BLANKS, Group, groups, hash_words, mix

END = hash_words([b"\n"])[0]
_HELD = 2_000_000
def with_ends(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a group, each document's followed by an end, and first tokens' places."""
    h, first = g.words(BLANKS)
    return np.insert(h, first[1:], END), first + np.arange(g.n + 1)


class _Sum:
    """Counts by key, added up whenever many have been put in. Each key may bring columns, which
    are the same wherever it occurs."""

    def __init__(self, most: int) -> None:
        self.most, self.held = most, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def put(self, keys: np.ndarray, counts: np.ndarray, *columns: np.ndarray) -> None:
        self.parts.append((keys, counts, *columns))
        self.held += len(keys)
        if self.held > self.most:
            self.take()

    def take(self) -> tuple[np.ndarray, ...]:
        """Sorted keys, their counts so far, and their columns; all stay."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts, *columns = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[order], at) if len(at) else counts
        self.parts = [(keys[at], sums, *(x[order[at]] for x in columns))]
        self.held = len(at)
        return self.parts[0]


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash that tells a pair of word numbers."""
    return mix(mix(first.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64))


def _rows(shard: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(shard), 200_000):
        s = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(shard[s].astype(np.int32)), *(pa.array(x[s].view(np.int64)) for x in columns)], names=["shard", *names])


_COUNTS = "shard int, key bigint, c bigint"
_PAIRS = "shard int, first binary, second binary, c binary"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as many bytes each (1, 2, 4 or 8) as the largest needs."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w - (w == 8))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _pair_rows(shard: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, most: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Pairs by shard and first number, many in a row, so that little is written for each."""
    order = np.lexsort((first, shard))
    shard, first, second, counts = shard[order], first[order], second[order], counts[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else []
    rows: list[tuple] = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        for k in range(i, j, most):
            s = slice(k, min(k + most, j))
            rows.append((int(shard[i]), packed(np.diff(first[s], prepend=0)), packed(second[s]), packed(counts[s])))
            if len(rows) >= 1000 or s.stop == len(shard):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "first", "second", "c"])
                rows = []


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.names.index("t"))


def _added_up(batches: Iterator[pa.RecordBatch], put, rows, most: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's keys; what it holds is sent on whenever it stays too much."""
    total = _Sum(most)
    for batch in batches:
        for g in groups(_text(batch), limit=1 << 22, lower=True):
            put(total, g)
            if total.held > 2 * most // 3 and len(total.parts) == 1:
                yield from rows(total.take())
                total = _Sum(most)
    yield from rows(total.take())


def _by_shard(batches: Iterator[pa.RecordBatch], put) -> dict[int, _Sum]:
    """The counts of the shards in a partition."""
    out: dict[int, _Sum] = {}
    for batch in batches:
        shard, *columns = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        order = np.argsort(shard, kind="stable")
        shard, columns = shard[order], [x[order] for x in columns]
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            put(out.setdefault(int(shard[i]), _Sum(_HELD)), *(x[i:j] for x in columns))
    return out


class Words:
    """The vocabulary: sorted hashes in shards by their first bits, and counts beside them."""

    def __init__(self, folder: str, bits: int, sizes: list[int], tokens: int, part: int):
        self.folder, self.bits, self.tokens, self.part = folder, bits, tokens, part
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.size = int(self.first[-1])

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: not learned) and counts of words by hash."""
        distinct, inverse = np.unique(h, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        shard = self.shard(distinct)
        cuts = np.searchsorted(shard, np.arange(len(self.first)))
        for s in np.unique(shard).tolist():
            own = distinct[cuts[s] : cuts[s + 1]]
            keys = files.mapped(f"{self.folder}/words-{s}", np.uint64)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            part = np.arange(cuts[s], cuts[s + 1])[hit]
            number[part] = at[hit] + self.first[s]
            count[part] = files.mapped(f"{self.folder}/counts-{s}", np.int64)[at[hit]]
        return number[inverse], count[inverse]


def count_words(docs: DataFrame, folder: str, tokens_guess: int, part: int, most: int) -> Words:
    """``docs`` has the texts in column t."""
    bits = max(0, (max(tokens_guess // 20, 1) // part).bit_length())
    shape = Words(folder, bits, [0] * (1 << bits), 0, part)

    def count(batches):
        put = lambda total, g: total.put(*np.unique(with_ends(g)[0], return_counts=True))
        return _added_up(batches, put, lambda found: _rows(shape.shard(found[0]), [*found[:2]], ["key", "c"]), most)

    def write(batches):
        own = _by_shard(batches, lambda total, key, c: total.put(key.view(np.uint64), c))
        for s, total in own.items():
            keys, counts = total.take()[:2]
            files.write_array(f"{folder}/words-{s}", keys)
            files.write_array(f"{folder}/counts-{s}", counts)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["shard", "key", "c"])

    made = docs.mapInArrow(count, _COUNTS).repartitionById(1 << bits, "shard").mapInArrow(write, _COUNTS).collect()
    sizes, tokens = [0] * (1 << bits), 0
    for s, size, n in made:
        sizes[s], tokens = size, tokens + n
    for s in range(1 << bits):
        if not sizes[s]:
            files.write_array(f"{folder}/words-{s}", np.zeros(0, np.uint64))
            files.write_array(f"{folder}/counts-{s}", np.zeros(0, np.int64))
    return Words(folder, bits, sizes, tokens, part)


def _discounts(n: list[int]) -> list[float]:
    """Discounts for counts of 1, 2 and more, from how many things occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


class Model:
    def __init__(self, words: Words, shards: int, pairs: list[int]):
        self.words, self.shards = words, shards
        self.discount = np.array([0.0, *_discounts(pairs)])
        self.lower = np.zeros(4)
        self.kinds, self.spare = 0, 0.0
        #: Words with more tokens than this have their pairs spread over all shards.
        self.hot = max(words.tokens // max(shards, 1), 1)

    def shard(self, first: np.ndarray, second: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        spread = np.where(tokens > self.hot, second + 1, 0).astype(np.uint64)
        return (mix(mix(first.astype(np.uint64)) + spread) % np.uint64(self.shards)).astype(np.int64)

    def stat(self, name: str, number: np.ndarray) -> np.ndarray:
        """Rows of a table by word number, in files of ``words.part`` rows."""
        out = np.zeros((len(number), 5), np.int64)
        part = number // self.words.part
        for p in np.unique(part).tolist():
            own = part == p
            out[own] = files.mapped(f"{self.words.folder}/{name}-{p}", np.int64).reshape(-1, 5)[number[own] - p * self.words.part]
        return out

    def pair_counts(self, first: np.ndarray, second: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        key, shard = pair_key(first, second), self.shard(first, second, tokens)
        order = np.lexsort((key, shard))
        out = np.zeros(len(key), np.int64)
        shard, key = shard[order], key[order]
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            own = key[cuts[s] : cuts[s + 1]]
            keys = files.mapped(f"{self.words.folder}/pairs-{s}", np.uint64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                out[order[cuts[s] : cuts[s + 1]][hit]] = files.mapped(f"{self.words.folder}/times-{s}", np.int64)[at[hit]]
        return out

    def score(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every token, and its count among those learned from."""
        number, count = self.words.find(h)
        if not self.kinds:
            return np.zeros(len(h)), count
        context = np.concatenate((number[:1], number[:-1]))
        tokens = np.concatenate((count[:1], count[:-1]))
        end, of_end = self.words.find(np.array([END], np.uint64))
        context[first[:-1]], tokens[first[:-1]] = end[0], of_end[0]
        known = number >= 0
        stats = np.zeros((len(h), 5), np.int64)
        distinct, inverse = np.unique(number[known], return_inverse=True)
        stats[known] = self.stat("stats", distinct)[inverse]
        follows = stats[:, 4]
        kept = np.maximum(follows - self.lower[np.minimum(follows, 3)], 0)
        below = kept / self.kinds + self.spare / (self.words.size + 1)
        some = np.flatnonzero(context >= 0)
        distinct, inverse = np.unique(context[some], return_inverse=True)
        own = self.stat("stats", distinct)[inverse]
        total = own[:, 0]
        some, own, total, inverse = some[total > 0], own[total > 0], total[total > 0], None
        times = np.zeros(len(some), np.int64)
        both = np.flatnonzero(number[some] >= 0)
        times[both] = self.pair_counts(context[some][both], number[some][both], tokens[some][both])
        left = own[:, 1:4] @ self.discount[1:]
        p = below.copy()
        p[some] = (np.maximum(times - self.discount[np.minimum(times, 3)], 0) + left * below[some]) / total
        return np.log10(p), count


def train(docs: DataFrame, text_col: str = "text", word_shard: int = 1_000_000, pair_shard: int = 2_000_000, held: int = _HELD) -> Model:
    """Count ``docs`` and write the model to the shared folder: about ``word_shard`` words or
    ``pair_shard`` tokens to a file; tasks add up about ``held`` counts before they send them."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col(text_col).cast("string").alias("t"))
    folder = new_path(spark, "kneser-ney")
    files.make_folder(folder)
    guess = docs.select(F.sum(F.octet_length("t")) / 6).first()[0] or 0
    words = count_words(docs, folder, int(guess), word_shard, held)
    if not words.size:
        return Model(words, 1, [0] * 4)
    shards = max(1, -(-words.tokens // pair_shard))
    shape = Model(words, shards, [0] * 4)

    def pairs(total: _Sum, g: Group) -> None:
        h, first = with_ends(g)
        number, _ = words.find(h)
        context = np.concatenate((number[:1], number[:-1]))
        context[first[:-1]] = words.find(np.array([END], np.uint64))[0][0]
        keys, at, counts = np.unique(pair_key(context, number), return_index=True, return_counts=True)
        total.put(keys, counts, context[at], number[at])

    def rows(found: tuple) -> Iterator[pa.RecordBatch]:
        _, times, a, b = found
        return _pair_rows(shape.shard(a, b, tokens_of(a)), a, b, times)

    def tokens_of(number: np.ndarray) -> np.ndarray:
        out = np.zeros(len(number), np.int64)
        distinct, inverse = np.unique(number, return_inverse=True)
        shard = np.searchsorted(words.first, distinct, "right") - 1
        counts = np.zeros(len(distinct), np.int64)
        for s in np.unique(shard).tolist():
            counts[shard == s] = files.mapped(f"{folder}/counts-{s}", np.int64)[distinct[shard == s] - words.first[s]]
        out[:] = counts[inverse]
        return out

    def count(batches):
        return _added_up(batches, pairs, rows, held)

    def write(batches):
        shards: dict[int, _Sum] = {}
        for batch in batches:
            for s, *raw in zip(*(x.to_pylist() for x in batch.columns)):
                a, b, c = map(unpacked, raw)
                a = np.cumsum(a)
                shards.setdefault(s, _Sum(_HELD)).put(pair_key(a, b), c, a, b)
        for s, total in shards.items():
            keys, times, a, b = total.take()
            files.write_array(f"{folder}/pairs-{s}", keys)
            files.write_array(f"{folder}/times-{s}", times)
            order = np.argsort(a, kind="stable")
            a, b, times = a[order], b[order], times[order]
            at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            seen = [np.add.reduceat(x.astype(np.int64), at) for x in (times, times == 1, times == 2, times >= 3)]
            second, n = np.unique(b, return_counts=True)
            none = np.zeros(len(second), np.int64)
            columns = [np.concatenate((a[at], second)), *(np.concatenate((x, none)) for x in seen), np.concatenate((np.zeros(len(at), np.int64), n))]
            for i in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in columns], names=_STAT)
            ones = [int((times == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, *ones, len(keys))], names=_STAT)

    schema = ", ".join(f"{c} bigint" for c in _STAT)
    found = docs.mapInArrow(count, _PAIRS).repartitionById(shards, "shard").mapInArrow(write, schema)
    stats = found.groupBy("word").agg(*(F.sum(c).alias(c) for c in _STAT[1:]))
    parts = -(-words.size // word_shard)

    def write_stats(batches):
        tables: dict[int, np.ndarray] = {}
        ones = np.zeros(5, np.int64)
        for batch in batches:
            word = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns[1:]], axis=1)
            ones += rows[word < 0].sum(axis=0)
            for p in np.unique(word[word >= 0] // word_shard).tolist():
                if p not in tables:
                    tables[p] = np.zeros((min(word_shard, words.size - p * word_shard), 5), np.int64)
                own = (word >= 0) & (word // word_shard == p)
                tables[p][word[own] - p * word_shard] = rows[own]
        for p, table in tables.items():
            files.write_array(f"{folder}/stats-{p}", table)
            follows = table[:, 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (p, *(int((follows == k).sum()) for k in (1, 2, 3, 4)), int(follows.sum()))], names=_STAT)
        if ones.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, *ones.tolist())], names=_STAT)

    by_part = stats.repartitionById(parts, F.pmod(F.floor(F.col("word") / F.lit(word_shard)), F.lit(parts)).cast("int"))
    made = by_part.mapInArrow(write_stats, schema).collect()
    model = Model(words, shards, [sum(r[k] for r in made if r[0] < 0) for k in (1, 2, 3, 4)])
    follows = [sum(r[k] for r in made if r[0] >= 0) for k in (1, 2, 3, 4)]
    model.kinds = sum(r[5] for r in made if r[0] >= 0)
    model.lower = np.array([0.0, *_discounts(follows)])
    kinds = [follows[0], follows[1], words.size - follows[0] - follows[1]]
    model.spare = float(np.dot(model.lower[1:], kinds)) / model.kinds
    missing = set(range(shards)) - set(_written(folder, "pairs-"))
    for s in missing:
        files.write_array(f"{folder}/pairs-{s}", np.zeros(0, np.uint64))
        files.write_array(f"{folder}/times-{s}", np.zeros(0, np.int64))
    return model


def _written(folder: str, prefix: str) -> list[int]:
    from pyarrow import fs

    store, path = files.at(folder)
    names = (x.base_name for x in store.get_file_info(fs.FileSelector(path)))
    return [int(x[len(prefix) :]) for x in names if x.startswith(prefix) and x[len(prefix) :].isdigit()]


_STAT = ["word", "total", "once", "twice", "more", "follows"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score (add-half unigrams), score (log10 of the model) and
    perplexity of every document."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    docs = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = own.value
        for batch in batches:
            parts = []
            for g in groups(_text(batch), limit=1 << 22, lower=True):
                h, first = with_ends(g)
                logs, count = m.score(h, first)
                base = np.log10((count + 0.5) / (m.words.tokens + 0.5 * (m.words.size + 1)))
                at = first[:-1]
                parts.append((np.diff(first), np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)))
            n, known, base, logs = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(logs.astype(float)), pa.array(10.0 ** (-logs / np.maximum(n, 1)))],
                names=[id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
