"""Language identification by mixture inference.

Each language has a multinomial over hashed byte n-grams, counted in Spark from labelled texts.
For a document, expectation-maximisation estimates the proportions of all languages from the
n-grams' likelihoods. Then the sets of the first 1, 2, ... languages by proportion are fitted
alone and the set with the best likelihood, less half of log(n-grams) for each language and
scaled by ``penalty``, is chosen. Sets grow until no mixture could make up for one language
more, or up to ``max_set``. The prediction is the largest language of that set and the score its
proportion.

``accept`` also rejects on the chosen set's likelihood for each n-gram. The floor of a language
lies halfway between the mean over its training n-grams, each left out of the counts once, and
the mean over all buckets, which n-grams that have nothing to do with the language get. Short
texts get room of two standard errors; fewer than n n-grams, which all overlap, tell nothing.
``predict`` gives the best language in any case.

The model has ``buckets`` counts for each language, so its size is bounded by the number of
language tags; more than ``max_languages`` tags are refused with an error.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
if nothing could be learned; rows without a language are not learned from; repeated rows count
each; extra columns are ignored by ``predict`` and kept by ``accept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from credograph.llm.shared import small_batches, unused
from credograph.llm.spans import Group, groups, mix

UNKNOWN = "und"
#: Bytes of texts that a task counts or fits at once: a few arrays of ten to thirty times that are held.
_TRAINED, _READ = 1 << 19, 1 << 18
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(g: Group, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of a group and the document of each. Digits and ASCII signs count as
    blanks; none reaches over a document's end."""
    data = np.where(_ASCII_LETTER[g.data] | (g.data >= 128), g.data, np.uint8(32)).astype(np.uint64)
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = data[:m].copy()
    for k in range(1, n):
        h = (h << np.uint64(8)) | data[k : m + k]
    doc = np.repeat(np.arange(g.n), np.diff(g.bounds))
    same = doc[:m] == doc[n - 1 :]
    return (mix(h[same]) & np.uint64(buckets - 1)).astype(np.int64), doc[:m][same]


def _count(lang_col: str, text_col: str, n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.schema.names
            langs = batch.column(names.index(lang_col)).to_pylist()
            for g in groups(batch.column(names.index(text_col)), lower=True, limit=_TRAINED):
                codes, doc = grams(g, n, buckets)
                own = langs[g.first : g.first + g.n]
                order = {name: i for i, name in enumerate(dict.fromkeys(own))}
                which = np.array([order[x] for x in own], np.int64)[doc]
                for name, i in order.items():
                    total.setdefault(name, np.zeros(buckets, np.int64))
                    total[name] += np.bincount(codes[which == i], minlength=buckets)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return run


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, n: int):
        self.languages, self.n, self.buckets = languages, n, counts.shape[1]
        self.likelihood = None
        if not len(languages):
            return
        total = counts.sum(axis=1, keepdims=True)
        own = (counts + 0.5) / (total + 0.5 * self.buckets)
        self.likelihood = own.T.astype(np.float32).copy()
        left_out = np.log(np.maximum(counts - 0.5, 0.5) / (total - 1 + 0.5 * self.buckets))
        often = counts / total
        usual = (often * left_out).sum(axis=1)
        #: By language: the likelihood that parts its texts from others, and how much single n-grams differ.
        self.floor = (usual + np.log(own).mean(axis=1)) / 2
        self.spread = np.sqrt((often * (left_out - usual[:, None]) ** 2).sum(axis=1))

    def infer(self, g: Group, penalty: float, max_set: int | None, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language and its proportion for each document of a group, -1 without n-grams, and
        whether the n-grams are as likely under the chosen set as texts of that language are."""
        codes, doc = grams(g, self.n, self.buckets)
        size = len(self.languages)
        best, share, known = np.full(g.n, -1), np.zeros(g.n), np.ones(g.n, bool)
        table = np.bincount(doc * self.buckets + codes, minlength=g.n * self.buckets)
        cells = np.flatnonzero(table)
        if not len(cells) or not size:
            return best, share, known
        count = table[cells].astype(np.float32)
        row = cells // self.buckets
        docs, first = np.unique(row, return_index=True)
        row = np.searchsorted(docs, row)
        like = self.likelihood[cells % self.buckets]
        total = np.add.reduceat(count, first)

        def fit(weight: np.ndarray, times: int, row: np.ndarray, like: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = np.add.reduceat(count, first)
            for _ in range(times):
                part = weight[row] * like
                part *= (count / part.sum(axis=1))[:, None]
                weight = np.add.reduceat(part, first, axis=0) / n[:, None]
            mixed = (weight[row] * like).sum(axis=1)
            return weight, np.add.reduceat(count * np.log(mixed), first), mixed

        alone = np.add.reduceat(count[:, None] * np.log(like), first, axis=0)
        weight, logs, mixed = fit(np.full((len(docs), size), 1 / size, np.float32), rounds, row, like, count, first)
        # the likelihood is concave in the proportions, so no mixture comes over this
        slope = np.add.reduceat((count / mixed)[:, None] * like, first, axis=0).max(axis=1) / total
        bound = logs + total * np.log(np.maximum(slope, 1.0)) + 1e-5 * np.abs(logs)
        order = np.argsort(-weight, axis=1, kind="stable")
        chosen = np.argmax(alone, axis=1)
        reached = alone[np.arange(len(docs)), chosen].astype(np.float64)
        cost = penalty * 0.5 * np.log(total)
        value = reached - cost
        part = np.ones(len(docs))
        for k in range(2, min(size, max_set or size) + 1):
            rising = bound - k * cost > value
            at = np.flatnonzero(rising)
            if not len(at):
                break
            start = np.zeros((len(at), size), weight.dtype)
            np.put_along_axis(start, order[at, :k], 1.0, axis=1)
            start *= np.maximum(weight[at], 1e-3)
            start /= start.sum(axis=1, keepdims=True)
            some = rising[row]
            own_row = np.searchsorted(at, row[some])
            fitted, logs, _ = fit(start, rounds // 2, own_row, like[some], count[some], np.searchsorted(own_row, np.arange(len(at))))
            better = logs - k * cost[at] > value[at]
            top = np.argmax(fitted, axis=1)
            won = at[better]
            value[won], reached[won] = logs[better] - k * cost[won], logs[better]
            chosen[won], part[won] = top[better], fitted[better, top[better]]
        best[docs], share[docs] = chosen, part
        # n-grams that overlap aren't independent: n of them count as one
        room = 2 * self.spread[chosen] * np.sqrt(self.n / total)
        known[docs] = (total < self.n) | (reached / total >= self.floor[chosen] - room)
        return best, share, known


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 4, buckets: int = 1 << 13, max_languages: int = 1024) -> Model:
    own = small_batches(docs).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).filter("l is not null and t is not null")
    counts = own.mapInArrow(_count("l", "t", n, buckets), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    for lang, bucket, k in counts.toLocalIterator():
        if lang not in table:
            table[lang] = np.zeros(buckets, np.int64)
            if len(table) > max_languages:
                raise ValueError(f"more than {max_languages} languages; raise max_languages")
        table[lang][bucket] = k
    names = sorted(table)
    return Model(names, np.array([table[x] for x in names]).reshape(len(names), buckets), n)


def _predict(model, text_col: str, fields: list[str], added: list[str], penalty: float, max_set: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        limit = max(1 << 16, _READ // max(1, len(own.languages) // 4))
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col))
            langs, scores, clear = [UNKNOWN] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
            for g in groups(text, lower=True, limit=limit):
                best, share, known = own.infer(g, penalty, max_set)
                clear[g.first : g.first + g.n] = known
                ascii_first = np.concatenate(([0], np.cumsum(_ASCII_LETTER[g.data])))
                letters = ascii_first[g.bounds[1:]] > ascii_first[g.bounds[:-1]]
                for i in range(g.n):
                    if not letters[i] and not any(map(str.isalpha, text[g.first + i].as_py() or "")):
                        continue
                    if best[i] >= 0:
                        langs[g.first + i], scores[g.first + i] = own.languages[best[i]], min(1.0, share[i])
                    elif own.languages:
                        langs[g.first + i], scores[g.first + i] = own.languages[0], 1 / len(own.languages)
            passed = [batch.column(batch.schema.names.index(f)) for f in fields]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(langs, pa.string()), pa.array(scores), pa.array(clear)], names=[*fields, *added])

    return run


def _with_prediction(docs: DataFrame, model: Model, text_col: str, keep_text: bool, penalty: float, max_set: int | None) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns for language, score and whether its n-grams are likely; and these."""
    fields = [f for f in docs.schema if keep_text or f.name != text_col]
    added = unused(docs.columns, "lang_found", "lang_score", "lang_known")
    schema = T.StructType([*fields, *map(T.StructField, added, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    own = docs.sparkSession.sparkContext.broadcast(model)
    out = small_batches(docs).mapInArrow(_predict(own, text_col, [f.name for f in fields], added, penalty, max_set), schema)
    return out, [F.col(f"`{x}`") for x in added]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 4.0, max_set: int | None = None) -> DataFrame:
    """id, lang_pred and score of every document."""
    out, (lang, score, _) = _with_prediction(docs.select(id_col, text_col), model, text_col, False, penalty, max_set)
    return out.select(id_col, lang.alias("lang_pred"), score.alias("score"))


def accept(docs: DataFrame, model: Model, text_col: str = "text", languages: list[str] | None = None, penalty: float = 4.0, max_set: int | None = None) -> DataFrame:
    """``docs`` without those whose language is unknown, whose n-grams are too unlikely in it, or
    whose language is not one of ``languages``."""
    out, (lang, _, known) = _with_prediction(docs, model, text_col, True, penalty, max_set)
    wanted = (lang != UNKNOWN) & known
    if languages is not None:
        wanted = wanted & lang.isin(languages)
    return out.filter(wanted).select(*docs.columns)
