"""Hard negatives by exact search behind a table of pivot distances.

1. Components become whole numbers. With ``M`` the greatest length of all vectors, a row y is
   lengthened by the component sqrt(M^2 - |y|^2) and a query q by 0; then |q - y|^2 =
   |q|^2 + M^2 - 2 q.y, so that large inner products are small distances.
2. A few rows far from one another are pivots. Every row's distances to them are stored, rows in
   order of label, nearest pivot and distance to it, in blocks of at most ``BLOCK`` rows in the
   shared folder. A block's least and greatest distances to each pivot are kept beside it.
3. By the triangle inequality |d(q, p) - d(y, p)| <= d(q, y) <= d(q, p) + d(y, p), so the stored
   distances bracket every score. Queries go to tasks with their like; a task leaves out blocks
   whose bracket (or label) lies outside what is asked for or can't better the results so far, then
   rows by the same rule, and takes the exact product of the rest.

Pivots are chosen among the ``SAMPLE`` rows whose ids hash least; they decide what is left out
early, never the result. Every row is in the index and every query meets every block in its
bracket. What a task holds is a slice of a block and a few hundred queries; a label or a vector
that a third of the rows share fills more blocks, not larger ones.

Defined cases: rows with a null id, a null label, a null vector or a component that is null or not
finite take no part; shorter vectors count as followed by zeros; rows of one id are rows of their
own, and a row is never its own positive; equal scores are ordered by id; an empty table gives no
rows; other columns are ignored. A greatest squared length of 2^63 and more is refused, as scores
would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from credograph.llm import files
from credograph.llm.shared import id_key, new_path, small_batches, stored, written

PIVOTS, SAMPLE, BLOCK = 16, 1024, 32_768
#: Queries that a task compares at once, and rows of a block.
_QUERIES, _ROWS = 256, 4096
LOWEST, HIGHEST = -(2**63), 2**63 - 1
_FIELDS = (("rows", np.int64), ("ids", np.int64), ("labels", np.int64), ("vectors", np.int64), ("distances", np.float64))


@dataclass(frozen=True)
class Index:
    """Blocks in ``folder``; their names and bounds are its files ``names`` and ``bounds``."""

    folder: str
    blocks: int
    dims: int
    square: int  # the greatest squared length
    pivots: np.ndarray  # whole numbers

    def bounds(self) -> np.ndarray:
        """For each block: least and greatest label, then least and greatest distance to each pivot."""
        return files.mapped(f"{self.folder}/bounds", np.float64).reshape(self.blocks, 2 + 2 * len(self.pivots))

    def labels(self) -> np.ndarray:
        return files.mapped(f"{self.folder}/names", np.int64).reshape(self.blocks, 4)

    def block(self, number: int) -> dict[str, np.ndarray]:
        partition, k = self.labels()[number, :2].tolist()
        out = {name: files.mapped(f"{self.folder}/{name}-{partition}-{k}", kind) for name, kind in _FIELDS}
        return out | {"vectors": out["vectors"].reshape(len(out["rows"]), self.dims), "distances": out["distances"].reshape(len(out["rows"]), len(self.pivots))}

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products: doubles hold whole numbers below 2^53."""
        if self.square < 2**53:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """(row, id, label, v) of the rows that take part, v whole numbers; written to the shared folder."""
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    own = own.select(F.col(id_col).cast("long").alias("id"), id_key(vectors, label_col).alias("label"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale)).alias("v"))
    return written(own.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, zeros after the shorter ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None] < sizes[:, None]] = flat
    return out


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each farthest from those before."""
    if not len(sample):
        return sample
    values = sample.astype(np.float64)
    chosen = [0]
    gap = ((values - values[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((values - values[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def build(rows: DataFrame, pivots: int = PIVOTS, block: int = BLOCK) -> Index:
    """The index of all ``rows`` (see ``prepared``)."""
    spark = rows.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
    if n and most >= 2.0**63:
        raise ValueError("components too large: scores would leave 64 bits")
    dims = dims or 0
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks() if n else None
    sample = _matrix(sample, dims) if n else np.zeros((0, 0), np.int64)
    chosen = _far_apart(sample, pivots)
    if n:  # exactly
        (square,) = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)")))).first()
    index = Index(new_path(spark, "pivot-index"), 0, dims, int(square) if n else 0, chosen)
    files.make_folder(index.folder)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _row_distances(index, _matrix(batch.column(3), dims))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["row", "id", "label", "v", "near", "gap"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, k, partition = [], 0, 0, TaskContext.get().partitionId()

        def flush():
            nonlocal held, size, k
            v = np.concatenate([_matrix(x.column(3), dims) for x in held])
            row, own, label = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(3))
            d = _row_distances(index, v)
            for name, values in zip((x for x, _ in _FIELDS), (row, own, label, v, d)):
                files.write_array(f"{index.folder}/{name}-{partition}-{k}", values)
            bounds = [float(label.min()), float(label.max()), *d.min(0).tolist(), *d.max(0).tolist()]
            out = pa.RecordBatch.from_pydict({"name": pa.array([[partition, k, int(label.min()), int(label.max())]], pa.list_(pa.int64())), "bounds": pa.array([bounds], pa.list_(pa.float64()))})
            held, size, k = [], 0, k + 1
            return out

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == block:
                    yield flush()
        if size:
            yield flush()

    kinds = "row long, id long, label long, v array<bigint>, near int, gap double"
    order = ("label", "near", "gap", "id", "row")
    placed = small_batches(rows).select("row", "id", "label", "v").mapInArrow(measure, kinds)
    if n > block:
        placed = placed.repartitionByRange(-(-n // block), *order)
    else:
        placed = placed.coalesce(1)
    made = placed.sortWithinPartitions(*order).mapInArrow(save, "name array<bigint>, bounds array<double>").collect()  # one row a block
    made.sort(key=lambda r: r.name)
    files.write_array(f"{index.folder}/names", np.array([r.name for r in made], np.int64).ravel())
    files.write_array(f"{index.folder}/bounds", np.array([r.bounds for r in made], np.float64).ravel())
    return Index(index.folder, len(made), dims, index.square, chosen)


def _row_distances(index: Index, v: np.ndarray) -> np.ndarray:
    """Of lengthened rows to lengthened pivots."""
    rest = lambda x: np.sqrt(np.maximum(index.square - (x.astype(np.float64) ** 2).sum(1), 0))
    square = 2.0 * index.square - 2.0 * index.products(v, index.pivots) - 2.0 * np.outer(rest(v), rest(index.pivots))
    return np.sqrt(np.maximum(square, 0))


def _ranked(query: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's ``k`` best, by query, then score downwards, then id."""
    order = np.lexsort((own, -score, query))
    q = query[order]
    fresh = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(fresh, np.diff(np.append(fresh, len(q))))
    return order[rank < k]


class _Search:
    """The best rows for a few queries, block after block."""

    def __init__(self, index: Index, v: np.ndarray, label: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.index, self.v, self.label, self.row, self.lo, self.hi, self.k, self.same = index, v, label, row, lo, hi, k, same
        self.reach = (v.astype(np.float64) ** 2).sum(1) + index.square
        self.gaps = np.sqrt(np.maximum(self.reach[:, None] - 2.0 * index.products(v, index.pivots), 0))
        # room for the rounding of roots
        self.slack = 1e-9 * self.reach + 1e-3
        self.scores, self.ids = np.full((len(v), k), LOWEST), np.full((len(v), k), HIGHEST)
        self.found = np.zeros(len(v), np.int64)

    def bracket(self, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of queries ``a`` with rows whose distances to each pivot lie in
        least..most (rows by pivots)."""
        near, far = np.zeros((len(a), len(least))), np.full((len(a), len(least)), np.inf)
        for p in range(self.gaps.shape[1]):
            d = self.gaps[a, p][:, None]
            np.maximum(near, least[None, :, p] - d, out=near)
            np.maximum(near, d - most[None, :, p], out=near)
            np.minimum(far, d + most[None, :, p], out=far)
        reach, slack = self.reach[a][:, None], self.slack[a][:, None]
        return (reach - far * far) / 2 - slack, (reach - near * near) / 2 + slack

    def wanted(self, a: np.ndarray) -> np.ndarray:
        """The least score that can still change a query's results."""
        return np.maximum(self.lo[a], np.where(self.found[a] >= self.k, self.scores[a, -1], LOWEST))

    def over(self, numbers: np.ndarray) -> None:
        every, bounds = np.arange(len(self.v)), self.index.bounds()[numbers]
        tags = self.index.labels()[numbers, 2:]
        p = len(self.index.pivots)
        low, top = self.bracket(every, bounds[:, 2 : 2 + p], bounds[:, 2 + p :])
        inside = (self.label[:, None] >= tags[None, :, 0]) & (self.label[:, None] <= tags[None, :, 1])
        only = inside & (tags[:, 0] == tags[:, 1])[None]
        live = (inside if self.same else ~only) & (top >= self.lo[:, None]) & (low <= self.hi[:, None])
        for j in np.argsort(-np.where(live, top, -np.inf).max(0), kind="stable").tolist():
            a = np.flatnonzero(live[:, j])
            a = a[top[a, j] >= self.wanted(a)]
            if len(a):
                self.block(a, self.index.block(int(numbers[j])))

    def block(self, a: np.ndarray, block: dict[str, np.ndarray]) -> None:
        for at in range(0, len(block["rows"]), _ROWS):
            d, labels, rows, ids = (block[x][at : at + _ROWS] for x in ("distances", "labels", "rows", "ids"))
            low, top = self.bracket(a, d, d)
            fits = (labels[None] == self.label[a][:, None]) == self.same
            fits &= (rows[None] != self.row[a][:, None]) & (top >= self.wanted(a)[:, None]) & (low <= self.hi[a][:, None])
            r = np.flatnonzero(fits.any(0))
            if not len(r):
                continue
            score = self.index.products(self.v[a], block["vectors"][at : at + _ROWS][r])
            last, last_id = np.where(self.found[a] >= self.k, self.scores[a, -1], LOWEST)[:, None], np.where(self.found[a] >= self.k, self.ids[a, -1], HIGHEST)[:, None]
            fits = fits[:, r] & (score >= self.lo[a][:, None]) & (score <= self.hi[a][:, None]) & ((score > last) | ((score == last) & (ids[r][None] < last_id)))
            x, y = np.nonzero(fits)
            if len(x):
                self.merge(a[x], score[x, y], ids[r][y])

    def merge(self, query: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        touched = np.unique(query)
        held = np.arange(self.k)[None] < self.found[touched][:, None]
        query = np.concatenate((np.repeat(touched, self.found[touched]), query))
        score, own = np.concatenate((self.scores[touched][held], score)), np.concatenate((self.ids[touched][held], own))
        best = _ranked(query, score, own, self.k)
        query, score, own = query[best], score[best], own[best]
        first = np.searchsorted(query, touched)
        rank = np.arange(len(query)) - first[np.searchsorted(touched, query)]
        self.scores[query, rank], self.ids[query, rank] = score, own
        self.found[touched] = np.diff(np.append(first, len(query)))


def search(index: Index, queries: DataFrame, k: int, same: bool, keep: tuple[str, ...]) -> DataFrame:
    """For each row of ``queries`` (row, label, v, lo, hi, bigint columns ``keep``, which name it)
    its ``k`` best rows of the index with the same or another label, not itself, whose scores lie
    in lo..hi: the columns ``keep``, rank, found_id and found_score."""
    spark = queries.sparkSession
    kinds = ", ".join(f"{c} long" for c in (*keep, "found_id", "found_score"))
    n = queries.count()
    batches = -(-n // _QUERIES) or 1
    # where queries are few, their blocks are dealt to several tasks
    deals = max(1, min(index.blocks, -(-2 * spark.sparkContext.defaultParallelism // batches)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            deal = batch.column(0).to_numpy()
            for number in np.unique(deal).tolist():
                part = batch.filter(pa.array(deal == number))
                for at in range(0, part.num_rows, _QUERIES):
                    some = part.slice(at, _QUERIES)
                    row, label, lo, hi = (some.column(i).to_numpy() for i in (1, 2, 4, 5))
                    found = _Search(index, _matrix(some.column(3), index.dims), label, row, lo, hi, k, same)
                    found.over(np.arange(number, index.blocks, deals))
                    held = np.arange(k)[None] < found.found[:, None]
                    which = np.repeat(np.arange(some.num_rows), found.found)
                    own = [some.column(6 + i).take(pa.array(which)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(found.ids[held]), pa.array(found.scores[held])], names=[*keep, "found_id", "found_score"])

    if not index.blocks:
        return spark.createDataFrame([], f"{kinds}, rank int")
    dealt = small_batches(queries).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = dealt.repartitionByRange(batches * deals, "deal", "label", *keep)
    found = dealt.select("deal", "row", "label", "v", "lo", "hi", *keep).mapInArrow(run, kinds)
    order = Window.partitionBy(*keep).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor (rows where ``is_anchor``, a condition on column ``id``) and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose
    score is ``low`` to ``high`` hundredths of the positive's."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col, label_col)
    index = build(rows)
    anchors = rows.filter(is_anchor)
    whole = anchors.select("row", "label", "v", F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"), F.col("id").alias("anchor_id"))
    near = search(index, whole, positives, True, ("row", "anchor_id"))
    near = stored(near, new_path(spark, "positives"))
    share = lambda part: F.col("found_score").cast("decimal(20,0)") * part
    # negative scores leave nothing between the bounds
    asked = near.filter("found_score >= 0").join(anchors.select("row", "label", "v"), "row").select(
        "row", "label", "v", F.ceil(share(low) / 100).cast("long").alias("lo"), F.floor(share(high) / 100).cast("long").alias("hi"), "anchor_id",
        F.col("rank").cast("long").alias("place"), F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"),
    )
    found = search(index, asked, negatives, False, ("row", "anchor_id", "place", "positive_id", "positive_score"))
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))


#: The query over ``embeddings`` in DuckDB's SQL.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::bigint AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r != b.r),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS place FROM pairs WHERE same) WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.place ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.ar = n.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""
