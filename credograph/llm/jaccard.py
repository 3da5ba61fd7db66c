"""Exact n-gram Jaccard join of documents by signature trees.

A document's set is its distinct word shingles. Documents with equal sets form one class and
only classes are compared. Any two similar sets share a shingle among the first few of each in
one fixed order, here from rare to frequent by a count sketch of all documents, so every class
is listed under these shingles and only lists are searched:

1. Of the members of a list only those stay that have a partner in it by size and by place in the
   order: a pair can't overlap by more than what either has from the shared shingle on. Lists
   with the same members are searched once. A list longer than ``block`` is dealt out to blocks
   at random.
2. In each block a signature tree over bitmaps of the sets finds members that have a possible
   partner; only their whole sets are sent.
3. In each block of what remains, the tree is traversed again and pairs that no bound excludes
   are counted exactly. Pairs that are already connected are skipped, so a block gives at most
   as many links as it has members. Each node's largest block comes first; of the others only
   those that still hold several components follow, and of their members only those that a tree
   over finer bitmaps leaves a possible partner of another component.
4. Lists that were dealt out and still hold several components are searched whole: the blocks of
   their largest component against those of the others, and the others among themselves.

No list, component or table of sets is ever held by one task or the driver; a task holds one
block, or a pair of them.

Defined cases: A-Z is lower-cased; a text of fewer words than a shingle is one shingle; a text
without words, or null, has the empty set and is linked with nothing; repeated rows and repeated
ids are rows with their own sets; ties take the smallest id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from credograph.llm import signature_tree as tree
from credograph.llm.components import components
from credograph.llm import lookup
from credograph.llm.shared import Scratch, id_key, new_path, small_batches, stored
from credograph.llm.spans import BLANKS, groups, hand_back, mix, windows

_SKETCH = 1 << 20
_SLICE = 1 << 10
_FILTER = 1 << 27
_PART = 1 << 15
#: Bits for each element of the finer bitmaps.
_FINE = 8
#: Members of lists that are compared at once by size and place.
_LISTED = 1 << 16
#: Bytes of texts whose shingles are made at once.
_AT_ONCE = 1 << 19
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed shingles of each text."""
    for g in groups(texts, lower=True, limit=_AT_ONCE):
        h, first = g.words(BLANKS)
        whole = windows(h, k)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(whole[i : j - k + 1]) if j - i >= k else windows(h[i:j], j - i) if j > i else h[:0]


def set_hash(elements: np.ndarray) -> int:
    """64 bits that stand for a set; the same whatever made it."""
    total = lambda x: mix(x).sum(dtype=np.uint64, keepdims=True)
    return int(mix((total(elements) ^ total(elements ^ _SALT) * _SALT) + np.uint64(len(elements))).astype(np.int64)[0])


def _sketch(text_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(_SKETCH, np.int64)
        for batch in batches:
            for elements in shingle_sets(batch.column(batch.schema.names.index(text_col)), k):
                np.add.at(count, (elements & np.uint64(_SKETCH - 1)).astype(np.int64), 1)
        slices = count.reshape(-1, _SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slices))), pa.array([x.tobytes() for x in slices], pa.binary())], names=["slice", "counts"])

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(raw, np.int64)
            total[i] = total[i] + own if i in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])


def frequency_classes(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """A frequency class for each of 2^20 shingle buckets, over all documents: one megabyte,
    whatever the input. Any classes give right results; good ones keep frequent shingles last."""
    parts = docs.select(text_col).mapInArrow(_sketch(text_col, k), "slice bigint, counts binary")
    sums = parts.repartition("slice").mapInArrow(_add_slices, "slice bigint, counts binary")
    count = np.zeros(_SKETCH, np.int64)
    for i, raw in sums.collect():
        count[i * _SLICE : (i + 1) * _SLICE] = np.frombuffer(raw, np.int64)
    return np.minimum(np.log2(count + 1) * 6, 255).astype(np.uint8)


def _summaries(id_col: str, text_col: str, k: int, least: tree.Threshold, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank: np.ndarray = classes.value
        for batch in batches:
            names = batch.schema.names
            sizes, hashes, keys, bits = [], [], [], []
            for elements in shingle_sets(batch.column(names.index(text_col)), k):
                n = len(elements)
                sizes.append(n)
                hashes.append(set_hash(elements) if n else None)
                own = elements
                if n > 1:
                    p = least.prefix(n)
                    kind = rank[(elements & np.uint64(_SKETCH - 1)).astype(np.int64)]
                    # by class, then by hash: the elements come sorted by hash
                    own = elements[np.argsort(kind, kind="stable")[:p]]
                keys.append(own.astype(np.int64))
                bits.append(tree.bitmap(elements).tobytes() if n else b"")
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(id_col)), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), lists, pa.array(bits, pa.binary())],
                names=[id_col, "n", "node", "keys", "bits"],
            )

    return run


def _partners(least: tree.Threshold, block: int, at_once: int = _LISTED):
    """Of members (key, node, n, rest) in order of key and n, where ``rest`` elements of a set aren't
    before the key's, those that another member of their list can link with. The first
    shingle that two sets share bounds their overlap by either's rest, so a linked pair stays in
    its list. Lists longer than ``block`` stay whole; a task holds ``at_once`` members, or a list
    that begins there."""

    def some(key: np.ndarray, n: np.ndarray, rest: np.ndarray, long: int | None) -> np.ndarray:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(first, len(key)))
        stays = np.repeat(length > block, length)
        if long is not None:
            stays |= key == long
        i, d = np.flatnonzero(~stays), 0
        while True:
            d += 1
            i = i[i + d < len(key)]
            i = i[(key[i] == key[i + d]) & (100 * n[i] >= least.of * n[i + d])]
            if not len(i):
                return stays
            pair = i[least.overlap(n[i], n[i + d]) <= np.minimum(rest[i], rest[i + d])]
            stays[pair] = stays[pair + d] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        long = None

        def part(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, long
            key, node, n, rest = (np.concatenate(x) for x in zip(*held))
            # the last list may go on, unless it is longer than all that is held
            end = len(key) if last else int(np.searchsorted(key, key[-1])) or len(key)
            own = np.flatnonzero(some(key[:end], n[:end], rest[:end], long))
            long = key[-1] if end == len(key) else None
            held = [[x[end:] for x in (key, node, n, rest)]]
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(node[own])], names=["key", "node"])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(4)])
            if sum(len(x[0]) for x in held) >= max(at_once, block + 1):
                yield from part(False)
        if any(len(x[0]) for x in held):
            yield from part(True)

    return run


def _whole_sets(hash_col: str, text_col: str, k: int, marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = marks.value
        for batch in batches:
            names = batch.schema.names
            bit = batch.column(names.index(hash_col)).to_numpy(zero_copy_only=False) & (_FILTER - 1)
            some = np.flatnonzero(bits[bit // 8] >> (7 - bit % 8).astype(np.uint8) & 1)
            texts = batch.column(names.index(text_col)).take(pa.array(some))
            own = [x for x in shingle_sets(texts, k) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "elements"])

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, own), pa.int64()), pa.array([tree.bitmap(x, _FINE).tobytes() for x in own], pa.binary())], names=["node", "n", "bits"])


class _Block:
    """The rows of one block: nodes with sizes, bitmaps or whole sets, sides and labels."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def parents(self) -> tuple[list[int], dict]:
        first: dict = {}
        return [first.setdefault(r["label"], i) for i, r in enumerate(self.rows)], first

    def pairs(self, bitmaps: list[np.ndarray], least: tree.Threshold, visit, skip) -> None:
        sizes = [r["n"] for r in self.rows]
        sides = [[i for i, r in enumerate(self.rows) if r["side"] == s] for s in (0, 1, 2)]
        if sides[2]:
            root = tree.build(sides[2], sizes, bitmaps)
            tree.traverse(root, root, least, visit, skip)
        elif sides[0] and sides[1]:
            tree.traverse(tree.build(sides[0], sizes, bitmaps), tree.build(sides[1], sizes, bitmaps), least, visit, skip)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _possible(block: _Block, least: tree.Threshold) -> list[tuple]:
    """Rows of members with a possible partner of another label."""
    label = [r["label"] for r in block.rows]
    some = [False] * len(label)

    def visit(i: int, j: int) -> None:
        some[i] = some[j] = True

    block.pairs([np.frombuffer(r["bits"], np.uint8) for r in block.rows], least, visit, lambda i, j: label[i] == label[j] or (some[i] and some[j]))
    return [tuple(r[c] for c in ("key", "block", "node", "n", "side", "label")) for r, x in zip(block.rows, some) if x]


def _links(block: _Block, least: tree.Threshold) -> list[tuple]:
    """Links that connect the members of a block as all of its similar pairs do."""
    sets = [np.frombuffer(r["elements"], np.uint64) for r in block.rows]
    parent, _ = block.parents()
    out = []

    def visit(i: int, j: int) -> None:
        a, b = sets[i], sets[j]
        merged = np.concatenate((a, b))
        merged.sort()
        if int((merged[1:] == merged[:-1]).sum()) >= least.overlap(len(a), len(b)):
            x, y = _find(parent, i), _find(parent, j)
            parent[max(x, y)] = min(x, y)
            out.append((block.rows[i]["node"], block.rows[j]["node"]))

    block.pairs([tree.bitmap(x) for x in sets], least, visit, lambda i, j: _find(parent, i) == _find(parent, j))
    return out


def _by_block(work, least: tree.Threshold, schema: pa.Schema):
    """Apply ``work`` to each run of rows with the same key and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, out = _Block(), None, []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = zip(*out) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if (row["key"], row["block"]) != at:
                    if len(block.rows) > 1:
                        out += work(block, least)
                    block, at = _Block(), (row["key"], row["block"])
                block.rows.append(row)
            if len(out) > 5000:
                yield from flush()
        if len(block.rows) > 1:
            out += work(block, least)
        yield from flush()
        del block
        hand_back()

    return run


_MEMBER = pa.schema([("key", pa.int64()), ("block", pa.string()), ("node", pa.int64()), ("n", pa.int64()), ("side", pa.int32()), ("label", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _mark(column: str):
    """Bits of the hashes in ``column``, in slices of a filter of ``_FILTER`` bits. A task holds the
    filter once, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(_FILTER // 8, np.uint8)
        for batch in batches:
            bit = batch.column(batch.schema.names.index(column)).to_numpy(zero_copy_only=False) & (_FILTER - 1)
            np.bitwise_or.at(own, bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
        slices = own.reshape(-1, _PART // 8)
        used = np.flatnonzero(slices.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([slices[i].tobytes() for i in some], pa.binary())], names=["slice", "bits"])
        del own, slices
        hand_back()

    return run


def _or_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(raw, np.uint8)
            total[i] = total[i] | own if i in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "bits"])


class _Search:
    def __init__(self, work: Scratch, docs: DataFrame, summaries: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, least: tree.Threshold):
        self.work, self.docs, self.summaries, self.nodes = work, docs, summaries, nodes
        self.id_col, self.text_col, self.k, self.least = id_col, text_col, k, least

    def possible(self, members: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
        """Of members (key, block, node, side, label), those with a possible partner in their
        block, by their own or other ``bitmaps`` (node, n, bits); blocks with the same members stay
        once."""
        dealt = members.join((self.nodes if bitmaps is None else bitmaps).select("node", "n", "bits"), "node").repartition("key", "block").sortWithinPartitions("key", "block")
        some = dealt.select("key", "block", "node", "n", "side", "label", "bits").mapInArrow(_by_block(_possible, self.least, _MEMBER), "key bigint, block string, node bigint, n bigint, side int, label bigint")
        some = self.work.write(some, "possible")
        alike = some.groupBy("key", "block").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node", "side")).alias("h"))
        once = alike.groupBy("c", "h").agg(F.min(F.struct("key", "block")).alias("first")).select("first.key", "first.block", "c")
        return some.join(once, ["key", "block"])

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Whole sets of the wanted nodes, made anew from the texts. Texts aren't shuffled: a
        filter of fixed size, filled by tasks, passes the texts of wanted nodes and few others."""
        own = self.summaries.join(wanted.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64(self.id_col)).alias("w"))
        parts = own.select("w").mapInArrow(_mark("w"), "slice bigint, bits binary").repartition("slice").mapInArrow(_or_slices, "slice bigint, bits binary")
        bits = np.zeros((_FILTER // _PART, _PART // 8), np.uint8)
        for i, raw in parts.toLocalIterator():
            bits[i] = np.frombuffer(raw, np.uint8)
        marks = self.docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))
        texts = self.docs.select(F.xxhash64(self.id_col).alias("w"), self.text_col)
        made = texts.mapInArrow(_whole_sets("w", self.text_col, self.k, marks), "node bigint, elements binary")
        return self.work.write(made.join(wanted.distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")

    def finer(self, sets: DataFrame) -> DataFrame:
        """node, n, bits: bitmaps of ``_FINE`` bits for each element of a set."""
        return self.work.write(sets.mapInArrow(_finer, "node bigint, n bigint, bits binary"), "finer")

    def links(self, some: DataFrame, sets: DataFrame) -> DataFrame:
        """Links within the blocks of ``some``."""
        full = some.join(sets, "node").select("key", "block", "node", "n", "side", "label", "elements").repartition("key", "block").sortWithinPartitions("key", "block")
        return self.work.write(full.mapInArrow(_by_block(_links, self.least, _LINK), "a bigint, b bigint"), "links")


def _rest(lists: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Blocks for all pairs of different components within lists that were dealt out."""
    own = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = own.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    own = own.join(main, "key").withColumn("side", F.when(F.col("label") == F.col("main"), 0).otherwise(1))
    parts = lambda c: F.ceil(c / F.lit(float(size))).cast("int")
    own = own.withColumn("p0", parts(F.col("most"))).withColumn("p1", parts(F.col("all") - F.col("most")))
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1"))).cast("int"))
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    against = lambda s, i, j: F.struct(F.format_string("m%d-%d", i, j).alias("block"), F.lit(s).cast("int").alias("side"))
    among = F.transform(up_to("p1"), lambda j: F.struct(F.format_string("o%d-%d", F.least("own", j), F.greatest("own", j)).alias("block"), F.when(j == F.col("own"), 2).when(j > F.col("own"), 0).otherwise(1).cast("int").alias("side")))
    blocks = F.when(F.col("side") == 0, F.transform(up_to("p1"), lambda j: against(0, F.col("own"), j))).otherwise(F.concat(F.transform(up_to("p0"), lambda i: against(1, i, F.col("own"))), among))
    return own.select("key", "node", "label", F.explode(blocks).alias("b")).select("key", "b.block", "node", "b.side", "label")


def _classes(work: Scratch, summaries: DataFrame) -> DataFrame:
    """One of ``summaries`` for each set that isn't empty. Keys and bitmaps aren't shuffled: rows that
    repeat a set are looked up in sorted arrays."""
    rows = summaries.filter("n > 0").select("node", "row")
    again = rows.join(rows.groupBy("node").agg(F.min("row").alias("first")), "node").filter("row != first")
    table = lookup.write(work.write(again.select(F.col("row").alias("key"), F.lit(0).alias("value")), "again"), f"{work.path}/repeats")

    @F.pandas_udf("boolean")
    def repeats(row: pd.Series) -> pd.Series:
        return pd.Series(table.find(pa.array(row, pa.int64()))[0])

    return summaries.filter("n > 0").filter(~repeats("row")).select("node", "n", "keys", "bits")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, block: int = 256) -> DataFrame:
    """One row for each document: its id, n_shingles, and component_id, the smallest id that it
    reaches over links of at least ``percent`` hundredths of similarity."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind, least = docs.schema[id_col].dataType.simpleString(), tree.Threshold(percent)
    classes = spark.sparkContext.broadcast(frequency_classes(docs, text_col, shingle))
    path, work = new_path(spark, "jaccard"), Scratch(spark, "jaccard-work")
    summaries = docs.mapInArrow(_summaries(id_col, text_col, shingle, least, classes), f"`{id_col}` {kind}, n bigint, node bigint, keys array<bigint>, bits binary")
    summaries = work.write(summaries.withColumn("row", F.monotonically_increasing_id()), "summaries")
    nodes = _classes(work, summaries)

    # dealt out by key once; bitmaps are sent only for members that have a partner there
    listed = nodes.select("node", "n", F.posexplode("keys").alias("at", "key")).filter("key is not null").select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    listed = listed.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_partners(least, block), "key bigint, node bigint")
    listed = work.write(listed, "listed")
    lists = listed.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("h"))
    lists = lists.groupBy("c", "h").agg(F.min("key").alias("key")).select("key", "c")
    members = work.write(listed.join(lists, "key"), "members")
    search = _Search(work, docs, summaries, nodes, id_col, text_col, shingle, least)
    parts = F.ceil(F.col("c") / F.lit(float(block))).cast("int")
    dealt = members.select("key", F.pmod(F.xxhash64("node", "key"), parts).cast("string").alias("block"), "node", F.lit(2).alias("side"), F.col("node").alias("label"))
    some = work.write(search.possible(dealt), "some")
    dealt_out = members.filter(F.col("c") > block).select("key", "node")
    sets = search.sets(some.select("node").union(dealt_out.select("node")))

    # first the largest block of each node, which connects most; then what is not connected
    largest = some.groupBy("node").agg(F.max(F.struct("c", "key", "block")).alias("b")).select("b.key", "b.block").distinct()
    links = search.links(some.join(largest, ["key", "block"], "left_semi"), sets)
    labels = components(links, f"{work.path}/labels")
    left = some.join(largest, ["key", "block"], "left_anti").drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_blocks = left.groupBy("key", "block").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key", "block")
    left = left.join(open_blocks, ["key", "block"]).select(*_MEMBER.names)
    if not dealt_out.isEmpty():
        left = left.unionByName(search.possible(_rest(dealt_out, labels, block)).select(*_MEMBER.names))
    # a pair that doesn't link stands in many blocks: finer bitmaps exclude it without its sets
    left = work.write(search.possible(left.drop("n"), search.finer(sets)).select(*_MEMBER.names), "left")
    more = search.links(left, sets)
    if not more.isEmpty():
        labels = components(links.unionByName(more), f"{work.path}/more-labels")

    rows = summaries.select(id_col, "n", "node")
    own = rows.filter("n > 0").groupBy("node").agg(F.min(id_col).alias("own"))
    own = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = own.groupBy("label").agg(F.min("own").alias("component_id"))
    answer = own.join(first, "label").select("node", "component_id")
    answer = rows.join(answer, "node", "left").select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"))
    answer = stored(answer, path)
    work.close()
    return answer


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id. Documents
    without words stay, and so do rows without an id. Rows that repeat id and text stay once.

    Texts aren't shuffled: ids that go are looked up in sorted arrays, and only rows whose id
    repeats are dealt out by id and text."""
    spark, own_id = docs.sparkSession, F.col(f"`{id_col}`")
    found = link_components(docs.filter(own_id.isNotNull()), id_col, text_col, shingle, percent, block)
    by_id = found.groupBy(id_key(found, id_col).alias("key"), id_col).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    told = by_id.groupBy("key").agg(F.max(F.when(~F.col("stays"), 1).when(F.col("n") > 1, 2).otherwise(0)).alias("value")).filter("value > 0")
    table = lookup.write(told, new_path(spark, "duplicates"))

    @F.pandas_udf("bigint")
    def told_of(key: pd.Series) -> pd.Series:
        return pd.Series(table.find(pa.array(key, pa.int64(), from_pandas=True))[1])

    what = told_of(id_key(docs, id_col))
    again = docs.filter(what == 2).dropDuplicates([id_col, text_col])
    return docs.filter(what == 0).unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


#: ``link_components`` with its defaults over ``documents`` in DuckDB's SQL, each pair that shares a shingle.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i + 1 : i + least(len(w), 3)], ' ') AS g
  FROM (SELECT r, w, unnest(range(0, greatest(len(w) - 2, 1)::bigint)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
node AS (SELECT r, n, min(r) OVER (PARTITION BY h, n) AS node FROM (SELECT r, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS h FROM s GROUP BY r)),
one AS (SELECT DISTINCT node AS r, n FROM node),
links AS (SELECT a.r AS x, b.r AS y FROM s a JOIN one p ON a.r = p.r JOIN s b ON a.g = b.g JOIN one q ON b.r = q.r
  WHERE a.r < b.r AND 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n) GROUP BY a.r, b.r, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM one UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x),
label AS (SELECT x, min(y) AS label FROM reach GROUP BY x),
least_id AS (SELECT label, min(doc_id) AS component_id FROM d JOIN node USING (r) JOIN label ON x = node GROUP BY label)
SELECT doc_id, coalesce(node.n, 0)::bigint AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN node USING (r) LEFT JOIN label ON x = node LEFT JOIN least_id USING (label)"""
