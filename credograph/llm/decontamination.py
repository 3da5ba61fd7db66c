"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over word hashes of the items. Training words are streamed through it
and the longest match that ends at each word is tracked. Where that length reaches ``window``
(or a whole item that is shorter), the covered words are hit.

Items are cut into pieces, of ``block_words`` words at most, that share ``window`` - 1 words, and
the pieces are dealt to blocks of about that size. Each block's automaton is built by one task and
written to the shared folder as sorted arrays, so neither items nor automata reach the driver.
The tasks that scan texts memory-map the arrays of all blocks and read the texts once. Before
streaming, a vectorised test drops stretches in which some pair of neighbouring words occurs in no
item: they can't hold a window.

Defined cases: null and empty texts have no words and no hits; an item without words matches
nothing; an item without id hits words but is not counted; repeated items count once; extra
columns are passed through and may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from credograph.llm import files
from credograph.llm.shared import Scratch, new_path, small_batches, unused
from credograph.llm.spans import NON_ALNUM, groups

_REMEMBERED = 1 << 18


class SuffixAutomaton:
    """Suffix automaton of several sequences. State 0 is the empty match."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state for the match at ``p`` followed by ``symbol``, alone in its length."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        at = 0
        for symbol in sequence:
            if symbol in self.next[at]:
                at = self._split(at, symbol)
                continue
            new, p = self._state(self.length[at] + 1, {}, 0), at
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, symbol)
            at = new

    def step(self, at: int, length: int, symbol: int) -> tuple[int, int]:
        """The longest suffix of (match, symbol) that occurs in an item, and its length."""
        while symbol not in self.next[at]:
            at = self.link[at]
            if at < 0:
                return 0, 0
            length = self.length[at]
        return self.next[at][symbol], length + 1

    def holder(self, at: int, length: int) -> int:
        """The state of the suffix of the given length of the match at ``at``."""
        while at and self.length[self.link[at]] >= length:
            at = self.link[at]
        return at


def _runs(table: dict[int, list]) -> tuple[np.ndarray, np.ndarray, list]:
    """Sorted keys, where each key's values begin, and all values."""
    keys = sorted(table)
    values = [x for k in keys for x in table[k]]
    return np.array(keys, np.int64), np.cumsum([0, *(len(table[k]) for k in keys)]), values


def build(sequences: dict[bytes, list[str]], window: int, folder: str) -> None:
    """Write the automaton of word sequences (hashes as bytes, and the names of their items)."""
    words = [np.frombuffer(x, np.uint64) for x in sequences]
    vocabulary = np.unique(np.concatenate(words))
    coded = [np.searchsorted(vocabulary, h) for h in words]
    size = len(vocabulary)
    machine = SuffixAutomaton()
    for c in coded:
        machine.add(c.tolist())
    # by state: sequences with a window there; (length, sequence) of whole short ones there
    full: dict[int, dict] = {}
    whole: dict[int, list] = {}
    for k, c in enumerate(coded):
        at = length = 0
        for i, symbol in enumerate(c.tolist(), 1):
            at, length = machine.step(at, length, symbol)
            if i >= window:
                full.setdefault(machine.holder(at, window), {})[k] = None
        if len(c) < window:
            whole.setdefault(machine.holder(at, len(c)), []).append((len(c), k))
    moves = np.array([(s * size + symbol, to) for s, edges in enumerate(machine.next) for symbol, to in edges.items()], np.int64).reshape(-1, 2)
    moves = moves[np.argsort(moves[:, 0])]
    full_at, full_first, full_of = _runs({s: list(x) for s, x in full.items()})
    whole_at, whole_first, whole_of = _runs(whole)
    arrays = {
        "vocabulary": vocabulary, "pairs": np.unique(np.concatenate([c[:-1] * size + c[1:] for c in coded])),
        "moves": moves[:, 0], "targets": moves[:, 1], "link": np.array(machine.link), "length": np.array(machine.length),
        "full_at": full_at, "full_first": full_first, "full_of": np.array(full_of, np.int64),
        "whole_at": whole_at, "whole_first": whole_first, "whole_of": np.array(whole_of, np.int64),
    }
    for name, values in arrays.items():
        files.write_array(f"{folder}/{name}", values.astype(np.uint64 if name == "vocabulary" else np.int64))
    with files.writing(f"{folder}/names") as out:
        out.write(json.dumps({"window": window, "shortest": min(min(len(c), window) for c in coded), "names": list(sequences.values())}).encode())


class Matcher:
    """One block's automaton, read from its memory-mapped arrays."""

    def __init__(self, folder: str):
        self.array = lambda name: np.asarray(files.mapped(f"{folder}/{name}", np.uint64 if name == "vocabulary" else np.int64))
        self.vocabulary, self.pairs, self.moves, self.targets = map(self.array, ("vocabulary", "pairs", "moves", "targets"))
        self.link, self.length = self.array("link"), self.array("length")
        with files.reading(f"{folder}/names") as f:
            told = json.loads(f.read())
        self.window, self.shortest, self.names = told["window"], told["shortest"], told["names"]
        self.any_whole = len(self.array("whole_at")) > 0
        self.known: dict[tuple, object] = {}

    def stretches(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of word runs that may hold a window, and the words' codes."""
        code = np.searchsorted(self.vocabulary, h)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == h
        if self.shortest == 1:
            good, extra = known, 0
        else:
            key = code[:-1] * len(self.vocabulary) + code[1:]
            good = known[:-1] & known[1:]
            some = np.flatnonzero(good)
            at = np.searchsorted(self.pairs, key[some])
            at[at == len(self.pairs)] = 0
            good[some[self.pairs[at] != key[some]]] = False
            extra = 1
        if extra:
            ends = first[1:-1] - 1  # a pair over the end of a document is none
            good[ends[(ends >= 0) & (ends < len(good))]] = False
        padded = np.concatenate(([False], good, [False]))
        starts, ends = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
        keep = ends - starts >= self.shortest - extra
        return starts[keep], ends[keep] + extra, code

    def _remember(self, key: tuple, make):
        """Frequent passages meet the same states again and again."""
        if key not in self.known:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            self.known[key] = make()
        return self.known[key]

    def _of(self, kind: str, state: int) -> list:
        def make() -> list:
            keys, first = self.array(f"{kind}_at"), self.array(f"{kind}_first")
            at = int(np.searchsorted(keys, state))
            if at == len(keys) or keys[at] != state:
                return []
            of = self.array(f"{kind}_of")
            return (of.reshape(-1, 2) if kind == "whole" else of)[first[at] : first[at + 1]].tolist()

        return self._remember((kind, state), make)

    def _target(self, state: int, symbol: int) -> int:
        def make() -> int:
            key = state * len(self.vocabulary) + symbol
            at = int(np.searchsorted(self.moves, key))
            return int(self.targets[at]) if at < len(self.moves) and self.moves[at] == key else -1

        return self._remember((state, symbol), make)

    def _state(self, state: int) -> tuple[int, int]:
        """Link and length."""
        return self._remember((state,), lambda: (int(self.link[state]), int(self.length[state])))

    def _step(self, at: int, length: int, symbol: int) -> tuple[int, int]:
        while (to := self._target(at, symbol)) < 0:
            at = self._state(at)[0]
            if at < 0:
                return 0, 0
            length = self._state(at)[1]
        return to, length + 1

    def _holder(self, at: int, length: int) -> int:
        while at and self._state(up := self._state(at)[0])[1] >= length:
            at = up
        return at

    def hits(self, codes: list[int], base: int) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, sequences) of each match that reaches a limit, words counted from ``base``."""
        at = length = 0
        for i, symbol in enumerate(codes, base + 1):
            at, length = self._step(at, length, symbol)
            if length >= self.window:
                yield i - length, i, self._of("full", self._holder(at, self.window))
            up = at
            while self.any_whole and up > 0:
                for n, k in self._of("whole", up):
                    if n <= length:
                        yield i - n, i, [k]
                up = self._state(up)[0]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(folder: str) -> Matcher:
    """One for each block and worker; its arrays stay in the files."""
    if folder not in _MATCHERS:
        if len(_MATCHERS) > 256:
            _MATCHERS.clear()
        _MATCHERS[folder] = Matcher(folder)
    return _MATCHERS[folder]


def _scan(folders: list[str], text_col: str, added: list[str], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col))
            spans: list[list[tuple[int, int]]] = [[] for _ in range(len(text))]
            items: list[set[str]] = [set() for _ in range(len(text))]
            counts = np.zeros(len(text), np.int64)
            for g in groups(text, lower=True):
                h, first = g.words(NON_ALNUM)
                counts[g.first : g.first + g.n] = np.diff(first)
                for folder in folders if len(h) else ():
                    own = _matcher(folder)
                    starts, ends, code = own.stretches(h, first)
                    for s, e, d in zip(starts.tolist(), ends.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist()):
                        # a run of single known words may reach over the end of a document
                        while s < e:
                            stop = min(e, int(first[d + 1]))
                            for a, b, found in own.hits(code[s:stop].tolist(), s - int(first[d])):
                                spans[g.first + d].append((a, b))
                                for k in found:
                                    items[g.first + d].update(own.names[k])
                            s, d = stop, d + 1
            passed = [(f, batch.column(i)) for i, f in enumerate(batch.schema) if keep_text or f.name != text_col]
            arrays = [a for _, a in passed] + [pa.array(map(_merge, spans), pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f, _ in passed] + added)

    return run


def _pieces(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = [], []
            for g in groups(batch.column(1), lower=True):
                h, first = g.words(NON_ALNUM)
                for i in range(g.n):
                    own = h[first[i] : first[i + 1]]
                    for k in range(0, max(len(own) - window + 1, min(len(own), 1)), most - window + 1):
                        names.append(batch.column(0)[g.first + i].as_py())
                        words.append(own[k : k + most].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary())], names=["name", "words"])

    return run


def automata(items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 500_000) -> list[str]:
    """Build the automata of all items, one task for each block; their folders."""
    spark = items.sparkSession
    work, folder = Scratch(spark, "benchmark"), new_path(spark, "automata")
    own = small_batches(items).select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("string").alias("text"))
    most = max(block_words, 2 * window)
    pieces = work.write(own.mapInArrow(_pieces(window, most), "name string, words binary").distinct(), "pieces")
    total = pieces.select(F.sum(F.length("words")) / 8).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences: dict[bytes, list[str]] = {}
        block = None
        for batch in batches:
            for name, words, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = sequences.setdefault(words, [])
                if name is not None:
                    own.append(name)
        if sequences:
            files.make_folder(f"{folder}/{block}")
            build(sequences, window, f"{folder}/{block}")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], names=["block"])

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    made = sorted(r.block for r in dealt.mapInArrow(run, "block int").collect())  # one number a block
    work.close()
    return [f"{folder}/{b}" for b in made]


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 500_000, keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` with the hit word spans [s0, e0, s1, e1, ...], the ids of the
    items found and the number of words; and the names of these three columns."""
    folders = automata(items, item_id, item_text, window, block_words)
    added = unused(docs.columns, "hit_spans", "hit_items", "hit_words")
    fields = [f for f in docs.schema if keep_text or f.name != text_col]
    kinds = [T.ArrayType(T.LongType()), T.ArrayType(T.StringType()), T.LongType()]
    schema = T.StructType([*fields, *map(T.StructField, added, kinds)])
    return small_batches(docs).mapInArrow(_scan(folders, text_col, added, keep_text), schema), added


def _flag(added: list[str], limit: int) -> tuple[Column, Column]:
    """Hit words, and whether they are at least one in ``limit`` of the document's words."""
    spans, _, words = map(F.col, added)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(spans).cast("int") - 2), F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.when(F.size(spans) > i, spans[i + 1] - spans[i]).otherwise(0))
    return n_hit, (n_hit > 0) & (n_hit * limit >= words)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 20, **how) -> DataFrame:
    """One row for each document: words, hit words, items found, and the verdict that at least
    one word in ``limit`` is hit."""
    marked, added = mark(docs.select(id_col, text_col), items, text_col, keep_text=False, **how)
    n_hit, contaminated = _flag(added, limit)
    _, found, words = map(F.col, added)
    return marked.select(
        id_col, words.alias("n_words"), n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(found), ","), 256).alias("items_sha256"), contaminated.alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", limit: int = 20, max_span: int | None = None, length_col: str | None = None, **how) -> DataFrame:
    """``docs`` without documents over the coverage limit. With ``max_span``, the words of
    longer hit spans are also cut out of the documents that stay; ``length_col``, if there, is
    set anew for these."""
    names = docs.columns
    if max_span is None:
        marked, added = mark(docs, items, text_col, **how)
        return marked.filter(~_flag(added, limit)[1]).select(*names)
    folders, added = automata(items, **how), unused(names, "hit_spans", "hit_items", "hit_words")
    scan = _scan(folders, text_col, added, True)

    # found and cut by one worker: a second operator would be a second worker for each core
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            spans, _, words = (batch.column(batch.schema.names.index(c)).to_pylist() for c in added)
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            stays = [i for i, (n, w) in enumerate(zip(n_hit, words)) if not (n > 0 and n * limit >= w)]
            own = {n: batch.column(batch.schema.names.index(n)).take(pa.array(stays, pa.int64())) for n in names}
            long = {k: x for k, i in enumerate(stays) if (x := [(a, b) for a, b in zip(spans[i][::2], spans[i][1::2]) if b - a > max_span])}
            if long:
                changed = {n: own[n].to_pylist() for n in (text_col, length_col) if n}
                for k, x in long.items():
                    text = changed[text_col][k]
                    g = next(groups(pa.array([text], pa.string()), lower=True))
                    starts, ends, _ = g.spans(NON_ALNUM)
                    raw, out, at = text.encode(), [], 0
                    for a, b in x:
                        out.append(raw[at : starts[a]])
                        at = ends[b - 1]
                    changed[text_col][k] = b"".join([*out, raw[at:]]).decode()
                    if length_col:
                        changed[length_col][k] = len(changed[text_col][k])
                own |= {n: pa.array(x, own[n].type) for n, x in changed.items()}
            yield pa.RecordBatch.from_arrays(list(own.values()), names=names)

    return small_batches(docs).mapInArrow(cut, docs.schema)


#: ``report`` over ``documents`` and ``benchmark`` in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::varchar AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS g
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 12, 1)::bigint)) AS s FROM i WHERE len(w) > 0)),
places AS (SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0)::bigint)) AS s FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT r, s, p.n, item FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""
