"""Cheapest repair of conversations by dynamic programming over four grammar states.

Each row's first fault is found: blank (nothing but blanks), duplicate (role and text seen earlier
in the conversation) or truncated (its last sign is none of ``.!?``). Edits are Keep (0), Rerole
to user or assistant (1), Delete (2; required of blank and duplicate rows) and Insert of an empty
user or assistant turn (5); a truncated row that stays costs 5 more. The initials of the roles
must then read ``(s?(ua)+)?``. Of the cheapest ways, the one with the least audit string (the
initials of its edits, in order) is taken.

Conversations are dealt to tasks by id and sorted there, so that each streams through its task.
A forward Viterbi pass holds, for each of the states nothing, system, user and assistant, the
least (cost, audit) of the ways that end there; after each row, inserts carry the states on (at
most two in a row can help, as the states after nothing repeat). Edits that all ways share
are final: they leave the table at once, so a task holds a short end of each audit string and the
rows it speaks of, whatever the length of a conversation. Repeated turns are told by a table of
the (role, text) that occur more than once and the turn of the first.

Defined cases: a null role or text is one blank; rows are ordered by turn (nulls first), equal
ones by role, then text; repeated rows are duplicates; the null id is a conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credograph.llm.shared import small_batches

#: Costs of the edits, states (nothing, system, user, assistant) and their moves.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
#: Length of audit strings above which their common beginning is taken off.
_LONG = 64
_MUST = {0: "u", 1: "u", 2: "a", 3: "u"}  # the only role but system that may follow a state


class Walk:
    """The pass over one conversation; ``emit(edit, role, text)`` gets the edits in order."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.emit, self.at, self.rows = emit, 0, deque()
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self._insert()

    def _insert(self) -> None:
        for _ in range(2):
            for state, way in enumerate(list(self.best)):
                if way is not None:
                    to = MOVES[state, _MUST[state]]
                    new = (way[0] + INSERT, way[1] + "I")
                    if self.best[to] is None or new < self.best[to]:
                        self.best[to] = new

    def row(self, role: str, text: str, fault: str | None) -> None:
        self.rows.append((role, text))
        found: list[tuple[int, str] | None] = [None] * 4
        initial, extra = role[:1], TRUNCATED if fault == "truncated" else 0

        def offer(to: int, cost: int, audit: str) -> None:
            if found[to] is None or (cost, audit) < found[to]:
                found[to] = (cost, audit)

        for state, way in enumerate(self.best):
            if way is None:
                continue
            cost, audit = way
            offer(state, cost + DELETE, audit + "D")
            if fault not in ("blank", "duplicate"):
                if (state, initial) in MOVES:
                    offer(MOVES[state, initial], cost + KEEP + extra, audit + "K")
                offer(MOVES[state, _MUST[state]], cost + REROLE + extra, audit + "R")
        self.best = found
        self._insert()
        self._prune()
        if max(len(way[1]) for way in self.best if way is not None) > _LONG:
            self._settle(os.path.commonprefix([way[1] for way in self.best if way is not None]))

    def _prune(self) -> None:
        """Take away ways that can't be the cheapest any more. What may follow nothing may follow
        an assistant turn, but for a system turn, which can be deleted; what may follow a system
        turn may follow an assistant turn."""
        after = self.best[3]
        if after is not None:
            if self.best[0] is not None and after[0] + DELETE < self.best[0][0]:
                self.best[0] = None
            if self.best[1] is not None and after[0] < self.best[1][0]:
                self.best[1] = None

    def _settle(self, edits: str) -> None:
        """``edits`` are final."""
        for edit in edits:
            role, text = (None, "") if edit == "I" else self.rows.popleft()
            if edit == "D":
                self.emit(edit, None, None)
                continue
            initial = role[:1] if edit == "K" else _MUST[self.at]
            self.at = MOVES[self.at, initial]
            self.emit(edit, role if edit == "K" else ROLES[initial], text)
        self.best = [way and (way[0], way[1][len(edits) :]) for way in self.best]

    def end(self) -> int:
        """The least cost."""
        cost, audit = min(self.best[s] for s in ENDS if self.best[s] is not None)
        self._settle(audit)
        return cost


def marked(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, fault, first_turn, repeated): fault is blank, truncated or null;
    repeated tells that the conversation has the role and text more than once, first at
    first_turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    own = own.withColumns({"fault": F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated"), "key": F.unhex(F.sha2("text", 256))})
    # a null turn is less than any in a struct
    counted = own.groupBy("conv", "role", "key").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).filter("n > 1")
    seen = counted.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("repeated"))
    same = own["conv"].eqNullSafe(seen["c"]) & (own["role"] == seen["r"]) & (own["key"] == seen["k"])
    return own.join(seen, same, "left").select("conv", "turn", "role", "text", "fault", "first_turn", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def _streamed(turns: DataFrame, run, kinds: str, *columns: str) -> DataFrame:
    """Each conversation's rows in order, through ``run`` in one task."""
    own = marked(turns, *columns)
    dealt = small_batches(own).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(run, kinds)


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, turn, role, text, fault) with duplicates told."""
    before = None
    for batch in stream:
        for conv, turn, role, text, fault, first, repeated in zip(*(c.to_pylist() for c in batch.columns)):
            place = (conv, turn, role, text)
            if fault != "blank" and repeated and (turn != first or place == before):
                fault = "duplicate"
            before = place
            yield conv, turn, role, text, fault


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits: id, place (from 0), edit (its initial), and role and text after it (null where the
    row is deleted)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = [[], [], [], [], []]
        walk = conv = None
        place = 0

        def emit(edit: str, role: str | None, text: str | None) -> None:
            nonlocal place
            for column, x in zip(made, (conv, place, edit, role, text)):
                column.append(x)
            place += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], names=["conv", "place", "edit", "role", "text"])
            for column in made:
                column.clear()
            return out

        for own, _, role, text, fault in _rows(stream):
            if walk is None or own != conv:
                if walk is not None:
                    walk.end()
                walk, conv, place = Walk(emit), own, 0
            walk.row(role, text, fault)
            if len(made[0]) >= 1000:
                yield batch()
        if walk is not None:
            walk.end()
        yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(turns.schema[id_col].dataType), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = f"conv {turns.schema[id_col].dataType.simpleString()}, place long, edit string, role string, text string"
    return _streamed(turns, run, schema, id_col, turn_col, role_col, text_col).withColumnRenamed("conv", id_col)


class _Tally:
    """What is reported of one conversation."""

    def __init__(self):
        self.walk, self.audit, self.hash, self.empty = Walk(self._edit), [], hashlib.sha256(), True
        self.faults, self.illegal, self.before = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.least = self.most = None
        self.turns = 0

    def _edit(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.walk.row(role, text, fault)

    def end(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        cost = self.walk.end()
        return gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: missing turn numbers, rows by first fault, neighbours whose
    roles may not follow each other, the cost of the cheapest repair, its audit string, and a hash
    of what it leaves."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        tally = conv = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * len(kinds)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

        for own, turn, role, text, fault in _rows(stream):
            if tally is None or own != conv:
                if tally is not None:
                    made.append((conv, *tally.end()))
                    if len(made) >= 1000:
                        yield batch()
                tally, conv = _Tally(), own
            tally.row(turn, role, text, fault)
        if tally is not None:
            made.append((conv, *tally.end()))
        yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["conv", *_FIGURES, "audit", "repaired_sha256"]
    kinds = [to_arrow_type(turns.schema[id_col].dataType), *[pa.int64()] * len(_FIGURES), pa.string(), pa.string()]
    schema = f"conv {turns.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _FIGURES) + ", audit string, repaired_sha256 string"
    return _streamed(turns, run, schema, id_col, turn_col, role_col, text_col).withColumnRenamed("conv", id_col)


#: The damaged ``conversations`` and their report in DuckDB's SQL. The states are columns n, s, u and
#: a of structs (cost, audit, what is left); a recursion takes one row of every conversation at a time.
SQL = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS m FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(0, CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
faulty AS (
  SELECT *, role[1] AS i, lag(role[1]) OVER (PARTITION BY cid ORDER BY k) || role[1] AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM numbered),
steps AS (SELECT cid AS id, k, chr(10) || role || ':' || text AS own, text AS body, i, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM faulty),
figures AS (
  SELECT cid AS id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY cid),
ways(cid, done, n, s, u, a) AS (
  SELECT cid, 0::bigint, {'c': 0::bigint, 'a': '', 'o': ''}, NULL::struct(c bigint, a varchar, o varchar), {'c': 5::bigint, 'a': 'I', 'o': chr(10) || 'user:'},
    {'c': 10::bigint, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} FROM ids
  UNION ALL
  SELECT cid, done, n, s, u, list_sort(list_filter([a, CASE WHEN u IS NOT NULL THEN {'c': u.c + 5, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'} END], lambda x: x IS NOT NULL))[1]
  FROM (
    SELECT cid, done, n, s, a, list_sort(list_filter(list_concat([u], list_transform(list_filter([n, s, a], lambda w: w IS NOT NULL),
      lambda w: {'c': w.c + 5, 'a': w.a || 'I', 'o': w.o || chr(10) || 'user:'})), lambda x: x IS NOT NULL))[1] AS u
    FROM (
      SELECT cid, k AS done, {'c': n.c + 2, 'a': n.a || 'D', 'o': n.o} AS n,
        list_sort(list_filter([CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'D', 'o': s.o} END, CASE WHEN NOT must AND i = 's' THEN {'c': n.c + more, 'a': n.a || 'K', 'o': n.o || own} END], lambda x: x IS NOT NULL))[1] AS s,
        list_sort(list_filter(list_concat(list_concat([CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'a': u.a || 'D', 'o': u.o} END],
          list_transform(list_filter([n, s, a], lambda w: w IS NOT NULL AND NOT must AND i = 'u'), lambda w: {'c': w.c + more, 'a': w.a || 'K', 'o': w.o || own})),
          list_transform(list_filter([n, s, a], lambda w: w IS NOT NULL AND NOT must), lambda w: {'c': w.c + 1 + more, 'a': w.a || 'R', 'o': w.o || chr(10) || 'user:' || body})), lambda x: x IS NOT NULL))[1] AS u,
        list_sort(list_filter([CASE WHEN a IS NOT NULL THEN {'c': a.c + 2, 'a': a.a || 'D', 'o': a.o} END, CASE WHEN u IS NOT NULL AND NOT must AND i = 'a' THEN {'c': u.c + more, 'a': u.a || 'K', 'o': u.o || own} END,
          CASE WHEN u IS NOT NULL AND NOT must THEN {'c': u.c + 1 + more, 'a': u.a || 'R', 'o': u.o || chr(10) || 'assistant:' || body} END], lambda x: x IS NOT NULL))[1] AS a
      FROM ways JOIN steps ON steps.id = ways.cid AND steps.k = ways.done + 1))),
ended AS (SELECT cid, CASE WHEN a IS NULL OR ways.n <= a THEN ways.n ELSE a END AS w FROM ways LEFT JOIN figures ON figures.id = ways.cid WHERE done = coalesce(figures.n, 0))
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
  coalesce(illegal, 0)::bigint AS illegal, w.c AS cost, w.a AS audit, sha256(substring(w.o, 2)) AS repaired_sha256
FROM ids JOIN ended USING (cid) LEFT JOIN figures ON figures.id = ids.cid"""
