"""Exact posteriors on graphs of small width, of any size, by elimination in rounds.

In a round all variables are eliminated that have fewer neighbours than all of theirs (ties by
hash), so no two of them share a factor: the factors of each are multiplied to its clique's table
and it is summed out. The cliques form a tree; a second pass hands beliefs down it, round by round.
On trees and chains the number of rounds follows the logarithm of their size.

Only variables with at most ``most`` neighbours are eliminated, and only their factors are gathered,
so a row holds at most 2^(most + 1) numbers. Messages to the same variables are added up in tasks
first, so a hub is no hot group. If only wider variables are left, an error says so.

Where parts that share no variable are known, those of few numbers are each eliminated in one pass of
a task (``within``); rounds do what is left, wide variables and large parts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from credograph.operators import factor_graph
from credograph.sources.folders import apart, cut, small_batches

WIDEST = 20
#: Numbers in a batch that a task hands back, and what a row weighs beside its own, in numbers.
_NUMBERS, _ROW = 1 << 20, 64
#: Numbers in the tables of a part that a task may eliminate, and neighbours of the variables that go there.
_PART, _NARROW = 1 << 18, 8


class TooWide(RuntimeError):
    """The width found is over the limit: use message passing."""


def _cube(logs, n: int) -> np.ndarray:
    """A table with one axis for each variable, in the order of their bits."""
    return np.asarray(logs, float).reshape((2,) * n, order="F")


def _on(table: np.ndarray, own: list[str], scope: list[str]) -> np.ndarray:
    """``table`` over ``own`` with its axes in the order of ``scope``, to be broadcast over the rest."""
    order = sorted(range(len(own)), key=lambda i: scope.index(own[i]))
    return table.transpose(order).reshape([2 if v in own else 1 for v in scope])


def _summed(table: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    top = table.max()
    return np.log(np.maximum(np.exp(table - top).sum(axis=axes), 1e-300)) + top


def _flat(table: np.ndarray) -> list[float]:
    return table.reshape(-1, order="F").tolist()


def chunks(rows: Iterator[tuple], columns: list[str], sized: int) -> Iterator[pd.DataFrame]:
    """``rows`` in frames of about ``_NUMBERS`` numbers, counted in the list at place ``sized``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[sized]) + _ROW
        if n >= _NUMBERS:
            yield pd.DataFrame(held, columns=columns)
            held, n = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def product(scope: list[str], factors) -> np.ndarray:
    """The sum of log tables (vars, logs) over all of ``scope``."""
    table = np.zeros((2,) * len(scope))
    for f in factors:
        own = list(f["vars"])
        table = table + _on(_cube(f["logs"], len(own)), own, scope)
    return table


def _eliminate(frames: Iterator[pd.DataFrame], largest: bool = False) -> Iterator[pd.DataFrame]:
    """A row (variable, factors) to its clique's table and the message with the variable summed out,
    or, with ``largest``, with its better value."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for v, factors in zip(frame["variable"], frame["f"]):
                rest = sorted({u for f in factors for u in f["vars"]} - {v})
                table = product([v, *rest], factors)
                yield v, rest, _flat(table), _flat(table.max(axis=0) if largest else _summed(table, (0,)))

    return chunks(rows(), ["variable", "rest", "logs", "message"], 2)


def _hand_down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A clique's table times its parent's belief on what they share, less its own message."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for v, rest, logs, message, parent, rest_up, up in zip(*(frame[c] for c in ("variable", "rest", "logs", "message", "parent", "rest_up", "up"))):
                rest = list(rest)
                if parent is not None:
                    scope = [parent, *rest_up]
                    table = _cube(up, len(scope))
                    shared = _summed(table, tuple(i for i, u in enumerate(scope) if u not in rest)) if len(scope) > len(rest) else table
                    down = _on(shared, [u for u in scope if u in rest], rest) - _cube(message, len(rest))
                    logs = _flat(_cube(logs, len(rest) + 1) + down[None])
                yield v, rest, list(logs)

    return chunks(rows(), ["variable", "rest", "belief"], 2)


def _added_up(cells: DataFrame) -> DataFrame:
    """Tables (vars, logs) of cells (vars, x, w): those of the same variables are added up."""
    sums = cells.groupBy("vars", "x").agg(F.sum("w").alias("w"))
    return sums.groupBy("vars").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("c")).select("vars", F.col("c.w").alias("logs"))


def log_tables(variables: DataFrame, factors: DataFrame) -> DataFrame:
    """vars (in order), logs: all factors and the variables' own."""
    dense = factor_graph.tables(factors).select("vars", F.posexplode("pots").alias("x", "p"))
    place = lambda v: (F.array_position(F.array_sort("vars"), v) - 1).cast("int")
    moved = F.transform("vars", lambda v, j: F.call_function("shiftleft", F.call_function("shiftright", F.col("x"), j).bitwiseAND(1), place(v)))
    turned = dense.select(F.array_sort("vars").alias("vars"), F.aggregate(moved, F.lit(0), lambda a, b: a + b).alias("x"), F.log("p").alias("w"))
    alone = factor_graph.unary(variables).select(F.array("variable").alias("vars"), F.inline(F.array(F.struct(F.lit(0).alias("x"), F.lit(0.0).alias("w")), F.struct(F.lit(1).alias("x"), F.col("base").alias("w")))))
    return _added_up(turned.unionByName(alone))


def _round(live: DataFrame, k: int, most: int, kept: DataFrame | None = None, strict: bool = True, largest: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """Round ``k`` of elimination: the cliques of the variables that go (variable, rest, logs, message),
    and the tables that are left. ``kept`` (variable) stay. None if no other is left, or, where not
    ``strict``, if all others have more than ``most`` neighbours."""
    ends = live.select("vars", F.explode("vars").alias("variable"))
    pairs = ends.select("variable", F.explode("vars").alias("other")).distinct()
    counted = pairs.groupBy("variable").agg(F.count("*").alias("d"))
    if kept is not None:
        counted = apart(counted).join(kept, "variable", "left_anti")
    rank = cut(counted.select("variable", "d", F.struct("d", F.xxhash64("variable").alias("h"), "variable").alias("rank")))
    left = rank.agg(F.count("*").alias("n"), F.min("d").alias("d")).first()
    if not left.n:
        return None
    if left.d - 1 > most:
        if strict:
            raise TooWide(f"every variable left has more than {most} neighbours")
        return None
    # each is its own neighbour too: it goes if none ranks before it
    lowest = apart(pairs).join(rank.select(F.col("variable").alias("other"), "d", F.col("rank").alias("r")), "other").groupBy("variable").agg(F.min_by("other", "r").alias("lowest"), F.min("d").alias("d"))
    chosen = lowest.filter((F.col("lowest") == F.col("variable")) & (F.col("d") - 1 <= most)).select("variable")
    held = apart(ends).join(chosen, "variable").join(apart(live), "vars").groupBy("variable").agg(F.collect_list(F.struct("vars", "logs")).alias("f"))
    made = cut(small_batches(held).mapInPandas(partial(_eliminate, largest=largest), "variable string, rest array<string>, logs array<double>, message array<double>"))
    gone = made.select(F.col("variable").alias("v"))
    stay = apart(live).join(apart(ends).join(gone, ends.variable == gone.v).select("vars"), "vars", "left_anti").select("vars", F.posexplode("logs").alias("x", "w"))
    sent = made.filter(F.size("rest") > 0).select(F.col("rest").alias("vars"), F.posexplode("message").alias("x", "w"))
    return made, cut(_added_up(stay.unionByName(sent)), k)


def reduced(tables: DataFrame, kept: DataFrame, most: int = WIDEST, strict: bool = True, largest: bool = False) -> DataFrame:
    """``tables`` (vars in order, logs) with all variables but ``kept`` (variable) summed out, up to a
    factor for each connected part. Where not ``strict``, variables with more than ``most``
    neighbours stay too. With ``largest`` each takes its better value instead of a sum."""
    live = cut(_added_up(tables.select("vars", F.posexplode("logs").alias("x", "w"))))
    for k in count():
        step = _round(live, k, most, kept, strict, largest)
        if step is None:
            return live
        live = step[1]


def _pass(frames: Iterator[pd.DataFrame], most: int, largest: bool) -> Iterator[pd.DataFrame]:
    """A row (part, f, kept) to the tables that are left of the part. Those of no variable are its total."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for part, f, kept in zip(frame["part"], frame["f"], frame["kept"]):
                live: dict[tuple, np.ndarray] = {}
                of: dict[str, set] = {}
                near: dict[str, set] = {}

                def put(own: tuple, table: np.ndarray) -> None:
                    if own in live:
                        live[own] = live[own] + table
                        return
                    live[own] = table
                    for v in own:
                        of.setdefault(v, set()).add(own)
                        near.setdefault(v, set()).update(own)

                for x in f:
                    put(tuple(x["vars"]), _cube(x["logs"], len(x["vars"])))
                stay = set(kept if kept is not None else ())
                queue = [(len(n), v) for v, n in near.items() if v not in stay]
                heapq.heapify(queue)
                while queue and queue[0][0] - 1 <= most:
                    d, v = heapq.heappop(queue)
                    if v not in near or len(near[v]) != d:
                        continue  # it went, or stands elsewhere in the queue
                    rest = sorted(near.pop(v) - {v})
                    table = np.zeros((2,) * d)
                    for own in of.pop(v):
                        table = table + _on(live.pop(own), list(own), [v, *rest])
                        for u in own:
                            if u != v:
                                of[u].discard(own)
                    for u in rest:
                        near[u].discard(v)
                    put(tuple(rest), table.max(axis=0) if largest else _summed(table, (0,)))
                    for u in rest:
                        if u not in stay:
                            heapq.heappush(queue, (len(near[u]), u))
                for own, table in live.items():
                    yield part, list(own), _flat(table)

    return chunks(rows(), ["part", "vars", "logs"], 2)


def within(tables: DataFrame, kept: DataFrame | None = None, most: int = _NARROW, largest: bool = False) -> DataFrame:
    """``tables`` (part, vars in order, logs) after the variables with at most ``most`` neighbours are
    summed out, all but ``kept`` (part, variable). No two parts share a variable. Parts of more than
    ``_PART`` numbers stay as they are. A table of no variable holds its part's total."""
    sizes = tables.groupBy("part").agg(F.sum(F.size("logs")).alias("n"))
    marked = cut(tables.select("part", "vars", "logs").join(apart(sizes).select("part", (F.col("n") <= _PART).alias("small")), "part"))
    held = marked.filter("small").groupBy("part").agg(F.collect_list(F.struct("vars", "logs")).alias("f"))
    names = None if kept is None else kept.groupBy("part").agg(F.collect_set("variable").alias("kept"))
    held = held.withColumn("kept", F.lit(None).cast("array<string>")) if names is None else apart(held).join(names, "part", "left")
    kind = tables.schema["part"].dataType.simpleString()
    done = small_batches(held).select("part", "f", "kept").mapInPandas(partial(_pass, most=min(most, _NARROW), largest=largest), f"part {kind}, vars array<string>, logs array<double>")
    return cut(done.unionByName(marked.filter("not small").select("part", "vars", "logs")))


def totals(tables: DataFrame, most: int = WIDEST) -> DataFrame:
    """variable, log_total: the log sum over all variables of each connected part of ``tables``, named
    after the variable that went last."""
    live, ends = cut(_added_up(tables.select("vars", F.posexplode("logs").alias("x", "w")))), []
    while (step := _round(live, len(ends), most)) is not None:
        made, live = step
        ends.append(made.filter(F.size("rest") == 0).select("variable", F.col("message")[0].alias("log_total")))
    return reduce(DataFrame.unionByName, ends) if ends else tables.select(F.col("vars")[0].alias("variable"), F.lit(0.0).alias("log_total")).limit(0)


def cliques(variables: DataFrame, factors: DataFrame, most: int = WIDEST) -> DataFrame:
    """variable, round, rest (its neighbours when it went, sorted), logs (the clique's table: the
    variable is bit 0, then ``rest``), message (the variable summed out)."""
    live, out = cut(log_tables(variables, factors)), []
    while (step := _round(live, len(out), most)) is not None:
        made, live = step
        out.append(made.withColumn("round", F.lit(len(out))))
    if not out:
        return variables.select("variable", F.array().cast("array<string>").alias("rest"), F.array().cast("array<double>").alias("logs"), F.array().cast("array<double>").alias("message"), F.lit(0).alias("round"))
    return reduce(DataFrame.unionByName, out)


def width(found: DataFrame) -> int:
    """The treewidth of the elimination: the size of the largest clique less one."""
    return found.agg(F.max(F.size("rest"))).first()[0] or 0


def tree(found: DataFrame) -> DataFrame:
    """variable, parent: each clique (named after its variable) below that of the neighbour which
    goes next; null for a component's last."""
    order = found.select(F.col("variable").alias("other"), F.col("round").alias("then"))
    up = found.select("variable", F.explode("rest").alias("other")).join(apart(order), "other").groupBy("variable").agg(F.min_by("other", "then").alias("parent"))
    return found.select("variable").join(apart(up), "variable", "left")


def calibrate(found: DataFrame) -> DataFrame:
    """variable, rest, belief: each clique's table of log weights given everything."""
    own = cut(apart(found).join(tree(found), "variable"))
    rounds = [r[0] for r in own.select("round").distinct().orderBy(F.desc("round")).collect()]  # one number a round
    done: list[DataFrame] = []
    for k in rounds:
        here = own.filter(F.col("round") == k)
        if not done:
            done.append(cut(here.select("variable", "rest", F.col("logs").alias("belief"))))
            continue
        # each round is written once; a parent may be in any round before
        above = reduce(DataFrame.unionByName, done).select(F.col("variable").alias("parent"), F.col("rest").alias("rest_up"), F.col("belief").alias("up"))
        done.append(cut(small_batches(apart(here).join(above, "parent", "left")).mapInPandas(_hand_down, "variable string, rest array<string>, belief array<double>")))
    return reduce(DataFrame.unionByName, done) if done else own.select("variable", "rest", F.col("logs").alias("belief"))


def marginals(variables: DataFrame, factors: DataFrame, most: int = WIDEST) -> DataFrame:
    """variable, belief."""
    beliefs = calibrate(cliques(variables, factors, most))
    cells = beliefs.select("variable", F.array_max("belief").alias("top"), F.posexplode("belief").alias("x", "w")).select("variable", "x", F.exp(F.col("w") - F.col("top")).alias("e"))
    return cells.groupBy("variable").agg((F.sum(F.when(F.col("x").bitwiseAND(1) == 1, F.col("e")).otherwise(0.0)) / F.sum("e")).alias("belief"))


def joint(beliefs: DataFrame, names: list[str]) -> DataFrame | None:
    """assignment (bit i: names[i]) and p, from the smallest calibrated clique that covers all
    names; None if no clique does."""
    scope = F.concat(F.array("variable"), "rest")
    best = beliefs.filter(F.size(F.array_except(F.array(*map(F.lit, names)), scope)) == 0).orderBy(F.size("rest"), "variable").limit(1)
    if best.isEmpty():
        return None
    top = best.select(F.concat(F.array("variable"), "rest").alias("scope"), F.array_max("belief").alias("top"), F.posexplode("belief").alias("x", "w"))
    bits = sum((F.call_function("shiftleft", F.call_function("shiftright", F.col("x"), (F.array_position("scope", v) - 1).cast("int")).bitwiseAND(1), F.lit(i)) for i, v in enumerate(names)), F.lit(0))
    cells = top.select(bits.alias("assignment"), F.exp(F.col("w") - F.col("top")).alias("e"))
    sums = cells.groupBy("assignment").agg(F.sum("e").alias("e"))
    return sums.crossJoin(sums.agg(F.sum("e").alias("z"))).select("assignment", (F.col("e") / F.col("z")).alias("p"))
