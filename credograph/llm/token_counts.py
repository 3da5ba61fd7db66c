"""Token counts kept up to date by signed changes.

A ``Rollup`` is a folder with additive totals by source, language and tokenizer version. Changes
come in batches. A row inserts a document's count (+1 document, +tokens), deletes it (-1, -tokens)
or revises it (0, new tokens - old tokens). A batch is added up to one row for each group before it
is stored, so the folder's size follows the number of groups and not that of documents.

A batch is a folder named after it, which holds one table for each attempt to store it. The first
finished attempt counts and later ones don't: a batch that is sent again, or whose job is run twice
at once, counts once. A compaction lists batches and attempts once and records what it took in;
batches that come later, also while it runs, are left for the next. ``totals`` adds up the last
compaction and the batches after it. Commits may run side by side, also with a compaction;
compactions have to take turns: one that finds its number taken when it ends changes nothing.
A compaction and the batches in it stay readable until ``KEPT`` later ones are done, so that lazy
totals and commits which began before still find what they read; whoever comes later still looks
again.

Hot groups: counts are added up in each task before they are shuffled, so a source with any share
of the rows sends one row for each task.

Defined cases: a null source, language or version is a group of its own; null tokens count as 0;
an unknown kind of change raises an error; a repeated row counts each time; an empty batch is stored
and changes nothing; groups whose documents and tokens have both become 0 are left out; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credograph.llm.shared import delete

#: Compactions that stay readable.
KEPT = 3
GROUPS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, documents bigint, tokens bigint"


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, place: str) -> list:
        where = self._path(f"{self.folder}/{place}")
        return list(self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _attempt(self, batch: str) -> str | None:
        """The first finished attempt to store a batch."""
        done = []
        for x in self._list(f"batches/{batch}"):
            end = self._path(x.getPath(), "_SUCCESS")
            if self._fs.exists(end):
                done.append((self._fs.getFileStatus(end).getModificationTime(), x.getPath().getName()))
        return f"{self.folder}/batches/{batch}/{min(done)[1]}" if done else None

    def _compactions(self) -> dict[int, str]:
        """Finished compactions by number: a marker file names each one's folder."""
        found = sorted(((int(x.getPath().getName()), x) for x in self._list("merged") if x.getLen()), reverse=True)[: KEPT + 1]
        return {n: f"{self.folder}/tables/{self.spark.read.text(x.getPath().toString()).first()[0]}" for n, x in found}

    def _compaction(self) -> str | None:
        found = self._compactions()
        return found[max(found)] if found else None

    def _held(self, merged: str | None, names: list[str]) -> dict[str, str]:
        """Those of ``names`` that the compaction took in, with the attempt that counted."""
        if merged is None or not names:
            return {}
        wanted = self.spark.createDataFrame([(x,) for x in names], "name string")
        held = self.spark.read.schema("name string, attempt string").parquet(f"{merged}/batches")
        return {r.name: r.attempt for r in held.join(F.broadcast(wanted), "name").collect()}

    def _looked_up(self, names: list[str]) -> tuple[str | None, dict[str, str]]:
        """The last compaction and what it holds of ``names``; if it is removed meanwhile, the next."""
        while True:
            merged = self._compaction()
            try:
                return merged, self._held(merged, names)
            except (AnalysisException, Py4JJavaError):
                if merged == self._compaction():
                    raise

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store a batch of changes (source, lang, version, change: insert, delete or revise,
        tokens, old_tokens). False if it was there already."""
        name = hashlib.sha256(batch.encode()).hexdigest()
        if self._attempt(name) or self._looked_up([name])[1]:
            return False
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null"))))
        sign = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).when(F.col("change") == "revise", 0).otherwise(wrong.cast("int"))
        signed = F.when(F.col("change") == "insert", new).when(F.col("change") == "delete", -old).otherwise(new - old)
        delta = changes.groupBy(*GROUPS).agg(F.sum(sign).cast("long").alias("documents"), F.sum(signed).cast("long").alias("tokens"))
        own = f"{self.folder}/batches/{name}/{uuid.uuid4().hex}"
        delta.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(own)
        first = self._looked_up([name])[1].get(name) or (self._attempt(name) or "").rsplit("/", 1)[-1]
        if first and first != own.rsplit("/", 1)[1]:
            delete(self.spark, own)
            return False
        return bool(first)

    def _parts(self) -> tuple[str | None, dict[str, str]]:
        """The last compaction, and the attempts that count of the batches after it."""
        names = [x.getPath().getName() for x in self._list("batches")]
        merged, held = self._looked_up(names)
        attempts = {x: self._attempt(x) for x in names if x not in held}
        return merged, {x: place for x, place in attempts.items() if place}

    def _sums(self, merged: str | None, fresh: dict[str, str]) -> DataFrame:
        places = [*([f"{merged}/totals"] if merged else []), *fresh.values()]
        rows = self.spark.read.schema(_SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*GROUPS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens of all batches so far."""
        return self._sums(*self._parts())

    def compact(self) -> bool:
        """Merge the totals so far into one table, beside the names of all batches ever in it.
        Only then is what ``KEPT`` compactions have taken in deleted, so a stop at any point loses and
        doubles nothing."""
        number = max((int(x.getPath().getName()) for x in self._list("merged")), default=-1) + 1
        merged, fresh = self._parts()
        if not fresh:
            return False
        own = uuid.uuid4().hex
        self._sums(merged, fresh).write.parquet(f"{self.folder}/tables/{own}/totals")
        names = self.spark.createDataFrame([(x, place.rsplit("/", 1)[1]) for x, place in fresh.items()], "name string, attempt string")
        if merged:
            names = names.unionByName(self.spark.read.schema(names.schema).parquet(f"{merged}/batches"))
        names.write.parquet(f"{self.folder}/tables/{own}/batches")
        try:
            marker = self._fs.create(self._path(f"{self.folder}/merged/{number:012d}"), False)
        except Py4JJavaError:  # another compaction took the number
            delete(self.spark, f"{self.folder}/tables/{own}")
            return False
        marker.write(bytearray(own.encode()))
        marker.close()
        old = self._compactions().get(number - KEPT)
        if old:
            for x in self._held(old, [x.getPath().getName() for x in self._list("batches")]):
                delete(self.spark, f"{self.folder}/batches/{x}")
            delete(self.spark, old)
        return True


#: Tokenizer versions of the production query: what counts as a token.
VERSIONS = {"blank-words-1": r"[^\x20\x09-\x0D]+", "letter-words-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def counted(text: Column, version: str) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(VERSIONS[version])).cast("long")


def counts_and_revisions(docs: DataFrame, text: str) -> DataFrame:
    """A row for each row of ``docs`` and version: ``tokens`` of the text, and ``revised``, those
    that stay when each line is kept once. Only texts that repeat a line are counted twice."""
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    once = F.array_distinct(lines)
    revised = lambda v: F.when(F.size(once) == F.size(lines), counted(F.col(text), v)).otherwise(counted(F.array_join(once, "\n"), v))
    each = F.array(*[F.struct(F.lit(v).alias("version"), counted(F.col(text), v).alias("tokens"), revised(v).alias("revised")) for v in VERSIONS])
    return docs.select(*[c for c in docs.columns if c not in ("version", "tokens", "revised")], F.inline(each))
