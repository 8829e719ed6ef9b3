"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents), bucketed and sorted by hash; all runs have the same buckets. A
new batch of documents is counted into a run of its own, lines that one of the runs before already knows to be frequent
are anti-joined away, and the rest is written as a run of level 0. When a level holds `fanout` runs they are merged
into one of the next level. As buckets match, these joins and merges read run beside run and exchange nothing. Lines
whose counts over all runs reach `min_docs` are dropped from every document.

All joins are on 128-bit hashes. Very frequent lines would make one task of a join hot, so lines that take more
than 1/HOT of all (document, line) pairs, of which there are at most HOT, are broadcast and the rest shuffled.

Defined cases. A null or empty text is one empty line. The key of a line is the line without white space at both
ends, A-Z lower-cased; lines with keys shorter than `min_chars` stay. Repeated rows with equal id and text are one
document when counting and all of them are returned. Rows that share an id but not the text are different
documents. An empty table gives an empty result. Extra columns stay; clashing ones are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk.llm.common import BLANK, Scratch, ascii_lower

BATCHES, FANOUT, HOT = 4, 2, 10_000
OWN = ["n_lines", "n_dropped", "kept"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes that together name a line."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key, F.length(key)).alias("h2")]


class LineRuns:
    """The levels of sorted runs; `add` takes the line counts of a batch of documents that no earlier batch held."""

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int = FANOUT):
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _table(self, counts: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        written = counts.select("h1", "h2", "docs").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        written.option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.scratch.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def both(self, one: str, two: str) -> DataFrame:
        """The counts of two runs together."""
        one, two = self.scratch.spark.table(one), self.scratch.spark.table(two).withColumnRenamed("docs", "more")
        found = one.join(two.hint("merge"), ["h1", "h2"], "full_outer")
        return found.select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))

    def _merged(self, runs: list[str]) -> str:
        while len(runs) > 1:
            one, two, *rest = runs
            runs = [*rest, self._table(self.both(one, two))]
            self._drop(one)
            self._drop(two)
        return runs[0]

    @property
    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(self._merged(merged), level + 1)

    def unknown(self, batch: str) -> DataFrame:
        """The rows of a table of counts that no run knows to be frequent."""
        counts = self.scratch.spark.table(batch)
        for run in self.runs:
            known = self.scratch.spark.table(run).where(F.col("docs") >= self.min_docs).select("h1", "h2")
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        batch = self._table(counts)
        self._put(self._table(self.unknown(batch)), 0)
        self._drop(batch)

    def frequent(self) -> DataFrame:
        """The lines that reach `min_docs`, after all runs have been merged into one."""
        self.levels = [[self._merged(self.runs)]]
        return self.scratch.spark.table(self.runs[0]).where(F.col("docs") >= self.min_docs)

    def clear(self) -> None:
        for name in self.runs:
            self._drop(name)
        self.levels = [[]]


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Each document with n_lines (before dropping), n_dropped and kept (its other lines joined by newlines)."""
    docs = docs.drop(*OWN)
    scratch = Scratch(docs.sparkSession, "lines")
    name = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t1"), F.length(F.coalesce("text", F.lit(""))).alias("_t2")]
    split = docs.select(*name, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = split.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "_t1", "_t2", "pos", *hashes(F.col("key")), F.pmod(F.xxhash64("doc_id", "_t1"), F.lit(batches)).alias("batch"))
    lines.write.partitionBy("batch").parquet(scratch.path("lines"))
    lines = docs.sparkSession.read.schema(lines.schema).parquet(scratch.path("lines"))

    runs = LineRuns(scratch, min_docs, fanout)
    for b in range(batches):
        once = lines.where(F.col("batch") == b).dropDuplicates(["h1", "h2", "doc_id", "_t1", "_t2"])
        runs.add(once.groupBy("h1", "h2").agg(F.count("*").alias("docs")))
    frequent = scratch.keep(runs.frequent(), "frequent")
    runs.clear()

    hot_at = F.lit(max(min_docs, lines.count() // HOT))
    hot, cold = frequent.where(F.col("docs") >= hot_at), frequent.where(F.col("docs") < hot_at)
    dropped = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_semi").unionByName(lines.join(cold, ["h1", "h2"], "left_semi"))
    dropped = dropped.groupBy("doc_id", "_t1", "_t2").agg(F.collect_set("pos").alias("_drop"))

    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *name, F.coalesce("text", F.lit("")).alias("_x"))
    same = keyed["doc_id"].eqNullSafe(dropped["doc_id"]) & (keyed["_t1"] == dropped["_t1"]) & (keyed["_t2"] == dropped["_t2"])
    found = keyed.join(dropped, same, "left").select("row", "_x", F.coalesce("_drop", F.array()).alias("_drop"))
    parts = F.split("_x", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    kept = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n"))[0]
    counted = found.select("row", F.size(parts).cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"), F.when(F.size("_drop") == 0, F.col("_x")).otherwise(kept).alias("kept"))
    return counted.select("row.*", "n_lines", "n_dropped", "kept")
