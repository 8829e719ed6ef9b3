"""Persisted snapshots: a keyed table of which a change rewrites only the partitions it touches, committed whole; and a cache of extractions by content and version.

Rows lie in `data/<by>=…/run=…`; a commit is a table of the valid (partition, run) pairs, written aside and then renamed to the next number. A job that is
killed leaves rows that no commit names, and the state before. Of two jobs that commit at once, one fails on the rename and leaves nothing behind but such rows; this
asks for a file system with atomic renames.

Defined cases. Keys compare null-safe, so a row with a null key replaces its like; of rows with one key in a batch, the greatest by all columns counts. The key holds the
partition column, whose null and empty values are one partition read back as null. A batch without news commits nothing. An empty state has no rows.
A folder a value of the partition column is written and listed in each commit, so a column of many values is better put into a bounded number of shards, as the cache does.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_root(spark: SparkSession, name: str) -> str:
    """A new folder's path that the cluster shares, deleted when the session ends: under spark.checkpoint.dir, or in local mode, where it is unset, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='korbwerk-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return root


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]):
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


class Snapshot:
    """A table of `schema` under `root`, one row a `key`, partitioned by the column `by` of the key."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str], by: str):
        if by not in key:
            raise ValueError(f"{by} is no part of the key")
        self.spark, self.root, self.key, self.by = spark, root.rstrip("/"), list(key), by
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()
        if "run" in self.columns:
            raise ValueError("run names the folders of commits")

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        fs, p = self._path("commits")
        return max((int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()), default=0) if fs.exists(p) else 0

    def _pairs(self) -> DataFrame:
        schema, n = f"{self.by} {self.schema[self.by].dataType.simpleString()}, run string", self.version()
        return self.spark.read.schema(schema).parquet(f"{self.root}/commits/{n}") if n else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The committed rows; folders that the commit doesn't name are not read."""
        if not self.version():
            return self.spark.createDataFrame([], self.schema)
        plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema) + ", run string"
        rows, pairs = self.spark.read.schema(plain).parquet(f"{self.root}/data"), self._pairs()
        return rows.join(pairs, _same(rows, pairs, [self.by, "run"]), "left_semi").select(*self.columns)

    def _commit(self, rows: DataFrame, replace: bool) -> int:
        run, n = uuid.uuid4().hex, self.version()
        rows.hint("rebalance", self.by).withColumn("run", F.lit(run)).write.mode("append").partitionBy(self.by, "run").parquet(f"{self.root}/data")
        pairs, plain = self._pairs(), f"{self.by} {self.schema[self.by].dataType.simpleString()}, run string"
        new = self.spark.read.schema(plain).parquet(f"{self.root}/data").where(F.col("run") == run).select(self.by, "run").distinct()
        kept = pairs.join(new, _same(pairs, new, [self.by]), "left_anti") if replace else pairs
        kept.unionByName(new).write.parquet(f"{self.root}/commits/_{run}")
        fs, aside = self._path("commits", f"_{run}")
        _, final = self._path("commits", str(n + 1))
        _, nested = self._path("commits", str(n + 1), f"_{run}")  # where a rename goes whose target has come to be; readers skip it
        if fs.exists(final) or not fs.rename(aside, final) or fs.exists(nested):
            raise RuntimeError(f"commit {n + 1} of {self.root} was made by another job")
        return n + 1

    def _batch(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.key]
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        return typed.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("r")).select(*self.key, *[f"r.{c}" for c in rest]).select(*self.columns)

    @contextmanager
    def _staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """`rows` worked out once, into a folder of their own that is deleted again, as a batch's news are read several times."""
        parts = ("staged", uuid.uuid4().hex)
        try:
            rows.write.parquet("/".join([self.root, *parts]))
            yield self.spark.read.schema(self.schema).parquet("/".join([self.root, *parts]))
        finally:
            fs, p = self._path(*parts)
            fs.delete(p, True)

    def upsert(self, rows: DataFrame) -> int:
        """Adds new rows and replaces changed ones; rows that are there as they are change nothing. Returns the number of the commit that holds."""
        old, batch = self.read(), self._batch(rows)
        with self._staged(batch.join(old, _same(batch, old, self.columns), "left_anti")) as news:
            if news.isEmpty():
                return self.version()
            touched = news.select(self.by).distinct()
            beside = old.join(touched, _same(old, touched, [self.by]), "left_semi")
            beside = beside.join(news, _same(beside, news, self.key), "left_anti")
            return self._commit(beside.unionByName(news), replace=True)

    def add(self, rows: DataFrame) -> int:
        """Adds rows whose keys aren't there, without touching others."""
        old, batch = self.read(), self._batch(rows)
        with self._staged(batch.join(old, _same(batch, old, self.key), "left_anti")) as news:
            return self.version() if news.isEmpty() else self._commit(news, replace=False)


class ExtractionCache:
    """Results of an extraction by content (sha256) and version of the extractor: each is computed once, and again for a new version."""

    def __init__(self, spark: SparkSession, root: str, result: str):
        self.store = Snapshot(spark, root, f"sha256 string, version string, result array<{result}>, shard string", ["sha256", "version", "shard"], "shard")

    def extracted(self, contents: DataFrame, version: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(sha256, result) of all `contents`. `extract` gets those contents whose key is not held, each once, and returns (sha256, result), result an array of what one content gives.

        A content for which it returns no row, or null, is held with an empty result; null keys have none.
        """
        keys = contents.where("sha256 IS NOT NULL").select("sha256").distinct()
        held = self.store.read().where(F.col("version") == version)
        new = contents.dropDuplicates(["sha256"]).join(keys.join(held, "sha256", "left_anti"), "sha256", "left_semi")
        if not new.isEmpty():
            found = new.select("sha256").join(extract(new).select("sha256", "result"), "sha256", "left")
            kind = self.store.schema["result"].dataType
            self.store.add(found.select("sha256", F.lit(version).alias("version"), F.coalesce("result", F.array().cast(kind)).alias("result"), F.substr("sha256", F.lit(1), F.lit(2)).alias("shard")))
        return self.store.read().where(F.col("version") == version).join(keys, "sha256", "left_semi").select("sha256", "result")
