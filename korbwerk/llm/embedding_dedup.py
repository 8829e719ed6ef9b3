"""Embedding near-duplicates by sorted projection passes.

A pass draws random hyperplanes, writes the sides on which a vector lies as bits one after another, and sorts all
vectors by these bit strings: vectors with a small angle between them share long prefixes and come to stand close.
The order is cut into blocks of `block` neighbours, each sent to one task with the `margin` vectors that precede
it, where all pairs of the window are compared. Pairs found with at least the wanted cosine are verified links; a
task returns a spanning forest of them, and the forests of all passes are united into components.

Equal vectors are one class from the start, with one row that counts for all of them. Spark's range partitioning sorts
the classes, ties broken by a hash that differs from pass to pass; a class's rank is its place in its partition and
the number of rows in the partitions before it.

How many passes are made follows from the wanted recall and from the data: in the first pass every class is compared
with the one half a block further on, and the bits that both share say how deep the order must cut there before a
block is as small as that. A pair at the threshold meets in a pass if it agrees on so many bits (`passes_for`). Dense
groups need more passes than evenly spread vectors; places where even the far neighbour is linked need none.

Within a component every pair is then compared, in tiles of `tile` by `tile` classes that are spread over tasks,
so the links of large groups are counted in full although no window holds them and no pair is written out.

Defined cases. Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, nor do vectors of
different lengths with each other. Rows with equal vectors link (cosine 1); rows that share an id are rows of their
own, and the component id is the smallest non-null id. An empty table gives an empty result. Extra columns are not
carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch
from korbwerk.llm.components import components

THRESHOLD, RECALL, BITS, BLOCK, MARGIN, TILE = 0.95, 0.98, 48, 2048, 512, 256
#: Passes after which the data are asked how many are needed.
FIRST_PASSES = 4


def passes_for(depths: dict[int, int], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The fewest passes in which a pair at the threshold has met with a mean probability of `recall`; `depths` has the number of vectors by how many bits cut their surroundings into blocks."""
    total, side = sum(depths.values()), 1 - math.acos(threshold) / math.pi
    missed = lambda n: sum(k * (1 - side**d) ** n for d, k in depths.items()) / max(1, total)
    few, many = 0, 1
    while missed(many) > 1 - recall:
        few, many = many, 2 * many
    while many - few > 1:
        middle = (few + many) // 2
        few, many = (middle, many) if missed(middle) > 1 - recall else (few, middle)
    return many


def _unit(batch: pa.RecordBatch, name: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Unit vectors in double precision and the rows that have one."""
    out, rows = [], []
    for i, v in enumerate(batch.column(name).to_pylist()):
        if not v or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            x = x / top  # keeps the norm finite
            out.append(x / np.sqrt(x @ x))
            rows.append(i)
    return out, np.array(rows, dtype=np.int64)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the unit vector (bytes of doubles), null for rows without a direction."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = _unit(batch, "embedding")
            raw: list[bytes | None] = [None] * len(batch)
            for i, x in zip(rows.tolist(), found, strict=True):
                raw[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "unit"])

    return vectors.select("vec_id", "embedding").mapInArrow(units, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, unit binary")


def codes(classes: DataFrame, passes: range, bits: int = BITS) -> DataFrame:
    """key, and for each pass its number and the class's code."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            raw = batch.column("unit").to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], dtype=np.int64)
            for d in np.unique(sizes).tolist():
                if d not in planes:
                    planes[d] = np.concatenate([np.random.default_rng((d, p)).standard_normal((d, bits)) for p in passes], axis=1)
                mine = np.flatnonzero(sizes == d)
                sides = np.stack([np.frombuffer(raw[i]) for i in mine]) @ planes[d] > 0
                found = sides.reshape(len(mine), len(passes), bits) @ weights
                keys = batch.column("key").take(pa.array(np.repeat(mine, len(passes))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(passes.start, passes.stop, dtype=np.int32), len(mine))), pa.array(found.ravel())], ["key", "pass", "code"])

    return classes.select("key", "unit").mapInArrow(coded, "key binary, pass int, code long")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys in batches sorted by them."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[: len(key)] != at:
                if rows:
                    yield at, rows
                at, rows = row[: len(key)], []
            rows.append(row[len(key) :])
    if rows:
        yield at, rows


def _cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Cosines of all pairs; -1 between vectors of different lengths."""
    out = np.full((len(a), len(b)), -1.0)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for d in np.intersect1d(la, lb):
        i, j = np.flatnonzero(la == d), np.flatnonzero(lb == d)
        out[np.ix_(i, j)] = np.stack([np.frombuffer(a[k]) for k in i]) @ np.stack([np.frombuffer(b[k]) for k in j]).T
    return out


def _forest(threshold: float):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from korbwerk.llm.ngram_join import spanning

        for _, rows in _groups(batches, ["block"]):
            keys, units = [r[0] for r in rows], [r[1] for r in rows]
            a, b = np.nonzero(np.triu(_cosines(units, units) >= threshold, 1))
            kept = spanning(len(keys), a, b)
            yield pa.RecordBatch.from_pydict({"u": pa.array([keys[a[k]] for k in kept], pa.binary()), "v": pa.array([keys[b[k]] for k in kept], pa.binary())})

    return windows


def _count(threshold: float):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, ["component", "i", "j"]):
            one = [r for r in rows if r[0] == i]
            two = one if i == j else [r for r in rows if r[0] == j]
            keys, counts = [], []
            if one and two:
                linked = _cosines([r[3] for r in one], [r[3] for r in two]) >= threshold
                if i == j:
                    np.fill_diagonal(linked, False)
                keys, counts = [r[1] for r in one], (linked @ np.array([r[2] for r in two])).tolist()
                if i != j:
                    keys, counts = keys + [r[1] for r in two], counts + (np.array([r[2] for r in one]) @ linked).tolist()
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "links": pa.array(counts, pa.int64())})

    return tiles


def ranked(coded: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """key, pass, code and rank, the place of each row in the order by pass, code and a tie-break."""
    spark = coded.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "code", "tie", "key"]
    placed = coded.withColumn("tie", F.xxhash64("pass", "key")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = scratch.keep(placed.withColumn("at", F.monotonically_increasing_id()).drop("tie"), name)
    # The upper bits are the partition, the lower 33 the place in it.
    placed = placed.select("key", "pass", "code", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))  # a row a partition
    return placed.join(F.broadcast(bases), "part").select("key", "pass", "code", (F.col("base") + F.col("place")).alias("rank"))


def _linked(ranks: DataFrame, classes: DataFrame, scratch: Scratch, name: str, threshold: float, block: int, margin: int) -> DataFrame:
    own = F.floor(F.col("rank") / block).cast("long")
    blocks = F.when(F.col("rank") % block >= block - margin, F.array(own, own + 1)).otherwise(F.array(own))
    windows = ranks.select("key", F.explode(blocks).alias("block")).join(classes.select("key", "unit"), "key")
    windows = windows.select("block", "key", "unit").repartition("block").sortWithinPartitions("block")
    return scratch.keep(windows.mapInArrow(_forest(threshold), "u binary, v binary"), name)


def _depths(ranks: DataFrame, classes: DataFrame, threshold: float, block: int, bits: int) -> dict[int, int]:
    """Number of classes by the bits that cut off the one half a block further on in the first pass; 0 if that one is linked with it, or in another pass."""
    first = ranks.where("pass = 0").select("key", "code", "rank")
    ahead = first.select(F.col("key").alias("far"), F.col("code").alias("far_code"), (F.col("rank") - block // 2).alias("rank"))
    pairs = first.join(ahead, "rank").join(classes.select("key", F.col("unit").alias("a")), "key").join(classes.select(F.col("key").alias("far"), F.col("unit").alias("b")), "far")
    apart = F.length(F.bin(F.col("code").bitwiseXOR(F.col("far_code"))))
    depth = F.when(F.col("code") == F.col("far_code"), bits + 1).otherwise(F.lit(bits + 1) - apart)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths = batch.column("depth").to_numpy().copy()
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if len(a) == len(b) and np.frombuffer(a) @ np.frombuffer(b) >= threshold:
                    depths[i] = 0
            yield pa.RecordBatch.from_arrays([pa.array(depths)], ["depth"])

    found = pairs.select(depth.cast("int").alias("depth"), "a", "b").mapInArrow(far, "depth int").groupBy("depth").agg(F.count("*").alias("n"))
    known = {r.depth: r.n for r in found.collect()}
    # Classes with less than half a block after them meet whatever they share.
    return known | {0: known.get(0, 0) + max(0, classes.count() - sum(known.values()))}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, margin: int = MARGIN, tile: int = TILE, bits: int = BITS) -> DataFrame:
    """Per vector: n_links (other vectors with at least the cosine `threshold`), component_id and kept."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = scratch.keep(unit_vectors(vectors).withColumn("key", F.unhex(F.md5("unit"))), "rows")
    classes = rows.where(F.col("unit").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = scratch.keep(classes, "classes")

    ranks = ranked(codes(classes, range(FIRST_PASSES), bits), scratch, "first")
    links = [_linked(ranks, classes, scratch, "links0", threshold, block, margin)]
    passes = passes_for(_depths(ranks, classes, threshold, block, bits), threshold, recall)
    if passes > FIRST_PASSES:
        ranks = ranked(codes(classes, range(FIRST_PASSES, passes), bits), scratch, "more")
        links.append(_linked(ranks, classes, scratch, "links1", threshold, block, margin))

    joined = scratch.keep(components(reduce(DataFrame.union, links), scratch, "components").withColumnRenamed("node", "key"), "joined")
    tiles = scratch.keep(joined.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "tiles")
    members = joined.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    pairs = members.join(classes.select("key", "copies", "unit"), "key").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("component", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), "tile", "key", "copies", "unit")
    pairs = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counts = pairs.mapInArrow(_count(threshold), "key binary, links long").groupBy("key").agg(F.sum("links").alias("links"))

    named = classes.select("key", "vec_id", "copies").join(joined, "key", "left").join(counts, "key", "left")
    named = named.select("key", "vec_id", F.coalesce("component", "key").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = scratch.keep(named, "named")
    least = scratch.keep(named.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    found = scratch.keep(named.join(least, "component").select("key", "n_links", "component_id"), "found")
    alone = F.col("key").isNull()
    all_rows = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return all_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
