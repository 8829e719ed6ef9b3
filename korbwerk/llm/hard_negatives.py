"""Hard negatives by STR-packed R-trees.

Components are floored to whole numbers of 1/256, so that scores, inner products, are whole numbers and exact. The rows of each label are tiled: cut into
slabs of equal rows along the coordinates that vary most, one coordinate after another (sort-tile-recursive, the slabs' boundaries
from quantiles over all rows). Each tile is packed by the same rule into an R-tree whose leaves hold LEAF rows; its nodes keep the bounding
box, and a box gives an interval for the inner product of any row in it with an anchor, coordinate by coordinate.

Anchors meet the trees in blocks, a bounded block with one bounded tree in a task. There a best-first queue opens the
box with the highest upper end first, skips boxes whose interval lies outside all wanted score windows, and boxes whose upper
end is strictly below the k-th best score. The best of all trees are ranked at the end. The search is exact; how many
boxes it skips depends on the data.

An anchor's positives are its first rows of the same label; a positive's negatives are the first rows of other labels
whose score is from `low` to `high` percent of the positive's.

Defined cases. Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows of equal
id, label and components count once; other rows that share an id are rows of their own, and none of them is a positive
of an anchor of that id. Vectors of different lengths don't meet; empty vectors have score 0 with each other. Components
that a long can't hold count as its nearest value, and so do scores, in comparisons too.
An empty table gives an empty result. Extra columns are not carried along.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 5, 80, 100
SCALE, LEAF, FAN = 256, 64, 16
#: Rows of a tree and anchors of a block, both held by one task.
TILE, BLOCK = 4096, 4096
#: Coordinates along which tiles are cut, each into at most SLABS.
AXES, SLABS = 3, 64
LEAST, MOST = -(2**63), 2**63 - 1
TREE = ["label", "dim", "tile"]


def points(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and the floored components of the rows that take part."""
    vectors = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(x * SCALE)).alias("v")).distinct()


def tiled(rows: DataFrame, scratch: Scratch, tile: int = TILE, axes: int = AXES) -> DataFrame:
    """`rows` with the number of their tile within label and dim; no tile has many more than `tile` rows."""
    group = ["label", "dim"]
    sizes = scratch.keep(rows.groupBy(group).agg(F.count("*").alias("n")), "sizes")
    rows = rows.join(sizes.select(*group, F.ceil(F.col("n") / tile).alias("tiles")), group).withColumn("tile", F.lit(0).cast("long"))
    if not sizes.where(F.col("n") > tile).isEmpty():
        spread = rows.where("tiles > 1").select(*group, F.posexplode("v").alias("axis", "x")).groupBy(*group, "axis").agg(F.variance(F.col("x").cast("double")).alias("var"))
        widest = Window.partitionBy(group).orderBy(F.desc("var"), "axis")
        best = spread.withColumn("k", F.row_number().over(widest)).where(F.col("k") <= axes).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("k", "axis"))).alias("axes"))
        rows = rows.join(scratch.keep(best, "axes"), group, "left")
        rows = rows.withColumn("left", F.col("tiles"))
        for k in range(axes):
            x = F.get("v", F.get("axes", k)["axis"])
            slabs = F.least(F.ceil(F.pow("left", F.lit(1 / (axes - k)))), F.lit(SLABS)).cast("long")
            at = [*group, "tile"]
            rows = rows.withColumn("x", x).withColumn("slabs", slabs)
            bounds = rows.where("slabs > 1").groupBy(at).agg(F.percentile_approx("x", [i / SLABS for i in range(1, SLABS)], 10_000).alias("bounds"))
            below = F.size(F.filter("bounds", lambda b: b <= F.col("x")))
            slab = F.coalesce(F.floor(below * F.col("slabs") / SLABS), F.lit(0)).cast("long")
            rows = rows.join(scratch.keep(bounds, f"bounds-{k}"), at, "left")
            rows = rows.withColumn("tile", F.col("tile") * SLABS + slab).withColumn("left", F.ceil(F.col("left") / F.col("slabs"))).drop("bounds", "x", "slabs")
        rows = rows.drop("axes", "left")
    # Equal coordinates stay in one slab: tiles that got too many rows are divided by id.
    parts = scratch.keep(rows.groupBy(TREE).agg(F.ceil(F.count("*") / (2 * tile)).alias("parts")), "tile-sizes")
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return rows.join(parts, TREE).select("label", "dim", F.concat_ws("-", "tile", part).alias("tile"), "vec_id", "v")


def str_order(x: np.ndarray, leaf: int = LEAF, most_axes: int = 6) -> np.ndarray:
    """The rows' order in which consecutive runs of `leaf` are the leaves."""
    pages = -(-len(x) // leaf)
    spread = x.astype(np.float64).var(axis=0) if len(x) else np.zeros(0)
    axes = np.argsort(-spread, kind="stable")[: min(most_axes, max(0, math.ceil(math.log2(max(1, pages)))))].tolist()

    def pack(rows: np.ndarray, at: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if at == len(axes) or pages <= 1:
            return [rows]
        rows = rows[np.argsort(x[rows, axes[at]], kind="stable")]
        slabs = math.ceil(pages ** (1 / (len(axes) - at)))
        step = leaf * -(-pages // slabs)
        return [y for i in range(0, len(rows), step) for y in pack(rows[i : i + step], at + 1)]

    return np.concatenate(pack(np.arange(len(x)), 0)) if len(x) else np.zeros(0, dtype=np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    """The rows of a column of lists, all of length `dim`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def boxes(rows: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper corners of the boxes, the leaves' first, up to one root."""
    lo, hi, step, out = rows, rows, leaf, []
    while True:
        starts = np.arange(0, len(lo), step)
        lo, hi, step = np.minimum.reduceat(lo, starts, axis=0), np.maximum.reduceat(hi, starts, axis=0), fan
        out.append((lo, hi))
        if len(lo) == 1:
            return out


def held(scores: np.ndarray) -> np.ndarray:
    """Scores as a long holds them."""
    return np.clip(scores, LEAST, MOST) if scores.dtype == object else scores


INDEX = "label long, dim int, tile string, ids binary, rows binary, corners binary"


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row: the tile's tree, rows in the order of its leaves and the corners of all boxes."""
    label, dim, tile = (k.as_py() for k in key)
    x, ids = _matrix(table.column("v"), dim), table.column("vec_id").to_numpy()
    order = np.lexsort((ids,))
    order = order[str_order(x[order])]
    x, ids = np.ascontiguousarray(x[order]), ids[order].astype(np.int64)
    corners = b"".join(c.tobytes() for level in boxes(x) for c in level)
    return pa.table({"label": pa.array([label], pa.int64()), "dim": pa.array([dim], pa.int32()), "tile": [tile], "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([x.tobytes()], pa.binary()), "corners": pa.array([corners], pa.binary())})


class Tree:
    """A packed R-tree read from its row of the index."""

    def __init__(self, dim: int, ids: bytes, rows: bytes, corners: bytes, leaf: int = LEAF, fan: int = FAN):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.rows = np.frombuffer(rows, dtype=np.int64).reshape(len(self.ids), dim)
        self.leaf, self.fan, self.levels, flat, n, at = leaf, fan, [], np.frombuffer(corners, dtype=np.int64), -(-len(self.ids) // leaf), 0
        while True:
            lo, hi = flat[at : at + n * dim].reshape(n, dim), flat[at + n * dim : at + 2 * n * dim].reshape(n, dim)
            self.levels.append((lo, hi))
            at += 2 * n * dim
            if n == 1:
                break
            n = -(-n // fan)
        self._typed: np.ndarray | None = None
        self.top = int(np.abs(np.stack(self.levels[-1])).astype(object).max(initial=0)) if dim else 0

    def exact(self, anchors: np.ndarray) -> type:
        """float64 where all sums of products are exact in it, else Python's whole numbers."""
        top = int(np.abs(anchors.astype(object)).max(initial=0)) if anchors.size else 0
        return np.float64 if anchors.shape[1] * top * self.top < 2**53 else object

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the lower and upper ends of the scores of anchors (rows) with boxes (columns)."""
        kind = self.exact(anchors)
        a = anchors.astype(kind)
        up, down, out = np.where(a > 0, a, 0), np.where(a < 0, a, 0), []
        for lo, hi in self.levels:
            lo, hi = lo.astype(kind).T, hi.astype(kind).T
            out.append((held(up @ lo + down @ hi), held(up @ hi + down @ lo)))
        return out

    def search(self, anchor: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray]], windows: list[tuple[float, float]], k: int, but: int | None = None) -> tuple[list[list[tuple[int, int]]], int]:
        """For each window of scores (both ends included) the best k (score, id), higher scores first, then smaller ids, leaving out the id `but`; and the number of leaves read."""
        found: list[list[tuple]] = [[] for _ in windows]  # heaps of (score, -id), the worst first
        last = len(ends) - 1
        wanted = lambda lo, hi: any(hi >= w[0] and lo <= w[1] and (len(f) < k or hi >= f[0][0]) for w, f in zip(windows, found, strict=True))
        queue, leaves = [(-ends[last][1][0], last, 0)], 0
        rows = self.typed(anchor.dtype)
        while queue:
            high, level, node = heapq.heappop(queue)
            if not wanted(ends[level][0][node], -high):
                if all(-high < w[0] or (len(f) == k and -high < f[0][0]) for w, f in zip(windows, found, strict=True)):
                    break  # nothing that is left reaches higher
                continue
            if level:
                below = ends[level - 1]
                for child in range(node * self.fan, min((node + 1) * self.fan, len(below[0]))):
                    if wanted(below[0][child], below[1][child]):
                        heapq.heappush(queue, (-below[1][child], level - 1, child))
                continue
            leaves += 1
            start = node * self.leaf
            score, ids = held(rows[start : start + self.leaf] @ anchor), self.ids[start : start + self.leaf]
            least = min(max(w[0], f[0][0]) if len(f) == k else w[0] for w, f in zip(windows, found, strict=True))
            near = np.flatnonzero(score >= least)
            if but is not None:
                near = near[ids[near] != but]
            if not len(near):
                continue
            near = near[np.lexsort((ids[near], -score[near]))]
            score, ids = score[near], ids[near].tolist()
            for w, f in zip(windows, found, strict=True):
                first = int(np.count_nonzero(score > w[1]))
                for s, i in zip(score[first : first + k].tolist(), ids[first : first + k], strict=True):
                    if s < w[0] or (len(f) == k and (s, -i) <= f[0]):
                        break
                    (heapq.heappush if len(f) < k else heapq.heapreplace)(f, (s, -i))
        return [[(int(s), -i) for s, i in sorted(f, reverse=True)] for f in found], leaves

    def typed(self, kind) -> np.ndarray:
        """The rows as numbers of this kind."""
        if self._typed is None or self._typed.dtype != kind:
            self._typed = self.rows.astype(kind)
        return self._typed


FOUND = "anchor_id long, anchor long, positive long, vec_id long, score long"


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _search(k: int, low: int, high: int, negatives: bool):
    """Finds for a block of anchors the best of one tree: of the anchor's own label, or for each score of a positive the best in its window."""

    def search(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int | None, int, int]] = []
        if len(trees) and len(anchors):
            row = trees.to_pylist()[0]
            tree = Tree(row["dim"], row["ids"], row["rows"], row["corners"])
            ids, keys, all_anchors = anchors.column("anchor_id").to_pylist(), anchors.column("anchor").to_pylist(), _matrix(anchors.column("v"), row["dim"])
            scores = anchors.column("positives").to_pylist() if negatives else None
            kind = tree.exact(all_anchors)
            for start in range(0, len(ids), 256):
                some = all_anchors[start : start + 256]
                ends, some = tree.bounds(some), some.astype(kind)
                for i in range(len(some)):
                    mine = [(lo[i], hi[i]) for lo, hi in ends]
                    n = start + i
                    if scores is None:
                        asked, windows, but = [None], [(-math.inf, math.inf)], ids[n]
                    else:
                        asked = [p for p in scores[n] if window(p, low, high)[0] <= window(p, low, high)[1]]
                        windows, but = [window(p, low, high) for p in asked], None
                    if windows:
                        best, _ = tree.search(some[i], mine, windows, k, but)
                        out += [(ids[n], keys[n], p, vec, s) for p, b in zip(asked, best, strict=True) for s, vec in b]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "anchor", "positive", "vec_id", "score"), columns, strict=True)})

    return search


def _met(index: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int, low: int, high: int, negatives: bool) -> DataFrame:
    """What the pairs of trees and blocks find, ranked over all trees."""
    key = [*TREE, "a_label", "block"]
    ours = index.join(pairs, TREE)
    theirs = anchors.withColumnRenamed("label", "a_label").join(pairs, ["a_label", "dim", "block"])
    found = ours.groupBy(key).cogroup(theirs.groupBy(key)).applyInArrow(_search(k, low, high, negatives), FOUND)
    best = Window.partitionBy("anchor_id", "anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def is_anchor(vec_id: Column, every: int = EVERY) -> Column:
    return vec_id % every == 0


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor, the rows whose id is divisible by `every`, and each of its positives."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.keep(points(vectors), "points")
    index = scratch.keep(tiled(rows, scratch, tile).groupBy(TREE).applyInArrow(_pack, INDEX), "index")
    anchors = rows.where(is_anchor(F.col("vec_id"), every)).withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    parts = scratch.keep(anchors.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).alias("parts")), "anchor-sizes")
    anchors = anchors.join(parts, ["label", "dim"]).withColumn("block", F.pmod("anchor", "parts")).drop("parts").withColumnRenamed("vec_id", "anchor_id")
    anchors = scratch.keep(anchors, "anchors")
    trees = index.select(TREE)
    blocks = parts.select(F.col("label").alias("a_label"), "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    pairs = scratch.keep(trees.join(blocks, "dim"), "pairs")  # a row for each tree and block, no vectors

    own = scratch.keep(_met(index, anchors, pairs.where(F.col("label") == F.col("a_label")), positives, low, high, False).drop("positive", "rank"), "own")
    scores = own.groupBy("anchor_id", "anchor").agg(F.collect_set("score").alias("positives"))
    asked = anchors.join(scores, ["anchor_id", "anchor"])
    others = _met(index, asked, pairs.where(F.col("label") != F.col("a_label")), negatives, low, high, True)
    found = own.select("anchor_id", "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    others = others.select("anchor_id", "anchor", F.col("positive").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return found.join(others, ["anchor_id", "anchor", "positive_score"]).select(*names)
