"""Matching labels to price tags on leaflet pages, and names to names.

These have no relational form: pages are grouped and each is solved by itself. A page holds tens of labels; where the costs of
all pairs are held, one with more than MOST_BOXES boxes is an error, so nothing larger meets in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPT_COST, LINK_DISTANCE = 650.0, 185.0
#: Boxes of a page at most; the costs of all its pairs are held at once.
MOST_BOXES = 4000


def _bounded(boxes: DataFrame) -> DataFrame:
    """Fails on pages that have too many boxes; these are counted before they are grouped."""
    sizes = boxes.groupBy("page_key").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_BOXES)
    crowded = sizes.limit(1).collect()
    if crowded:
        raise ValueError(f"page {crowded[0].page_key} has more than {MOST_BOXES} boxes")
    return boxes


def cheapest_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """A least-cost assignment of rows to columns by shortest augmenting paths; every row is assigned if there are enough columns."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in cheapest_pairs(cost.T))
    n, m = cost.shape
    row_of, left, up = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, base = start, -1, 0.0
        while True:
            through = base + cost[row] - left[row] - up
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            base = reach[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = int(row_of[column])
        seen = done & (reach <= base)
        for c in np.flatnonzero(seen):
            if row_of[c] >= 0:
                left[row_of[c]] += base - reach[c]
            up[c] -= base - reach[c]
        left[start] += base
        while column >= 0:
            before = int(via[column])
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def most_pairs(choices: list[list[int]], columns: int) -> list[tuple[int, int]]:
    """A largest matching of rows, each with the columns it may have, to columns; rows with few choices go first.

    Rows look for a chain of exchanges that ends in a free column, breadth first, so its length is not bounded by the call stack.
    """
    taken, has = [-1] * columns, [-1] * len(choices)
    for start in sorted(range(len(choices)), key=lambda r: len(choices[r])):
        by, waiting, free = {}, deque([start]), -1
        while waiting and free < 0:
            row = waiting.popleft()
            for c in choices[row]:
                if c not in by:
                    by[c] = row
                    if taken[c] < 0:
                        free = c
                        break
                    waiting.append(taken[c])
        while free >= 0:
            row = by[free]
            taken[free], has[row], free = row, free, has[row]
    return [(r, c) for r, c in enumerate(has) if c >= 0]


def near_pairs(a: np.ndarray, b: np.ndarray, reach: float) -> list[list[int]]:
    """For each point of `a` the points of `b` within `reach`, found by square cells of that size."""
    cells: dict[tuple[int, int], list[int]] = {}
    for j, (x, y) in enumerate(np.floor(b / reach).astype(np.int64).tolist()):
        cells.setdefault((x, y), []).append(j)
    out = []
    for (x, y), p in zip(np.floor(a / reach).astype(np.int64).tolist(), a, strict=True):
        near = np.array(sorted(j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((x + dx, y + dy), ())), dtype=np.int64)
        out.append(near[np.hypot(*(b[near] - p).T) <= reach].tolist() if len(near) else [])
    return out


def _of(page: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, corners and centres of a page's boxes of one kind, in order of their ids."""
    page = page.filter(pc.equal(page.column("kind"), kind)).sort_by("box_id")
    corners = np.stack([page.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
    return page.column("box_id").to_numpy(), corners, (corners[:, :2] + corners[:, 2:]) / 2


def _by_page(boxes: DataFrame, solve: Callable[[pa.Table], dict[str, Sequence]], schema: str) -> DataFrame:
    """What `solve` says of each page, as columns beside page_key. Boxes with null coordinates are left out, a null page is a page of its own."""

    def solved(page: pa.Table) -> pa.Table:
        found = solve(page)
        n = len(next(iter(found.values())))
        return pa.table({"page_key": pa.array([page.column("page_key")[0].as_py()] * n, pa.int64())} | {k: pa.array(v, pa.float64() if k == "cost" else pa.int64()) for k, v in found.items()})

    placed = boxes.select("page_key", "kind", "box_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).dropna(subset=["x0", "y0", "x1", "y1"])
    return placed.groupBy("page_key").applyInArrow(solved, f"page_key long, {schema}")


def each_page(rows: DataFrame, columns: Sequence[str], solve: Callable[[list[tuple]], list[tuple]], found: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """(page_key, found): what `solve` says of each page's rows, one array a page, of structs with the fields `found`.

    Pages are arrays, many to a batch, as most hold a few boxes and a call of its own costs more than solving one.
    """
    kind = pa.list_(pa.struct([(n, t) for n, (_, t) in found.items()]))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = [c.to_pylist() for c in lists.flatten().flatten()]
            out, start = [], 0
            for n in pc.list_value_length(lists).to_pylist():
                out.append([dict(zip(found, r, strict=True)) for r in solve(list(zip(*[v[start : start + n] for v in values], strict=True)))])
                start += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["page_key", "found"])

    packed = rows.groupBy(F.col("page_key").cast("long").alias("page_key")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return packed.mapInArrow(solved, f"page_key long, found array<struct<{','.join(f'{n}:{t}' for n, (t, _) in found.items())}>>")


def assign_prices(boxes: DataFrame, accept: float = ACCEPT_COST) -> DataFrame:
    """boxes (page_key, kind: label or price, box_id, x0, y0, x1, y1) -> (page_key, label_id, price_id, cost): least total distance per page, prices above their label cost double, pairs beyond `accept` are left out."""

    def solve(page: pa.Table) -> dict[str, Sequence]:
        (labels, _, a), (prices, _, b) = _of(page, "label"), _of(page, "price")
        d = b[None, :, :] - a[:, None, :]
        cost = np.hypot(d[..., 0], d[..., 1]) * np.where(d[..., 1] < 0, 2.0, 1.0)
        pairs = [(r, c) for r, c in cheapest_pairs(cost) if cost[r, c] <= accept]
        return {"label_id": [labels[r] for r, _ in pairs], "price_id": [prices[c] for _, c in pairs], "cost": [float(cost[r, c]) for r, c in pairs]}

    return _by_page(_bounded(boxes), solve, "label_id long, price_id long, cost double")


def match_anchors(boxes: DataFrame, reach: float = LINK_DISTANCE) -> DataFrame:
    """boxes as above -> (page_key, label_id, price_id): as many labels as possible get a price within `reach`.

    Repeated boxes are boxes of their own. A page's boxes meet in one task, however many they are;
    only those in neighbouring cells are compared. An empty table gives an empty result.
    """

    def solve(page: pa.Table) -> dict[str, Sequence]:
        (labels, _, a), (prices, _, b) = _of(page, "label"), _of(page, "price")
        pairs = most_pairs(near_pairs(a, b, reach), len(prices))
        return {"label_id": [labels[r] for r, _ in pairs], "price_id": [prices[c] for _, c in pairs]}

    return _by_page(boxes, solve, "label_id long, price_id long")


def price_groups(boxes: DataFrame, apart: float = 24.0) -> DataFrame:
    """boxes -> (page_key, box_id, group_id): price boxes merged one after another into groups whose growing bounds they touch or come near."""

    def solve(rows: list[tuple]) -> list[tuple]:
        groups, named, out = [], [], []
        for i, x0, y0, x1, y1 in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
            k = next((k for k, g in enumerate(groups) if max(g[0] - x1, x0 - g[2], 0.0) + max(g[1] - y1, y0 - g[3], 0.0) <= apart), None)
            if k is None:
                k = len(named)
                groups.append((x0, y0, x1, y1))
                named.append(i)
            else:
                g = groups[k]
                groups[k] = min(g[0], x0), min(g[1], y0), max(g[2], x1), max(g[3], y1)
            out.append((i, named[k]))
        return out

    corners = ["x0", "y0", "x1", "y1"]
    prices = _bounded(boxes).where("kind = 'price'").select("page_key", F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in corners]).dropna(subset=corners)
    return each_page(prices, ["box_id", *corners], solve, {"box_id": ("bigint", pa.int64()), "group_id": ("bigint", pa.int64())}).select("page_key", F.inline("found"))


def gram_size(least: float, shortest: int) -> int:
    """The longest q for which names of at least `shortest` characters with a ratio of `least` must share a q-gram."""
    fits = lambda q: all(shared_grams(q, least, n) > 0 for n in (2 * shortest, 10**6))
    return max(q for q in range(1, shortest + 1) if q == 1 or fits(q))


def shared_grams(q: int, least: float, both):
    """What q-grams two names of `both` characters together share at least: of the matched half, each unmatched character and the end break q - 1."""
    return both * (least / 2) - (q - 1) * (both * (1 - least) + 1)


def similar_names(products: DataFrame, least: float = 0.92) -> DataFrame:
    """(left_id, right_id, ratio): pairs of different names that are nearly equal by matching blocks.

    Equal names are compared once. Candidates share one of their rarest q-grams and are of similar length; q, the number
    of q-grams looked at and the lengths follow from `least`, so that no pair is missed and no pair of all names formed.
    """
    from korbwerk.functions.text import plain_key

    shortest = 8
    q = gram_size(least, shortest)
    names = products.select("product_id", plain_key(F.col("product_name")).alias("name")).where(F.length("name") >= shortest).groupBy("name").agg(F.min("product_id").alias("id"))
    grams = names.select("id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - q + 1), lambda i: F.substr("name", i, F.lit(q)))).alias("gram"))
    # The k-th occurrence of a gram in a name is a gram of its own, so shared ones count as often as they are shared.
    grams = grams.withColumn("k", F.row_number().over(Window.partitionBy("id", "gram").orderBy("name")))
    grams = grams.join(grams.groupBy("gram", "k").agg(F.count("*").alias("common")), ["gram", "k"])
    place = F.row_number().over(Window.partitionBy("id").orderBy("common", "gram", "k"))
    # The other name has at least this share of the length, else too little could match.
    needed = F.greatest(F.lit(1), F.ceil(shared_grams(q, least, F.length("name") * (1 + least / (2 - least))) - 1e-6))
    rare = grams.withColumn("place", place).where(F.col("place") <= F.length("name") - q + 1 - needed + 1)
    a, b = rare.alias("a"), rare.alias("b")
    la, lb = F.length("a.name"), F.length("b.name")
    close = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")) & (F.least(la, lb) * 2 >= least * (la + lb) - 1e-6)
    pairs = a.join(b, close).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.name").alias("l"), F.col("b.name").alias("r")).distinct()

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)])

    return pairs.select("left_id", "right_id", ratio("l", "r").alias("ratio")).where(F.col("ratio") >= least)


def reconcile(matched: DataFrame, anchors: DataFrame) -> DataFrame:
    """matched (page_key, label_id, price, expected) and anchors (page_key, anchor_id, price): the price stays if it is near the expected one, else the page's nearest anchor that is takes its place, else the row is rejected."""
    from korbwerk.functions.price import close

    wrong = matched.where(F.col("expected").isNotNull() & ~close(F.col("price"), F.col("expected")))
    options = wrong.select("page_key", "label_id", "expected").join(anchors.select("page_key", F.col("price").alias("seen")), "page_key").where(close(F.col("seen"), F.col("expected")))
    better = options.groupBy("page_key", "label_id").agg(F.min_by("seen", F.struct(F.abs(F.col("seen") - F.col("expected")), "seen")).alias("better"))
    fine = F.col("expected").isNull() | close(F.col("price"), F.col("expected"))
    state = F.when(fine, "kept").when(F.col("better").isNotNull(), "corrected").otherwise("rejected")
    return matched.join(better, ["page_key", "label_id"], "left").select("page_key", "label_id", F.when(fine, F.col("price")).otherwise(F.col("better")).alias("price"), state.alias("state"))
