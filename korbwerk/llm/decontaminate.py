"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item's shingles are runs of five words, those of an item with fewer words one run of them all; documents are cut
into runs of each width that occurs among the items, so a short item is found inside a long document like any other.
Items with the same shingles are one class from the start.

The shingles of a test item are ordered by hash; its sketch is its `sketch` smallest ones (a bottom-k MinHash). A
document contains a sketched shingle with a probability equal to the item's containment in it, however long the
document is, so hits among the sketch estimate containment itself. Items are partitioned by size (powers of two of
their number of shingles), and each partition has its own number of hits that makes a candidate: all items whose
containment reaches the threshold get there with probability `recall`. Candidates are verified on the exact
shingle sets.

Documents are read once for the search and once, for candidates only, for the verification; no document is
shuffled but as hits. The sketches are broadcast up to BROADCAST_ROWS rows and joined by shuffle beyond.

Defined cases. Words are A-Z lower-cased runs of non-white-space. Items or documents without words match nothing, nor
do documents shorter than an item's shingles. Repeated documents and items are reported once for each of their ids.
Documents that share an id are judged text by text, and the one that holds most of an item is reported; items that
share an id are one item with the shingles of all its texts. Empty tables give an empty result. Extra columns are not
carried along.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import BLANK, Scratch, ascii_lower

THRESHOLD, SKETCH, RECALL, SHINGLE = 0.8, 16, 0.9999, 5
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text; an empty array for null or blank texts."""
    inner = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(BLANK))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))


def needed_hits(size: int, threshold: float = THRESHOLD, sketch: int = SKETCH, recall: float = RECALL) -> int:
    """Most hits that an item of `size` shingles at the threshold reaches with probability `recall`: its sketch draws without replacement from shingles of which threshold * size are contained."""
    drawn, held = min(size, sketch), math.ceil(threshold * size - 1e-9)
    whole = math.comb(size, drawn)
    reached, hits = 0.0, drawn + 1
    while hits > 1 and reached < recall:
        hits -= 1
        reached += math.comb(held, hits) * math.comb(size - held, drawn - hits) / whole if drawn - hits <= size - held else 0.0
    return hits


def partition_need(p: int, threshold: float = THRESHOLD, sketch: int = SKETCH, recall: float = RECALL) -> int:
    """Hits that all items of 2**p to 2**(p + 1) - 1 shingles reach; of large partitions, where it hardly changes, 64 sizes are tried."""
    return min(needed_hits(s, threshold, sketch, recall) for s in range(2**p, 2 ** (p + 1), max(1, 2**p // 64)))


def shingle_rows(df: DataFrame, widths: Sequence[int]) -> DataFrame:
    """The columns of `df` but `words`, with h: the 64-bit hash of each run of words of each width; shingles of a text may repeat."""
    keys = [c for c in df.columns if c != "words"]
    cut = []
    for size in widths:
        n = F.size("words")
        shifted = [F.slice("words", F.lit(k + 1), F.greatest(n - (size - 1), F.lit(0))).alias(f"w{k}") for k in range(size)]
        runs = df.where(n >= size).select(*keys, F.inline(F.arrays_zip(*shifted)))
        cut.append(runs.select(*keys, F.xxhash64(*[f"w{k}" for k in range(size)]).alias("h")))
    return reduce(DataFrame.unionByName, cut)


def item_shingles(items: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """(item_id, h) of all items, distinct, and the widths that occur."""
    cut = items.select("item_id", words(F.col("text")).alias("words"))
    width = F.least(F.size("words"), F.lit(size))
    widths = sorted(r[0] for r in cut.select(width.alias("w")).where("w > 0").distinct().collect())
    rows = [shingle_rows(cut.where(width == w), [w]) for w in widths] or [shingle_rows(cut.limit(0), [size])]
    return reduce(DataFrame.unionByName, rows).distinct(), widths or [size]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, sketch: int = SKETCH, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_contained, containment) for each item of whose distinct shingles a document holds at least the share `threshold`."""
    scratch = Scratch(docs.sparkSession, "contained")
    shingled, widths = item_shingles(items)
    shingled = scratch.keep(shingled, "items")
    # Items with the same set of shingles are one class, named by the set's hash.
    named = shingled.groupBy("item_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("item"))
    named = scratch.keep(named, "named")
    least = named.groupBy("item").agg(F.min(F.struct("item_id")).alias("one"))
    own = shingled.join(least, shingled["item_id"].eqNullSafe(F.col("one.item_id"))).select("item", "h")
    own = scratch.keep(own, "classes")
    by_hash = F.row_number().over(Window.partitionBy("item").orderBy("h"))
    sized = own.withColumn("rank", by_hash).withColumn("n", F.count("*").over(Window.partitionBy("item")))
    part = F.floor(F.log2("n")).cast("int")
    largest = named.agg(F.max("n")).first()[0] or 1
    needs = {p: partition_need(p, threshold, sketch, recall) for p in range(largest.bit_length())}
    need = F.element_at(F.create_map(*[F.lit(x) for kv in needs.items() for x in kv]), part)
    sketches = scratch.keep(sized.where(F.col("rank") <= sketch).select("h", "item", need.alias("need")), "sketches")
    if sketches.count() <= BROADCAST_ROWS:
        sketches = F.broadcast(sketches)
    cut = docs.select("doc_id", F.xxhash64("text").alias("hash"), words(F.col("text")).alias("words"))
    found = shingle_rows(cut, widths).join(sketches, "h")
    candidates = found.groupBy("doc_id", "hash", "item").agg(F.count_distinct("h").alias("hits"), F.max("need").alias("need")).where("hits >= need")
    candidates = scratch.keep(candidates.select("doc_id", "hash", "item"), "candidates")

    which = candidates.select("doc_id", "hash").distinct()
    again = cut.join(which, cut["doc_id"].eqNullSafe(which["doc_id"]) & (cut["hash"] == which["hash"]), "left_semi")
    asked = own.join(candidates.select("item").distinct(), "item", "left_semi")
    asked = F.broadcast(asked) if own.count() <= BROADCAST_ROWS else asked
    shared = shingle_rows(again, widths).join(asked, "h").groupBy("doc_id", "hash", "item").agg(F.count_distinct("h").alias("n_contained"))
    shared = shared.alias("s").join(candidates.alias("c"), F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.hash") == F.col("c.hash")) & (F.col("s.item") == F.col("c.item")), "left_semi")
    best = shared.join(named, "item").groupBy("doc_id", "item_id", F.col("n").alias("n_shingles")).agg(F.max("n_contained").alias("n_contained"))
    return best.withColumn("containment", F.col("n_contained") / F.col("n_shingles")).where(F.col("n_contained") >= threshold * F.col("n_shingles") - 1e-9)
