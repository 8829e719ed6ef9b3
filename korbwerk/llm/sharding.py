"""Sharding by sampled splitters: range partitions of nearly equal bytes, in DataFrame operations only.

Records are ordered by a key (a hash of the text, so that equal texts stand together) and two tie-breaks. Size-weighted
samples of the keys give quantile boundaries, these cut the order into ranges, and every range that is overfull, by
bytes or by rows, is sampled and cut again. A boundary stands at the first record of a key, and a key in which more than one
would fall gets a range of its own; only a range that holds one key alone is cut within the key, so no group of equal texts stays in one task. Exact sums over the ranges
then tell which bytes of the order belong to which shard, and prefix sums within the ranges place each record.

Only the sample is sampled (about PER_CUT rows for each boundary that is drawn); sizes, sums and places cover all rows.
The driver sees two sums and whether any range is still overfull.

Law: `bytes`. A shard ends within half a record of its share, or within half a group of equal texts where such a
group has at most `group` of a shard's bytes: these stay in one shard. Larger groups are divided between shards.

Defined cases. A null text has size 1 and checksum 0, as an empty one; the two are separate groups. Null ids are ids as
others; repeated rows are records of their own and stand next to each other. A record larger than a shard fills the
shard in which its middle lies, so shards may stay empty, as they do in tables of fewer records than shards. An empty table gives an empty
result. Columns to keep are carried along whatever their names; the operator's own columns replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch

LAW, SHARDS = "bytes", 8
#: Groups of equal texts of at most this share of a shard's bytes are not divided.
GROUP = 0.02
#: A range is overfull with more than one RANGES-th of a shard's bytes, or more than MOST_ROWS rows; ranges of FEW rows are left.
RANGES, MOST_ROWS, FEW = 8, 1_000_000, 16
#: At most FAN ranges come from one in a round; PER_CUT rows are sampled for each.
FAN, PER_CUT, ROUNDS = 256, 32, 7
OWN = ("size", "text_crc32", "shard", "slot")
_FIRST, _LAST = -(2**63), 2**63 - 1


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def keyed(docs: DataFrame, keep: Sequence[str], key: Column | None) -> DataFrame:
    """Each record (`row`) with its size, checksum and place in the order: key, tie, uid."""
    tie = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.lit(0).cast("long")
    place = [(F.xxhash64("text") if key is None else key).alias("key"), tie.alias("tie"), F.monotonically_increasing_id().alias("uid")]
    return docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text_size(F.col("text")).alias("size"), text_crc(F.col("text")).alias("crc"), *place)


def _stats(rows: DataFrame) -> DataFrame:
    one = F.min("key").eqNullSafe(F.max("key"))
    return rows.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), one.alias("one_key"))


def _cuts(rows: DataFrame, overfull: DataFrame, limit: float, most_rows: int, round_: int) -> DataFrame:
    """(r, cuts): the sorted boundaries that divide each overfull range, at weighted quantiles of a size-weighted sample."""
    parts = F.least(F.ceil(2 * F.greatest(F.col("bytes") / limit, F.col("n") / most_rows)), F.lit(FAN)).cast("long")
    wanted = overfull.select("r", "bytes", "one_key", F.greatest(parts, F.lit(2)).alias("parts"))
    rows = rows.select("r", "size", "key", "tie", "uid").join(wanted, "r")
    share = F.col("bytes") / (F.col("parts") * PER_CUT)
    drawn = (F.xxhash64("tie", "uid", F.lit(round_)) / 2.0**64 + 0.5) * share < F.col("size")
    order = Window.partitionBy("r").orderBy("key", "tie", "uid")
    sample = rows.where(drawn).withColumn("weight", F.greatest(F.col("size").cast("double"), share))
    sample = sample.withColumn("upto", F.sum("weight").over(order)).withColumn("all", F.sum("weight").over(Window.partitionBy("r")))
    part = lambda x: F.floor(x * F.col("parts") / F.col("all"))
    cut = sample.where(part(F.col("upto") - F.col("weight")) != part(F.col("upto")))
    edge = lambda at: F.struct("key", F.lit(at).alias("tie"), F.lit(at).alias("uid"))
    keys = cut.where("NOT one_key").groupBy("r", "key").agg(F.count("*").alias("n"))
    around = keys.select("r", F.explode(F.when(F.col("n") > 1, F.array(edge(_FIRST), edge(_LAST))).otherwise(F.array(edge(_FIRST)))).alias("cut"))
    cuts = around.unionByName(cut.where("one_key").select("r", F.struct("key", "tie", "uid").alias("cut")))
    return cuts.groupBy("r").agg(F.slice(F.array_sort(F.collect_set("cut")), 1, FAN - 1).alias("cuts"))


def _below(cuts: Column, me: Column) -> Column:
    """How many of the sorted `cuts` are at or below `me`, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(FAN.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= me, at + step).otherwise(at))


def ranges(rows: DataFrame, scratch: Scratch, total: int, shards: int, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """`rows` with the number r of their range, ascending in the order, and a table of the ranges' bytes and rows."""
    limit = max(1, total) / (shards * RANGES)
    rows = rows.withColumn("r", F.lit(0).cast("long"))
    stats = scratch.keep(_stats(rows), "stats-0")
    for i in range(1, ROUNDS + 1):
        overfull = stats.where((F.col("n") > FEW) & ((F.col("bytes") > limit) | (F.col("n") > most_rows)))
        if overfull.isEmpty():
            break
        cuts = scratch.keep(_cuts(rows, overfull, limit, most_rows, i), f"cuts-{i}")
        below = F.coalesce(_below(F.col("cuts"), F.struct("key", "tie", "uid")), F.lit(0))
        rows = rows.join(cuts, "r", "left").withColumn("r", F.col("r") * FAN + below).drop("cuts")
        stats = scratch.keep(_stats(rows), f"stats-{i}")
    return rows, stats


def placed(rows: DataFrame, stats: DataFrame, total: int, shards: int, group: float = GROUP) -> DataFrame:
    """`rows` with shard and nth, their number within the range."""
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    rows = rows.join(stats.select("r", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "r")
    order, same = Window.partitionBy("r").orderBy("key", "tie", "uid"), Window.partitionBy("r", "key")
    rows = rows.withColumn("upto", F.col("base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("g_bytes", F.sum("size").over(same)).withColumn("g_from", F.min(F.col("upto") - F.col("size")).over(same))
    whole = F.col("g_bytes") <= group * max(1, total) / shards
    middle = F.when(whole, F.col("g_from") + F.col("g_bytes") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    shard = F.least(F.floor(middle * shards / max(1, total)), F.lit(shards - 1)).cast("int")
    return rows.withColumn("shard", shard).select("row", "size", "crc", "r", "nth", "shard")


def sharded(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] = ("doc_id",), key: Column | None = None, group: float = GROUP, most_rows: int = MOST_ROWS) -> DataFrame:
    """The columns `keep` of every document with its size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard, in the records' order)."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.keep(keyed(docs, keep, key), "keyed")
    total = rows.agg(F.sum("size")).first()[0] or 0
    at = scratch.keep(placed(*ranges(rows, scratch, total, shards, most_rows), total, shards, group), "placed")
    pieces = scratch.keep(at.groupBy("shard", "r").agg(F.count("*").alias("n"), F.min("nth").alias("first")), "pieces")
    before = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = pieces.select("shard", "r", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    kept = [F.col("row")[c].alias(c) for c in keep if c not in OWN]
    return at.join(starts, ["shard", "r"]).select(*kept, "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS, key: Column | None = None) -> None:
    """Writes whole records to `folder`, one sub-folder shard=k a shard, Parquet; within a file they are in order of their slots."""
    found = sharded(docs, shards, docs.columns, key).sortWithinPartitions("shard", "slot")
    found.write.partitionBy("shard").mode("overwrite").parquet(folder)
