"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key -ln(u)/w, u from a hash of its id, w its quality weight; ascending keys
are a weighted random order without replacement. A source takes complete epochs while its target allows, then
documents in key order until the rest of the budget is filled.

The order within a source is never sorted in one task: keys are cut into `buckets` monotone ranges, the ranges'
word sums are prefix-summed (at most `buckets` rows a source), and only the one range in which the budget ends is
prefix-summed row by row. Targets are computed over one row a source, at most MAX_SOURCES of them.

Weights are a column of the documents, or a default made of the text alone (`quality`).

Defined cases. Null texts have size 0 and are taken 0 words; a null source is a source of its own, after all
others; null ids draw their key from the text. Rows with equal ids draw equal keys and stand next to
each other, ordered by size, then text. No document is taken more than `cap` times, whatever its size. Weights that
are null, NaN or not positive count as the least of the default. An empty table gives an empty result. Columns other
than doc_id, text and source pass through untouched; the operator's own columns replace clashing ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch, word_count

WEIGHTS, SHARE, CAP, BUCKETS = (3, 1, 2), 1.5, 2.0, 512
#: What is computed over all sources meets in one task and is broadcast; more sources are an error.
MAX_SOURCES = 100_000
LEAST_WEIGHT = 0.25
OWN = ["size", "source_size", "target", "taken", "copies", "key", "tie", "bucket", "epochs", "left", "edge", "base", "once"]


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of the id's md5; of the text's where the id is null."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def quality(text: Column) -> Column:
    """Document quality weight from 0.25 to 1: texts broken into unusually short or long words weigh less."""
    mean = F.length(text) / F.greatest(word_count(text), F.lit(1))
    return F.when(mean.between(3.0, 12.0), 1.0).when(mean.between(2.0, 25.0), 0.5).otherwise(LEAST_WEIGHT)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source (source, source_size) -> target: weighted shares of `share` times all words, at most `cap` times the source's own; the excess is reshared.

    With sources in order of cap over weight, the first k are at their cap and the others get lambda times weight; k is the first at which lambda stays below the next cap.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    lam = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("lam", lam)
        .withColumn("level", F.min(F.when(F.col("lam") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("at"), "lam"))).over(every)["lam"])
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))
    )


def _drawn(docs: DataFrame, buckets: int, weight: Column | str | None) -> DataFrame:
    """`docs` with size, key, tie and bucket, all of which follow from the row alone."""
    given = None if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    weigh = quality(F.col("text")) if given is None else F.when((given > 0) & ~F.isnan(given), given).otherwise(LEAST_WEIGHT)
    docs = docs.withColumn("size", word_count(F.col("text"))).withColumn("key", -F.log(uniform(F.col("doc_id"), F.col("text"))) / weigh)
    return docs.withColumn("tie", F.coalesce(F.xxhash64("text"), F.lit(0))).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))


def _plan(keyed: DataFrame, scratch: Scratch, weights, share: float, cap: float) -> DataFrame:
    """One row a source: p_source, source_size, target, whole epochs, the words left after these, and the range in which these end, with the words before it."""
    ranges = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    ranges = scratch.keep(ranges, "ranges")
    sources = scratch.keep(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), "sources")
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"there are more than {MAX_SOURCES} sources")
    targets = source_targets(sources, weights, share, cap)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0))
    targets = targets.withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    ends = ends.where((F.col("base") <= F.col("left")) & (F.col("base") + F.col("words") > F.col("left"))).select(F.col("r.source").alias("source"), "bucket", "base")
    plan = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    return scratch.keep(plan.select(F.col("t.source").alias("p_source"), "source_size", "target", "epochs", "left", F.col("bucket").alias("edge"), "base"), "plan")


def _edge(rows: DataFrame) -> DataFrame:
    """Rows of the ranges in which budgets end, with whether each is taken once more."""
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie")
    edge = rows.where(F.col("bucket") == F.col("edge"))
    edge = edge.withColumn("upto", F.col("base") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("in", (F.col("upto") <= F.col("left")) | ((F.col("upto") - F.col("size") <= F.col("left")) & (F.col("upto") - F.col("left") <= F.col("left") - (F.col("upto") - F.col("size")))))
    whole = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.withColumn("open", F.col("left") - F.max(F.when(F.col("in"), F.col("upto")).otherwise(F.col("base"))).over(whole))
    fit = Window.partitionBy("source").orderBy("in", F.abs(F.col("open") - F.col("size")), "key", "doc_id", "tie")
    fill = ~F.col("in") & (F.row_number().over(fit) == 1) & (F.abs(F.col("open") - F.col("size")) < F.col("open"))
    return edge.withColumn("once", F.col("in") | fill)


def _copies(once: Column, cap: float) -> Column:
    return F.least(F.col("epochs") + once.cast("int"), F.lit(math.floor(cap + 1e-9))).cast("int")


def _below() -> Column:
    """Whether a row outside of the range in which its source's budget ends is taken once more."""
    return F.col("edge").isNotNull() & (F.col("bucket") < F.col("edge"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, buckets: int = BUCKETS, weight: Column | str | None = None) -> DataFrame:
    """Every document with its size, its source's size and target, the words taken and the number of copies.

    Whole documents are taken. Within the range in which the budget ends, the document that straddles it is taken if that ends nearer to the target; then the one
    untaken document of that range that best fits what is left, if it brings the source nearer.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = scratch.keep(_drawn(_own_aside(docs), buckets, weight).select("doc_id", "source", "size", "key", "tie", "bucket"), "keyed")
    plan = _plan(keyed, scratch, weights, share, cap)
    rows = keyed.join(F.broadcast(plan), keyed["source"].eqNullSafe(plan["p_source"])).drop("p_source")
    cols = ["doc_id", "source", "tie", "size", "source_size", "target"]
    inner = rows.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).select(*cols, _copies(_below(), cap).alias("copies"))
    return inner.unionByName(_edge(rows).select(*cols, _copies(F.col("once"), cap).alias("copies"))).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, buckets: int = BUCKETS, weight: Column | str | None = None) -> DataFrame:
    """The rows of `docs` as often as the mix takes them.

    A row outside of its source's last range is repeated where it is read; only those ranges are shuffled. Rows of
    equal id, source and text draw alike: so many of them as the mix takes are taken, in order of their other columns.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    drawn = _drawn(_own_aside(docs.withColumn("_row", F.struct(*[docs[c] for c in docs.columns]))), buckets, weight).select("_row", "doc_id", "source", "size", "key", "tie", "bucket")
    keyed = scratch.keep(drawn.drop("_row"), "keyed")
    plan = _plan(keyed, scratch, weights, share, cap)
    planned = lambda df: df.join(F.broadcast(plan), df["source"].eqNullSafe(plan["p_source"])).drop("p_source")
    edge = _edge(planned(keyed)).groupBy("source", "doc_id", "tie", "epochs").agg(F.count_if("once").alias("some"))
    edge = scratch.keep(edge.select(F.col("source").alias("e_source"), F.col("doc_id").alias("e_id"), F.col("tie").alias("e_tie"), "some"), "edge")
    rows = planned(drawn)
    inner = rows.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).select("_row", _copies(_below(), cap).alias("_n"))
    last = rows.where(F.col("bucket") == F.col("edge"))
    last = last.join(edge, last["source"].eqNullSafe(edge["e_source"]) & last["doc_id"].eqNullSafe(edge["e_id"]) & (last["tie"] == edge["e_tie"]))
    place = F.row_number().over(Window.partitionBy("source", "doc_id", "tie").orderBy(F.xxhash64("_row")))
    last = last.withColumn("once", place <= F.col("some")).select("_row", _copies(F.col("once"), cap).alias("_n"))
    taken = inner.unionByName(last).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def _own_aside(docs: DataFrame) -> DataFrame:
    """Without columns that have the names of the operator's own."""
    return docs.drop(*[c for c in docs.columns if c in OWN])
