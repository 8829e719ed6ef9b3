"""N-gram Jaccard join: MinHash banding, then exact verification on full sets of word shingles.

1. One pass over the texts gives each document the 128-bit fingerprint of its shingle set and its band hashes.
   Documents with equal sets are one class; from here on there is one row a class.
2. Band hashes are shuffled; classes that share one are candidates. Bands and rows follow from the wanted recall at
   the threshold (`banding`).
3. Candidates are verified within their band bucket, on full shingle sets, before anything is grouped: every class
   is compared with the bucket's smallest one. Classes that reach the threshold leave the bucket; the rest goes on
   with its own smallest class, for ROUNDS rounds (more are worth it where long boilerplate fills the buckets). Jaccard distance is a metric, so a class that links with one that
   left is itself within twice the distance of the class that both were compared with. Such pairs, of a similarity
   of at least 2 * threshold - 1, are therefore tied together, and no link is lost. Buckets that are not empty after
   all rounds are tied together whole.
4. Ties are joined into groups. A group is cut into tiles of bounded weight, and every pair of tiles is verified by
   one task, which returns link counts per class and a spanning forest of the verified links, not the pairs.
5. Verified links are joined into components.

Joins on a key that very many rows share (a class of a third of all documents, a bucket of a third of all classes)
are between tables that are written out, so that adaptive execution can split what is hot.

Defined cases. Words are A-Z lower-cased runs of non-white-space; a text of one to four words has one shingle of
all its words; texts that are null, empty or blank have no shingles and link with nothing. Repeated rows, and rows
with equal or null ids, are documents of their own in the same class. The component id is the smallest non-null
doc_id (null where all ids are null). An empty table gives an empty result. Extra columns are not carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch
from korbwerk.llm.components import components

THRESHOLD, RECALL, ROWS = 0.8, 0.999, 6
#: A tile holds about so many classes and shingles.
TILE_CLASSES, TILE_SHINGLES = 256, 1 << 20
#: Rounds of comparisons within band buckets, and the parts into which those with one class are dealt.
ROUNDS, PARTS = 1, 1024


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Number of bands of `rows` rows with which a pair at the threshold shares a band with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_011)
    return (draw.integers(0, 2**32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), draw.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)


def _row_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text."""
    from korbwerk.llm import tokens

    for first, last, words, counts in tokens.column_words(column):
        hashes, per_row = tokens.shingles(words, counts)
        ends = np.concatenate(([0], np.cumsum(per_row)))
        for i in range(last - first):
            yield np.unique(hashes[ends[i] : ends[i + 1]])


def _fingerprint(shingle_set: np.ndarray) -> bytes:
    from korbwerk.llm.tokens import mix64

    low = shingle_set.sum(dtype=np.uint64)
    high = mix64(shingle_set ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return high.astype(">u8").tobytes() + low.astype(">u8").tobytes()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, the class fingerprint (null without words), the number of shingles and the band hashes of each document."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from korbwerk.llm.tokens import mix64

        a, b = _permutations(bands * rows)
        a, b = a[:, None], b[:, None]
        weights = mix64(np.arange(1, rows + 1, dtype=np.uint64))
        salt = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(99))
        for batch in batches:
            prints, sizes, hashed = [], [], []
            for shingle_set in _row_sets(batch.column("text")):
                sizes.append(len(shingle_set))
                if not len(shingle_set):
                    prints.append(None)
                    hashed.append(None)
                    continue
                prints.append(_fingerprint(shingle_set))
                x = (shingle_set >> np.uint64(32)).astype(np.uint32)
                low = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
                for j in range(0, len(x), 1024):
                    np.minimum(low, (a * x[None, j : j + 1024] + b).min(axis=1), out=low)
                hashed.append(mix64((low.astype(np.uint64).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashed, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fp", "n", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp binary, n long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """fp and the shingle set (sorted 64-bit hashes, as bytes) of each document that has words."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, raw, held = [], [], 0
            for shingle_set in _row_sets(batch.column("text")):
                if len(shingle_set):
                    prints.append(_fingerprint(shingle_set))
                    raw.append(shingle_set.tobytes())
                    held += len(raw[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], ["fp", "shingles"])
                    prints, raw, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], ["fp", "shingles"])

    return docs.select("text").mapInArrow(sets, "fp binary, shingles binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, as a matrix product over the shingles that occur in both lists."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    lr, rr = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(shared):
        return out
    lp, rp = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
    lk, rk = shared[np.minimum(lp, len(shared) - 1)] == lv, shared[np.minimum(rp, len(shared) - 1)] == rv
    lp, lr, rp, rr = lp[lk], lr[lk], rp[rk], rr[rk]
    step = 8192
    lo, ro = np.argsort(lp, kind="stable"), np.argsort(rp, kind="stable")
    lp, lr, rp, rr = lp[lo], lr[lo], rp[ro], rr[ro]
    for at in range(0, len(shared), step):
        ls, rs = slice(*np.searchsorted(lp, [at, at + step])), slice(*np.searchsorted(rp, [at, at + step]))
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        a[lr[ls], lp[ls] - at] = 1
        b[rr[rs], rp[rs] - at] = 1
        out += a @ b.T
    return out


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of a subset of the links a-b that keeps everything connected that they connect."""
    parent, kept = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


CHECKED = "fp binary, center binary, near boolean, linked boolean"


def _compare(threshold: float):
    """Rows sorted by (center, part, role): the set of a center (role 0), then those to be compared with it -> for each whether it is near enough to be tied to the center, and whether it is linked with it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            fps, centers, near, linked = [], [], [], []
            for center, role, fp, raw in zip(*[batch.column(c).to_pylist() for c in ("center", "role", "fp", "shingles")], strict=True):
                if role == 0:
                    at, own = center, np.frombuffer(raw, np.uint64)
                    continue
                assert at == center
                other = np.frombuffer(raw, np.uint64)
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = int((own[place] == other).sum())
                union = len(own) + len(other) - common
                fps.append(fp)
                centers.append(center)
                near.append(common >= (2 * threshold - 1) * union - 1e-6)
                linked.append(common >= threshold * union - 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(centers, pa.binary()), pa.array(near, pa.bool_()), pa.array(linked, pa.bool_())], ["fp", "center", "near", "linked"])

    return compare


def _asked(left: DataFrame, scratch: Scratch, i: int) -> DataFrame:
    """Each class of a bucket (band, hash) of several, but its smallest one, with that one as its center."""
    buckets = left.groupBy("band", "hash").agg(F.min(F.struct("fp", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    buckets = scratch.keep(buckets.select("band", "hash", F.col("c.fp").alias("center"), F.col("c.n").alias("center_n")), f"buckets{i}")
    asked = left.join(buckets, ["band", "hash"]).where(F.col("fp") != F.col("center"))
    return scratch.keep(asked.select("band", "hash", "fp", "n", "center", "center_n"), f"asked{i}")


def _ties(asked: DataFrame, sets: DataFrame, scratch: Scratch, threshold: float, rounds: int) -> DataFrame:
    """Links (u, v) that join all classes which share a band and may reach the threshold; `sets` has the shingle set of each class in a bucket."""
    ties = []
    for i in range(rounds):
        # Sets whose sizes differ too much are not near; nothing is read for them.
        sized = F.least("n", "center_n") >= (2 * threshold - 1) * F.greatest("n", "center_n") - 1e-6
        pairs = asked.where(sized).select("fp", "center", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int").alias("part")).distinct()
        keys = pairs.select(F.col("center").alias("fp"), "part").distinct()
        centers = keys.join(sets, "fp").select(F.col("fp").alias("center"), "part", F.lit(0).alias("role"), "fp", "shingles")
        others = pairs.join(sets, "fp").select("center", "part", F.lit(1).alias("role"), "fp", "shingles")
        rows = centers.unionByName(others).repartition("center", "part").sortWithinPartitions("center", "part", "role")
        checked = scratch.keep(rows.mapInArrow(_compare(threshold), CHECKED), f"checked{i}")
        ties.append(checked.where("near").select(F.col("fp").alias("u"), F.col("center").alias("v")))
        left = asked.join(checked.where("linked").select("fp", "center"), ["fp", "center"], "left_anti")
        asked = _asked(scratch.keep(left.select("fp", "n", "band", "hash"), f"left{i}"), scratch, i + 1)
    ties.append(asked.select(F.col("fp").alias("u"), F.col("center").alias("v")))
    return reduce(DataFrame.union, ties)


VERIFIED = "fp binary, links long, other binary"


def _verify(threshold: float):
    """Rows sorted by (group, i, j) -> per class its weighted number of links within this pair of tiles (other is null), and forest links (other is set)."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        i, j = rows[0][:2]
        one = [r for r in rows if r[2] == i]
        two = one if i == j else [r for r in rows if r[2] == j]
        fps, links, others = [], [], []
        if one and two:
            left, right = [np.frombuffer(r[5], np.uint64) for r in one], [np.frombuffer(r[5], np.uint64) for r in two]
            common = overlaps(left, right)
            sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
            linked = common >= threshold * sizes - 1e-6
            if one is two:
                np.fill_diagonal(linked, False)
            weight_l, weight_r = np.array([r[4] for r in one]), np.array([r[4] for r in two])
            for rows_of, counts in ((one, linked @ weight_r),) if one is two else ((one, linked @ weight_r), (two, weight_l @ linked)):
                for r, c in zip(rows_of, counts.tolist(), strict=True):
                    if c:
                        fps.append(r[3])
                        links.append(c)
                        others.append(None)
            a, b = np.nonzero(np.triu(linked) if one is two else linked)
            for k in spanning(len(one) + len(two), a, b if one is two else b + len(one)):
                fps.append(one[a[k]][3])
                links.append(0)
                others.append(two[b[k]][3])
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(links, pa.int64()), pa.array(others, pa.binary())], ["fp", "links", "other"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "tile", "fp", "copies", "shingles")]
            for grp, i, j, tile, fp, copies, raw in zip(*cols, strict=True):
                if at != (grp, i, j):
                    if rows:
                        yield flush(rows)
                    at, rows = (grp, i, j), []
                rows.append((i, j, tile, fp, copies, raw))
        if rows:
            yield flush(rows)

    return verify


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, tile_classes: int = TILE_CLASSES, tile_shingles: int = TILE_SHINGLES, rounds: int = ROUNDS
) -> DataFrame:
    """Per document: class_id (smallest id among documents with the same shingle set), n_links (other documents with Jaccard at least `threshold`), component_id and kept (one document of each component)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngrams")
    bands = banding(threshold, recall, rows)
    signed = scratch.keep(signatures(docs, bands, rows), "signed")
    worded = signed.where(F.col("fp").isNotNull())
    # One document, by id and text, stands for its class: its text gives the shingle set.
    classes = worded.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_hash")).alias("own"), F.count("*").alias("copies"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")

    asked = _asked(classes.select("fp", "n", F.posexplode("bands").alias("band", "hash")), scratch, 0)
    several = asked.select("fp").union(asked.select("center")).distinct()
    wanted = scratch.keep(classes.join(several, "fp", "left_semi").select("fp", F.col("own.doc_id").alias("id"), F.col("own.text_hash").alias("hash")), "wanted")
    texts = docs.select("doc_id", "text").join(wanted.select("id", "hash"), docs["doc_id"].eqNullSafe(wanted["id"]) & (F.xxhash64(docs["text"]) == wanted["hash"]), "left_semi")
    sets = scratch.keep(shingle_sets(texts).dropDuplicates(["fp"]), "sets")

    ties = _ties(asked, sets, scratch, threshold, rounds)
    groups = scratch.keep(components(ties, scratch, "ties").withColumnRenamed("node", "fp").withColumnRenamed("component", "grp"), "groups")
    weighed = scratch.keep(groups.join(classes.select("fp", "copies", "n"), "fp"), "weighed")
    tiles = weighed.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / tile_classes), F.ceil(F.sum("n") / tile_shingles)).cast("int").alias("tiles"))
    members = weighed.join(scratch.keep(tiles, "tiles"), "grp").select("grp", "fp", "copies", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
    pairs = members.join(sets, "fp").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("grp", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), "tile", "fp", "copies", "shingles")
    pairs = pairs.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    verified = scratch.keep(pairs.mapInArrow(_verify(threshold), VERIFIED), "verified")

    counts = verified.where(F.col("other").isNull()).groupBy("fp").agg(F.sum("links").alias("links"))
    joined = components(verified.where(F.col("other").isNotNull()).select(F.col("fp").alias("u"), F.col("other").alias("v")), scratch, "links")
    joined = joined.withColumnRenamed("node", "fp")
    labelled = classes.select("fp", "class_id", "copies").join(joined, "fp", "left").join(counts, "fp", "left")
    labelled = labelled.select("fp", "class_id", F.coalesce("component", "fp").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    labelled = scratch.keep(labelled, "labelled")
    ids = scratch.keep(labelled.groupBy("component").agg(F.min("class_id").alias("component_id")), "ids")
    labelled = scratch.keep(labelled.join(ids, "component").select("fp", "class_id", "component", "component_id", "n_links"), "result")
    found = signed.select("doc_id", "text_hash", "fp").join(labelled, "fp", "left")
    alone = F.col("fp").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "component",
        "text_hash",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` less near-duplicates: of each component the document with the smallest id (and, of equal ids, hash) stays; documents without words all stay, exact repeats of a row once."""
    found = near_duplicates(docs, **options).where("kept")
    worded = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    stays = Scratch(docs.sparkSession, "one-of-each").keep(worded.union(found.where(F.col("component").isNull()).select("doc_id", "text_hash").distinct()), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("hash"))
    return rows.join(stays, rows["id"].eqNullSafe(stays["doc_id"]) & (rows["hash"] == stays["text_hash"]), "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
