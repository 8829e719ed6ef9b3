"""Sharding, source divergence and hard negatives: on odd tables and against plain versions."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from korbwerk.llm import divergence, hard_negatives, queries, sharding
from korbwerk.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "ab " * 60_000
ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, "one", "de", None, 3),
    (None, "the same five words here", "en", "b", 1), (6, "the same five words here", "en", "b", 1), (7, LONG, "de", "c", len(LONG)), (9, "Ünï ÇØdé 中文 wörds-and_more x", "fr", "d", 9),
]
CLASH = "size text_crc32 shard slot row key tie uid r terms lang_no total kept".split()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("clash") for c in CLASH})


def hot(spark, n=3000):
    """A third of all rows hold one text, and a third of these is one row repeated."""
    rows = spark.range(n).select(F.when(F.col("id") % 9 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.concat(F.lit("text "), "id", F.repeat(F.lit(" word"), (F.col("id") % 50).cast("int")))).alias("text"))
    return rows.withColumns({"lang": F.lit("en"), "source": F.lit("a")})


# Sharding


def lawful(found, docs, shards=8, group=sharding.GROUP):
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs}
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted((r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    total, most = sum(r.size for r in found), max(size.values(), default=0)
    for k in range(shards):
        assert abs(sum(r.size for r in by[k]) - total / shards) <= max(most, group * total / shards) + 1


def test_shards_are_equal_and_keep_small_groups(spark, docs):
    found, rows = sharding.sharded(docs, keep=["doc_id", "text"]).collect(), docs.collect()
    lawful(found, rows)
    where = collections.defaultdict(set)
    weight = collections.Counter()
    for r in found:
        where[r.text].add(r.shard)
        weight[r.text] += r.size
    limit = sharding.GROUP * sum(weight.values()) / 8
    assert all(len(s) == 1 for t, s in where.items() if weight[t] <= limit)


@pytest.mark.parametrize("most_rows", [sharding.MOST_ROWS, 40])
def test_shards_split_hot_groups(spark, most_rows):
    """A text that a third of the rows have, some of them in every column, is divided between shards and ranges."""
    rows = hot(spark)
    found = sharding.sharded(rows, keep=["doc_id", "text"], most_rows=most_rows).collect()
    lawful(found, rows.collect())
    assert len({r.shard for r in found if r.text.startswith("copy")}) > 2
    scratch = Scratch(spark, "test")
    keyed = scratch.keep(sharding.keyed(rows, ["doc_id"], None), "keyed")
    total = keyed.agg(F.sum("size")).first()[0]
    _, stats = sharding.ranges(keyed, scratch, total, 8, most_rows)
    largest = stats.agg(F.max("n")).first()[0]
    assert largest <= max(sharding.FEW, 2 * 3000 // 64 if most_rows > 3000 else 40)


def test_shards_equal_a_plain_version(spark, docs):
    """The order's middle bytes decide, group by group."""
    rows = docs.unionByName(docs.limit(40)).unionByName(docs.where("doc_id % 9 = 0"))
    order = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), F.xxhash64("doc_id", "text").alias("tie")).collect()
    order.sort(key=lambda r: (r.key, r.tie))
    sizes = [len((r.text or "").encode()) + 1 for r in order]
    total, at, want = sum(sizes), 0, collections.Counter()
    group = collections.Counter()
    for r, s in zip(order, sizes, strict=True):
        group[r.key] += s
    start, last = 0, None
    for r, s in zip(order, sizes, strict=True):
        if r.key != last:
            start, last = at, r.key
        middle = start + group[r.key] / 2 if group[r.key] <= sharding.GROUP * total / 8 else at + s / 2
        want[r.doc_id, s, min(int(middle * 8 / total), 7)] += 1
        at += s
    assert want == collections.Counter((r.doc_id, r.size, r.shard) for r in sharding.sharded(rows).collect())


def test_shards_of_odd_tables(spark, odd, tmp_path):
    found = sharding.sharded(odd, 3, odd.columns).collect()
    lawful(found, odd.collect(), 3)
    assert {r.key for r in found} == {"clash"} and {type(r.size) for r in found} == {int}
    nothing = sharding.sharded(odd.limit(0))
    assert nothing.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and nothing.collect() == []
    by_key = sharding.sharded(odd, 2, key=F.col("source")).collect()
    lawful(by_key, odd.collect(), 2)
    sharding.write(odd, str(tmp_path / "out"), 3)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == len(ODD) and sorted((r.shard, r.slot) for r in read.collect()) == sorted((r.shard, r.slot) for r in found)


def test_shards_query(spark, sf_dir, docs):
    found = queries.op11_sharding(spark, sf_dir)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert "Python" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    lawful(rows, docs.collect())
    assert rows and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sorted(rows) == sorted(queries.op11_sharding(spark, sf_dir).collect())


# Divergence


def plain_audit(rows, min_docs, top=50, smooth=5, scale=10**9):
    docs = [(r.lang or "", r.source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {s: collections.Counter() for _, s, _ in mine}
        for _, s, ts in mine:
            counts[s].update(t for t in ts if t in kept)
        share = lambda c: {t: 1 + scale * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 30])
def test_divergence_of_odd_tables(spark, odd, min_docs):
    found = divergence.audit(odd, min_docs)
    assert sorted(map(tuple, found.collect())) == plain_audit(odd.collect(), min_docs)
    assert divergence.audit(odd.limit(0), min_docs).collect() == []


def test_divergence_of_documents(spark, docs):
    found = divergence.audit(docs, 4, top=7)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs.collect(), 4, top=7)


def test_vocabulary_has_no_bound_and_shares_stay_exact(spark):
    assert divergence.VOCABULARY == 2**31 - 1
    count, total, terms = 3 * 10**12 + 1, 10**13 + 7, 10**6
    df = spark.createDataFrame([(count, total, terms), (0, 0, 0)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (count + 5) // (total + 5 * terms), None]


# Hard negatives


def plain_mine(rows, every=100, positives=5, negatives=5):
    good = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = [(i, lab, list(v)) for i, lab, v in dict.fromkeys((i, lab, tuple(v)) for i, lab, v in good)]
    out = []
    for a, lab, v in good:
        if a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other == lab) for i, other, w in good if len(w) == len(v)]
        best = sorted((-s, i) for s, i, same in scored if same and i != a)[:positives]
        for ps, p in ((-s, i) for s, i in best):
            fits = sorted((-s, i) for s, i, same in scored if not same and 80 * ps <= 100 * s <= 100 * ps)[:negatives]
            out += [(a, p, k, i, ps, -s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


VECTOR = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("tile, block", [(hard_negatives.TILE, hard_negatives.BLOCK), (30, 3)])
def test_negatives_equal_brute_force(spark, sf_dir, tile, block):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = hard_negatives.mine(rows, every=7, tile=tile, block=block)
    want = plain_mine([(r.vec_id, r.label, r.embedding) for r in rows.collect()], every=7)
    assert sorted(map(tuple, found.collect())) == want and want


def test_negatives_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.24], 2), (3, [0.5, 0.24], 2), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 2), (8, [1.0, 1.0], None),
        (None, [0.5, 0.2], 2), (9, [], 1), (100, [], 1), (10, [], 2), (11, [0.4, 0.3, 0.1], 1), (200, [0.4, 0.3, 0.1], 2), (12, [0.0, 0.0], 3), (13, [-0.5, -0.25], 2), (300, [0.0, 0.0], 3), (400, [3e30, 1.0], 4), (14, [3e30, -1.0], 4), (15, [2.9e30, 5.0], 5), (500, [-0.5, -0.2], 2), (500, [-0.5, -0.3], 2),
    ]
    df = spark.createDataFrame(rows, VECTOR).withColumns({c: F.lit("clash") for c in ("label_", "dim", "tile", "x", "v", "anchor", "score", "rank")})
    found = sorted(map(tuple, hard_negatives.mine(df).collect()))
    plain = [(i, lab, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v, lab in rows if i not in (400, 14, 15)]
    assert [r for r in found if r[0] != 400] == plain_mine(plain)
    assert [r[:4] for r in found if r[0] == 400] == [(400, 14, k, i) for k, i in enumerate((0, 1, 2, 3, 15), 1)]
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_negatives_of_one_hot_vector(spark):
    """A third of the rows have one vector: their tile is divided, and ties go by id."""
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, 0.5, 0.1] if i % 3 == 0 else [round(float(x), 3) for x in rng.uniform(-1, 1, 3)], i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, VECTOR)
    scratch = Scratch(spark, "test")
    tiles = hard_negatives.tiled(scratch.keep(hard_negatives.points(df), "points"), scratch, tile=20)
    assert tiles.count() == 900 and max(r["count"] for r in tiles.groupBy("label", "dim", "tile").count().collect()) <= 80
    assert sorted(map(tuple, hard_negatives.mine(df, every=50, tile=20).collect())) == plain_mine([(i, lab, np.array(v, dtype=np.float32).tolist()) for i, v, lab in rows], every=50)


def test_tree_skips_boxes_and_misses_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 6))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-4, 5, (3000, 6))).astype(np.int64)
    order = hard_negatives.str_order(x)
    assert sorted(order.tolist()) == list(range(3000))
    x = np.ascontiguousarray(x[order])
    ids = np.arange(3000, dtype=np.int64)
    corners = b"".join(c.tobytes() for level in hard_negatives.boxes(x) for c in level)
    tree = hard_negatives.Tree(6, ids.tobytes(), x.tobytes(), corners)
    read = 0
    for a in x[::300]:
        score = x @ a
        top = int(score.max())
        windows = [(-np.inf, np.inf), (top // 2, top * 8 // 10), (top + 1, top + 9)]
        ends = [(lo[0], hi[0]) for lo, hi in tree.bounds(a[None, :])]
        found, leaves = tree.search(a.astype(np.float64), ends, windows, 5)
        read += leaves
        for w, f in zip(windows, found, strict=True):
            fit = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if w[0] <= s <= w[1])[:5]
            assert f == [(-s, i) for s, i in fit]
    assert read < 10 * len(tree.levels[0][0])


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_hard_negatives"])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, sf_dir)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
