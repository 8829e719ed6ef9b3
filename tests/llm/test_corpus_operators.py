"""Each corpus operator on odd tables, and against a plain version of itself on the smallest tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korbwerk.llm import components, decontaminate, elias_fano, embedding_dedup, language, line_dedup, mixing, ngram_join, ngram_lm, pii, queries, token_files, tokens, url_filter
from korbwerk.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "ab" * 60_000
ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, "one", "de", None, 3),
    (None, "the same five words here", "en", "b", 1), (6, "the same five words here", "en", "b", 1), (7, LONG, "de", "c", len(LONG)), (8, "x " * 30_000, None, "c", 60_000), (9, "Ünï çødé 中文 words and more words", "fr", "d", 9), (10, "a\nb\r\n\n", "fr", "d", 5),
]
CLASH = "size source_size target taken copies kept n_links component_id class_id fp text_hash tie tiles spans score lang_pred n_lines n_dropped _drop key bucket rid pos batch".split()


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm(tuple(r[c] for c in want.columns) for r in got.collect()) == norm(want.fetchall())


# --- 1


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://A.NET/x", ("a.net", "/x", "net/", "block")), ("http://a.net", ("a.net", "", None, "allow")),
        ("http://w.example.net/en/1", ("w.example.net", "/en/1", "example.net/en/", "allow")), ("http://example.com/de/?casino", ("example.com", "/de/", "example.com/de/", "block")), ("http://badexample.com/de/", ("badexample.com", "/de/", None, "allow")),
        ("http://x.com/casino-royale", ("x.com", "/casino-royale", None, "block")), ("http://x.com/casinos", ("x.com", "/casinos", None, "allow")), ("http://cheap-pills.com/a#b", ("cheap-pills.com", "/a", None, "block")), ("http://cheap-cheap.com/", ("cheap-cheap.com", "/", None, "allow")),
        ("x://h?q://z/net/", ("h", "", None, "allow")), ("http://h/" + "a" * 200_000, ("h", "/" + "a" * 200_000, None, "allow")),
    ],
)
def test_url(url, want):
    assert url_filter.UrlJudge()(url)[:4] == want


def test_url_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "x"), (1, "http://a.net/", "x"), (None, None, None)], "page_id long, url string, host string")
    assert [r.verdict for r in url_filter.judge_urls(df).collect()] == ["block", "block", "allow"]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_vocabulary(spark):
    terms = spark.createDataFrame([("Casino", 1.0), ("casino", 0.2), ("deal", 0.6), ("win", 0.4), ("track", 0.3), (None, 1.0), ("", 1.0), ("zero", 0.0), ("nan", float("nan"))], "term string, weight double")
    assert url_filter.vocabulary(terms) == {"casino": 1.0, "deal": 0.6, "win": 0.4, "track": 0.3}
    df = spark.createDataFrame([(1, "http://x.com/casino", "h"), (2, "http://x.com/deal-win", "h"), (3, "http://x.com/deal-track", "h"), (4, None, "h")], "page_id long, url string, hit string").withColumns({c: F.lit("clash") for c in ("t", "in", "st", "host", "rule", "_row", "_judged", "weight")})
    got = url_filter.judge_urls(df, keep=("page_id", "hit", "t", "in", "st", "rule"), weights=terms).orderBy("page_id").collect()
    assert [(r.verdict, r.hit, r.t, r["in"], r.st, r.rule) for r in got] == [(v, "h", "clash", "clash", "clash", None) for v in ("block", "block", "allow", "allow")]
    assert [r.verdict for r in url_filter.judge_urls(df, weights={}).collect()] == ["allow"] * 4


# --- 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 2), max_size=200), st.lists(st.integers(0, 2**64 - 2), max_size=20))
def test_elias_fano(values, others):
    v = np.array(sorted(values), dtype=np.uint64)
    ef = elias_fano.EliasFano({f"a.{k}": x for k, x in elias_fano.build(v, 2**64).items()}, "a")
    assert (ef.get(np.arange(len(v))) == v).all()
    asked = np.array([*values, *others], dtype=np.uint64)
    for x, i in zip(asked.tolist(), ef.find(asked).tolist(), strict=True):
        assert (i >= 0) == (x in set(values)) and (i < 0 or int(v[i]) == x)
    pairs = elias_fano.EliasFano({f"a.{k}": x for k, x in elias_fano.build(v, 2**64, searched=False).items()}, "a")
    if len(v) > 1:
        assert [x.tolist() for x in pairs.get_pair(np.arange(len(v) - 1))] == [v[:-1].tolist(), v[1:].tolist()]


def test_elias_fano_dense_buckets():
    v = np.concatenate((np.arange(5000), np.array([10**9, 2 * 10**12]))).astype(np.uint64)
    ef = elias_fano.EliasFano({f"a.{k}": x for k, x in elias_fano.build(v, 2 * 10**12 + 1).items()}, "a")
    assert (ef.find(v) == np.arange(len(v))).all() and (ef.find(np.array([5000, 10**9 + 1], np.uint64)) == -1).all()


@pytest.mark.parametrize("block", [3, 16, tokens.BLOCK])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\t\x0bé中", max_size=30), min_size=1, max_size=6))
def test_word_hashes(block, texts):
    import pyarrow as pa

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "BLOCK", block)
        patch.setattr(tokens, "_powers", [])
        cut = tokens.word_hashes(*tokens.as_bytes(pa.array(texts)))
    assert [x.tolist() for x in cut] == [x.tolist() for x in tokens.word_hashes(*tokens.as_bytes(pa.array(texts)))]
    hashes, counts = tokens.word_hashes(*tokens.as_bytes(pa.array(texts)))
    every = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(every, hashes.tolist(), strict=True))) == len(set(every)) == len(set(hashes.tolist()))


def lm_plain(rows, least=1):
    """(text -> score, base) of a trigram model with absolute discounting, trained on all rows, of n-grams that occur `least` times."""
    seqs = [[*words(t), None] for t in rows]
    c = [collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()]
    for s in seqs:
        for k, t in enumerate(s):
            c[1][t] += 1
            c[2][s[k - 1] if k else None, t] += 1
            if k:
                c[3][s[k - 2] if k > 1 else None, s[k - 1], t] += k > 1
                c[3][None, s[k - 1], t] += k == 1
    n, v = sum(c[1].values()), len(c[1])
    kept = {k: {g: x for g, x in c[k].items() if x >= least} for k in (2, 3)}
    used = collections.Counter()
    for k in (2, 3):
        for g, x in kept[k].items():
            used[g[:-1]] += x - 0.75

    def score(text):
        s, total, base = [*words(text), None], 0.0, 0.0
        for k, t in enumerate(s):
            p = (c[1][t] + 1) / (n + v + 1)
            base += math.log10(p)
            before = s[k - 1] if k else None
            if c[1][before]:
                p = max(kept[2].get((before, t), 0) - 0.75, 0) / c[1][before] + (1 - used[before,] / c[1][before]) * p
            if k and (first := (s[k - 2] if k > 1 else None, before)) in kept[2]:
                p = max(kept[3].get((*first, t), 0) - 0.75, 0) / kept[2][first] + (1 - used[first] / kept[2][first]) * p
            total += math.log10(p)
        return total, base

    return score


@pytest.mark.parametrize(("least", "shards"), [(1, 5), (1, None), (2, 3)])
def test_language_model(spark, docs, least, shards):
    some = docs.where("length(text) < 2000")
    trie = ngram_lm.train(some, shards=shards, min_count=least)
    plain = lm_plain([r.text for r in some.collect()], least)
    for r, (_, text) in zip(ngram_lm.score(some, trie).orderBy("doc_id").collect(), sorted((r.doc_id, r.text) for r in some.collect()), strict=True):
        score, base = plain(text)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=0.003) and r.n_tokens == len(words(text)) + 1


def test_language_model_query_keeps_single_ngrams(spark, sf_dir, monkeypatch):
    made, train = [], ngram_lm.train
    monkeypatch.setattr(ngram_lm, "train", lambda *a, **b: made.append(train(*a, **b)) or made[-1])
    assert queries.op2_language_model(spark, sf_dir).count() == 200
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~ngram_lm.held_out(F.col("doc_id"))).collect()
    seqs = [[None, *words(r.text), None] for r in rows]
    assert made[0].bases[1][-1] == len({p for s in seqs for p in zip(s, s[1:], strict=False)})


def test_language_model_query_equals_plain(spark, sf_dir):
    """The registered query on whole texts, held-out ones too."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    plain, known = lm_plain(train), {w for t in train for w in words(t)}
    for r, (i, text) in zip(queries.op2_language_model(spark, sf_dir).orderBy("doc_id").collect(), rows, strict=True):
        score, base = plain(text)
        assert (r.held_out, r.n_tokens, r.n_known) == (held(i), len(words(text)) + 1, sum(w in known for w in words(text)) + 1)
        assert r.train_tokens == sum(len(words(t)) + 1 for t in train) and r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=0.003)


def test_language_model_odd(spark, odd, none):
    trie = ngram_lm.train(odd.drop(*CLASH), shards=3)
    got = ngram_lm.score(odd, trie).collect()
    assert len(got) == len(ODD) and all(r.score <= 0 and r.n_known == r.n_tokens for r in got)
    empty = ngram_lm.train(none, shards=3)
    assert [r.base_score for r in ngram_lm.score(odd, empty).collect()] == [0.0] * len(ODD)
    assert ngram_lm.score(none, trie).count() == 0


# --- 3


def cosine_plain(rows):
    """(n_links, component_id) by id of vectors (id, list) that all have a direction and different ids."""
    unit = np.array([v for _, v in rows])
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    linked, ids = unit @ unit.T >= 0.95, np.array([i for i, _ in rows])
    label, before = ids, None
    while before is None or (label != before).any():
        before, label = label, np.where(linked, label[None, :], ids.max() + 1).min(axis=1)
    return {i: (int(n) - 1, int(c)) for i, n, c in zip(ids.tolist(), linked.sum(axis=1), label, strict=True)}


def test_embeddings_table(spark):
    """The registered query on the table of sf0.01, whole, against brute force; extra columns with the operator's own names do no harm."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    want = cosine_plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op3_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert {i: got[i] for i in want} == want and all(got[i] == (0, i) for i in got.keys() - want.keys())
    clash = table.limit(40).withColumns({c: F.lit("clash") for c in (*CLASH, "key", "unit", "copies", "pass", "code")})
    assert embedding_dedup.near_duplicates(clash).count() == 40


def test_embeddings_of_one_topic(spark):
    """Near pairs inside one tight group of vectors, which short prefixes do not tell apart."""
    rng = np.random.default_rng(9)
    topic = rng.standard_normal(48)
    unit = lambda x: x / np.linalg.norm(x)
    group = [unit(unit(topic) + 0.5 * unit(rng.standard_normal(48))) for _ in range(1500)]
    near = [unit(x + 0.28 * unit(rng.standard_normal(48))) for x in group[:300]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*group, *near, *rng.standard_normal((300, 48))])]
    want = cosine_plain(rows)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64, margin=16).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items()) and sum(got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 300


def test_passes_follow_the_data():
    f = embedding_dedup.passes_for
    assert f({0: 10}) == 1 and f({3: 10}) < f({3: 10, 20: 10}) < f({20: 10}) < f({30: 10}) and f({}) == 1


def test_embeddings(spark, sf_dir):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base, base[:20] + 0.03 * rng.standard_normal((20, 16)), base[:1] + 0.02 * rng.standard_normal((150, 16)), base[3:4], base[3:4]])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(near)]
    bad = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, [float("nan")] * 16, 0), (905, [float("inf")] + [1.0] * 15, 0), (906, [1.0], 0), (906, [1.0], 0), (None, [2.0], 0), (907, [1e300] * 16, 0), (908, [1e-300] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=64, margin=16, tile=16).where("vec_id < 900").collect()}
    unit = near / np.linalg.norm(near, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    label = np.arange(len(near))
    for _ in range(len(near)):
        label = np.where(linked, label[None, :], 10**9).min(axis=1)
    assert [got[i].n_links for i in range(len(near))] == (linked.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(len(near))] == label.tolist()
    rest = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).where("vec_id >= 900 OR vec_id IS NULL").collect()]
    assert sorted(rest, key=str) == sorted([(i, 0, i) for i in range(900, 906)] + [(906, 2, 906), (906, 2, 906), (None, 2, 906), (907, 1, 907), (908, 1, 907)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- 4


def test_lines(spark, odd, none):
    rows = [(i, f"Top \nonly {i}\n\ttop", "en", "a", 1) for i in range(12)] + [(i, "few", "en", "a", 1) for i in range(20, 25)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOC), min_docs=10).collect()
    assert {(r.n_lines, r.n_dropped, r.kept) for r in got if r.doc_id < 12} == {(3, 2, f"only {i}") for i in range(12)}
    assert {r.kept for r in got if r.doc_id >= 20} == {"few"}
    found = line_dedup.drop_repeated_lines(odd, min_docs=2).collect()
    assert len(found) == len(ODD) and {(r.doc_id, r.n_dropped) for r in found if r.n_dropped} == {(4, 1), (5, 1), (6, 1), (None, 1)}
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_line_runs_join_and_merge_without_exchange(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "runs"), 3, fanout=3)
    counts = lambda lo, hi: spark.range(lo, hi).select(*line_dedup.hashes(F.col("id").cast("string"))).groupBy("h1", "h2").agg(F.lit(2).cast("long").alias("docs"))
    for lo in (0, 50, 100, 60, 70):
        runs.add(counts(lo, lo + 100))
    assert [len(x) for x in runs.levels] == [2, 1]
    for df in (runs.unknown(runs.runs[0]), runs.both(*runs.runs[:2])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = {i for i in range(200) if sum(lo <= i < lo + 100 for lo in (0, 50, 100, 60, 70)) >= 2}
    assert runs.frequent().count() == len(want)
    runs.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


# --- 5


def test_token_files(spark, odd, none, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.tokenizer_path())
    for df in (odd, docs.where("doc_id % 7 = 0")):
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.tokenised(df).collect()), key=lambda x: x[0])
        at, want = 0, []
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, token_files.END_ID]
            want.append((at, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    assert token_files.tokenised(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aZ é'.,!ß\n\t<|endoftext>1²", max_size=60))
def test_encoder(text):
    encode = token_files.encoder(token_files.tokenizer_path())
    (got,) = encode([text])
    assert np.frombuffer(got, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    """A tokenizer that keeps case and has tokens across spaces is used as it is."""
    encode = token_files.Encoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    texts = ["Hello World, hello world", "  two  spaces", "Ünï"]
    assert encode.plain is None
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# --- 6


def test_mixing(spark, odd, none, docs):
    for df in (odd, docs):
        got = mixing.mix(df).collect()
        assert len(got) == df.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
        total = sum(r["size"] for r in got)
        sources = {r.source: (r.source_size, r.target) for r in got}
        assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for s, t in sources.values())
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    for s, (_, target) in sources.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= max(r["size"] for r in got if r.source == s) / 2 + 1
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_rows(spark, odd, docs):
    """`mixed` gives each row as often as `mix` says; rows of one id and text keep their other columns; empty texts are not taken thrice."""
    for df in (odd, docs):
        assert mixing.mixed(df).columns == df.columns
        want = collections.Counter()
        for r in mixing.mix(df).collect():
            want[r.doc_id, r.source, r["size"]] += r.copies
        got = collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in mixing.mixed(df).collect())
        assert got == +want
    rows = [(1, "a b c", "s", "x", 1), (1, "a b c", "s", "y", 2), (1, "a b c", "t", "z", 3)] + [(None, None, "s", "n", 0)] * 3 + [(i, "w " * i, "s", "o", i) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    for share in (0.5, 1.5, 2.0):
        got = collections.Counter(tuple(r) for r in mixing.mixed(df, share=share, weight="weight").collect())
        copies = mixing.mix(df, share=share, weight="weight")
        assert all(n <= (6 if r[0] is None else 2) for r, n in got.items()) and sum(got.values()) == copies.agg(F.sum("copies")).first()[0]
    assert {r[3] for r in got} == {"x", "y", "z", "n", "o"} - ({"n"} if not any(r[0] is None for r in got) else set())


# --- 7 and components


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t"), "c").collect())
    assert got == {x: c for x, c in parent.items() if any({x} < {a, b} for a, b in pairs)}


def near_plain(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [[bool(a) and bool(b) and i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *[label[j] for j in range(len(rows)) if linked[i][j]]]) for i in range(len(rows))]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return sorted(((rows[i][0], sum(linked[i]), ids[label[i]]) for i in range(len(rows))), key=str)


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(2)
    text = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    rows = [(i, " ".join(text[:j] + ["new"] + text[j + 1 :] + [f"t{i}"] * int(i % 3))) for i, j in enumerate(rng.integers(0, 80, 60))] + [(100 + i, " ".join(text[i:])) for i in range(0, 70, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (256, 8):
        got = ngram_join.near_duplicates(df, tile_classes=tile).collect()
        assert sorted(((r.doc_id, r.n_links, r.component_id) for r in got), key=str) == near_plain(rows)
    got = ngram_join.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.n_links, r.component_id) for r in got), key=str) == near_plain([(r[0], r[1]) for r in ODD])
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 9, 10], key=str)


def test_banding():
    b = ngram_join.banding()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** b >= ngram_join.RECALL > 1 - (1 - 0.8**ngram_join.ROWS) ** (b - 1)


# --- 8


def test_language(spark, docs, odd, none):
    split = docs.withColumn("held", language.held_out(F.col("doc_id")))
    model = language.train(split.where("NOT held"))
    got = language.predict(split.where("held"), model, keep=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    found = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, model).collect()]
    assert len(found) == len(ODD) and {p for i, p, _ in found if i in (1, 2, 3)} == {"und"} and all(0 <= s <= 1 for *_, s in found)
    mixed = spark.createDataFrame([(1, "Die verschung einheit und der unglich keit. The and attion of that thnnt with the erring and the."), (2, "中文")], "doc_id long, text string")
    a, b = language.predict(mixed, model, spans=True).orderBy("doc_id").collect()
    assert [s.lang for s in a.spans] == ["de", "en"] and (b.lang_pred in model.langs, b.score, b.spans) == (True, 0.0, [])
    assert language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.train(none)).collect()} == {"und"}


def language_plain(train, texts):
    """(language, score) of each text by per-word trigram scores and a best path, all in plain Python."""
    def grams(word):
        w = [0, *[ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word], 0]
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            yield ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) * 0xD6E8FEB86659FD93 % 2**64) >> 48

    split = lambda t: ["".join(g) for ok, g in itertools.groupby(t or "", str.isalpha) if ok]
    langs, counts = sorted({x for _, x in train}), collections.defaultdict(collections.Counter)
    for text, lang in train:
        for word in split(text):
            counts[lang].update(grams(word))
    total = {x: sum(counts[x].values()) + 0.1 * language.BUCKETS for x in langs}
    out = []
    for text in texts:
        paths = None
        for word in split(text):
            own = [sum(math.log((counts[x][g] + 0.1) / total[x]) for g in grams(word)) for x in langs]
            if paths is None:
                paths = [(v, [i]) for i, v in enumerate(own)]
                continue
            top = max(range(len(langs)), key=lambda i: paths[i][0])
            moved = [paths[top][0] - language.PENALTY > paths[i][0] for i in range(len(langs))]
            paths = [(max(paths[i][0], paths[top][0] - language.PENALTY) + own[i], (paths[top] if moved[i] else paths[i])[1] + [i]) for i in range(len(langs))]
        if paths is None:
            out.append(("und", 0.0))
            continue
        best, letters = max(paths, key=lambda p: p[0])[1], collections.Counter()
        for word, i in zip(split(text), best, strict=True):
            letters[i] += len(word)
        lang = max(range(len(langs)), key=lambda i: letters[i])
        out.append((langs[lang], letters[lang] / letters.total()))
    return out


def test_language_query_equals_plain(spark, sf_dir):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    some = [r for r in rows if len(r.text or "") < 4000]
    want = language_plain([(r.text, r.lang) for r in rows if not held(r.doc_id) and r.lang is not None and r.text is not None], [r.text for r in some])
    got = {r.doc_id: r for r in queries.op8_language(spark, sf_dir).collect()}
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == held(r.doc_id) for r in rows)
    same = [got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=0.02) for r, (lang, score) in zip(some, want, strict=True)]
    assert sum(same) >= 0.99 * len(same)


def test_language_more_labels_than_a_byte(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}qz" for k in range(20)), f"l{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.train(df)).collect()}
    assert got == {i: x for i, _, x in rows}
    with pytest.raises(ValueError, match="more than 2000"):
        language.train(spark.range(2001).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang")))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 7), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_viterbi(sizes, rnd):
    scores = np.array([[rnd.randint(-30, 0) for _ in range(3)] for _ in range(sum(sizes))], np.float32).reshape(-1, 3)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    label = language.Model.labels(None, first, np.array(sizes), scores, 7.0)
    worth = lambda row, path: sum(row[i][x] for i, x in enumerate(path)) - 7.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for at, n in zip(first, sizes, strict=True):
        row = scores[at : at + n]
        best = max((worth(row, p) for p in itertools.product(range(3), repeat=n)), default=0)
        assert worth(row, label[at : at + n].tolist()) == pytest.approx(best)


# --- 9


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_plain(text):
    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_personal_data(spark, sf_dir, none):
    pieces = ["a@b.c", "%d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456-7", "+1", " ", "é中", "x", "79927398713", "0", "-", "é@b.co", "\n"]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(pieces, 12)) for _ in range(400)] + [None, "", "a" * 50_000 + "@", "1" * 50_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "5 " * 20_000, LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", pii.span_text(F.transform(pii.base_spans(F.coalesce("text", F.lit(""))), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))).alias("s")).collect()
    assert [(r.doc_id, r.s) for r in got if r.s != pii_plain(texts[r.doc_id])] == []
    assert pii.personal_data(none).count() == 0
    result = {r.doc_id: r for r in queries.op9_personal_data(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert result[r.doc_id].base_sha256 == hashlib.sha256(pii_plain(r.text).encode()).hexdigest()


def test_disclosing_terms(spark, odd):
    rows = [(i, f"Agent Falkenrath wrote to m@x.org re no {i} and that was all") for i in range(4)] + [(10 + i, "that was all about nothing") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.personal_data(df)
    shown = df.join(got, "doc_id").select("doc_id", "text", "spans", F.coalesce("clean", "text").alias("clean"), "sha256").orderBy("doc_id").collect()
    assert all(r.sha256 == hashlib.sha256(r.clean.encode()).hexdigest() for r in shown)
    assert {r["text"][s["s"] : s["e"]] for r in shown[:4] for s in r.spans} == {"m@x.org", "Agent", "Falkenrath", "wrote"}
    assert all(r.spans == [] and r.clean == r["text"] for r in shown[4:])
    assert shown[0].clean == "   to [email] re no 0 and that was all"
    assert pii.personal_data(odd).count() == len(ODD)


def test_long_text_full_of_matches(spark):
    text = " ".join(f"a{i}@b.c 1.2.3.{i % 256} word" for i in range(20_000))
    got = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(got.spans) == 40_000 and got.clean == " ".join(["[email] [ip] word"] * 20_000)


def disclosed_plain(rows, disclosure=pii.DISCLOSURE, chance=pii.CHANCE):
    """By row number, the (start, end) of all disclosing terms: words of at least four letters, of texts without unspaced scripts."""
    spans, said, per = [], collections.Counter(), []
    for text in rows:
        text = text or ""
        base = [tuple(map(int, x.split(":")[1:])) + (x.split(":")[0],) for x in pii_plain(text).split(",") if x]
        blank = list(text)
        for s, e, _ in base:
            blank[s:e] = " " * (e - s)
        spans.append([(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{4,}", "".join(blank))])
        said.update({w.lower() for w in re.findall(r"[^\W\d_]{2,}", text)})
        per.append({f"{k}:{text[s:e].lower()}" for s, e, k in base})
    n, held, both = len(rows), collections.Counter(), collections.Counter()
    for entities, words_ in zip(per, spans, strict=True):
        held.update(entities)
        both.update((x, w) for x in entities for w in {w for _, _, w in words_})
    found = set()
    for (x, w), c in both.items():
        s = max(said[w], c)
        expected = s * held[x] / n
        if math.log2(n * c / (s * held[x])) >= disclosure * math.log2(n / held[x]) > 0 and expected < c and min(math.log(expected / c), c * (math.log(expected / c) + 1) - expected) <= math.log(chance):
            found.add((x, w))
    return [{(s, e) for s, e, w in mine if any((x, w) in found for x in entities)} for mine, entities in zip(spans, per, strict=True)]


def test_disclosing_terms_equal_plain(spark):
    rng = np.random.default_rng(3)
    common = [f"{a}{b}wort" for a in "abcdefgh" for b in "xyz"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(common, 12))
        if i % 4 == 0:
            text += f" Person{'abcdefgh'[i % 8]}name schrieb an p{i % 8}@x.org und {'einmal' if i % 16 else 'zweimal'} Tel +49 30 12345{i % 24:02d}"
        rows.append(text)
    got = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    want = disclosed_plain(rows)
    assert {r.doc_id: {(x.s, x.e) for x in r.spans if x.k == len(pii.KINDS)} for r in got} == dict(enumerate(want)) and any(want)


def test_terms_of_single_texts(spark, sf_dir):
    far = "and so the talk went on about nothing at all " * 4
    rows = [(1, f"Falkenrath met Li and 王小明 {far}m@x.org {far}falkenrath"), (2, f"Falkenrath went home {far}")] + [(10 + i, far + ("li an" if i < 9 else "")) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [r["text"][s["s"] : s["e"]] for s in sorted(r.spans)] for r in df.join(pii.personal_data(df, disclosure=0.8), "doc_id").collect()}
    assert got.pop(1) == ["Falkenrath", "王小", "小明", "m@x.org", "falkenrath"] and not any(got.values())
    rare = spark.createDataFrame([(r[0], r[1].replace("li an", "")) for r in rows], "doc_id long, text string")
    assert "Li" in {r[1][s["s"] : s["e"]] for r in [rows[0]] for s in pii.personal_data(rare).where("doc_id = 1").first().spans}
    for r in queries.op9_personal_data(spark, sf_dir).where("n_email + n_ip + n_card + n_phone > 0").collect():
        if "term" in r.spans:
            break
    else:
        raise AssertionError("no term found")


# --- 10


def test_contamination(spark, docs, odd, none):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"q{x}" for x in rng.integers(0, 10**6, n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 12, 20, 33, 60, 200))]
    texts = []
    for i, text in items:
        w = text.split()
        texts += [f"{LONG} {text} tail", " ".join(w[: len(w) // 2]), " ".join(w[: max(1, int(len(w) * 0.9))]), text.upper()]
    rows = list(enumerate(texts))
    items += [(50, None), (51, ""), (52, items[6][1]), (None, items[7][1])]
    # Two texts of one id that hold half an item each are not a hit.
    half = items[9][1].split()
    rows += [(900, " ".join(half[:32])), (900, " ".join(half[28:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("h", "hash", "item", "words", "n", "w0")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("h", "item", "words", "n", "w0")})
    runs = lambda t, k: {tuple(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)}
    cut = {i: (min(5, len(words(q))), runs(q, min(5, len(words(q))))) for i, q in items if words(q)}
    want = {(d, i) for d, t in rows for i, (k, q) in cut.items() if len(runs(t, k) & q) >= 0.8 * len(q)}
    assert {i for d, i in want if d % 4 == 0} >= {0, 1, 2, 3, 4} and not any(d == 900 for d, _ in want)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert decontaminate.contaminated(none, bench).count() == 0 == decontaminate.contaminated(df, bench.limit(0)).count()
    assert {r.doc_id for r in decontaminate.contaminated(odd, spark.createDataFrame([(1, "THE same five words here")], "item_id long, text string")).collect()} == {None, 6}


def test_needed_hits_keep_recall():
    for size in (5, 16, 17, 40, 300):
        need, drawn, held = decontaminate.needed_hits(size), min(size, decontaminate.SKETCH), math.ceil(0.8 * size - 1e-9)
        missed = sum(math.comb(held, h) * math.comb(size - held, drawn - h) for h in range(need) if 0 <= drawn - h <= size - held) / math.comb(size, drawn)
        assert missed <= 1 - decontaminate.RECALL + 1e-12


# --- recall against brute force on the tables themselves


@pytest.mark.parametrize("rounds", [1, ngram_join.ROUNDS])
def test_near_duplicates_chains(spark, rounds):
    """Buckets that hold several groups, chains of links, and texts that only share a part."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for g in range(6):
        text = base[:100] + [f"g{g}x{i}" for i in range(18)]
        for i in range(8):
            rows.append((len(rows), " ".join(text[3 * i :] + [f"e{g}y{j}" for j in range(3 * i)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, rounds=rounds, tile_classes=8).collect()
    assert sorted(((r.doc_id, r.n_links, r.component_id) for r in got), key=str) == near_plain(rows)


def test_near_duplicates_recall_on_documents(spark):
    """Links of the documents of sf0.01 whose ids are divisible by 50, against all documents."""
    rows = [(r.doc_id, shingles(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = {i: sum(1 for j, b in rows if j != i and a and b and len(a & b) >= 0.8 * len(a | b)) for i, a in rows if i % 50 == 0}
    got = {r.doc_id: r.n_links for r in queries.op7_ngram_join(spark, "/root/testdata/sf0.01").collect() if r.doc_id % 50 == 0}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0
