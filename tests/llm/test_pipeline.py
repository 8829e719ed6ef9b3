"""The pipeline's stages on the smallest tables."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from korbwerk.llm import decontaminate, ngram_join, queries, token_files
from test_corpus_operators import near_plain, shingles


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert ngram_join.near_duplicates(docs).where("n_links > 0").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
            kept = docs.count()
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[1] >= 0.95 * sizes[0] and kept < sizes[0]
    out = P.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == docs.count() and out.agg(F.min("start")).first()[0] == 0


def run_plain(rows, items):
    """(doc_id, start, n_tokens, ids_crc32) of the whole pipeline over documents of scripts that are all learned, in plain Python; mixing by its SQL."""
    from tokenizers import Tokenizer

    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    component = {i: c for i, _, c in near_plain([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    tests = [shingles(t) for t in items if shingles(t)]
    rows = [r for r in rows if not any(len(shingles(r["text"]) & t) >= 0.8 * len(t) for t in tests)]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows))
    out, at, encode = [], 0, Tokenizer.from_file(token_files.tokenizer_path()).encode
    text = {r["doc_id"]: r["text"] for r in rows}
    for doc_id, size, taken in sorted(con.sql(f"SELECT doc_id, size, taken FROM ({queries.ORACLES['op6_mixing']})").fetchall()):
        ids = [*encode(text[doc_id], add_special_tokens=False).ids, token_files.END_ID]
        for _ in range(taken // size):
            out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    return out


def test_run_equals_plain(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = P.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [len(s) for s in P.STAGES] == [2] * 5
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == run_plain(docs, items)


def test_texts_in_several_languages_stay(spark, sf_dir):
    """A text of which no language holds half of the letters is no reason to drop it; one without a known letter is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL AND length(text) > 300")
    pick = {r.lang: r.text[:290] for r in docs.collect()}
    rows = [(10**9, " ".join(list(pick.values())[:3])), (10**9 + 1, "12 34 --"), (10**9 + 2, "\u0531\u0532\u0533 \u0534\u0535")]
    more = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "text")])
    kept = {r.doc_id for r in P.identify_language(spark, docs.unionByName(more), sf_dir).collect()}
    assert kept >= {10**9} | {r.doc_id for r in docs.collect()} and not kept & {10**9 + 1, 10**9 + 2}


def test_stages_on_odd_tables(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three four five six", "en", None, 27), (3, "one two three four five six", "de", "a", 27), (3, "one two three four five six", "de", "a", 27), (4, "ab" * 50_000, "en", "b", 100_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("score", "lang_pred", "_id", "tie", "copies", "text_hash", "row")})
    sizes = []
    for df in (odd, odd.limit(0)):
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, df, sf_dir)
            assert kept.columns == odd.columns
            sizes.append(kept.count())
        assert P.STAGES[-1][1](spark, df, sf_dir).count() == df.count()
    assert sizes[:3] == [4, 4, 6] and sizes[4:] == [0] * 4
