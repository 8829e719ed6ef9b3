"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korbwerk.llm import decontaminate, divergence, embedding_dedup, hard_negatives, language, line_dedup, mixing, ngram_join, ngram_lm, pii, sharding, token_files, url_filter
from korbwerk.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", ngram_lm.held_out(F.col("doc_id")))
    return ngram_lm.score(docs, ngram_lm.train(docs.where("not held_out")), keep=("doc_id", "held_out"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenised(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("component", "text_hash")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    return language.predict(docs, language.train(docs.where("not held_out")), keep=("doc_id", "held_out"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < len(pii.KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    removed = F.size(F.filter("spans", lambda x: x["full"])).cast("long")
    more = [(F.size("spans").cast("long") - removed).alias("n_generalised"), removed.alias("n_removed"), F.col("sha256").alias("sanitised_sha256")]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"), *more)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"), sharding.SHARDS, ["doc_id"])
    more = [F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return found.select("doc_id", "size", "text_crc32", *more)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_language_model": op2_language_model,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op8_language": op8_language,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
    "op11_sharding": op11_sharding,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}


def _hit(term: str) -> str:
    return rf"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INT)"


def _lower(col: str) -> str:
    return f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES: dict[str, str] = {
    "op1_url_filter": rf"""
WITH s AS (SELECT page_id, {_lower("coalesce(url, '')")} AS u,
                  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, u, {_lower("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM s),
h AS (SELECT *, {" + ".join(map(_hit, url_filter.STRICT_TERMS))} AS strict_hits, {" + ".join(map(_hit, url_filter.SOFT_TERMS))} AS soft_hits FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(strict_hits AS INT) AS strict_hits, CAST(soft_hits AS INT) AS soft_hits, CAST(strict_hits + soft_hits / {url_filter.SOFT_HITS} AS DOUBLE) AS weight FROM r""",
    "op4_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, {_lower(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
d AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "op6_mixing": rf"""
WITH k0 AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, length(text) / greatest({_WORDS}, 1) AS mean,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN mean BETWEEN 3.0 AND 12.0 THEN 1.0 WHEN mean BETWEEN 2.0 AND 25.0 THEN 0.5 ELSE 0.25 END)::DOUBLE AS key FROM k0),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    (list_value(3.0, 1.0, 2.0)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT])::DOUBLE AS w FROM s0),
s2 AS (SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM s1),
lv AS (SELECT arg_min(lam, ratio) AS level FROM s2 WHERE lam <= ratio),
t0 AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM s2, lv),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS epochs FROM t0),
p AS (SELECT *, greatest(target - epochs * source_size, 0) AS lft FROM t),
r AS (SELECT k.*, p.source_size, p.target, p.epochs, p.lft, floor((1 - exp(-key)) * {mixing.BUCKETS}) AS bucket,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, max(upto) OVER (PARTITION BY source, bucket) AS last_, min(upto - size) OVER (PARTITION BY source, bucket) AS base FROM r),
e AS (SELECT *, base <= lft AND last_ > lft AS edge, last_ <= lft AS below,
    upto <= lft OR (upto - size <= lft AND upto - lft <= lft - (upto - size)) AS inn FROM b),
o AS (SELECT *, lft - max(CASE WHEN inn THEN upto ELSE base END) OVER (PARTITION BY source, bucket) AS open_ FROM e),
f AS (SELECT *, edge AND NOT inn AND abs(open_ - size) < open_ AND row_number() OVER (PARTITION BY source, bucket ORDER BY inn, abs(open_ - size), key, doc_id) = 1 AS fill FROM o)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN below OR (edge AND (inn OR fill)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM f""",
    "op10_decontamination": rf"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM t),
z AS (SELECT DISTINCT least(len(ws), 5) AS width FROM w WHERE kind = 'i' AND len(ws) > 0),
g AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(ws) - width + 2), lambda k: array_to_string(ws[k:k + width - 1], ' '))) AS s
  FROM w JOIN z ON len(ws) >= width AND (kind = 'd' OR width = least(len(ws), 5))),
n AS (SELECT id, count(*) AS n_shingles FROM g WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_contained FROM g d JOIN g i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_contained, n_contained / n_shingles AS containment FROM m JOIN n ON item_id = id WHERE n_contained >= 0.8 * n_shingles - 1e-9""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
gc AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT gc.*, 1 + (1000000000::HUGEINT * (n + 5)) // (total::HUGEINT + 5 * v) AS p FROM gc JOIN l ON gc.lang = l.lang),
lc AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
lp AS (SELECT lc.lang, term, 1 + (1000000000::HUGEINT * (n::HUGEINT + 5)) // (total::HUGEINT + 5 * v) AS q FROM lc JOIN l ON lc.lang = l.lang),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM gp JOIN lp USING (lang, term) WHERE gp.n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.TOP}""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
}
