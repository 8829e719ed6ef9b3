"""Registered queries: further joins, counters, state changes and predicates of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.functions import price as P
from korbwerk.functions import text
from korbwerk.operators import relational as R
from korbwerk.plans.registry import query
from korbwerk.plans.views import AS_OF, Views, as_of

DAY = f"DATE '{AS_OF}'"
OFFER = ["store_id", "product_id", "valid_from", "price"]


@query("s7_best_document", " SELECT user_id, arg_max(event_id, (value, event_id)) AS best FROM events WHERE event_type <> 'error' GROUP BY 1")
def s7(v: Views) -> DataFrame:
    """Of the documents that answered, the largest, then the last."""
    return v.table("events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"))


@query("s15_static_places", " SELECT user_id, coalesce(n.r, 'unknown') AS place FROM users LEFT JOIN (SELECT n_nationkey AS k, n_name AS r FROM nation WHERE n_nationkey % 2 = 0) n ON n.k = user_id % 25")
def s15(v: Views) -> DataFrame:
    known = v.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("r"))
    return v.users.withColumn("k", F.col("user_id") % 25).join(known, "k", "left").select("user_id", F.coalesce("r", F.lit("unknown")).alias("place"))


@query("s17_source_registry", " SELECT store_id, CASE WHEN store_id % 5 = 0 THEN 'tuned-' || store_id WHEN store_id % 5 = 1 THEN 'own-' || store_id ELSE 'fallback-' || retailer END AS source FROM stores")
def s17(v: Views) -> DataFrame:
    """A store's own source, else the address it names, else its chain's."""
    tuned = v.stores.where("store_id % 5 = 0").select("store_id", F.concat(F.lit("tuned-"), "store_id").alias("tuned"))
    own = F.when(F.col("store_id") % 5 == 1, F.concat(F.lit("own-"), "store_id"))
    return v.stores.join(tuned, "store_id", "left").select("store_id", F.coalesce("tuned", own, F.concat(F.lit("fallback-"), "retailer")).alias("source"))


@query("s18_content_once", " SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def s18(v: Views) -> DataFrame:
    return v.table("documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("f19_f20_store_and_dates", " SELECT o.store_id, count(*) AS n FROM offers o JOIN stores s USING (store_id) WHERE o.valid_to >= o.valid_from AND s.retailer = 'REWE' GROUP BY 1")
def f19(v: Views) -> DataFrame:
    return v.offers.where("valid_to >= valid_from").join(v.stores.where("retailer = 'REWE'"), "store_id").groupBy("store_id").agg(F.count("*").alias("n"))


@query("f22_f25_pages_to_read", " SELECT store_id, day, page FROM (SELECT store_id, day, unnest(range(1, pages + 1)) AS page FROM archives) p WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.store_id = p.store_id AND o.valid_from = p.day AND o.page = p.page)", dates="day")
def f22(v: Views) -> DataFrame:
    pages = v.archives.select("store_id", "day", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages"))).alias("page"))
    return pages.join(v.offers.select("store_id", F.col("valid_from").alias("day"), F.col("page").cast("long").alias("page")), ["store_id", "day", "page"], "left_anti")


@query("f28_plausible", " SELECT product_id, abs(price / (grams / 10.0::DOUBLE) - 50) <= 50 * 0.15 AS plausible FROM (SELECT p_partkey AS product_id, p_retailprice AS price, p_size AS grams FROM part)")
def f28(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("product_id"), (F.abs(F.col("p_retailprice") / (F.col("p_size") / 10.0) - 50) <= 50 * 0.15).alias("plausible"))


_ALIAS = ", aliases AS (SELECT lower(brand) || ' ' || product_name AS alias_key, max(product_id) AS product_id FROM products WHERE grams % 2 = 0 GROUP BY 1), keys AS (SELECT lower(brand) || ' ' || product_name AS key, min(product_id) AS product_id FROM products GROUP BY 1)"


@query("j17_alias_or_key", _ALIAS + " SELECT p.product_id, coalesce(a.product_id, k.product_id) AS resolved FROM products p LEFT JOIN aliases a ON a.alias_key = lower(p.brand) || ' ' || p.product_name LEFT JOIN keys k ON k.key = lower(p.brand) || ' ' || p.product_name")
def j17(v: Views) -> DataFrame:
    p = v.products.withColumn("key", F.concat_ws(" ", F.lower("brand"), "product_name"))
    aliases = p.where("grams % 2 = 0").groupBy("key").agg(F.max("product_id").alias("alias_id"))
    keys = p.groupBy("key").agg(F.min("product_id").alias("key_id"))
    return p.join(aliases, "key", "left").join(keys, "key", "left").select("product_id", F.coalesce("alias_id", "key_id").alias("resolved"))


@query("j19_j21_catalogue", " SELECT m.media_id, p.product_name FROM media m JOIN products p USING (product_id) WHERE m.source = 'retailer_cdn' AND NOT EXISTS (SELECT 1 FROM current_offers o WHERE o.product_id = m.product_id)")
def j19(v: Views) -> DataFrame:
    return v.media.where("source = 'retailer_cdn'").join(v.products, "product_id").join(v.current, "product_id", "left_anti").select("media_id", "product_name")


_BOXES = ", b AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey * 37 % 600 AS x, l_partkey * 53 % 800 AS y FROM lineitem GROUP BY ALL)"


@query("j22_j23_spatial", _BOXES + """, d AS (SELECT a.page, a.n, a.x, a.y, b.n AS m, b.x AS px, b.y AS py, sqrt(pow(a.x - b.x - 10, 2) + pow(a.y - b.y - 30, 2)) - CASE WHEN a.x // 300 = b.x // 300 THEN 90 ELSE 0 END AS cost FROM b a JOIN b ON a.page = b.page)
 SELECT page, n, x, y, count(*) AS options, round(min(cost), 6) AS cost FROM d WHERE cost <= 185 GROUP BY 1, 2, 3, 4""")
def j22(v: Views) -> DataFrame:
    """For each label the price tags of its page within 185 units, those in the same half of the page favoured by 90."""
    k = F.col("l_partkey")
    b = v.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), (k * 37 % 600).alias("x"), (k * 53 % 800).alias("y")).distinct()
    tags = b.select("page", F.col("x").alias("px"), F.col("y").alias("py"), F.col("n").alias("m"))
    same = F.floor(F.col("x") / 300) == F.floor(F.col("px") / 300)
    cost = F.sqrt(F.pow(F.col("x") - F.col("px") - 10, 2) + F.pow(F.col("y") - F.col("py") - 30, 2)) - F.when(same, 90).otherwise(0)
    return b.join(tags, "page").withColumn("cost", cost).where("cost <= 185").groupBy("page", "n", "x", "y").agg(F.count("*").alias("options"), F.round(F.min("cost"), 6).alias("cost"))


@query("j25_best_image", """, t AS (SELECT DISTINCT product_name AS name, unnest(string_split(product_name, ' ')) AS w FROM products), i AS (SELECT product_id, unnest(list_distinct(string_split(lower(kind) || ' ' || product_name, ' '))) AS w FROM products WHERE grams > 45),
 s AS (SELECT name, product_id, count(*) AS shared FROM t JOIN i USING (w) GROUP BY 1, 2) SELECT name, arg_max(product_id, (shared, -product_id)) AS image FROM s WHERE shared >= 2 GROUP BY 1""")
def j25(v: Views) -> DataFrame:
    """The image whose words overlap most with a name, at least two."""
    names = v.products.select(F.col("product_name").alias("name"), F.explode(F.split("product_name", " ")).alias("w")).distinct()
    images = v.products.where("grams > 45").select("product_id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", F.lower("kind"), "product_name"), " "))).alias("w"))
    shared = names.join(images, "w").groupBy("name", "product_id").agg(F.count("*").alias("shared")).where("shared >= 2")
    return shared.groupBy("name").agg(F.max_by("product_id", F.struct("shared", -F.col("product_id"))).alias("image"))


@query("j26_run_snapshots", " SELECT r.run_id, s.status AS snapshot FROM runs r LEFT JOIN (SELECT run_id + 1 AS run_id, status FROM runs WHERE value > 5) s USING (run_id)")
def j26(v: Views) -> DataFrame:
    s = v.runs.where("value > 5").select((F.col("run_id") + 1).alias("run_id"), F.col("status").alias("snapshot"))
    return v.runs.join(s, "run_id", "left").select("run_id", "snapshot")


@query("j28_users_with_stores", " SELECT user_id, list_sort(list(store_id)) AS stores FROM users JOIN favourites USING (user_id) GROUP BY 1", lists="stores")
def j28(v: Views) -> DataFrame:
    return v.users.join(v.favourites, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list("store_id")).alias("stores"))


@query("j31_favourite_offers", " SELECT product_id, store_id FROM current_offers WHERE product_id % 50 = 0 UNION SELECT o.product_id, o.store_id FROM current_offers o JOIN products p USING (product_id) WHERE p.product_name IN (SELECT product_name FROM products WHERE product_id % 400 = 0)")
def j31(v: Views) -> DataFrame:
    exact = v.current.where("product_id % 50 = 0").select("product_id", "store_id")
    family = v.products.join(v.products.where("product_id % 400 = 0").select("product_name"), "product_name", "left_semi").select("product_id")
    return exact.union(v.current.join(family, "product_id", "left_semi").select("product_id", "store_id")).distinct()


@query("a2_health", " SELECT count(*) FILTER (WHERE active AND verified) AS released, (SELECT count(*) FROM runs WHERE status IN ('failed', 'warning', 'running')) AS problems FROM stores")
def a2(v: Views) -> DataFrame:
    return v.stores.agg(F.count_if(F.col("active") & F.col("verified")).alias("released")).join(v.runs.agg(F.count_if(F.col("status").isin("failed", "warning", "running")).alias("problems")))


@query("a5_first_offer", " SELECT product_id, store_id, price FROM current_offers QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id, valid_from) = 1")
def a5(v: Views) -> DataFrame:
    return R.top(v.current, ["product_id"], ["price", "store_id", "valid_from"]).select("product_id", "store_id", "price")


@query("a19_a23_review_stats", " SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 0) AS correct, count(*) FILTER (WHERE toxic = 1) AS wrong, count(*) FILTER (WHERE quality IS NULL) AS \"open\", floor(count(*) FILTER (WHERE toxic = 0) / count(*)::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS accuracy FROM documents JOIN labels USING (doc_id)")
def a19(v: Views) -> DataFrame:
    j = v.table("documents").select("doc_id").join(v.table("labels"), "doc_id")
    ok = F.col("toxic") == 0
    return j.agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("wrong"), F.count_if(F.col("quality").isNull()).alias("open"), R.rate(F.count_if(ok), F.count("*")).alias("accuracy"))


@query("a21_leaflet_counters", " SELECT store_id, count(*) FILTER (WHERE local) AS local, count(*) FILTER (WHERE NOT local) AS online, count(*) FILTER (WHERE product_id % 2 = 0) AS food FROM offers GROUP BY 1")
def a21(v: Views) -> DataFrame:
    return v.offers.groupBy("store_id").agg(F.count_if("local").alias("local"), F.count_if(~F.col("local")).alias("online"), F.count_if(F.col("product_id") % 2 == 0).alias("food"))


@query("a26_by_kind", " SELECT kind, count(*) AS offers, round(sum(price), 2) AS subtotal, count(DISTINCT store_id) AS stores FROM current_offers JOIN products USING (product_id) GROUP BY 1")
def a26(v: Views) -> DataFrame:
    return v.current.join(v.products, "product_id").groupBy("kind").agg(F.count("*").alias("offers"), F.round(F.sum("price"), 2).alias("subtotal"), F.count_distinct("store_id").alias("stores"))


@query("w4_primary_provenance", " SELECT l_suppkey AS store_id, l_partkey AS product_id, l_orderkey AS provenance FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber, l_orderkey) = 1")
def w4(v: Views) -> DataFrame:
    return R.top(v.table("lineitem"), ["l_suppkey", "l_partkey"], [F.desc("l_shipdate"), "l_linenumber", "l_orderkey"]).select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("provenance"))


@query("w6_logo_with_fallback", " SELECT p.product_id, coalesce(a.id, b.id) AS logo FROM products p LEFT JOIN (SELECT product_id, max(media_id) AS id FROM media WHERE active AND is_primary GROUP BY 1) a USING (product_id) LEFT JOIN (SELECT product_id, max(media_id) AS id FROM media WHERE active GROUP BY 1) b USING (product_id)")
def w6(v: Views) -> DataFrame:
    best = v.media.where("active").groupBy("product_id").agg(F.max_by("media_id", F.struct("is_primary", "media_id")).alias("logo"))
    return v.products.select("product_id").join(best, "product_id", "left")


@query("w14_cell_bounds", _BOXES + ", r AS (SELECT DISTINCT page, x FROM b) SELECT page, x, (x + lag(x) OVER w) / 2.0 AS lo, (x + lead(x) OVER w) / 2.0 AS hi FROM r WINDOW w AS (PARTITION BY page ORDER BY x)")
def w14(v: Views) -> DataFrame:
    """Each column of a page reaches to the middle between it and its neighbours."""
    x = v.table("lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 37 % 600).alias("x")).distinct()
    w = Window.partitionBy("page").orderBy("x")
    return x.select("page", "x", ((F.col("x") + F.lag("x").over(w)) / 2.0).alias("lo"), ((F.col("x") + F.lead("x").over(w)) / 2.0).alias("hi"))


@query("t4_t5_latest_runs", " SELECT run_id, store_id, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 30")
def t4(v: Views) -> DataFrame:
    return v.runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(30).select("run_id", "store_id", "status")


@query("u5_leaflet_dedup", " SELECT store_id, product_id, price, valid_from, max(page) AS page FROM (SELECT *, round(price, 0) AS p0 FROM offers) GROUP BY 1, 2, 3, 4", dates="valid_from")
def u5(v: Views) -> DataFrame:
    return R.top(v.offers, OFFER, [F.desc("page")]).select("store_id", "product_id", "price", "valid_from", "page")


@query("d2_d5_fill_if_empty", " SELECT product_id, coalesce(nullif(brand, 'Brand#1'), kind) AS brand, CASE WHEN grams % 4 = 0 THEN kind ELSE 'auto' END AS category FROM products")
def d2(v: Views) -> DataFrame:
    """An empty brand is filled; a locked category stays."""
    return v.products.select("product_id", F.coalesce(F.nullif("brand", F.lit("Brand#1")), F.col("kind")).alias("brand"), F.when(F.col("grams") % 4 == 0, F.col("kind")).otherwise("auto").alias("category"))


@query("d4_last_occurrence", " SELECT l_suppkey AS store_id, l_partkey AS product_id, l_linenumber AS page, max(l_shipdate)::DATE AS seen FROM lineitem GROUP BY 1, 2, 3", dates="seen")
def d4(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("page")).agg(F.to_date(F.max("l_shipdate")).alias("seen"))


@query("d6_d9_corrections", " SELECT product_id, product_name AS alias FROM products WHERE grams > 30 UNION SELECT product_id, lower(brand) FROM products WHERE grams <= 30 AND product_name NOT LIKE 'old%'")
def d6(v: Views) -> DataFrame:
    p = v.products
    return p.where("grams > 30").select("product_id", F.col("product_name").alias("alias")).union(p.where("grams <= 30 AND product_name NOT LIKE 'old%'").select("product_id", F.lower("brand"))).distinct()


@query("d11_live_leaflets", f" SELECT store_id, day FROM archives WHERE valid_to >= {DAY} AND day <= {DAY}", dates="day")
def d11(v: Views) -> DataFrame:
    return v.archives.where((F.col("valid_to") >= as_of()) & (F.col("day") <= as_of())).select("store_id", "day")


@query("fn2_fn8_labels", r" SELECT product_id, CASE WHEN grams >= 10 THEN grams || ' g' ELSE grams * 100 || ' ml' END AS package, CASE WHEN grams >= 10 THEN 'kg' ELSE 'l' END AS base, floor((CASE WHEN grams >= 10 THEN grams ELSE grams * 100 END) / 1000.0::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE AS in_base FROM products")
def fn2(v: Views) -> DataFrame:
    heavy = F.col("grams") >= 10
    unit, n = F.when(heavy, "g").otherwise("ml"), F.when(heavy, F.col("grams")).otherwise(F.col("grams") * 100).cast("double")
    return v.products.select("product_id", F.concat_ws(" ", text.amount_label(n), unit).alias("package"), P.base_unit(unit).alias("base"), P.half_up(P.in_base(n, unit), 4).alias("in_base"))


@query("fa_consensus_name", """, n AS (SELECT brand, product_name AS name, count(*) AS votes FROM products GROUP BY 1, 2) SELECT brand, arg_max(name, (votes, length(name), name)) AS name FROM n GROUP BY 1""")
def consensus(v: Views) -> DataFrame:
    """The name most often given; of equals the longest, then the last by letters."""
    n = v.products.groupBy("brand", F.col("product_name").alias("name")).agg(F.count("*").alias("votes"))
    return n.groupBy("brand").agg(F.max_by("name", F.struct("votes", F.length("name"), "name")).alias("name"))


@query("q_run_status", " SELECT run_id, CASE WHEN status IN ('failed', 'warning') THEN CASE WHEN value > 10 THEN 'warning' ELSE 'failed' END WHEN value > 10 THEN 'success' ELSE 'no_offers' END AS final FROM runs")
def run_status(v: Views) -> DataFrame:
    some = F.col("value") > 10
    return v.runs.select("run_id", F.when(F.col("status").isin("failed", "warning"), F.when(some, "warning").otherwise("failed")).when(some, "success").otherwise("no_offers").alias("final"))
