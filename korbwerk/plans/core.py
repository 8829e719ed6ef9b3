"""Registered queries: selections, joins, aggregates, windows, sets and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import text
from korbwerk.operators import relational as R
from korbwerk.plans.registry import query
from korbwerk.plans.views import AS_OF, Views, as_of, cents

DAY = f"DATE '{AS_OF}'"
SELECTED = """,
selected AS (SELECT f.user_id, f.store_id FROM favourites f JOIN users u USING (user_id) JOIN stores s USING (store_id) WHERE s.active AND s.verified
  AND NOT coalesce(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(u.lat)) / 2), 2) + cos(radians(u.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(u.lon)) / 2), 2))) > u.radius_km, false))"""
KM = "2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(p.lon)) / 2), 2)))"
OFFER = ["store_id", "product_id", "valid_from", "price"]


@query("f1_current_offers", f" SELECT store_id, product_id, valid_from, valid_to, price FROM offers WHERE valid_from <= {DAY} AND valid_to >= {DAY} AND local", dates="valid_from valid_to")
def f1(v: Views) -> DataFrame:
    return R.valid_on(v.offers, as_of()).select("store_id", "product_id", "valid_from", "valid_to", "price")


@query("f2_upcoming_offers", f" SELECT store_id, product_id, valid_from, price FROM offers WHERE valid_from > {DAY} AND valid_from <= {DAY} + 14", dates="valid_from")
def f2(v: Views) -> DataFrame:
    return R.upcoming(v.offers, as_of()).select(*OFFER)


@query("f3_selected_stores", SELECTED + " SELECT user_id, store_id FROM selected")
def f3(v: Views) -> DataFrame:
    return R.selected_stores(v.users, v.favourites, v.stores)


@query("f4_name_search", " SELECT product_id, product_name, brand FROM products WHERE product_name ILIKE '%ring%' OR brand ILIKE '%brand#12%'")
def f4(v: Views) -> DataFrame:
    return v.products.where(F.col("product_name").ilike("%ring%") | F.col("brand").ilike("%brand#12%")).select("product_id", "product_name", "brand")


@query("f5_retailer_filter", " SELECT store_id, retailer FROM stores WHERE lower(retailer) = 'rewe' AND (contains(lower(store_name), 'supplier') OR contains(lower(retailer), 'x'))")
def f5(v: Views) -> DataFrame:
    return v.stores.where((F.lower("retailer") == "rewe") & (F.lower("store_name").contains("supplier") | F.lower("retailer").contains("x"))).select("store_id", "retailer")


@query("f6_j10_stores_in_radius", f" SELECT user_id, store_id, round({KM}, 6) AS km FROM users p, stores s WHERE s.active AND s.lat IS NOT NULL AND {KM} <= p.radius_km")
def f6(v: Views) -> DataFrame:
    return R.stores_in_radius(v.users, v.stores, "user_id", digits=6)


@query("f21_visible_media", " SELECT media_id, product_id, source FROM media WHERE active AND source <> 'pdf_embedded'")
def f21(v: Views) -> DataFrame:
    return v.media.where("active AND source <> 'pdf_embedded'").select("media_id", "product_id", "source")


@query("f27_market_ids", " SELECT event_id, list_sort(list_distinct([x for x in [TRY_CAST(y AS INT) for y in string_split(regexp_replace(props, '[^0-9,]', '', 'g') || ',' || user_id, ',')] if x > 0])) AS ids FROM events", lists="ids")
def f27(v: Views) -> DataFrame:
    ids = F.split(F.concat_ws(",", F.regexp_replace("props", "[^0-9,]", ""), F.col("user_id").cast("string")), ",")
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("int")), lambda x: x > 0)))
    return v.table("events").select("event_id", numbers.alias("ids"))


@query("j1_corrected_brands", " SELECT DISTINCT p.brand FROM products p JOIN media m USING (product_id) WHERE m.source = 'admin_curated' AND p.brand IS NOT NULL")
def j1(v: Views) -> DataFrame:
    return v.products.join(v.media.where("source = 'admin_curated'"), "product_id").where("brand IS NOT NULL").select("brand").distinct()


@query("j3_users_without_orders", " SELECT user_id FROM users WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def j3(v: Views) -> DataFrame:
    return v.users.join(v.table("orders").select(F.col("o_custkey").alias("user_id")).distinct(), "user_id", "left_anti").select("user_id")


@query("j5_offers_of_selected_stores", SELECTED + " SELECT store_id, product_id, valid_from, price FROM current_offers WHERE store_id IN (SELECT store_id FROM selected)", dates="valid_from")
def j5(v: Views) -> DataFrame:
    return v.current.join(R.selected_stores(v.users, v.favourites, v.stores), "store_id", "left_semi").select(*OFFER)


@query("j6_j7_offer_detail", """, latest AS (SELECT l_suppkey AS store_id, l_partkey AS product_id, l_shipdate::DATE AS valid_from, max_by(l_linenumber, l_orderkey * 100 + l_linenumber) AS page FROM lineitem GROUP BY 1, 2, 3)
 SELECT o.store_id, o.product_id, o.valid_from, o.price, r.reference_price, r.reference_type, l.page FROM offers o LEFT JOIN price_references r USING (store_id, product_id, valid_from, price) LEFT JOIN latest l USING (store_id, product_id, valid_from)""", dates="valid_from")
def j6(v: Views) -> DataFrame:
    seen = v.table("lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("valid_from"), "l_linenumber", "l_orderkey")
    latest = seen.groupBy("store_id", "product_id", "valid_from").agg(F.max_by("l_linenumber", F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("page"))
    return v.offers.select(*OFFER).join(v.references, OFFER, "left").join(latest, OFFER[:3], "left")


@query("j8_category_default", " SELECT product_id, coalesce(m.source, 'Sonstiges') AS category FROM products p LEFT JOIN (SELECT product_id, max_by(source, media_id) AS source FROM media GROUP BY 1) m USING (product_id)")
def j8(v: Views) -> DataFrame:
    kind = v.media.groupBy("product_id").agg(F.max_by("source", "media_id").alias("source"))
    return v.products.join(kind, "product_id", "left").select("product_id", F.coalesce("source", F.lit("Sonstiges")).alias("category"))


@query("j9_first_barcode", " SELECT product_id, min(media_id) AS first_media FROM products LEFT JOIN media USING (product_id) GROUP BY 1")
def j9(v: Views) -> DataFrame:
    return v.products.join(v.media, "product_id", "left").groupBy("product_id").agg(F.min("media_id").alias("first_media"))


_REGIONS = ", regions AS (SELECT n_nationkey AS region_id, 50.0::DOUBLE + n_nationkey / 25.0::DOUBLE AS lat, 7.0::DOUBLE + n_nationkey % 5 / 5.0::DOUBLE AS lon, 10 + n_nationkey AS radius_km FROM nation)"


def regions(v: Views) -> DataFrame:
    n = F.col("n_nationkey")
    return v.table("nation").select(n.alias("region_id"), (50.0 + n / 25.0).alias("lat"), (7.0 + n % 5 / 5.0).alias("lon"), (10 + n).alias("radius_km"))


@query("j11_stores_by_region", _REGIONS + f" SELECT region_id, count(*) AS stores, round(min({KM}), 6) AS nearest_km FROM regions p, stores s WHERE s.active AND s.lat IS NOT NULL AND {KM} <= p.radius_km GROUP BY 1")
def j11(v: Views) -> DataFrame:
    return R.stores_in_radius(regions(v), v.stores, "region_id").groupBy("region_id").agg(F.count("*").alias("stores"), F.round(F.min("km"), 6).alias("nearest_km"))


_FOUND = ", found AS (SELECT store_id + 1000000 AS found_id, retailer, lat + (store_id % 5) * 0.0004::DOUBLE AS lat, lon FROM stores WHERE store_id % 2 = 0)"


@query("j12_same_store", f"{_FOUND} SELECT p.found_id, min(s.store_id) AS known_id FROM found p JOIN stores s ON p.retailer = s.retailer WHERE {KM} < {K.SAME_STORE_KM} GROUP BY 1")
def j12(v: Views) -> DataFrame:
    """Stores that were found anew beside known ones of their chain: the known store that each is."""
    s = v.stores.select("store_id", "retailer", "lat", "lon")
    f = F.col("store_id")
    found = s.where(f % 2 == 0).select((f + 1000000).alias("found_id"), "retailer", (F.col("lat") + f % 5 * 0.0004).alias("lat"), "lon")
    near = R.within(found, s, K.SAME_STORE_KM, on=["retailer"], size=0.01).where(F.col("km") < K.SAME_STORE_KM)
    return near.groupBy(F.col("l.found_id").alias("found_id")).agg(F.min("r.store_id").alias("known_id"))


_ARCHIVED = " JOIN archives a ON a.store_id = o.store_id AND (a.valid_from IS NULL OR a.valid_from = o.valid_from) AND (a.valid_to IS NULL OR a.valid_to = o.valid_to)"


@query("j13_offers_of_archives", f" SELECT a.store_id, a.day, count(*) AS offers, count(*) FILTER (WHERE o.page <= a.pages) AS on_page FROM offers o{_ARCHIVED} GROUP BY 1, 2", dates="day")
def j13(v: Views) -> DataFrame:
    # valid_to is never null here, so it can be a join key; only the start is optional.
    a = v.archives.withColumnRenamed("valid_from", "a_from")
    joined = v.offers.join(a, ["store_id", "valid_to"]).where(F.col("a_from").isNull() | (F.col("a_from") == F.col("valid_from")))
    return joined.groupBy("store_id", "day").agg(F.count("*").alias("offers"), F.count_if(F.col("page") <= F.col("pages")).alias("on_page"))


@query("j14_preferred_archive", f" SELECT store_id, product_id, valid_from, price, day FROM (SELECT o.store_id, o.product_id, o.valid_from, o.price, a.day, row_number() OVER (PARTITION BY o.store_id, o.product_id, o.valid_from, o.price ORDER BY (a.pages = o.page) DESC, a.day DESC) AS r FROM offers o{_ARCHIVED}) WHERE r = 1", dates="valid_from day")
def j14(v: Views) -> DataFrame:
    a = v.archives.withColumnRenamed("valid_from", "a_from")
    joined = v.offers.join(a, ["store_id", "valid_to"]).where(F.col("a_from").isNull() | (F.col("a_from") == F.col("valid_from")))
    return R.top(joined, OFFER, [F.desc(F.col("pages") == F.col("page")), F.desc("day")]).select(*OFFER, "day")


@query("j16_store_lookup", """, wanted AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Supplier#' || lpad(user_id::VARCHAR, 9, '0') ELSE lpad((user_id % 100)::VARCHAR, 4, '0') END AS name,
   (ARRAY['REWE', 'Lidl', 'Netto Marken-Discount', 'ALDI SÜD', 'ALDI NORD', 'EDEKA', 'PENNY'])[event_id % 7 + 1] AS retailer FROM events),
  named AS (SELECT DISTINCT name, retailer FROM wanted),
  liked AS (SELECT n.name, n.retailer, min(s.store_id) AS store_id FROM named n JOIN stores s ON s.retailer = n.retailer AND s.store_name ILIKE '%' || n.name || '%' GROUP BY 1, 2)
 SELECT w.event_id, coalesce(e.store_id, l.store_id) AS store_id FROM wanted w LEFT JOIN stores e ON e.store_name = w.name LEFT JOIN liked l ON l.name = w.name AND l.retailer = w.retailer""")
def j16(v: Views) -> DataFrame:
    from korbwerk.constants import RETAILERS

    e = F.col("event_id")
    wanted = v.table("events").select(
        e, F.when(e % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).otherwise(F.lpad((F.col("user_id") % 100).cast("string"), 4, "0")).alias("name"),
        F.element_at(F.array(*map(F.lit, RETAILERS)), (e % 7 + 1).cast("int")).alias("retailer"),
    )
    names = wanted.select("name", "retailer").distinct()
    liked = names.alias("n").join(v.stores.alias("s"), (F.col("s.retailer") == F.col("n.retailer")) & F.contains("s.store_name", "n.name")).groupBy("n.name", "n.retailer").agg(F.min("s.store_id").alias("liked_id"))
    exact = v.stores.select(F.col("store_name").alias("name"), F.col("store_id").alias("exact_id"))
    return wanted.join(exact, "name", "left").join(liked, ["name", "retailer"], "left").select("event_id", F.coalesce("exact_id", "liked_id").alias("store_id"))


@query("j18_learned_brand", """, names AS (SELECT product_id, lower(brand) || ' ' || product_name AS full_name FROM products), brands AS (SELECT DISTINCT lower(brand) AS brand FROM products WHERE length(brand) >= 2)
 SELECT product_id, max_by(b.brand, length(b.brand)) AS brand FROM names n JOIN brands b ON n.full_name = b.brand OR starts_with(n.full_name, b.brand || ' ') OR starts_with(n.full_name, b.brand || '-') GROUP BY 1""")
def j18(v: Views) -> DataFrame:
    """Candidate prefixes of each name, cut at blanks and hyphens and no longer than the longest brand, make the prefix join an equi-join; the longest known brand wins."""
    names = v.products.select("product_id", F.concat_ws(" ", F.lower("brand"), "product_name").alias("name"))
    brands = v.products.select(F.lower("brand").alias("brand")).where(F.length("brand") >= 2).distinct()
    ends = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: (i <= F.col("longest")) & ((i == F.length("name")) | F.substr("name", i + 1, F.lit(1)).isin(" ", "-")))
    longest = brands.agg(F.max(F.length("brand")).alias("longest"))
    prefixes = names.where(F.length("name") > 0).join(F.broadcast(longest)).select("product_id", F.explode(F.transform(ends, lambda i: F.substr("name", F.lit(1), i))).alias("brand"))
    return prefixes.join(brands, "brand").groupBy("product_id").agg(F.max_by("brand", F.length("brand")).alias("brand"))


@query("j20_unique_reference", " SELECT product_name, min(product_id) AS product_id FROM products GROUP BY 1 HAVING count(DISTINCT kind) = 1 UNION ALL SELECT brand || '/' || kind, min(product_id) FROM products GROUP BY brand, kind HAVING count(*) = 1")
def j20(v: Views) -> DataFrame:
    one = v.products.groupBy("product_name").agg(F.count_distinct("kind").alias("n"), F.min("product_id").alias("product_id")).where("n = 1")
    two = v.products.groupBy(F.concat_ws("/", "brand", "kind").alias("product_name"), "brand", "kind").agg(F.count("*").alias("n"), F.min("product_id").alias("product_id")).where("n = 1")
    return one.select("product_name", "product_id").unionByName(two.select("product_name", "product_id"))


@query("j30_family_members", r""", keyed AS (SELECT product_id, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')) AS family, grams FROM products)
 SELECT family, count(*) AS members, min(grams) AS least, max(grams) AS most FROM keyed GROUP BY 1""")
def j30(v: Views) -> DataFrame:
    return v.products.groupBy(text.family_key(F.col("product_name")).alias("family")).agg(F.count("*").alias("members"), F.min("grams").alias("least"), F.max("grams").alias("most"))


@query("a1_dashboard", " SELECT (SELECT count(*) FROM stores) AS stores, (SELECT count(*) FROM stores WHERE active AND verified) AS released, (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM offers) AS offers, (SELECT count(*) FROM media WHERE active) AS media, (SELECT count(*) FROM runs WHERE status IN ('failed', 'warning')) AS problems")
def a1(v: Views) -> DataFrame:
    parts = [
        v.stores.agg(F.count("*").alias("stores"), F.count_if(F.col("active") & F.col("verified")).alias("released")), v.products.agg(F.count("*").alias("products")), v.offers.agg(F.count("*").alias("offers")),
        v.media.agg(F.count_if("active").alias("media")), v.runs.agg(F.count_if(F.col("status").isin("failed", "warning")).alias("problems")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.join(p)  # one row each
    return found


@query("a3_distinct_offers", " SELECT retailer, count(*) AS \"rows\", count(DISTINCT (product_id, price, valid_from, valid_to)) AS \"distinct_offers\" FROM offers JOIN stores USING (store_id) GROUP BY 1")
def a3(v: Views) -> DataFrame:
    return v.offers.join(v.stores, "store_id").groupBy("retailer").agg(F.count("*").alias("rows"), F.count_distinct(F.struct("product_id", "price", "valid_from", "valid_to")).alias("distinct_offers"))


@query("a4_cheapest_offer", " SELECT product_id, min(price) AS price, arg_min(store_id, (price, store_id, valid_from)) AS store_id FROM current_offers GROUP BY 1")
def a4(v: Views) -> DataFrame:
    best = v.current.groupBy("product_id").agg(F.min(F.struct("price", "store_id", "valid_from")).alias("b"))
    return best.select("product_id", "b.price", "b.store_id")


@query("a6_basket_by_store", " SELECT user_id, o.store_id, round(sum(p * quantity), 2) AS total, count(*) AS items FROM items JOIN (SELECT store_id, product_id, min(price) AS p FROM current_offers GROUP BY 1, 2) o USING (product_id) GROUP BY 1, 2")
def a6(v: Views) -> DataFrame:
    best = v.current.groupBy("store_id", "product_id").agg(F.min("price").alias("p"))
    return v.items.join(best, "product_id").groupBy("user_id", "store_id").agg(F.round(F.sum(F.col("p") * F.col("quantity")), 2).alias("total"), F.count("*").alias("items"))


@query("a8_rates", " SELECT store_id, coalesce(floor(count(*) FILTER (WHERE status = 'success') / count(*)::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE, 0) AS success_rate, CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 100.0 ELSE floor(count(*) FILTER (WHERE status = 'failed' AND value > 10) / (count(*) FILTER (WHERE status = 'failed'))::DOUBLE * 10000 + 0.5) / 100.0::DOUBLE END AS failed_rate FROM runs GROUP BY 1")
def a8(v: Views) -> DataFrame:
    ok, bad = F.col("status") == "success", F.col("status") == "failed"
    return v.runs.groupBy("store_id").agg(R.rate(F.count_if(ok), F.count("*")).alias("success_rate"), R.rate(F.count_if(bad & (F.col("value") > 10)), F.count_if(bad), 2, 100.0).alias("failed_rate"))


@query("a11_duplicate_names", r" SELECT trim(regexp_replace(lower(product_name), '[^a-z0-9äöüß]+', ' ', 'g')) AS name, count(*) AS n, min(product_id) AS first_id FROM products GROUP BY 1 HAVING count(*) > 1")
def a11(v: Views) -> DataFrame:
    return v.products.groupBy(text.plain_key(F.col("product_name")).alias("name")).agg(F.count("*").alias("n"), F.min("product_id").alias("first_id")).where("n > 1")


@query("a12_confusion", " SELECT retailer, count(*) FILTER (WHERE verified AND active) AS tp, count(*) FILTER (WHERE verified AND NOT active) AS fp, count(*) FILTER (WHERE NOT verified AND active) AS fn, CASE WHEN count(*) FILTER (WHERE verified) = 0 THEN 100.0 ELSE floor(count(*) FILTER (WHERE verified AND active) / (count(*) FILTER (WHERE verified))::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE END AS \"precision_pct\" FROM stores GROUP BY 1")
def a12(v: Views) -> DataFrame:
    yes, real = F.col("verified"), F.col("active")
    return v.stores.groupBy("retailer").agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"), R.rate(F.count_if(yes & real), F.count_if(yes), 1, 100.0).alias("precision_pct"))


@query("a13_dominant_validity", " SELECT store_id, valid_from, valid_to, n FROM (SELECT store_id, valid_from, valid_to, count(*) AS n, row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, valid_from, valid_to) AS r FROM offers GROUP BY 1, 2, 3) WHERE r = 1", dates="valid_from valid_to")
def a13(v: Views) -> DataFrame:
    return R.mode(v.offers, ["store_id"], ["valid_from", "valid_to"]).select("store_id", "valid_from", "valid_to", "n")


@query("a14_a15_span_and_pages", " SELECT store_id, min(valid_from) AS first_day, max(valid_to) AS last_day, max(page) AS pages FROM offers GROUP BY 1", dates="first_day last_day")
def a14(v: Views) -> DataFrame:
    return v.offers.groupBy("store_id").agg(F.min("valid_from").alias("first_day"), F.max("valid_to").alias("last_day"), F.max("page").alias("pages"))


@query("a16_single_page", " SELECT store_id, product_id, min(page) AS page FROM offers GROUP BY 1, 2 HAVING count(DISTINCT page) = 1")
def a16(v: Views) -> DataFrame:
    return v.offers.groupBy("store_id", "product_id").agg(F.collect_set("page").alias("p")).where(F.size("p") == 1).select("store_id", "product_id", F.col("p")[0].alias("page"))


@query("a17_page_texts", " SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a17(v: Views) -> DataFrame:
    said = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return said.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


@query("a20_user_stats", " SELECT count(*) AS users, count(*) FILTER (WHERE o.last IS NOT NULL) AS buyers, count(*) FILTER (WHERE o.last >= TIMESTAMP '1998-06-08') AS active_7d FROM users LEFT JOIN (SELECT o_custkey AS user_id, max(o_orderdate) AS last FROM orders GROUP BY 1) o USING (user_id)")
def a20(v: Views) -> DataFrame:
    last = v.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("last"))
    return v.users.join(last, "user_id", "left").agg(F.count("*").alias("users"), F.count("last").alias("buyers"), F.count_if(F.col("last") >= "1998-06-08").alias("active_7d"))


@query("a22_retailers", " SELECT DISTINCT retailer FROM stores")
def a22(v: Views) -> DataFrame:
    return v.stores.select("retailer").distinct()


@query("a24_pages_by_offer", " SELECT l_suppkey AS store_id, l_partkey AS product_id, list_sort(list_distinct(list(l_linenumber))) AS pages FROM lineitem GROUP BY 1, 2", lists="pages")
def a24(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages"))


@query("a25_identical_offers", " SELECT product_id, price, valid_from, list_sort(list_distinct(list(store_id))) AS store_ids, count(*) AS n FROM current_offers GROUP BY 1, 2, 3", dates="valid_from", lists="store_ids")
def a25(v: Views) -> DataFrame:
    return R.identical_groups(v.current, ["product_id", "price", "valid_from"], "store_id")


@query("a27_complete_baskets", """, best AS (SELECT store_id, product_id, min(price) AS p FROM current_offers GROUP BY 1, 2), wanted AS (SELECT user_id, count(*) AS n FROM items GROUP BY 1),
 totals AS (SELECT user_id, store_id, sum(p * quantity) AS total FROM items JOIN best USING (product_id) GROUP BY 1, 2), counts AS (SELECT user_id, store_id, count(*) AS n FROM items JOIN best USING (product_id) GROUP BY 1, 2)
 SELECT t.user_id, count(*) AS stores, round(min(total), 2) AS best, round(max(total), 2) AS worst FROM totals t JOIN counts c USING (user_id, store_id) JOIN wanted w ON w.user_id = t.user_id AND c.n * 20 >= w.n GROUP BY 1""")
def a27(v: Views) -> DataFrame:
    """Stores that have at least a twentieth of a user's list (no store has all of it in these tables), with the least and the largest total."""
    best = v.current.groupBy("store_id", "product_id").agg(F.min("price").alias("p"))
    wanted = v.items.groupBy("user_id").agg(F.count("*").alias("n"))
    totals = v.items.join(best, "product_id").groupBy("user_id", "store_id").agg(F.sum(F.col("p") * F.col("quantity")).alias("total"), F.count("*").alias("c"))
    return totals.join(wanted, "user_id").where(F.col("c") * 20 >= F.col("n")).groupBy("user_id").agg(F.count("*").alias("stores"), F.round(F.min("total"), 2).alias("best"), F.round(F.max("total"), 2).alias("worst"))


@query("a28_highest_price", " SELECT store_id, product_id, valid_from, price, max(price) OVER (PARTITION BY product_id) - price AS saved FROM current_offers", dates="valid_from")
def a28(v: Views) -> DataFrame:
    return v.current.select(*OFFER, (F.max("price").over(Window.partitionBy("product_id")) - F.col("price")).alias("saved"))


@query("w1_latest_run", " SELECT store_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1")
def w1(v: Views) -> DataFrame:
    return R.top(v.runs, ["store_id"], [F.desc("started_at"), F.desc("run_id")]).select("store_id", "run_id", "status")


@query("w2_latest_by_kind", """, four AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at DESC, run_id DESC) AS r FROM runs QUALIFY r <= 4)
 SELECT store_id, max_by(status, started_at) FILTER (WHERE source_key LIKE '%:web') AS web, max_by(status, started_at) FILTER (WHERE source_key LIKE '%:pdf') AS pdf FROM four GROUP BY 1""")
def w2(v: Views) -> DataFrame:
    four = R.top(v.runs, ["store_id"], [F.desc("started_at"), F.desc("run_id")], 4)
    of = lambda kind: F.max_by("status", F.when(F.endswith("source_key", F.lit(kind)), F.col("started_at"))).alias(kind[1:])
    return four.groupBy("store_id").agg(of(":web"), of(":pdf"))


@query("w3_latest_archive", " SELECT store_id, max(day) AS day, max_by(pages, day) AS pages FROM archives GROUP BY 1", dates="day")
def w3(v: Views) -> DataFrame:
    return R.top(v.archives, ["store_id"], [F.desc("day")]).select("store_id", "day", "pages")


_PRIO = "CASE source WHEN 'prospect_crop' THEN 100 WHEN 'pdf_embedded' THEN 150 WHEN 'retailer_cdn' THEN 200 WHEN 'official_product' THEN 300 ELSE 400 END"


@query("w5_preferred_media", f" SELECT product_id, arg_max(media_id, ({_PRIO}, is_primary, source <> 'prospect_crop', media_id)) AS public_id, arg_max(media_id, (source = 'prospect_crop', {_PRIO}, media_id)) AS audit_id FROM media WHERE active GROUP BY 1")
def w5(v: Views) -> DataFrame:
    from korbwerk.constants import MEDIA_PRIORITY

    crop = F.col("source") == "prospect_crop"
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_PRIORITY.items() for x in kv]), F.col("source"))
    return v.media.where("active").groupBy("product_id").agg(F.max_by("media_id", F.struct(priority, "is_primary", ~crop, "media_id")).alias("public_id"), F.max_by("media_id", F.struct(crop, priority, "media_id")).alias("audit_id"))


@query("w7_leaflet_choice", f""" SELECT store_id, day FROM (SELECT store_id, day, row_number() OVER (PARTITION BY store_id ORDER BY CASE WHEN day <= {DAY} AND valid_to >= {DAY} THEN 0 WHEN day > {DAY} THEN 1 ELSE 2 END,
  CASE WHEN day > {DAY} THEN date_diff('day', {DAY}, day) ELSE date_diff('day', day, {DAY}) END) AS r FROM archives) WHERE r = 1""", dates="day")
def w7(v: Views) -> DataFrame:
    bucket = F.when((F.col("day") <= as_of()) & (F.col("valid_to") >= as_of()), 0).when(F.col("day") > as_of(), 1).otherwise(2)
    return R.top(v.archives, ["store_id"], [bucket, F.abs(F.datediff("day", as_of()))]).select("store_id", "day")


@query("w8_w9_best_row", " SELECT store_id, product_id, price, page FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY abs(price - seen * page * 100), valid_from, price) AS r FROM offers) WHERE r = 1")
def w8(v: Views) -> DataFrame:
    return R.top(v.offers, ["store_id", "product_id"], [F.abs(F.col("price") - F.col("seen") * F.col("page") * 100), "valid_from", "price"]).select("store_id", "product_id", "price", "page")


@query("w10_line_context", """, l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
 SELECT doc_id, pos, lag(length(line)) OVER w AS before, lead(length(line)) OVER w AS after, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 FOLLOWING) AS around FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY line ~ '.*[0-9]{3}.*'""")
def w10(v: Views) -> DataFrame:
    lines = v.table("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    n = F.length("line").cast("long")
    found = lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line", F.lag(n).over(w).alias("before"), F.lead(n).over(w).alias("after"), F.sum(n).over(w.rowsBetween(-6, 1)).alias("around"))
    return found.where(F.col("line").rlike("[0-9]{3}")).drop("line")


@query("w12_carry_forward", " SELECT run_id, last_value(CASE WHEN status = 'success' THEN run_id END IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS last_success FROM runs")
def w12(v: Views) -> DataFrame:
    w = Window.partitionBy("store_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.runs.select("run_id", F.last(F.when(F.col("status") == "success", F.col("run_id")), ignorenulls=True).over(w).alias("last_success"))


@query("w13_sessions", """, g AS (SELECT *, CASE WHEN started_at - lag(started_at) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM runs WINDOW w AS (PARTITION BY store_id ORDER BY started_at, run_id)),
 n AS (SELECT *, sum(new) OVER (PARTITION BY store_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT store_id, session, count(*) AS runs, min(run_id) AS first_run FROM n GROUP BY 1, 2""")
def w13(v: Views) -> DataFrame:
    w = Window.partitionBy("store_id").orderBy("started_at", "run_id")
    new = F.when(F.col("started_at") - F.lag("started_at").over(w) <= F.expr("INTERVAL 2 HOURS"), 0).otherwise(1)
    return v.runs.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("store_id", "session").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"))


@query("t1_t3_product_page", " SELECT store_id, product_id, price FROM current_offers ORDER BY price, store_id, product_id, valid_from LIMIT 50")
def t1(v: Views) -> DataFrame:
    return v.current.orderBy("price", "store_id", "product_id", "valid_from").limit(50).select("store_id", "product_id", "price")


@query("t6_counted_report", " SELECT count(*) OVER () AS total, product_id, price FROM (SELECT product_id, min(price) AS price FROM current_offers GROUP BY 1) ORDER BY price DESC, product_id LIMIT 100")
def t6(v: Views) -> DataFrame:
    best = v.current.groupBy("product_id").agg(F.min("price").alias("price"))
    return best.orderBy(F.desc("price"), "product_id").limit(100).join(best.agg(F.count("*").alias("total"))).select("total", "product_id", "price")


@query("u1_near_or_favourite", f" SELECT user_id, store_id FROM favourites UNION SELECT user_id, store_id FROM users p, stores s WHERE s.active AND s.lat IS NOT NULL AND {KM} <= p.radius_km")
def u1(v: Views) -> DataFrame:
    """Near stores come once from places that differ, so only the favourites are held against them, by their own distances."""
    users, stores = v.users.distinct(), v.stores.select("store_id", "lat", "lon", "active").distinct()
    return R.stores_in_radius(users, stores, "user_id").select("user_id", "store_id").unionByName(R.pairs_out_of_radius(v.favourites, users, stores))


@query("u2_only_crops", " SELECT DISTINCT product_id FROM media WHERE source = 'prospect_crop' AND active EXCEPT SELECT product_id FROM media WHERE source IN ('official_product', 'retailer_cdn') AND active")
def u2(v: Views) -> DataFrame:
    m = v.media.where("active")
    return m.where("source = 'prospect_crop'").select("product_id").distinct().join(m.where("source IN ('official_product', 'retailer_cdn')"), "product_id", "left_anti")


@query("u3_add_missing", f", a AS (SELECT * FROM offers WHERE local), b AS (SELECT * FROM offers WHERE NOT local) SELECT store_id, product_id, price FROM a UNION ALL SELECT store_id, product_id, price FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.store_id = b.store_id AND a.product_id = b.product_id)")
def u3(v: Views) -> DataFrame:
    return R.add_missing(v.offers.where("local"), v.offers.where("NOT local"), ["store_id", "product_id"]).select("store_id", "product_id", "price")


@query("u4_u6_deduplicate", " SELECT DISTINCT l_suppkey AS store_id, l_partkey AS product_id, l_quantity AS quantity FROM lineitem")
def u4(v: Views) -> DataFrame:
    return v.table("lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity")).dropDuplicates()


@query("u7_prefix_names", " SELECT a.product_id FROM products a WHERE EXISTS (SELECT 1 FROM products b WHERE b.brand = a.brand AND b.product_id < a.product_id AND (b.product_name = a.product_name OR (starts_with(a.product_name, b.product_name) AND length(a.product_name) <= length(b.product_name) + 24)))")
def u7(v: Views) -> DataFrame:
    """Each different name meets the names of its brand that are among its last 25 beginnings; of these the first product counts."""
    names = v.products.dropna(subset=["brand", "product_name"]).groupBy("brand", "product_name").agg(F.min("product_id").alias("first"))
    n = F.length("product_name")
    begins = F.transform(F.sequence(F.greatest(n - 24, F.lit(0)), n), lambda i: F.substr("product_name", F.lit(1), i))
    prefixes = names.select("brand", F.col("product_name").alias("name"), F.explode(begins).alias("product_name"))
    least = prefixes.join(names, ["brand", "product_name"]).groupBy("brand", F.col("name").alias("product_name")).agg(F.min("first").alias("first"))
    return v.products.join(least, ["brand", "product_name"]).where(F.col("first") < F.col("product_id")).select("product_id")


@query("u8_brand_evidence", " SELECT brand FROM products WHERE grams > 40 UNION SELECT brand FROM products JOIN media USING (product_id) WHERE is_primary UNION SELECT kind FROM products")
def u8(v: Views) -> DataFrame:
    p = v.products
    return p.where("grams > 40").select("brand").union(p.join(v.media.where("is_primary"), "product_id").select("brand")).union(p.select("kind")).distinct()


@query("u11_all_pages", " SELECT store_id, day, unnest(range(1, pages + 1)) AS page FROM archives", dates="day")
def u11(v: Views) -> DataFrame:
    return v.archives.select("store_id", "day", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages"))).alias("page"))


@query("d1_offer_upsert", f", old AS (SELECT store_id, product_id, min(price) AS price, min(seen) AS seen FROM offers WHERE valid_from < {DAY} GROUP BY 1, 2), new AS (SELECT store_id, product_id, min(price) AS price, max(seen) AS seen FROM offers WHERE valid_from >= {DAY} GROUP BY 1, 2) SELECT coalesce(o.store_id, n.store_id) AS store_id, coalesce(o.product_id, n.product_id) AS product_id, coalesce(n.price, o.price) AS price, coalesce(o.seen, n.seen) AS seen FROM old o FULL JOIN new n ON o.store_id = n.store_id AND o.product_id = n.product_id")
def d1(v: Views) -> DataFrame:
    old = v.offers.where(F.col("valid_from") < as_of()).groupBy("store_id", "product_id").agg(F.min("price").alias("price"), F.min("seen").alias("seen"))
    new = v.offers.where(F.col("valid_from") >= as_of()).groupBy("store_id", "product_id").agg(F.min("price").alias("price"), F.max("seen").alias("seen"))
    return R.upsert(old, new, ["store_id", "product_id"], fill=["seen"])


@query("d3_price_reference", f" SELECT store_id, product_id, valid_from, price, reference_price, reference_type, floor((1 - price / reference_price) * 1000 + 0.5) / 10.0::DOUBLE AS discount FROM price_references WHERE reference_price > price", dates="valid_from")
def d3(v: Views) -> DataFrame:
    r = v.references.where(F.col("reference_price") > F.col("price"))
    return r.withColumn("discount", F.floor((1 - F.col("price") / F.col("reference_price")) * 1000 + 0.5) / 10.0)


@query("d7_store_names", " SELECT store_id, retailer || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END AS name FROM (SELECT store_id, retailer, row_number() OVER (PARTITION BY retailer ORDER BY store_id) AS r FROM stores)")
def d7(v: Views) -> DataFrame:
    s = R.ranked(v.stores, ["retailer"], ["store_id"], "r")
    return s.select("store_id", F.concat("retailer", F.when(F.col("r") > 1, F.concat(F.lit(" ("), F.col("r"), F.lit(")"))).otherwise("")).alias("name"))


@query("d8_orphans", " SELECT product_id FROM products WHERE product_id NOT IN (SELECT product_id FROM current_offers) AND product_id NOT IN (SELECT product_id FROM items WHERE quantity > 60)")
def d8(v: Views) -> DataFrame:
    return v.products.join(v.current, "product_id", "left_anti").join(v.items.where("quantity > 60"), "product_id", "left_anti").select("product_id")


@query("d10_clamped_quantity", " SELECT user_id, product_id, greatest(0, least(quantity, 40)) AS quantity FROM items")
def d10(v: Views) -> DataFrame:
    return v.items.select("user_id", "product_id", F.greatest(F.lit(0.0), F.least("quantity", F.lit(40.0))).alias("quantity"))


@query("d13_run_state", " SELECT store_id, arg_max(status, (status = 'failed', started_at)) AS state FROM runs GROUP BY 1")
def d13(v: Views) -> DataFrame:
    return v.runs.groupBy("store_id").agg(F.max_by("status", F.struct(F.col("status") == "failed", "started_at")).alias("state"))


@query("x_events_rollup", " SELECT status, source_key, count(*) AS runs, round(sum(value), 2) AS total FROM runs GROUP BY ROLLUP (status, source_key)")
def x1(v: Views) -> DataFrame:
    return v.runs.rollup("status", "source_key").agg(F.count("*").alias("runs"), F.round(F.sum("value"), 2).alias("total"))


@query("x_daily_windows", " SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x2(v: Views) -> DataFrame:
    return v.table("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
