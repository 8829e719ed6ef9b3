"""Registered queries: offers out of text, links and JSON, matching on pages, similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.functions.text import master_key
from korbwerk.operators import extract, importer, matching
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views


def leaflets(v: Views) -> DataFrame:
    """A leaflet a store: its offers' cards one below the other, in order of product."""
    de = F.regexp_replace(F.format_string("%.2f", F.col("price") % 900 + 1), r"\.", ",")
    cards = v.offers.join(v.products, "product_id").select("store_id", "product_id", "valid_from", F.concat_ws("\n", "product_name", F.concat(F.lit("je "), F.col("grams") * 10, F.lit(" g, (1 kg = "), F.col("grams") % 9 + 1, F.lit(",49)")), F.concat(de, F.lit(" €"))).alias("card"))
    return cards.groupBy("store_id", "valid_from").agg(F.array_sort(F.collect_list(F.struct("product_id", "card"))).alias("c")).select("store_id", "valid_from", F.concat("store_id", F.lit("/"), "valid_from").alias("leaflet"), F.array_join(F.transform("c", lambda x: x["card"]), "\n").alias("text"))


@query("g1_text_offers", """ SELECT store_id || '/' || valid_from AS leaflet, product_name AS name, round(price % 900 + 1, 2) AS price, grams * 10 AS quantity, 'g' AS unit, count(*) AS n FROM offers JOIN products USING (product_id) GROUP BY ALL""")
def g1(v: Views) -> DataFrame:
    """What the cards of all leaflets say, read back from their text."""
    found = extract.card_offers(leaflets(v), "leaflet", "text", above=2, below=0)
    return found.groupBy("leaflet", "name", "price", "quantity", "unit").agg(F.count("*").alias("n"))


@query(
    "g5_w11_sections",
    r""", l AS (SELECT doc_id, unnest([x for x in list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: trim(y)) if x <> '']) AS line, generate_subscripts([x for x in list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: trim(y)) if x <> ''], 1) AS pos FROM documents),
 s AS (SELECT doc_id, last_value(nullif(regexp_extract(line, '^(\pL+)\.$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l) SELECT doc_id, count(DISTINCT section) AS sections, count(*) AS lines FROM s GROUP BY 1""",
)
def g5(v: Views) -> DataFrame:
    return extract.week_sections(v.table("documents"), heading=r"^(\p{L}+)\.$").groupBy("doc_id").agg(F.count_distinct("section").alias("sections"), F.count("*").alias("lines"))


@query("s5_ranked_links", r""", l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS url, generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), 1) AS pos FROM pages), d AS (SELECT page_id, url, min(pos) AS pos FROM l GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN regexp_matches(lower(url), '\.pdf([?#]|$)') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'prospekt|angebot|flyer|leaflet') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(lower(url), 'agb|datenschutz|impressum') THEN 40 ELSE 0 END AS score FROM d)
 SELECT page_id, score, count(*) AS n FROM s GROUP BY 1, 2""")
def s5(v: Views) -> DataFrame:
    return extract.link_offers(v.table("pages")).groupBy("page_id", "score").agg(F.count("*").alias("n"))


@query("f10_link_kinds", r""" SELECT page_id, CASE WHEN regexp_matches(url, '/p/[^?#]*\d{4,}|flyx_content=p-') THEN 'ONLINE_ONLY' WHEN page_id % 3 = 0 THEN 'LOCAL_ONLY' WHEN page_id % 3 = 1 THEN 'NAVIGATION' ELSE 'EDITORIAL' END AS kind FROM pages""")
def f10(v: Views) -> DataFrame:
    k = F.col("page_id") % 3
    return v.table("pages").select("page_id", extract.classify_link(F.col("url"), F.when(k == 0, F.col("page_id")), F.when(k == 2, F.lit("x"))).alias("kind"))


_JSON = "'{\"id\":' || event_id || ',\"page\":{\"n\":' || (event_id % 7) || ',\"items\":[{\"price\":{\"amount\":' || user_id || '}},' || props || ']}}'"


@query("fj1_json_walk", " SELECT event_id, 10 AS nodes, CAST(user_id AS VARCHAR) AS first_price FROM events")
def fj1(v: Views) -> DataFrame:
    """All nodes of a nested JSON document a row, and the first scalar under any of three names."""
    built = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"page":{"n":'), F.col("event_id") % 7, F.lit(',"items":[{"price":{"amount":'), F.col("user_id"), F.lit("}},"), F.col("props"), F.lit("]}}"))
    nodes = extract.json_nodes(v.table("events").select("event_id", built.alias("doc")), "event_id", "doc")
    first = extract.first_of(nodes, "event_id", ["price", "value", "amount"])
    return nodes.groupBy("event_id").agg(F.count("*").alias("nodes")).join(first, "event_id").select("event_id", F.col("nodes").cast("int").alias("nodes"), F.col("value").alias("first_price"))


def boxes(v: Views, tagged: bool = False) -> DataFrame:
    """Labels and price tags on the pages of orders: one of each a line item, the tags moved; if `tagged`, a third of the tags is missing."""
    k = F.col("l_partkey")
    at = v.table("lineitem").select(F.col("l_orderkey").alias("page_key"), (F.xxhash64("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice") % 1000000007).alias("box_id"), (k * 37 % 600).cast("double").alias("x"), (k * 53 % 800).cast("double").alias("y"), (k % 3 != 0).alias("tagged")).dropDuplicates(["page_key", "box_id"])
    label = at.select("page_key", F.lit("label").alias("kind"), "box_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 80).alias("x1"), (F.col("y") + 20).alias("y1"))
    tag = (at.where("tagged") if tagged else at).select("page_key", F.lit("price").alias("kind"), "box_id", (F.col("x") + 10).alias("x0"), (F.col("y") + 30).alias("y0"), (F.col("x") + 50).alias("x1"), (F.col("y") + 50).alias("y1"))
    return label.unionByName(tag)


#: Most boxes of a page that the SQL counterparts of the matchings can take: a table for each set of price tags.
_MOST = 16
_PAGES = """, boxes AS (SELECT DISTINCT l_orderkey AS page, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
 lab AS (SELECT page, (l_partkey * 37 % 600)::DOUBLE AS x, (l_partkey * 53 % 800)::DOUBLE AS y, l_partkey % 3 <> 0 AS tagged, row_number() OVER (PARTITION BY page ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS i FROM boxes),
 cost AS (SELECT a.page, a.i, b.i AS j, b.tagged, sqrt(pow(b.x - a.x - 10, 2) + pow(b.y - a.y + 30, 2)) AS far, b.y - a.y + 30 < 0 AS over FROM lab a JOIN lab b ON a.page = b.page),
 n AS (SELECT page, count(*) AS n FROM lab GROUP BY 1)"""
_CHEAPEST = ", d0 AS (SELECT DISTINCT page, 0::BIGINT AS mask, 0::DOUBLE AS cost FROM lab)" + "".join(
    f", d{k + 1} AS (SELECT d.page, d.mask + (1::BIGINT << c.j::INT) AS mask, min(d.cost + c.far * CASE WHEN c.over THEN 2 ELSE 1 END) AS cost FROM d{k} d JOIN cost c ON c.page = d.page AND c.i = {k} WHERE (d.mask >> c.j::INT) % 2 = 0 GROUP BY 1, 2)" for k in range(_MOST)
)
_LARGEST = ", d0 AS (SELECT DISTINCT page, 0::BIGINT AS mask FROM lab)" + "".join(
    f", d{k + 1} AS (SELECT page, mask FROM d{k} UNION SELECT d.page, d.mask + (1::BIGINT << c.j::INT) FROM d{k} d JOIN cost c ON c.page = d.page AND c.i = {k} WHERE c.tagged AND c.far <= 185 AND (d.mask >> c.j::INT) % 2 = 0)" for k in range(_MOST)
)


@query("m1_assignment", _PAGES + _CHEAPEST + " SELECT n.page AS page_key, n AS labels, n AS prices, round(cost, 4) AS cost FROM n JOIN (" + " UNION ALL ".join(f"SELECT page, {k} AS k, cost FROM d{k}" for k in range(1, _MOST + 1)) + ") d ON d.page = n.page AND d.k = n.n")
def m1(v: Views) -> DataFrame:
    """Per page the labels and the price tags that are assigned, each counted once, and the least total cost."""
    found = matching.assign_prices(boxes(v))
    return found.groupBy("page_key").agg(F.count_distinct("label_id").alias("labels"), F.count_distinct("price_id").alias("prices"), F.round(F.sum("cost"), 4).alias("cost"))


@query("m2_matching", _PAGES + _LARGEST + f" SELECT page AS page_key, max(bit_count(mask))::BIGINT AS labels FROM d{_MOST} GROUP BY 1 HAVING max(bit_count(mask)) > 0")
def m2(v: Views) -> DataFrame:
    """Per page as many labels as can have a tag of their own within reach, where some tags are missing."""
    tags = boxes(v, tagged=True)
    found = matching.match_anchors(tags)
    once = F.least(F.count_distinct("label_id"), F.count_distinct("price_id"))
    return found.groupBy("page_key").agg(once.alias("labels"))


@query("m4_price_groups", None)
def m4(v: Views) -> DataFrame:
    return matching.price_groups(boxes(v)).groupBy("page_key").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("boxes"))


@query("m6_reconciled", """, m AS (SELECT o_custkey AS page_key, o_orderkey AS label_id, floor(o_totalprice) % 40 / 4.0::DOUBLE + 1 AS price, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice) % 17 / 4.0::DOUBLE + 1 END AS expected FROM orders), c AS (SELECT m.*, abs(price - expected) <= greatest(0.031, least(price, expected) * 0.0075) AS ok FROM m),
 b AS (SELECT c.page_key, c.label_id, arg_min(a.price, (abs(a.price - c.expected), a.price)) AS better FROM c JOIN m a ON a.page_key = c.page_key AND NOT c.ok AND abs(a.price - c.expected) <= greatest(0.031, least(a.price, c.expected) * 0.0075) GROUP BY 1, 2)
 SELECT page_key, label_id, CASE WHEN coalesce(ok, true) THEN price ELSE better END AS price, CASE WHEN coalesce(ok, true) THEN 'kept' WHEN better IS NOT NULL THEN 'corrected' ELSE 'rejected' END AS state FROM c LEFT JOIN b USING (page_key, label_id)""")
def m6(v: Views) -> DataFrame:
    k, t = F.col("o_orderkey"), F.floor("o_totalprice")
    m = v.table("orders").select(F.col("o_custkey").alias("page_key"), k.alias("label_id"), (t % 40 / 4.0 + 1).alias("price"), F.when(k % 3 != 0, t % 17 / 4.0 + 1).alias("expected"))
    return matching.reconcile(m, m.select("page_key", F.col("label_id").alias("anchor_id"), "price"))


@query("e3_similar_names", None)
def e3(v: Views) -> DataFrame:
    return matching.similar_names(v.products)


@query("k1_import", """, t AS (SELECT t.*, p.grams, lower(p.product_name) || '|' || p.grams || 'g' AS product_key, t.valid_from + 180 AS valid_to FROM texts t JOIN products p USING (product_id)),
 j AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'nur\\s+online') THEN 'online' WHEN price > 5000 THEN 'quality' WHEN valid_from < DATE '1996-01-01' THEN 'date' END AS why FROM t),
 n AS (SELECT store_id, product_key, valid_from, price, valid_to FROM j WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY store_id, product_key, valid_from, price ORDER BY product_id DESC) = 1),
 k AS (SELECT DISTINCT store_id, product_key, valid_from, price FROM t WHERE product_id % 3 = 0),
 u AS (SELECT coalesce(n.store_id, k.store_id) AS store_id, coalesce(n.product_key, k.product_key) AS product_key, coalesce(n.valid_to, k.valid_from + 30) AS valid_to, n.store_id IS NULL AS old FROM n FULL JOIN k ON n.store_id = k.store_id AND n.product_key = k.product_key AND n.valid_from = k.valid_from AND n.price = k.price)
 SELECT store_id, count(*) AS offers, count(DISTINCT product_key) AS products, max(valid_to)::VARCHAR AS last_day, count(*) FILTER (WHERE old) AS untouched FROM u GROUP BY 1""")
def k1(v: Views) -> DataFrame:
    """Offers merged into those of an earlier import, which a third of the products has; rejected ones leave the old rows as they are."""
    rows = v.texts.join(v.products, "product_id").select("store_id", "product_name", F.col("grams").cast("double").alias("quantity"), F.lit("g").alias("unit"), "price", "valid_from", F.date_add("valid_from", 180).alias("valid_to"), F.lit(1).alias("page"), F.col("text").alias("source_text"), F.lit("").alias("source_url"), F.col("product_id").alias("seq"))
    old = rows.where("seq % 3 = 0").select("store_id", master_key(F.col("product_name"), F.col("quantity"), F.col("unit")).alias("product_key"), "valid_from", "price").distinct()
    known = old.withColumns({"valid_to": F.date_add("valid_from", 30), "source_url": F.lit("old")})
    offers, _ = importer.import_offers(rows, known, F.lit("1996-01-01").cast("date"))
    return offers.groupBy("store_id").agg(F.count("*").alias("offers"), F.count_distinct("product_key").alias("products"), F.max("valid_to").cast("string").alias("last_day"), F.count_if(F.col("source_url") == "old").alias("untouched"))
