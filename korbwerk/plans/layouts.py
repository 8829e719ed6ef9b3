"""Registered queries: lines, price anchors and offers of leaflet pages, laid out from line items and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.operators import layout
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views, cents


def words(v: Views) -> DataFrame:
    """A word a line item, on pages of four orders."""
    k = F.col("l_partkey")
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    x, y = (k * 37 % 600).cast("double"), (k * 53 % 300).cast("double")
    return rows.select(F.floor(F.col("l_orderkey") / 4).alias("page_key"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + k).alias("word_id"), F.concat(F.lit("w"), k).alias("text"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 12 + k % 30).alias("y1"), (k % 100).cast("double").alias("confidence"))


@query("w13_word_lines", """, w AS (SELECT DISTINCT l_orderkey // 4 AS page, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, 'w' || l_partkey AS text, (l_partkey * 37 % 600)::DOUBLE AS x0, (l_partkey * 53 % 300)::DOUBLE AS y0, 12.0::DOUBLE + l_partkey % 30 AS h, (l_partkey % 100)::DOUBLE AS sure FROM lineitem),
 o AS (SELECT *, y0 + h / 2 AS cy, greatest(10.0::DOUBLE, least(20.0::DOUBLE, h * 0.55::DOUBLE)) AS tol, row_number() OVER (PARTITION BY page ORDER BY y0 + h / 2, x0, id) AS n FROM w),
 f AS (WITH RECURSIVE f(page, n, ring, lines, line) AS (
   SELECT page, n, [{'id': 1::BIGINT, 's': cy, 'k': 1::BIGINT}], 1::BIGINT, 1::BIGINT FROM o WHERE n = 1
   UNION ALL
   SELECT page, n, CASE WHEN hit IS NULL THEN list_slice(list_append(ring, {'id': lines + 1, 's': cy, 'k': 1::BIGINT}), -5, -1) ELSE list_transform(ring, lambda l: CASE WHEN l.id = hit THEN {'id': l.id, 's': l.s + cy, 'k': l.k + 1} ELSE l END) END,
     CASE WHEN hit IS NULL THEN lines + 1 ELSE lines END, coalesce(hit, lines + 1)
   FROM (SELECT o.page, o.n, o.cy, f.ring, f.lines, list_filter(list_reverse(f.ring), lambda l: abs(l.s / l.k - o.cy) <= o.tol)[1].id AS hit FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1) t) SELECT * FROM f),
 g AS (SELECT page, line, string_agg(text, ' ' ORDER BY x0, n) AS text, min(x0) AS x0, min(y0) AS y0, max(x0 + 40) AS x1, max(y0 + h) AS y1, max(h) AS max_height, round(avg(sure), 6) AS confidence FROM f JOIN o USING (page, n) GROUP BY 1, 2)
 SELECT page AS page_key, row_number() OVER (PARTITION BY page ORDER BY y0, x0, line)::INT AS line_no, text, x0, y0, x1, y1, max_height, confidence FROM g""")
def w13_lines(v: Views) -> DataFrame:
    return layout.line_groups(words(v)).withColumn("confidence", F.round("confidence", 6))


def blocks(v: Views) -> DataFrame:
    """Blocks of an order's page: a price a line item, some with a former price, and every fourth one the loyalty programme's name."""
    k = F.col("l_partkey")
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    x, y = (k * 37 % 120).cast("double"), (k * 53 % 300).cast("double")
    de = lambda c: F.regexp_replace(F.format_string("%.2f", c), r"\.", ",")
    price = de((k % 900 + 100) / 100.0)
    text = F.when(k % 4 == 0, "Nur mit Lidl Plus").when(k % 4 == 1, F.concat(price, F.lit("*"))).when(k % 4 == 2, F.concat(F.lit("statt "), de((k % 900 + 300) / 100.0), F.lit("\n"), price, F.lit("*"))).otherwise(F.concat(price, F.lit(" *")))
    return rows.select(F.floor(F.col("l_orderkey") / 2).alias("page_key"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + k).alias("block_id"), x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 20).alias("y1"), text.alias("text"))


_ANCHORS = """, b AS (SELECT DISTINCT l_orderkey // 2 AS page, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, (l_partkey * 37 % 120)::DOUBLE AS x0, (l_partkey * 53 % 300)::DOUBLE AS y0, l_partkey % 4 AS kind, (l_partkey % 900 + 100) / 100.0::DOUBLE AS price, CASE WHEN l_partkey % 4 = 2 THEN (l_partkey % 900 + 300) / 100.0::DOUBLE END AS regular FROM lineitem),
 p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM b WHERE kind <> 0),
 c AS (SELECT p.page, p.n, coalesce(list(q.id ORDER BY q.id) FILTER (WHERE q.id IS NOT NULL), []) AS options FROM p LEFT JOIN p q ON q.page = p.page AND q.id <> p.id AND q.y0 >= p.y0 AND q.price < p.price AND greatest(q.y0 - p.y0 - 20, 0) <= 45 AND abs(p.x0 - q.x0) <= 55
   AND EXISTS (SELECT 1 FROM b l WHERE l.kind = 0 AND l.page = p.page AND l.x0 + 50 > least(p.x0, q.x0) - 18 AND l.x0 < greatest(p.x0, q.x0) + 68 AND l.y0 + 20 > least(p.y0, q.y0) - 10 AND l.y0 < greatest(p.y0, q.y0) + 30) GROUP BY 1, 2),
 f AS (WITH RECURSIVE f(page, n, used, id, partner) AS (
   SELECT page, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT page FROM p)
   UNION ALL
   SELECT page, n, CASE WHEN gone OR hit IS NULL THEN used ELSE list_append(used, hit) END, CASE WHEN NOT gone THEN id END, CASE WHEN NOT gone THEN hit END
   FROM (SELECT p.page, p.n, p.id, f.used, list_contains(f.used, p.id) AS gone, list_filter(c.options, lambda o: NOT list_contains(f.used, o))[1] AS hit FROM f JOIN p ON p.page = f.page AND p.n = f.n + 1 JOIN c ON c.page = p.page AND c.n = p.n) t) SELECT * FROM f)
 SELECT f.page AS page_key, f.id AS block_id, coalesce(f.partner, 0) AS partner_id, least(p.x0, q.x0) AS x0, least(p.y0, q.y0) AS y0, greatest(p.x0, q.x0) + 50 AS x1, greatest(p.y0, q.y0) + 20 AS y1, p.price, p.regular AS regular_price, q.price AS app_price FROM f JOIN p ON p.id = f.id LEFT JOIN p q ON q.id = f.partner"""


@query("m3_price_anchors", _ANCHORS)
def m3(v: Views) -> DataFrame:
    return layout.price_anchors(blocks(v)).withColumn("partner_id", F.coalesce("partner_id", F.lit(0)))


def cards(v: Views) -> DataFrame:
    """The current offers of a store and day as cards in three columns of a page."""
    rows = v.current.join(v.products, "product_id").select("store_id", "valid_from", "product_id", "product_name", (F.col("grams") % 40 + 10).alias("grams"), cents(F.col("price") % 400 + 1).alias("price")).distinct()
    page = F.col("store_id") * 100000 + F.datediff("valid_from", F.lit("1970-01-01").cast("date"))
    rows = rows.withColumn("page_key", page).withColumn("i", F.row_number().over(Window.partitionBy("page_key").orderBy("product_id", "price")) - 1)
    return rows.withColumns({"x": (F.col("i") % 3 * 190).cast("double"), "y": (F.floor(F.col("i") / 3) * 170).cast("double"), "unit_price": cents(F.col("price") * 100 / F.col("grams")), "retailer": F.element_at(F.array(*map(F.lit, ("REWE", "ALDI SÜD", "PENNY"))), (F.col("store_id") % 3 + 1).cast("int"))})


@query(
    "g11_page_offers",
    """, k AS (SELECT DISTINCT store_id, valid_from, product_id, product_name, grams % 40 + 10 AS grams, floor((price % 400 + 1) * 100 + 0.5) / 100.0::DOUBLE AS price FROM current_offers JOIN products USING (product_id))
 SELECT store_id * 100000 + date_diff('day', DATE '1970-01-01', valid_from) AS page_key, product_name AS name, price, CASE WHEN product_id % 5 = 0 THEN (floor(price * 100 + 0.5) - 50) / 100.0::DOUBLE END AS app_price,
  CASE WHEN product_id % 4 <> 0 THEN grams * 10.0::DOUBLE END AS quantity, CASE WHEN product_id % 4 <> 0 THEN 'g' END AS unit, CASE WHEN product_id % 4 <> 0 THEN floor(price * 100 / grams * 100 + 0.5) / 100.0::DOUBLE END AS unit_price, product_id % 4 <> 0 AS assigned FROM k""",
)
def g11(v: Views) -> DataFrame:
    """Offers read back from the pages' blocks and price tags; every fourth product's block says no package, every fifth has a second, lower price."""
    c = cards(v)
    p, de = F.col("product_id"), lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.", ",")
    text = F.when(p % 4 == 0, F.col("product_name")).otherwise(F.concat(F.col("product_name"), F.lit("\nje "), F.col("grams") * 10, F.lit(" g\n(1 kg = "), de(F.col("unit_price")), F.lit(")")))
    box = lambda x, y, w, h: [x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")]
    texts = c.select("page_key", F.col("i").cast("long").alias("block_id"), *box(F.col("x"), F.col("y"), 150, 40), text.alias("text"), "retailer")
    head = c.select("page_key", F.lit(-1).cast("long").alias("block_id"), *box(F.lit(0.0), F.lit(-60.0), 500, 30), F.lit("Gültig ab Montag").alias("text"), "retailer").distinct()
    spot = box(F.col("x") + 50, F.col("y") + 50, 50, 25)
    tags = c.select("page_key", F.col("i").cast("long").alias("tag_id"), *spot, "price")
    second = c.where(p % 5 == 0).select("page_key", (F.col("i") + 100000).cast("long").alias("tag_id"), *spot, ((F.floor(F.col("price") * 100 + 0.5) - 50) / 100.0).alias("price"))
    found = layout.page_offers(texts.unionByName(head), tags.unionByName(second))
    return found.select("page_key", "name", "price", "app_price", "quantity", "unit", "unit_price", F.col("cost").isNotNull().alias("assigned"))
