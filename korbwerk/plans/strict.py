"""Registered queries: strict pages, agreed names and cards of price tags, laid out from offers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.functions.price import half_up
from korbwerk.operators import rebuild
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views


def read_pages(v: Views) -> tuple[DataFrame, DataFrame]:
    """Offers on a store's pages of a year, some with a clipped name, a wrong unit price or none; and the cards of these pages, each with one to three readings of its name."""
    p = F.col("product_id")
    o = v.offers_by_product.join(v.products.select("product_id", "product_name", "grams"), "product_id")
    number = F.datediff("valid_from", F.lit("1970-01-01").cast("date"))
    per = half_up(F.col("price") * 100 / F.col("grams"), 2)
    o = o.select(
        (F.col("store_id") * 10000 + (F.year("valid_from") - 1990) * 10 + F.col("page")).alias("page_key"),
        F.concat_ws("-", "store_id", "product_id", number, F.round(F.col("price") * 100).cast("long")).alias("offer_id"),
        "store_id", "product_id", "page", "product_name", F.when(p % 9 == 0, F.concat("product_name", F.lit(" pr"))).otherwise(F.col("product_name")).alias("name"),
        "price", (F.col("grams") * 10).cast("double").alias("quantity"), F.lit("g").alias("unit"), F.when(p % 3 == 1, per).when(p % 7 == 2, per * 2).alias("unit_price"),
    )
    n = F.col("product_name")
    extra, fine, clipped = F.concat(n, F.lit(" extra")), F.concat(F.lit("feine "), n), F.concat(n, F.lit(" pr"))
    readings = F.when(p % 5 == 0, F.array(n, extra)).when(p % 5 == 1, F.array(n, n)).when(p % 5 == 2, F.array(n, F.lit("feine butter"), extra)).when(p % 5 == 3, F.array(n, clipped)).otherwise(F.array(extra, fine, n))
    held = ((p + F.col("page")) % 3 != 0) & ((F.col("store_id") % 4 != 0) | (p % 8 == 0))
    return o, o.where(held).select("page_key", F.col("offer_id").alias("card_id"), readings.alias("names"), *rebuild.VALUES)


_PAGES = r""", o AS (SELECT store_id * 10000 + (year(valid_from) - 1990) * 10 + page AS page_key, store_id || '-' || product_id || '-' || date_diff('day', DATE '1970-01-01', valid_from::DATE) || '-' || round(price * 100)::BIGINT AS offer_id, store_id, product_id, page, product_name,
   CASE WHEN product_id % 9 = 0 THEN product_name || ' pr' ELSE product_name END AS name, product_id % 9 <> 0 AND regexp_matches(product_name, '[a-z]{4,}$') AS strict, price, grams, floor(price * 100 / grams * 100 + 0.5) / 100.0::DOUBLE AS per FROM offers JOIN products USING (product_id)),
 e AS (SELECT *, CASE WHEN product_id % 3 = 1 THEN per WHEN product_id % 7 = 2 THEN per * 2 END AS up, floor((grams * 10 / 1000.0::DOUBLE * up + 1e-9) * 100 + 0.5) / 100.0::DOUBLE AS x0, CASE WHEN x0 BETWEEN 0.05 AND 500 THEN x0 END AS x, coalesce(abs(price - x) <= greatest(0.031::DOUBLE, least(price, x) * 0.0075::DOUBLE), false) AS near FROM o),
 j AS (SELECT *, strict AND x IS NOT NULL AS checked, strict AND near AS correct, NOT strict OR (x IS NOT NULL AND NOT near) AS bad FROM e),
 pg AS (SELECT page_key, count(*) AS n, count(*) FILTER (WHERE NOT strict) AS unfit, count(*) FILTER (WHERE NOT bad) AS good, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE bad) AS rejected FROM j GROUP BY 1),
 r AS (SELECT offer_id, page_key, price, x, near, unnest(rs) AS name, generate_subscripts(rs, 1) AS pos FROM (SELECT *, CASE product_id % 5 WHEN 0 THEN [product_name, product_name || ' extra'] WHEN 1 THEN [product_name, product_name] WHEN 2 THEN [product_name, 'feine butter', product_name || ' extra'] WHEN 3 THEN [product_name, product_name || ' pr'] ELSE [product_name || ' extra', 'feine ' || product_name, product_name] END AS rs
   FROM j WHERE (product_id + page) % 3 <> 0 AND (store_id % 4 <> 0 OR product_id % 8 = 0))),
 rd AS (SELECT offer_id, page_key, price, x, near, name, min(pos) AS pos, list_filter(string_split(name, ' '), lambda w: length(w) >= 3) AS ws FROM r WHERE regexp_matches(name, '[a-z]{4,}$') GROUP BY ALL),
 ag AS (SELECT a.offer_id, a.page_key, a.price, a.x, a.near, a.name, a.pos, count(*) FILTER (WHERE s >= 0.6) AS support, max(s) AS best FROM (SELECT a.*, len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws))::DOUBLE AS s FROM rd a JOIN rd b ON a.page_key = b.page_key AND a.offer_id = b.offer_id AND a.pos <> b.pos) a GROUP BY ALL),
 cn AS (SELECT * FROM ag WHERE support >= 1 QUALIFY row_number() OVER (PARTITION BY page_key, offer_id ORDER BY support DESC, best DESC, length(name) DESC, pos) = 1)
"""
_REBUILT = """, f AS (SELECT page_key, min(offer_id) AS offer_id, name, price FROM cn WHERE x IS NULL OR near GROUP BY page_key, name, price),
 en AS (SELECT page_key, count(*) AS recovered FROM f JOIN pg USING (page_key) WHERE unfit >= 1 AND unfit / n >= 0.12::DOUBLE GROUP BY page_key, good HAVING count(*) >= greatest(2, good // 2))
"""


@query("m7_strict_pages", _PAGES + _REBUILT + " SELECT page_key, offer_id, name, price, false AS rebuilt FROM j WHERE NOT bad AND page_key NOT IN (SELECT page_key FROM en) UNION ALL SELECT page_key, offer_id, name, price, true FROM f SEMI JOIN en USING (page_key)")
def m7(v: Views) -> DataFrame:
    return rebuild.strict_pages(*read_pages(v))[0]


@query("m7_page_metrics", _PAGES + _REBUILT + " SELECT page_key, checked + coalesce(recovered, 0) AS checked, correct + coalesce(recovered, 0) AS correct, rejected, coalesce(recovered, 0) AS recovered FROM pg LEFT JOIN en USING (page_key)")
def m7_metrics(v: Views) -> DataFrame:
    return rebuild.strict_pages(*read_pages(v))[1]


@query("m7_consensus_names", _PAGES + " SELECT page_key, offer_id AS card_id, name FROM cn")
def m7_names(v: Views) -> DataFrame:
    return rebuild.consensus_names(read_pages(v)[1])


@query(
    "m7_card_cells",
    """, t AS (SELECT DISTINCT l_orderkey // 4 AS page, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, (l_partkey * 37 % 900)::DOUBLE AS x0, (l_partkey * 53 % 1200)::DOUBLE AS y0, x0 + 60 AS x1, y0 + 30 AS y1, x0 + 30 AS cx, y0 + 15 AS cy FROM lineitem),
 n AS (SELECT a.*, max(CASE WHEN abs(b.cy - a.cy) <= 190 AND b.cx < a.cx THEN (a.cx + b.cx) / 2 END) AS l, min(CASE WHEN abs(b.cy - a.cy) <= 190 AND b.cx >= a.cx THEN (a.cx + b.cx) / 2 END) AS r, max(CASE WHEN abs(b.cx - a.cx) <= 230 AND b.cy < a.cy THEN (a.cy + b.cy) / 2 END) AS t, min(CASE WHEN abs(b.cx - a.cx) <= 230 AND b.cy >= a.cy THEN (a.cy + b.cy) / 2 END) AS b FROM t a LEFT JOIN t b ON a.page = b.page AND a.id <> b.id GROUP BY ALL),
 m AS (SELECT page, id, cx, cy, y0, y1, coalesce(l, 0) AS l, coalesce(r, 1000) AS r, coalesce(t, 0) AS t, coalesce(b, 1300) AS b FROM n)
 SELECT page AS page_key, id AS tag_id, trunc(CASE WHEN r - l > 500 THEN greatest(0, cx - 290) ELSE l END)::BIGINT AS "left", trunc(greatest(0, least(CASE WHEN b - t > 580 THEN greatest(0, cy - 580.0::DOUBLE * 0.84::DOUBLE) ELSE t END, y0 - 55)))::BIGINT AS top,
  trunc(CASE WHEN r - l > 500 THEN least(1000, cx + 210) ELSE r END)::BIGINT AS "right", trunc(least(1300, greatest(CASE WHEN b - t > 580 THEN least(1300, cy + 580.0::DOUBLE * 0.16::DOUBLE) ELSE b END, y1 + 30)))::BIGINT AS bottom FROM m""",
)
def m7_cells(v: Views) -> DataFrame:
    k = F.col("l_partkey")
    rows = v.table("lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("page_key"), "l_orderkey", "l_linenumber", "l_partkey").repartition("page_key").distinct()
    x, y = (k * 37 % 900).cast("double"), (k * 53 % 1200).cast("double")
    tags = rows.select("page_key", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + k).alias("tag_id"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 30).alias("y1"))
    return rebuild.card_cells(tags, 1000, 1300)
