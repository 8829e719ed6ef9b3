"""Registered queries: offers and identifiers out of JSON, built of the offers of a store and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk.operators import extract, flyers, jsontree
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views, as_of, cents

KEY = "leaflet"
#: Manifests number a product by its id from here on; one product has the number of another, so that neither is found by it.
FIRST_NUMBER, SAME_NUMBER = 1_000_000, (8, 1_000_009)


def _cards(v: Views) -> DataFrame:
    return v.current.join(v.products, "product_id").select("store_id", "valid_from", "product_id", "product_name", "grams", cents(F.col("price") % 400 + 1).alias("price")).distinct()


def _json(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def _listed(cards: DataFrame, **lists: Column) -> DataFrame:
    """One row a store and day, with JSON arrays of what each card gives, in order of product and price; null is left out."""
    packed = cards.groupBy("store_id", "valid_from").agg(F.array_sort(F.collect_list(F.struct("product_id", "price", *[c.alias(k) for k, c in lists.items()]))).alias("c"))
    array = lambda k: F.concat(F.lit("["), F.array_join(F.array_compact(F.transform("c", lambda x: x[k])), ","), F.lit("]")).alias(k)
    return packed.select(F.concat_ws("/", "store_id", "valid_from").alias(KEY), *[array(k) for k in lists])


_K = ", k AS (SELECT DISTINCT store_id, valid_from, product_id, product_name, grams, floor((price % 400 + 1) * 100 + 0.5) / 100.0::DOUBLE AS price FROM current_offers JOIN products USING (product_id))"


def network(v: Views) -> DataFrame:
    """Answers as a shop's site gives them: offers with wrapped prices and packages, and products that are no offers."""
    p, price = F.col("product_id"), F.col("price").cast("string")
    offer = F.concat(F.lit('{"productName":'), _json(F.col("product_name")), F.lit(',"price":{"amount":'), price, F.lit('},"oldPrice":"'), F.format_string("%.2f", F.col("price") + 2), F.lit('","packageSize":"'), F.col("grams") * 10, F.lit(' g","validFrom":"'), F.col("valid_from"), F.lit('","nested":[{"deep":{"title":"x","price":null}}]}'))
    plain = F.concat(F.lit('{"name":'), _json(F.col("product_name")), F.lit(',"price":'), price, F.lit("}"))
    rows = _listed(_cards(v), deals=F.when(p % 3 != 0, offer), goods=F.when(p % 3 == 0, plain))
    return rows.select(KEY, F.concat(F.lit('{"data":{"deals":'), "deals", F.lit(',"shelf":{"list":'), "goods", F.lit("}}}")).alias("doc"))


@query("g8_network_offers", _K + """ SELECT store_id || '/' || valid_from AS leaflet, product_name AS name, price, round(price + 2, 2) AS regular_price, (grams * 10)::DOUBLE AS quantity, 'g' AS unit, valid_from::VARCHAR AS valid_from FROM (SELECT DISTINCT store_id, valid_from, product_name, price, grams FROM k WHERE product_id % 3 <> 0) k""")
def g8(v: Views) -> DataFrame:
    found = jsontree.network_offers(jsontree.objects(extract.json_nodes(network(v), KEY, "doc"), KEY), KEY)
    return found.select(KEY, "name", "price", F.round("regular_price", 2).alias("regular_price"), "quantity", "unit", "valid_from")


def manifest(v: Views) -> DataFrame:
    """A leaflet's manifest: pages with hotspots, which name their product by number, by address or in full, or say that it is sold online; and the catalogue."""
    p, price = F.col("product_id"), F.col("price").cast("string")
    number = F.when(p == SAME_NUMBER[0], SAME_NUMBER[1]).otherwise(p + FIRST_NUMBER).cast("string")
    spot = (
        F.when(p % 4 == 0, F.concat(F.lit('{"productId":"'), number, F.lit('","offerPrice":'), price, F.lit("}")))
        .when(p % 4 == 1, F.concat(F.lit('{"link":{"url":"https://shop.de/p/'), number, F.lit('"},"text":{"price":{"value":"'), price, F.lit('"}}}')))
        .when(p % 4 == 2, F.concat(F.lit('{"title":'), _json(F.col("product_name")), F.lit(',"price":'), price, F.lit(',"oldPrice":'), F.format_string("%.2f", F.col("price") + 1), F.lit("}")))
        .otherwise(F.concat(F.lit('{"productId":"'), number, F.lit('","price":'), price, F.lit(',"badge":"Nur online"}')))
    )
    goods = F.concat(F.lit('{"productId":"'), number, F.lit('","title":'), _json(F.col("product_name")), F.lit("}"))
    rows = _listed(_cards(v), spots=spot, goods=goods)
    return rows.select(KEY, F.concat(F.lit('{"flyer":{"pages":[{"pageNumber":3,"hotspots":'), "spots", F.lit('},{"number":2,"hotspots":[]}]},"products":'), "goods", F.lit("}")).alias("doc"))


def _objects(v: Views) -> DataFrame:
    return jsontree.objects(extract.json_nodes(manifest(v), KEY, "doc"), KEY)


@query("g9_manifest_offers", _K + """ SELECT store_id || '/' || valid_from AS leaflet, 3 AS page, product_name AS name, price, count(*) AS n FROM (SELECT DISTINCT store_id, valid_from, product_name, price FROM k WHERE product_id % 4 <> 3
 AND NOT (product_id IN (8, 9) AND EXISTS (SELECT 1 FROM k o WHERE o.store_id = k.store_id AND o.valid_from = k.valid_from AND o.product_id IN (8, 9) AND o.product_name <> k.product_name))) k GROUP BY ALL""")
def g9(v: Views) -> DataFrame:
    found = jsontree.manifest_offers(_objects(v), KEY)
    return found.groupBy(KEY, "page", "name", F.round("price", 2).alias("price")).agg(F.count("*").alias("n"))


@query("fj3_identifiers", _K + """ SELECT store_id || '/' || valid_from AS leaflet, (CASE WHEN product_id = 8 THEN 1000009 ELSE product_id + 1000000 END)::VARCHAR AS id, count(*) + count(*) FILTER (WHERE product_id % 4 <> 2) AS n FROM k GROUP BY 1, 2""")
def fj3(v: Views) -> DataFrame:
    """Every product number that a manifest's objects give, and how often; addresses count as their numbers."""
    found = _objects(v).select(KEY, F.explode(jsontree.identifiers()).alias("id"))
    return found.groupBy(KEY, "id").agg(F.count("*").alias("n"))


@query("fj4_paths", _K + """ SELECT store_id || '/' || valid_from AS leaflet, count(*) * 1 + 2 + 3 * count(*) FILTER (WHERE product_id % 4 = 1) AS on_page, count(*) AS in_catalogue, count(*) + 3 * count(*) FILTER (WHERE product_id % 4 = 1) AS in_container FROM k GROUP BY 1""")
def fj4(v: Views) -> DataFrame:
    """Objects on pages, in the catalogue and in containers, by their paths alone."""
    nodes = extract.json_nodes(manifest(v), KEY, "doc").where(F.startswith("value", F.lit("{")))
    p = F.col("path")
    return nodes.groupBy(KEY).agg(F.count_if(jsontree.on_page(p)).alias("on_page"), F.count_if(jsontree.in_catalogue(p)).alias("in_catalogue"), F.count_if(jsontree.container(p).isNotNull()).alias("in_container"))


@query("fj5_online_flags", _K + """ SELECT store_id || '/' || valid_from AS leaflet, count(*) FILTER (WHERE product_id % 4 = 3) AS online FROM k GROUP BY 1""")
def fj5(v: Views) -> DataFrame:
    """Hotspots that say they are sold online alone."""
    spots = _objects(v).where(jsontree.container(F.col("path")) == F.col("path"))
    return spots.groupBy(KEY).agg(F.count_if(jsontree.sold_online(F.col("json"), F.col("fields"))).alias("online"))


@query("fj1_inherited_page", _K + """ SELECT store_id || '/' || valid_from AS leaflet, 3::INT AS page, 2 + count(*) * 2 + 2 * count(*) FILTER (WHERE product_id % 4 = 1) * 2 + count(*) FILTER (WHERE product_id % 4 = 2) + count(*) FILTER (WHERE product_id % 4 IN (0, 3)) + count(*) FILTER (WHERE product_id % 4 IN (2, 3)) + 1 AS nodes FROM k GROUP BY 1""")
def fj1_inherited(v: Views) -> DataFrame:
    """How many nodes of a manifest belong to the page that gives itself the number 3: the page, its fields, its hotspots and all in these."""
    nodes = extract.json_nodes(manifest(v), KEY, "doc")
    return nodes.where("page = 3").groupBy(KEY, "page").agg(F.count("*").alias("nodes"))


@query("fj6_all_text", " SELECT event_id, user_id || ' ' || event_type AS text FROM events")
def fj6(v: Views) -> DataFrame:
    e = F.concat(F.lit('{"a":{"id":'), "user_id", F.lit('},"b":[null,{"kind":"'), "event_type", F.lit('"}],"c":{}}'))
    return jsontree.all_text(extract.json_nodes(v.table("events").select("event_id", e.alias("doc")), "event_id", "doc"), "event_id")


@query("fj7_gathered", _K + """ SELECT store_id || '/' || valid_from AS leaflet, count(*) AS spots, count(*) FILTER (WHERE product_id % 4 = 2) AS named, round(sum(price), 2) AS total, round(sum(CASE WHEN product_id % 4 = 2 THEN price + 1 END), 2) AS regular FROM k GROUP BY 1""")
def fj7(v: Views) -> DataFrame:
    """Fields that are spread over the objects of a hotspot, put together."""
    found = jsontree.gathered(_objects(v), KEY)
    return found.groupBy(KEY).agg(F.count("*").alias("spots"), F.count("name").alias("named"), F.round(F.sum("price"), 2).alias("total"), F.round(F.sum("regular_price"), 2).alias("regular"))


def flyer(v: Views) -> DataFrame:
    """A flyer a store and day: a page of links, to products of stores, of the shop and to none of the catalogue; and a page a text, of offers or of what is sold online."""
    p, price = F.col("product_id"), F.col("price").cast("string")
    number = ((p + FIRST_NUMBER) * 100000 + F.round(F.col("price") * 100)).cast("long").cast("string")
    details = F.concat(F.lit('{"url":"/x","productDetails":{"productId":"'), number, F.lit('","title":'), _json(F.col("product_name")), F.lit("}}"))
    local = F.concat(F.lit('{"productId":"'), number, F.lit('","packageSize":"'), F.col("grams") * 10, F.lit(' g","storeOnly":true,"price":'), price, F.lit("}"))
    shop = F.concat(F.lit('{"productId":'), number, F.lit(',"title":'), _json(F.col("product_name")), F.lit(',"oldPrice":'), F.format_string("%.2f", F.col("price") + 1), F.lit(',"price":{"value":"'), price, F.lit('"}}'))
    shown = F.concat_ws("\n", F.concat("product_name", F.lit(" in der Filiale")), F.concat(F.lit("je "), F.col("grams") * 10, F.lit(" g, KW 25")), F.concat(F.regexp_replace(F.format_string("%.2f", F.col("price")), r"\.", ","), F.lit(" €")))
    told = F.to_json(F.struct(shown.alias("altText"), F.when(p % 5 == 4, "Nur online").alias("badge"), F.lit("https://x.de/nur online").alias("image")))
    rows = _listed(_cards(v), links=F.when(p % 5 < 3, details), goods=F.when(p % 5 == 0, local).when(p % 5 == 1, shop), told=F.when(p % 5 > 2, told))
    return rows.select(KEY, F.concat(F.lit('{"data":{"flyer":{"pages":[{"links":'), "links", F.lit("}"), F.regexp_replace(F.regexp_replace("told", r"^\[(?=.)(?!\])", ","), r"^\[\]$|\]$", ""), F.lit('],"products":'), "goods", F.lit("}}}")).alias("doc"))


@query("g10_flyer_offers", _K + """, n AS (SELECT *, row_number() OVER (PARTITION BY store_id, valid_from ORDER BY product_id, price) + 1 AS place FROM k WHERE product_id % 5 > 2),
 o AS (SELECT store_id || '/' || valid_from AS leaflet, 1 AS page, 'link' AS kind, 'link' AS title_from, product_name || ' ' || grams * 10 || ' g' AS name, price, NULL::DOUBLE AS regular_price, (grams * 10)::DOUBLE AS quantity, true AS local FROM k WHERE product_id % 5 = 0
  UNION ALL SELECT store_id || '/' || valid_from, 1, 'link', 'catalogue', product_name, price, round(price + 1, 2), NULL, false FROM k WHERE product_id % 5 = 1
  UNION ALL SELECT store_id || '/' || valid_from, place, 'text', '', product_name || ' in der Filiale', price, NULL, (grams * 10)::DOUBLE, true FROM n WHERE product_id % 5 = 3)
 SELECT DISTINCT leaflet, page, kind, title_from, name, price, regular_price, quantity, local FROM o""")
def g10(v: Views) -> DataFrame:
    found = flyers.flyer_offers(flyer(v), KEY, "doc", as_of())
    return found.select(F.col("flyer_key").alias(KEY), "page", "kind", F.coalesce("title_from", F.lit("")).alias("title_from"), "name", "price", F.round("regular_price", 2).alias("regular_price"), "quantity", "local")
