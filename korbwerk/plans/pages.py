"""Registered queries: offers read back out of pages in each retailer's layout, made of the offers of a store and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk.operators import parsers
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views, as_of, cents


def _de(x: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", x), r"\.", ",")


def _cards(v: Views) -> DataFrame:
    """The current offers with a price that has at most three digits before the comma."""
    shown = cents(F.col("price") % 900 + 1)
    return v.current.join(v.products, "product_id").join(v.stores.select("store_id", "retailer"), "store_id").select("store_id", "valid_from", "retailer", "product_id", "product_name", "grams", shown.alias("price"))


def _card(layout: str) -> Column:
    name, grams, price = F.col("product_name"), (F.col("grams") * 10).cast("string"), F.col("price")
    g = F.concat(grams, F.lit(" g"))
    return {
        "REWE": F.concat_ws("\n", name, F.concat(F.lit("je "), g), F.lit("Aktion"), F.concat(_de(price), F.lit(" €"))),
        "EDEKA": F.concat_ws("\n", F.concat(F.lit("Angebot: "), name), F.concat(F.lit("je "), g), F.concat(F.lit("App-Preis von "), _de(price - 0.5), F.lit(" €")), F.concat(F.lit("Festpreis von "), _de(price), F.lit(" €"))),
        "Netto Marken-Discount": F.concat_ws("\n", F.concat_ws(" ", name, g), F.concat(F.lit("statt "), _de(price + 1), F.lit(" "), _de(price)), F.lit("Filiale")),
        "ALDI SÜD": F.concat_ws("\n", name, g, F.concat(_de(price), F.lit(" €")), F.lit("Alle Wochenangebote"), F.lit("Filiale"), F.lit("Filiale")),
        "Lidl": F.concat_ws("\n", F.concat(name, F.lit(" in der Filiale")), F.concat(F.lit("je "), g, F.lit(", KW 25")), F.concat(_de(price), F.lit(" €"))),
    }[layout]


HEADS = {"REWE": "Angebote im Markt\nDiese Woche 15.6. bis 20.6.", "EDEKA": "gültig vom 15.06.98 bis 20.06.98", "Netto Marken-Discount": "Start\nFilialangebote", "ALDI SÜD": "Wochenangebote Mo., 15.6. – Sa., 20.6.", "Lidl": ""}


def page_texts(cards: DataFrame, layout: str) -> DataFrame:
    """(leaflet, text): a page a store and day, its cards in order of product; of Lidl a page an offer."""
    each = ["store_id", "valid_from", *(["product_id", "price"] if layout == "Lidl" else [])]
    pages = cards.select(*each, F.struct("product_id", "price", _card(layout).alias("card")).alias("c")).groupBy(*each).agg(F.array_sort(F.collect_set("c")).alias("cards"))
    return pages.select(F.concat_ws("/", *each).alias("leaflet"), F.concat_ws("\n", F.lit(HEADS[layout]), F.transform("cards", lambda c: c["card"])).alias("text"))


_ROWS = ", k AS (SELECT store_id, valid_from, retailer, product_id, product_name, grams, floor((price % 900 + 1) * 100 + 0.5) / 100.0::DOUBLE AS price FROM current_offers JOIN products USING (product_id) JOIN (SELECT store_id, retailer FROM stores) USING (store_id))"
_LEAFLET = "store_id || '/' || valid_from"
_SQL = {
    "REWE": (_LEAFLET, "product_name", "NULL::DOUBLE", "NULL::DOUBLE"),
    "EDEKA": (_LEAFLET, "product_name", "NULL::DOUBLE", "floor((price - 0.5) * 100 + 0.5) / 100.0::DOUBLE"),
    "Netto Marken-Discount": (_LEAFLET, "product_name || ' ' || grams * 10 || ' g'", "floor((price + 1) * 100 + 0.5) / 100.0::DOUBLE", "NULL::DOUBLE"),
    "ALDI SÜD": (_LEAFLET, "product_name", "NULL::DOUBLE", "NULL::DOUBLE"),
    "Lidl": (f"{_LEAFLET} || '/' || product_id || '/' || price", "product_name || ' in der Filiale'", "NULL::DOUBLE", "NULL::DOUBLE"),
}
_DATED = {"Netto Marken-Discount": "NULL"}


def _select(layout: str) -> str:
    leaflet, name, regular, app = _SQL[layout]
    if layout == "Lidl":
        leaflet = "'one'"
    return f" SELECT {leaflet} AS leaflet, {name} AS name, price, {regular} AS regular_price, {app} AS app_price, (grams * 10)::DOUBLE AS quantity, 'g' AS unit, {_DATED.get(layout, chr(39) + '1998-06-15' + chr(39))} AS starts, count(*) AS n FROM (SELECT DISTINCT * FROM k) k"


def _counted(found: DataFrame, layout: str) -> DataFrame:
    leaflet = F.lit("one") if layout == "Lidl" else F.col("leaflet")
    return found.groupBy(leaflet.alias("leaflet"), "name", F.round("price", 2).alias("price"), "regular_price", "app_price", "quantity", "unit", F.col("valid_from").cast("string").alias("starts")).agg(F.count("*").alias("n"))


def _register(name: str, layout: str) -> None:
    # Offers of one store and day with equal names, prices and packages are one on a page.
    same = "SELECT DISTINCT store_id, valid_from, retailer, " + ("product_id, " if layout == "Lidl" else "") + "product_name, grams, price FROM k"

    @query(name, _ROWS + _select(layout).replace("SELECT DISTINCT * FROM k", same) + " GROUP BY ALL")
    def run(v: Views) -> DataFrame:
        return _counted(parsers.PARSERS[layout](page_texts(_cards(v), layout), "leaflet", "text", as_of()), layout)


for _name, _layout in (("g2_rewe", "REWE"), ("g3_edeka", "EDEKA"), ("g4_netto", "Netto Marken-Discount"), ("g5_aldi", "ALDI SÜD"), ("g6_lidl", "Lidl")):
    _register(_name, _layout)


@query(
    "g7_collected",
    _ROWS
    + """, d AS (SELECT DISTINCT store_id, valid_from, retailer, CASE WHEN retailer = 'Lidl' THEN product_id END AS one, product_name, grams, price, CASE WHEN retailer = 'EDEKA' THEN floor((price - 0.5) * 100 + 0.5) / 100.0::DOUBLE ELSE price END AS asked FROM k WHERE retailer IN ('REWE', 'EDEKA', 'Netto Marken-Discount', 'ALDI SÜD', 'Lidl'))
 SELECT retailer, count(*) AS offers, round(sum(price), 2) AS total, round(sum(floor(asked / (grams * 10 / 1000.0::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE), 2) AS per_kg FROM d GROUP BY 1""",
)
def g7(v: Views) -> DataFrame:
    """All pages, each read by its retailer's parser, with unit prices worked out."""
    cards = _cards(v)
    pages = [page_texts(cards.where(F.col("retailer") == x), x).withColumn("retailer", F.lit(x)) for x in parsers.PARSERS]
    texts = pages[0]
    for p in pages[1:]:
        texts = texts.unionByName(p)
    found = parsers.collect(texts, "leaflet", "text", "retailer", as_of())
    return found.groupBy("retailer").agg(F.count("*").alias("offers"), F.round(F.sum("price"), 2).alias("total"), F.round(F.sum("unit_price"), 2).alias("per_kg"))
