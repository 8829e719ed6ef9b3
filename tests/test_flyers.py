"""Flyers: links, catalogue and page texts, case by case."""

import json

from pyspark.sql import functions as F

from korbwerk.operators import flyers

REF = "2026-08-19"


def flyer(**fields):
    return json.dumps({"data": {"flyer": fields}}, ensure_ascii=False)


def link(number, **more):
    return {"url": "/x", "productDetails": {"productId": number, "title": "Feiner Gouda"}} | more


def offers(spark, rows, schema="k string, doc string"):
    docs = spark.createDataFrame(rows, schema).withColumn("page", F.lit("clash")).withColumn("flyer_key", F.lit(1))
    return flyers.flyer_offers(docs, "k", "doc", F.lit(REF).cast("date")).collect()


def test_links_find_the_last_product_of_their_number(spark):
    doc = flyer(
        pages=[
            {"links": [link("A1"), link(77, channel="Filiale"), link("none"), link("B2"), {"url": "/y"}, "text", link("C3"), link("D4")]},
            {"links": [link(" a1 "), link("a1")]},
        ],
        products=[
            {"productId": "a1", "title": "Alter Preis", "price": 1},
            {"productId": "A1", "brand": "Hof", "title": "Frische Vollmilch", "content": "1 l", "offerPrice": "x", "price": {"value": "1,29 €"}, "uvp": 1.59, "storeOnly": True},
            {"productId": 77, "salesPrice": "2.49", "canonicalUrl": "/kanon"},
            {"productId": "B2", "title": "Ohne Preis"},
            {"productId": "C3", "title": "je 500 g", "price": 3},
            {"productId": "D4", "title": "Zarter Braten", "price": 4.5, "inStore": True, "note": "Nur Online"},
        ],
    )
    found = offers(spark, [("f", doc), ("f", doc), ("g", None), ("h", "{broken"), ("i", "{}"), (None, doc), ("j", flyer(pages=[])), ("l", flyer(pages={"a": 1}))])
    got = sorted((r.flyer_key, r.page, r.product_id, r.name, r.price, r.regular_price, r.local, r.title_from, r.url) for r in found)
    assert got == [
        ("f", 1, "77", "Feiner Gouda", 2.49, None, True, "link", "/kanon"),
        ("f", 1, "a1", "Hof Frische Vollmilch 1 l", 1.29, 1.59, True, "catalogue", "/x"),
        ("f", 1, "d4", "Zarter Braten", 4.5, None, False, "catalogue", "/x"),
        ("f", 2, "a1", "Hof Frische Vollmilch 1 l", 1.29, 1.59, True, "catalogue", "/x"),
    ]


def test_products_may_be_an_object(spark):
    found = offers(spark, [("f", flyer(pages=[{"links": [link("A")]}], products={"x": {"productId": "a", "title": "Feine Butter", "price": 2}, "y": 3}))])
    assert [(r.name, r.price, r.local) for r in found] == [("Feine Butter", 2.0, False)]


def test_texts_of_pages(spark):
    card = lambda name, price: f"{name} in der Filiale\nje 500 g, KW 34\n{price} €"
    doc = flyer(
        pages=[{"id": 1, "altText": card("Butter", "1,99")}, {"id": 2, "image": card("Bild", "9,99")}, {"id": 3, "altText": card("Sahne", "0,99"), "badge": "Nur online"}, {"id": 4}, {"id": 5, "alt": "kurz"}],
        texts=[{"pageIndex": 1, "text": card("Käse", "2,99")}, {"pageId": "4", "content": card("Quark", "0,79")}, {"pageId": "fort", "text": card("Nichts", "1,00")}, {"text": "ohne Seite"}, 7],
    )
    got = sorted((r.page, r.kind, r.name, r.price, r.local) for r in offers(spark, [("f", doc)]))
    # Every line near the wording counts as a name, so the pages' ids do.
    want = {1: ("1", "Butter in der Filiale", 1.99), 2: ("2", "Käse in der Filiale", 2.99), 4: ("4", "Quark in der Filiale", 0.79)}
    assert got == [(page, "text", name, price, True) for page, (number, told, price) in want.items() for name in (number, told)]


def test_shop_signal(spark):
    cases = {
        '{"productId": 1}': True,
        '{"productId": "", "product_id": null}': False,
        '{"url": "https://www.lidl.de/p/feine-milch/p1234567"}': True,
        '{"href": "/p/milch-1234567?x=1"}': True,
        '{"href": "https://anders.de/p/milch-1234567"}': False,
        '{"deeplink": "https://anders.de/?flyx_content=p-1234567"}': True,
        '{"url": "https://www.lidl.de/c/angebote"}': False,
        "{}": False,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", flyers.shop_signal(F.parse_json("c").try_cast("map<string,variant>")).alias("s")).collect()
    assert {r.c: r.s for r in rows} == cases


def test_no_flyers(spark):
    assert offers(spark, []) == []
