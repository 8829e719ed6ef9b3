"""Known answers of the functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from korbwerk.functions import dates, geo, price, promo, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def L(x):
    return F.lit(x)


def test_former_price(spark):
    assert one(spark, price.former_price(L(0.89), L(41.0))) == 1.49


@pytest.mark.parametrize(
    ("wording", "at", "regular", "want"),
    [
        ("3 für 2, je 0,49", 0.49, None, ("free_item", 0.98, 1.47, None, "3 für 2")),
        ("ab 3 Stück 1,66 €", 2.22, None, ("tier_price", 2.22, None, 1.66, "ab 3 Stück · 1,66 €")),
        ("ab 3 Stück 2,66 €", 2.22, None, None),
        ("2 + 1 gratis", 3.0, 3.0, ("free_item", 6.0, 9.0, None, "3 für 2")),
        ("2 + 1 gratis", 3.0, None, None),
        ("3 für 4,99 €", 2.0, 2.0, ("fixed_bundle", 4.99, 6.0, None, "3 für 4,99 €")),
        ("3 für 4,99 €", 2.0, None, ("fixed_bundle", 4.99, None, None, "3 für 4,99 €")),
        ("x SPECIAL_PRICE kind=lidl_plus label=Lidl Plus price=1,50 y SPECIAL_PRICE kind=card label=Karte  neu price=1.20", 2.0, None, ("member_price", 2.0, None, 1.2, "Karte neu · 1,20 €")),
        ("2 für 30", 2.0, 2.0, None),
        ("lecker", 1.0, 1.0, None),
        (None, 1.0, 1.0, None),
    ],
)
def test_promotions(spark, wording, at, regular, want):
    row = spark.range(1).select(L(wording).cast("string").alias("text"), L(at).cast("double").alias("price"), L(regular).cast("double").alias("regular"), L("x").alias("kind"))
    for got in (one(spark, promo.multibuy(L(wording).cast("string"), L(at).cast("double"), L(regular).cast("double"))), promo.with_promotion(row, "text", "price", "regular").first().promotion):
        assert (got and tuple(got[c] for c in ("kind", "bundle_price", "regular_price", "special_price", "label"))) == want


def test_expected_price(spark):
    assert one(spark, price.expected_price(L(0.33), L("l"), L(6.03))) == 1.99
    assert one(spark, price.expected_price(L(500.0), L("g"), L(12.98))) == 6.49
    assert one(spark, price.expected_price(L(1.0), L("kg"), L(900.0))) is None


def test_unit_price(spark):
    assert one(spark, price.unit_price(L(1.99), L(500.0), L("g"))) == 3.98
    assert one(spark, price.unit_price(L(1.99), L(0.0), L("g"))) is None


@pytest.mark.parametrize(("code", "want"), [("4006381333931", "4006381333931"), ("4006381333932", None), ("96385074", "96385074"), ("123", None), ("", None), (None, None)])
def test_gtin(spark, code, want):
    assert one(spark, price.gtin(L(code).cast("string"))) == want


def test_numbers(spark):
    assert one(spark, price.german_number(L("1.234,5"))) == 1234.5
    assert one(spark, price.german_number(L("12.5"))) == 12.5
    assert one(spark, price.german_number(L("x"))) is None


def test_package(spark):
    got = one(spark, price.package(L("je 6 x 0,33-l-Fl., (1 l = 1,51 €)")))
    assert tuple(got) == (6, 0.33, "l")
    assert tuple(one(spark, price.package(L("je 400-g-Becher")))) == (1, 400.0, "g")
    assert tuple(one(spark, price.stated_unit_price(L("(1 kg = 4,73 €)")))) == (4.73, "kg")


def test_validity(spark):
    got = one(spark, dates.validity(L("gültig 10.8. bis 16.8. im Markt"), L(dt.date(2026, 8, 16))))
    assert tuple(got) == (dt.date(2026, 8, 10), dt.date(2026, 8, 16))
    got = one(spark, dates.validity(L("28.12. - 2.1."), L(dt.date(2025, 12, 30))))
    assert tuple(got) == (dt.date(2025, 12, 28), dt.date(2026, 1, 2))
    assert one(spark, dates.validity(L("immer"), L(dt.date(2026, 8, 16)))) is None


@pytest.mark.parametrize(("wording", "want"), [("17.08.2026", dt.date(2026, 8, 17)), ("2026-08-17", dt.date(2026, 8, 17)), ("17.08.26", dt.date(2026, 8, 17)), ("31.02.2026", None), ("morgen", None), (None, None)])
def test_dates(spark, wording, want):
    assert one(spark, dates.parse_date(L(wording).cast("string"))) == want


def test_weeks(spark):
    day = L(dt.date(2026, 8, 19))
    assert tuple(one(spark, dates.offer_week(day))) == (dt.date(2026, 8, 17), dt.date(2026, 8, 22))
    assert one(spark, dates.week_class(L(dt.date(2026, 8, 24)), L(dt.date(2026, 8, 29)), day)) == "next"
    assert one(spark, dates.week_label(day)) == "KW 34/2026"


def test_names(spark):
    assert one(spark, text.master_key(L("Äpfel, Klasse II, versch. Sorten"), L(1000.0), L("g"))) == "apfel|1000g"
    assert one(spark, text.master_key(L("Milch"), L(1.5), L("Liter"))) == "milch|1.5l"
    assert one(spark, text.family_key(L("Teppich 60 x 90 cm blau"))) == "teppich blau"
    assert one(spark, text.variant(L("Teppich 60×90 cm"))) == "60x90 cm"
    assert one(spark, text.retailer(L("Netto Filiale"))) == "Netto Marken-Discount"
    assert one(spark, text.category(L("Bio Vollmilch 1 l"))) == "molkerei-kuehlung"
    assert one(spark, text.category(L("Schraube"))) == "sonstiges"
    assert one(spark, text.online_only(L("Nur im Online-Shop"), L(None).cast("string"))) is True
    assert one(spark, text.suspicious(L("Kassenbon hochladen"))) == [r"\bkassenbon\b", r"\bhochladen\b"]
    assert one(spark, text.visible_text(L("<p>a &amp; b<script>x</script></p><!-- c -->"))) == "a & b"


def test_distance(spark):
    assert one(spark, geo.haversine_km(L(50.0), L(7.0), L(51.0), L(7.0))) == pytest.approx(111.195, abs=0.01)
    box = lambda *x: {k: L(float(v)) for k, v in zip(("x0", "y0", "x1", "y1"), x, strict=True)}
    assert one(spark, geo.rectangle_distance(box(0, 0, 10, 10), box(0, 20, 10, 30))) == pytest.approx(4.5)
    assert one(spark, geo.overlap_share(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(0.5)
