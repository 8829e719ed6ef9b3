"""Registered queries: what functions make of wordings, each held against known answers.

A query puts each product's name into one of a list of wordings and returns what the function reads out of it; the SQL
gives the answers that are known for the list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import dates, names, price
from korbwerk.operators import relational as R
from korbwerk.plans.registry import query
from korbwerk.plans.views import AS_OF, Views, as_of


def _text(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def known(name: str, cases: Sequence[tuple[str, object]], read: Callable[[Column], Column], kind: str = "VARCHAR", out: str = "found") -> None:
    """Registers a query on wordings, `{}` in which stands for the product's name, with what is read out of each; `kind` is the answers' SQL type."""
    n = len(cases)

    @query(name, f" SELECT product_id, replace((ARRAY[{', '.join(_text(a) for _, a in cases)}])[product_id % {n} + 1], '{{}}', product_name)::{kind} AS {out} FROM products")
    def run(v: Views) -> DataFrame:
        wording = F.replace(F.element_at(F.array(*[F.lit(w) for w, _ in cases]), (F.col("product_id") % n + 1).cast("int")), F.lit("{}"), F.col("product_name"))
        return R.once_each(v.products.select("product_id", wording.alias("wording")), ["wording"], **{out: read(F.col("wording"))}).select("product_id", out)


known(
    "fs3_clean_name",
    [
        ("{}", "{}"), ("  {} |", "{}"), ("{} Gültig ab 17.08.2026", "{}"), ("{} 20 Extra °P auf alles", "{}"), ("{} Mit PAYBACK sparen", "{}"), ("{} 1,99 €", "{}"), ("{} App", "{}"), ("{} {}", "{}"),
        ("Aktuelle Prospekte Filiale {}", "{}"), ("Zu den Angeboten {}", "{}"), ("Spanien - {}", "{}"), ("Ramont Weichkäse {}", "Géramont Weichkäse {}"), ("Frankreich / Luxemburg: {}", "{}"), ("{} - ", "{}"),
    ],
    names.clean_name,
)

_ISSUES = [why for _, why in K.NAME_ISSUES]
known(
    "f13_name_issue",
    [
        ("{}", None), ("x", K.NAME_MISSING), ("", K.NAME_MISSING), ("Knaller", K.NAME_IS_HEADING), ("Versch. Sorten", K.NAME_IS_HEADING), ("12,5 % vol", _ISSUES[0]), ("11 - 12 % Vol. {}", _ISSUES[1]), ("45 % Fett {}", _ISSUES[2]),
        ("aus {}", _ISSUES[3]), ("reich an {}", _ISSUES[4]), ("Gebrüht, {}", _ISSUES[5]), ("Schnittkäse, mind. 45 % Fett i.Tr.", _ISSUES[5]), ("Klasse II", _ISSUES[6]), ("Feine Würzung, vom Schwein", _ISSUES[7]), ("2er-Set", _ISSUES[8]),
        ("je 500 g", _ISSUES[9]), (".{}", _ISSUES[10]), ("{} " + "sehr lang " * 12 + "ja", K.NAME_TOO_LONG), ("https://x.de/{}", K.NAME_IS_URL), ("1,5 kg Äpfel", None),
    ],
    names.name_issue,
)

known("fs4_display_name", [("{}", "Hof {}"), ("Hof {}", "Hof {}"), ("Bio Hof {}", "Bio Hof {}"), ("hof", "hof")], lambda w: names.display_name(F.lit(" Hof "), w))
known(
    "fs5_offer_name",
    [("{} Spanien / Italien, Kl. I", "{}"), ("{} Ursprung: siehe Etikett", "{}"), ("{} Sorte und Kocheigenschaft: fest", "{}"), ("{} 100 % Baumwolle blau", "{}"), ("{} mit", "{}"), ("{} und", "{}"), ("{} mit Öl", "{} mit Öl")],
    names.offer_name,
)
known("fs6_without_origin", [("Ursprung Spanien: {}", "{}"), ("chile - {}", "{}"), ("Rheinland-Pfalz: {}", "{}"), ("Achtung: {}", "Achtung: {}"), ("{}", "{}")], names.without_origin)
known(
    "fs7_title",
    [
        ("Aktion\n{}\nje 500-g-Packung\n1,99", "{}"), ("{}\nversch. Sorten", "{}"), ("-20 %\nSpanien: {}\n(1 kg = 3,98)", "{}"), ("oder {}\naus Holz", "{}"), ("Gültig ab Montag\nEdel-\n{}\nKlasse I", "Edel{}"), ("je 500 g", ""),
    ],
    names.title_of,
)
known("fs9_name_quality", [("Bio Milch frisch", "89"), ("Milch", "12"), ("MILCH!", "0"), ("VOLLMILCH!", "-41"), ("Ab & Zu", "54"), ("", "0")], names.name_quality, "DOUBLE", "points")
known("fs10_repaired", [("Ikg {}", "1 kg {}"), ("I kg = 2,00 {}", "1 kg = 2,00 {}"), ("500 mi {}", "500 ml {}"), ("I  l {}", "1 l {}"), ("{}", "{}")], names.repaired)
known("f14_strict_name", [("Bio {} Bananen", "true"), ("Rasso statt", "false"), ("Kaffee {} Pr", "false"), ("Straße 35", "false"), ("Gouda jung 99", "false"), ("a|b Käse", "false"), ("Pak Choi", "true"), ("Aktion", "false")], names.strict_name, "BOOLEAN", "fit")
known("f15_plausible_word", [("{}", "true"), ("ab 3,99", "false"), ("je 5", "false"), ("Aktion", "false"), ("1,99 UVP", "false"), ("12 für", "false"), ("nur online {}", "false"), ("...", "false")], names.plausible_word, "BOOLEAN", "fit")
known("f16_bad_price_context", [("Montag 1,99", "true"), ("zzgl. Pfand 0,25", "true"), ("Aktion 1,99 zzgl. Pfand", "false"), ("20% sparen", "true"), ("Aktion: 20% sparen", "false"), ("5 € Bonus", "true"), ("{} 1,99", "false")], names.bad_price_context, "BOOLEAN", "bad")
known("f17_noise_line", [("Filiale", "true"), ("UVP 3,99", "true"), ("Gültig ab morgen", "true"), ("", "true"), ("{}", "false"), ("Aktionsware {}", "false")], names.is_noise_line, "BOOLEAN", "noise")
known("fs16_collected_category", [("Butterkeks {}", "Kekse & Gebäck"), ("Maggi Fix", "Kochen & Würzen"), ("Espresso", "Kaffee"), ("Gouda", "Käse"), ("Veltins", "Bier"), ("Rotwein", "Wein & Sekt"), ("Schraube", "Sonstiges")], names.collected_category)
known("f8_explicit_online_only", [('{"onlineOnly": true}', "true"), ('{"badge":"Nur online"}', "true"), ("Shoppe auf lidl.de {}", "true"), ("online only", "true"), ("online {}", "false"), ('{"webOnly": false}', "false")], lambda w: w.rlike("(?iU)" + "|".join(f"(?:{p})" for p in K.EXPLICIT_ONLINE_ONLY)), "BOOLEAN", "online")

known("fn1_scanned_price", [("1099", "10.99"), ("079", "0.79"), ("12,49", "12.49"), ("99999", None), ("12", None), ("3.99*", "3.99")], price.scanned_price, "DOUBLE", "price")
known("fn1_network_price", [("12,99 €", "12.99"), ("1299", "12.99"), ("3.5", "3.5"), ("gratis", None), ("500", "500")], price.network_price, "DOUBLE", "price")
known("fn11_prices", [("2,99 (1 kg = 5,98)", "2.99"), ("statt 3,49 2,79", "3.49|2.79"), ("1,99 €/kg 0,99", "0.99"), ("12345,67 0,5", ""), ("(0,99 €/l) 1,29 1,09", "1.29|1.09")], lambda w: F.array_join(F.transform(price.prices_without_units(w), lambda x: F.format_string("%.2f", x)), "|"))
known("fn12_current_price", [("statt 2,99 1,99*", "1.99"), ("UVP 3,99 2,49", "2.49"), ("Pfand 0,25 0,89", "0.89"), ("kg-Preis 9,98 4,99", "4.99"), ("{} 1,29 zzgl. 0,15 € Pfand", "1.29"), ("nichts", None)], lambda w: price.current_price(w, F.lit("Lidl")), "DOUBLE", "price")
known("fn13_regular_price", [("statt 2,99 1,99", "2.99"), ("UVP 1,49 1,99", None), ("1,99 2,49", "2.49"), ("1,99 1,49", None), ("-20 % 1,99 (1 kg = 9,90) 3,19", "3.19")], lambda w: price.regular_price(w, F.lit(1.99)), "DOUBLE", "price")
known("fn14_size", [("6 x 0,33 l (1 l = 1,51)", "1.98 l"), ("500-g-Packung", "500 g"), ("2,5 kg", "2.5 kg"), ("je Becher", ""), ("(1 kg = 3,98) 250 g", "250 g"), ("3 Stück", "3 stück")], lambda w: F.concat_ws(" ", F.regexp_replace(F.round(price.size(w)["quantity"], 6).cast("string"), r"\.0$", ""), F.nullif(price.size(w)["unit"], F.lit(""))))
known("fn15_unit_price", [("1 kg = 3,98", "3.98 kg"), ("100 g = 0,79", "0.79 kg"), ("1 l = € 1,5", "1.5 l"), ("100 ml = 2", "2.0 l"), ("kg 3", "")], lambda w: F.concat_ws(" ", price.unit_price_of(w)["price"].cast("string"), price.unit_price_of(w)["unit"]))
known("fn3_normalised_unit_price", [("100 g", "7.9 kg"), ("100ml", "7.9 l"), ("kg", "0.79 kg"), ("", "0.79 Stück"), ("st", "0.79 Stück")], lambda w: F.concat_ws(" ", price.normalised_unit_price(F.lit(0.79), w, F.lit("Stk."))["price"].cast("string"), price.normalised_unit_price(F.lit(0.79), w, F.lit("Stk."))["unit"]))
known("fn18_embedded_price", [("{}\n1,99\nx", "1.99"), ("kg-Preis\n3,98\n{}\n1,99 *", "1.99"), ("{} 2,49* x", "2.49"), ("{}", None)], price.embedded_price, "DOUBLE", "price")
known("fn19_price_triple", [("statt 2,99 1,99*", "1.99/2.99/"), ("2,99 Lidl Plus 1,99*", "2.99//1.99"), ("1,99*", "1.99//"), ("1,99", None), ("3,99 2,99 1,99*", "1.99//")], lambda w: F.when(price.price_triple(w).isNotNull(), F.concat(*[F.coalesce(price.price_triple(w)[c].cast("string"), F.lit("")) if c != "/" else F.lit("/") for c in ("price", "/", "regular", "/", "app")])))


@query("fn17_best_pack", " SELECT product_id, CASE product_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS quantity, CASE product_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 9.0 ELSE 2.0 END::DOUBLE AS unit_price FROM products")
def fn17(v: Views) -> DataFrame:
    """Of several packages and unit prices the pair that comes to the price."""
    k = F.col("product_id") % 3
    packs = F.when(k == 0, F.array(F.lit(0.5), F.lit(0.25))).when(k == 1, F.array(F.lit(0.5), F.lit(0.75))).otherwise(F.array(F.lit(1.0)))
    ups = F.when(k == 0, F.array(F.lit(4.0), F.lit(8.0))).when(k == 1, F.array(F.lit(6.0), F.lit(9.0))).otherwise(F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0)))
    cost = F.when(k == 0, 2.0).when(k == 1, 6.7).otherwise(2.1)
    return v.products.select("product_id", price.best_pack(packs, ups, cost).alias("b")).select("product_id", "b.*")


@query("fn20_effective_price", " SELECT store_id, product_id, valid_from, price, CASE WHEN product_id % 3 = 0 THEN ((floor(price * 100 + 0.5)::BIGINT * 9 + 5) // 10) / 100.0::DOUBLE ELSE price END AS effective FROM current_offers", dates="valid_from")
def fn20(v: Views) -> DataFrame:
    app = F.when(F.col("product_id") % 3 == 0, F.floor((F.floor(F.col("price") * 100 + 0.5) * 9 + 5) / 10) / 100.0)
    return v.current.select("store_id", "product_id", "valid_from", "price", price.effective_price(F.col("price"), app).alias("effective"))


known(
    "fd5_inferred_validity",
    [
        ("Gültig diese Woche bis Samstag, 20.06.98", "1998-06-15..1998-06-20 this_week_until"), ("Diese Woche 15.6. bis 21.6.", "1998-06-15..1998-06-20 this_week_range"), ("Wochenangebote Mo., 15.6. – Sa., 20.6.", "1998-06-15..1998-06-20 week_offers_range"),
        ("gültig von Montag, 15.06.1998 - Samstag, 20.06.1998", None), ("gültig vom 15.06.2015 bis zum 20.06.2015", "2015-06-15..2015-06-20 explicit_range"), ("{} 15.06.2015 - 21.06.2015", "2015-06-15..2015-06-21 explicit_range"),
        ("ab Montag, 15.06.2015", "2015-06-15..2015-06-20 ab_montag"), ("{} vom 15.6. bis 20.6. im Markt", "1998-06-15..1998-06-20 short_bis_range"), ("{} 28.12. - 2.1.", "1997-12-28..1998-01-02 short_range"), ("Angebote KW 25", "1998-06-15..1998-06-20 calendar_week"), ("{}", None),
    ],
    lambda w: F.transform(F.array(dates.inferred_validity(w, as_of())), lambda v: F.concat(v["from"].cast("string"), F.lit(".."), v["to"].cast("string"), F.lit(" "), v["source"]))[0],
)


@query("fd4_fd10_periods", f" SELECT product_id, (date_trunc('week', DATE '{AS_OF}')::DATE + CASE WHEN product_id % 2 = 0 THEN 7 ELSE 0 END)::VARCHAR AS starts, (date_trunc('week', DATE '{AS_OF}')::DATE + CASE WHEN product_id % 2 = 0 THEN 13 ELSE 6 END)::VARCHAR AS ends, CASE WHEN product_id % 2 = 0 THEN 'next' ELSE 'current' END AS class FROM products")
def fd10(v: Views) -> DataFrame:
    p = dates.period(F.when(F.col("product_id") % 2 == 0, "next").otherwise("current"), as_of())
    found = v.products.select("product_id", p.alias("p"))
    return found.select("product_id", F.col("p.from").cast("string").alias("starts"), F.col("p.to").cast("string").alias("ends"), dates.week_class(F.col("p.from"), F.col("p.to"), as_of()).alias("class"))


known("fd8_week_of_url", [("https://x.de/prospekt-kw33/{}", "33"), ("https://x.de/week/7", "7"), ("https://x.de/kw-333", None), ("{}", None)], dates.week_of_url, "INT", "week")


known(
    "f12_offer_acceptance",
    [
        ("Bio {}", "true 1.0"), ("Tiefgefroren", "false 0.0"), ("45 % Fett i. Tr.", "false 0.0"), ("Eis", "true 0.94"), ("Ast", "false 0.0"), ("XXL", "true 0.94"), ("mit {}", "false 0.0"), ("Natur mild", "false 0.0"),
    ],
    lambda w: F.transform(F.array(names.offer_quality(w, F.lit(1.99), F.lit(500.0), F.lit("g"), F.lit(None).cast("double"), F.lit(0.95))), lambda q: F.concat_ws(" ", q["accepted"].cast("string"), q["score"].cast("string")))[0],
)
