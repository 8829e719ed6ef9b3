"""Registered queries: titles of cards out of their lines, validity of leaflets, and offers in German order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.functions import dates, names
from korbwerk.operators import relational as R
from korbwerk.operators import titles
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views, as_of
from korbwerk.plans.wording import known

NOUNS = ("Butterkekse", "Apfelsaft", "Vollmilch", "Nudelsuppe", "Blattspinat", "Haselnusscreme")
SINGLES = ("Gouda", "Tomaten", "Zwieback", "Rotkohl")

known(
    "f18_usable_title",
    [
        ("Feine {}", "true"), ("Feine Butterkekse", "true"), ("Gouda", "true"), ("Spanien", "false"), ("Frühstück", "false"), ("versch. Sorten", "false"), ("je 500 g", "false"), ("1 kg = 3,98", "false"), ("3,99 €", "false"),
        ("Packung", "false"), ("Abc", "false"), ("Rind in der Schale", "false"), ("Knüller der Woche", "false"), ("12345678 Abcd", "false"), ("", "false"), ("Feine " + "Butterkekse " * 6, "false"), ("oder Gouda", "false"),
    ],
    names.usable_title, "BOOLEAN", "fit",
)


def card_lines(v: Views) -> DataFrame:
    """A line a line item on a card of two orders: titles of one or two words, packages, sorts, origins and unit prices."""
    k = F.col("l_partkey")
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    noun = F.element_at(F.array(*map(F.lit, NOUNS)), (k % 6 + 1).cast("int"))
    lone = F.element_at(F.array(*map(F.lit, SINGLES)), (k % 4 + 1).cast("int"))
    texts = [F.concat(F.lit("Zarte "), noun), lone, F.lit("je 500 g"), F.lit("versch. Sorten"), F.lit("Spanien"), F.lit("1 kg = 3,98"), F.concat(F.lit("Knusper "), noun, F.lit(" Klasse I")), F.concat(F.lit("Italien "), lone, F.lit(" Bestes"))]
    text = F.element_at(F.array(*texts), (F.col("l_suppkey") * 3 % 8 + 1).cast("int"))
    number = F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + k * 100 + F.col("l_suppkey") % 100
    y0 = (F.col("l_orderkey") % 2 * 140 + F.col("l_linenumber") * 20).cast("double")
    high = (10 + k % 4 * 5).cast("double")
    return rows.select(F.floor(F.col("l_orderkey") / 2).alias("card_key"), number.alias("line_no"), text.alias("text"), y0.alias("y0"), (y0 + high).alias("y1"), high.alias("max_height"))


_LINES = f""", w AS (SELECT DISTINCT l_orderkey // 2 AS card, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS no, l_suppkey * 3 % 8 AS kind, (ARRAY{list(NOUNS)})[l_partkey % 6 + 1] AS noun, (ARRAY{list(SINGLES)})[l_partkey % 4 + 1] AS lone,
  (l_orderkey % 2 * 140 + l_linenumber * 20)::DOUBLE AS y0, (10 + l_partkey % 4 * 5)::DOUBLE AS high FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
 raws AS (SELECT *, CASE kind WHEN 0 THEN 'Zarte ' || noun WHEN 1 THEN lone WHEN 2 THEN 'je 500 g' WHEN 3 THEN 'versch. Sorten' WHEN 4 THEN 'Spanien' WHEN 5 THEN '1 kg = 3,98' WHEN 6 THEN 'Knusper ' || noun || ' Klasse I' ELSE 'Italien ' || lone || ' Bestes' END AS raw FROM w),
 li AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY no, raw) - 1 AS i, count(*) OVER (PARTITION BY card) AS n FROM raws),
"""


@query("fs8_dense_titles", _LINES + """ e AS (SELECT card, coalesce(max(i) FILTER (WHERE kind IN (2, 5)), max(n)) AS en FROM li GROUP BY 1),
 v AS (SELECT card, i, en, CASE kind WHEN 0 THEN raw WHEN 1 THEN lone WHEN 6 THEN 'Knusper ' || noun WHEN 7 THEN lone || ' Bestes' END AS t, CASE WHEN kind = 1 THEN 1 ELSE 2 END AS words FROM li JOIN e USING (card)),
 s AS (SELECT *, words * 14 + least(len(t), 50) - (en - i) * 10 - CASE WHEN words = 1 THEN 30 ELSE 0 END AS score FROM v WHERE t IS NOT NULL AND i < en AND i >= en - 9),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY card ORDER BY score DESC, i DESC) = 1),
 a AS (SELECT b.card, b.t, b.i, s.t AS t2, s.i AS i2 FROM b LEFT JOIN s ON s.card = b.card AND b.words = 1 AND s.words = 1 AND abs(s.i - b.i) = 1 AND len(b.t) + len(s.t) + 1 <= 65 QUALIFY row_number() OVER (PARTITION BY b.card ORDER BY s.score DESC NULLS LAST, s.i DESC) = 1),
 f AS (SELECT card, arg_min(CASE kind WHEN 0 THEN raw WHEN 1 THEN lone ELSE raw END, i) AS t FROM li WHERE kind IN (0, 1, 7) GROUP BY 1)
 SELECT e.card AS card_key, coalesce(CASE WHEN t2 IS NULL THEN a.t WHEN a.i < i2 THEN a.t || ' ' || t2 ELSE t2 || ' ' || a.t END, f.t, '') AS title FROM e LEFT JOIN a USING (card) LEFT JOIN f USING (card)""")
def fs8_dense(v: Views) -> DataFrame:
    return titles.dense_titles(card_lines(v))


@query("fs8_placed_titles", _LINES + """ e AS (SELECT card, coalesce(max(i) FILTER (WHERE kind IN (2, 5) AND y0 < 250), max(n)) AS en FROM li GROUP BY 1),
 t AS (SELECT li.*, en, coalesce(x.y0, 250.0) AS below FROM li JOIN e USING (card) LEFT JOIN (SELECT card, i, y0 FROM li) x ON x.card = li.card AND x.i = en),
 s AS (SELECT card, i, raw, high, round(high * 4 - greatest(below - y0 - high, 0) * 0.22::DOUBLE + least(len(raw), 50) * 0.08::DOUBLE, 9) AS score FROM t WHERE kind IN (0, 1, 7) AND i < en AND i >= en - 7),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY card ORDER BY score DESC, i DESC) = 1),
 l AS (SELECT card, i, raw, high FROM li WHERE kind IN (0, 1, 7) AND y0 + high < 250 AND card NOT IN (SELECT card FROM b) QUALIFY row_number() OVER (PARTITION BY card ORDER BY i DESC) = 1),
 a AS (SELECT b.card, b.raw, b.i, s.raw AS t2, s.i AS i2 FROM b LEFT JOIN s ON s.card = b.card AND abs(s.i - b.i) = 1 AND abs(s.high - b.high) <= 7 QUALIFY row_number() OVER (PARTITION BY b.card ORDER BY s.score DESC NULLS LAST, s.i DESC) = 1),
 o AS (SELECT card, CASE WHEN t2 IS NULL OR t2 = raw THEN raw WHEN i < i2 THEN raw || ' ' || t2 ELSE t2 || ' ' || raw END AS t FROM a UNION ALL SELECT card, raw FROM l)
 SELECT e.card AS card_key, coalesce(t, '') AS title FROM e LEFT JOIN o USING (card)""")
def fs8_placed(v: Views) -> DataFrame:
    """Titles above a tag at 250; a line beside an equal one is cleaned to one."""
    lines = card_lines(v)
    return titles.placed_titles(lines, lines.select("card_key", F.lit(250.0).alias("top")).distinct())


@query("fd6_leaflet_validity", """, o AS (SELECT DISTINCT store_id, product_id, valid_from AS a, (valid_from + (product_id % 20)::INT)::DATE AS b FROM offers),
 y AS (SELECT *, try_strptime('1998' || strftime(a, '-%m-%d'), '%Y-%m-%d')::DATE AS sa, try_strptime('1998' || strftime(b, '-%m-%d'), '%Y-%m-%d')::DATE AS sb, product_id % 9 AS kind, date_trunc('week', DATE '1998-01-04')::DATE AS w98, date_trunc('week', make_date(isoyear(a) + 20, 1, 4))::DATE AS w20 FROM o),
 r AS (SELECT *, CASE kind WHEN 0 THEN a WHEN 1 THEN CASE WHEN b - a <= 14 THEN a END WHEN 2 THEN CASE WHEN sb >= sa AND sb - sa <= 14 THEN sa END WHEN 3 THEN CASE WHEN sb >= sa AND sb - sa <= 14 THEN sa END
   WHEN 4 THEN CASE WHEN b - a <= 14 THEN make_date(year(a) + 20, month(a), day(a)) END
   WHEN 5 THEN CASE WHEN isoyear((w20 + (week(a)::INT - 1) * 7)::DATE) = isoyear(a) + 20 THEN (w20 + (week(a)::INT - 1) * 7)::DATE END
   WHEN 6 THEN CASE WHEN isoyear((w98 + (week(a)::INT - 1) * 7)::DATE) = 1998 THEN (w98 + (week(a)::INT - 1) * 7)::DATE END END AS f FROM y),
 p AS (SELECT *, CASE WHEN f IS NULL THEN NULL WHEN kind IN (0, 5, 6) THEN f + 5 WHEN kind = 1 THEN b WHEN kind IN (2, 3) THEN sb ELSE make_date(year(b) + 20, month(b), day(b)) END AS t FROM r)
 SELECT store_id, product_id, a AS valid_from, CASE WHEN f IS NULL AND store_id % 2 = 1 THEN a ELSE f END::DATE AS starts, CASE WHEN f IS NULL AND store_id % 2 = 1 THEN a + 5 ELSE t END::DATE AS ends FROM p""", dates="valid_from starts ends")
def fd6(v: Views) -> DataFrame:
    """What pages with a day, a range or a week say, in nine wordings; odd stores' documents name a first day, which counts where the page says nothing."""
    p, a = F.col("product_id"), F.col("valid_from")
    rows = v.offers.select("store_id", "product_id", "valid_from").distinct().withColumn("b", F.date_add("valid_from", (p % 20).cast("int")))
    full, short = (lambda d: F.date_format(d, "dd.MM.yyyy")), (lambda d: F.date_format(d, "dd.MM."))
    month = lambda d: F.element_at(F.array(*map(F.lit, ("Januar", "Februar", "Maerz", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"))), F.month(d))
    named = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(". "), month(d), F.lit(" "), (F.year(d) + 20).cast("string"))
    week = F.weekofyear("valid_from").cast("string")
    b = F.col("b")
    wordings = [
        F.concat(F.lit("Prospekt Gültig ab "), full(a)), F.concat(full(a), F.lit(" – Sa. "), full(b)), F.concat(F.lit("Mo. "), short(a), F.lit(" - Sa. "), short(b)), F.concat(F.lit("gültig vom "), short(a), F.lit(" — "), short(b)),
        F.concat(named(a), F.lit(" - "), named(b)), F.concat(week, F.lit(". Woche "), (F.extract(F.lit("YEAROFWEEK"), a).cast("int") + 20).cast("string")), F.concat(F.lit("Angebote KW "), week), F.lit("täglich frisch"), F.lit(None).cast("string"),
    ]
    page = F.element_at(F.array(*wordings), (p % 9 + 1).cast("int"))
    document = F.when(F.col("store_id") % 2 == 1, wordings[0])
    said = rows.select("store_id", "product_id", "valid_from", page.alias("page"), document.alias("document"))
    found = R.once_each(said, ["page", "document"], v=dates.page_validity(F.col("page"), F.col("document"), as_of()))
    return found.select("store_id", "product_id", "valid_from", F.col("v.from").alias("starts"), F.col("v.to").alias("ends"))


@query("t7_german_order", """, g AS (SELECT brand, CASE product_id % 3 WHEN 0 THEN replace(replace(product_name, 'a', 'ä'), 'o', 'ö') WHEN 1 THEN upper(product_name) ELSE product_name END AS name, price, product_id, count(DISTINCT store_id) AS markets FROM current_offers JOIN products USING (product_id) GROUP BY ALL)
 SELECT brand, name, price, product_id, markets, row_number() OVER (PARTITION BY brand ORDER BY name COLLATE de, price, product_id) AS place FROM g""")
def t7(v: Views) -> DataFrame:
    """A brand's current offers, once a product and price with the number of markets, by name in German order, then by price."""
    p, n = F.col("product_id"), F.col("product_name")
    name = F.when(p % 3 == 0, F.translate(n, "ao", "äö")).when(p % 3 == 1, F.upper(n)).otherwise(n)
    groups = v.current.join(v.products, "product_id").groupBy("brand", name.alias("name"), "price", "product_id").agg(F.count_distinct("store_id").alias("markets"))
    w = Window.partitionBy("brand").orderBy(F.collate("name", "de"), "price", "product_id")
    return groups.withColumn("place", F.row_number().over(w))
