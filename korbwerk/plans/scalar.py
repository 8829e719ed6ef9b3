"""Registered queries: functions on names, prices, dates, places and markup, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.constants import CATEGORIES, ONLINE_ONLY, OTHER_CATEGORY, RETAILER_NAMES, SUSPICIOUS_NAMES
from korbwerk.functions import dates, geo, price, promo, text
from korbwerk.plans.registry import query
from korbwerk.plans.views import AS_OF, Views, as_of

DAY = f"DATE '{AS_OF}'"
RE = lambda p: p.replace("(?i)", "").replace("'", "''")


@query("fs1_fold", f" SELECT doc_id, sha256(translate(coalesce(text, ''), '{text.ACCENTS[0]}', '{text.ACCENTS[1]}')) AS folded FROM documents")
def fs1(v: Views) -> DataFrame:
    """The SHA-256 of each document's whole text without accents."""
    return v.table("documents").select("doc_id", F.sha2(text.fold(F.coalesce("text", F.lit(""))), 256).alias("folded"))


_NAME = "product_name || CASE product_id % 5 WHEN 0 THEN ' versch. Sorten' WHEN 1 THEN ' Herkunft: Spanien' WHEN 2 THEN ' Klasse II' WHEN 3 THEN ' Äpfel' ELSE ' 30 x 40 cm' END"


def _names(v: Views) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (" versch. Sorten", " Herkunft: Spanien", " Klasse II", " Äpfel", " 30 x 40 cm"))), (F.col("product_id") % 5 + 1).cast("int"))
    return v.products.withColumn("name", F.concat("product_name", tail))


@query("fs2_master_key", rf""", n AS (SELECT product_id, grams, lower({_NAME}) AS name FROM products)
 SELECT product_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(name, 'äöüé', 'aoue'), '\b(?:versch\.?|verschiedene)\s+sorten\b', ' ', 'g'), '\b(?:ursprung|herkunft)\s*:\s*[^,;]+', ' ', 'g'), '\b(?:kl\.?|klasse|handelsklasse)\s*[ivx]+\b', ' ', 'g'), '[^a-z0-9äöüß+]+', ' ', 'g'), '\s+', ' ', 'g')) || '|' || grams || 'g' AS key FROM n""")
def fs2(v: Views) -> DataFrame:
    return _names(v).select("product_id", text.master_key(F.col("name"), F.col("grams").cast("double"), F.lit("g")).alias("key"))


@query("fs12_family_variant", rf""", n AS (SELECT product_id, {_NAME} AS name FROM products)
 SELECT product_id, trim(regexp_replace(regexp_replace(translate(lower(name), 'äöüé', 'aoue'), '\b\d{{2,3}}\s*[x×]\s*\d{{2,3}}(?:\s*[x×]\s*\d{{1,3}})?\s*cm\b', ' ', 'g'), '[^a-z0-9ß]+', ' ', 'g')) AS family, replace(regexp_extract(name, '\b\d{{2,3}}\s*[x×]\s*\d{{2,3}}\s*cm\b'), '×', 'x') AS variant FROM n""")
def fs12(v: Views) -> DataFrame:
    return _names(v).select("product_id", text.family_key(F.col("name")).alias("family"), text.variant(F.col("name")).alias("variant"))


@query("fs13_fs14_slug_key", r" SELECT product_id, regexp_replace(regexp_replace(lower(brand || ' ' || product_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(lower(brand || ' ' || product_name), '[^a-z0-9äöüß]+', ' ', 'g')) AS key, CASE WHEN starts_with(lower(product_name), lower(brand)) THEN product_name ELSE brand || ' ' || product_name END AS shown FROM products")
def fs13(v: Views) -> DataFrame:
    full = F.concat_ws(" ", "brand", "product_name")
    return v.products.select("product_id", text.slug(full).alias("slug"), text.plain_key(full).alias("key"), text.display_name(F.col("brand"), F.col("product_name")).alias("shown"))


_RET = " ".join(f"WHEN contains(n, '{k}') THEN '{x}'" for k, x in RETAILER_NAMES.items())


@query("fs15_retailer", f", n AS (SELECT store_id, lower(retailer || ' Markt ' || store_name) AS n FROM stores) SELECT store_id, CASE {_RET} END AS chain FROM n")
def fs15(v: Views) -> DataFrame:
    return v.stores.select("store_id", text.retailer(F.concat_ws(" ", "retailer", F.lit("Markt"), "store_name")).alias("chain"))


_WORDS = [w[0] for w in CATEGORIES.values()]
_CAT = " ".join("WHEN regexp_matches(n, '{}') THEN '{}'".format("|".join(ws), k) for k, ws in CATEGORIES.items())


@query("fs16_category", f", n AS (SELECT product_id, lower(product_name || ' ' || (ARRAY[{', '.join(repr(w) for w in [*_WORDS, 'schraube'])}])[product_id % {len(_WORDS) + 1} + 1]) AS n FROM products) SELECT product_id, CASE {_CAT} ELSE '{OTHER_CATEGORY}' END AS category FROM n")
def fs16(v: Views) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, [*_WORDS, "schraube"])), (F.col("product_id") % (len(_WORDS) + 1) + 1).cast("int"))
    return v.products.select("product_id", text.category(F.concat_ws(" ", "product_name", word)).alias("category"))


@query("fs17_u9_token_coverage", r", t AS (SELECT turn, conv_id, list_distinct([x for x in string_split(trim(regexp_replace(lower(text), '[^a-z0-9äöüß]+', ' ', 'g')), ' ') if length(x) >= 3]) AS ts FROM conversations) SELECT a.conv_id, a.turn, CASE WHEN len(a.ts) = 0 THEN 0.0 ELSE round(len([x for x in a.ts if list_contains(b.ts, x)]) / len(a.ts), 6) END AS share FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def fs17(v: Views) -> DataFrame:
    t = v.table("conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("ts"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ts").alias("next"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.token_coverage(F.col("ts"), F.col("next")), 6).alias("share"))


_ONLINE = RE("|".join(ONLINE_ONLY))


@query("f7_online_only", f" SELECT store_id, product_id, count(*) FILTER (WHERE regexp_matches(lower(text), '{_ONLINE}')) AS online, count(*) AS n FROM texts GROUP BY 1, 2")
def f7(v: Views) -> DataFrame:
    return v.texts.groupBy("store_id", "product_id").agg(F.count_if(text.online_only(F.col("text"), F.lit(None))).alias("online"), F.count("*").alias("n"))


_SUSPECT = " + ".join(f"regexp_matches(lower(text), '{RE(p)}')::INT" for p in SUSPICIOUS_NAMES)


@query("f24_suspicious_lines", rf", l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents) SELECT doc_id, sum({_SUSPECT} + (length(trim(text)) < 3)::INT + (length(text) > 120)::INT)::BIGINT AS reasons FROM l GROUP BY 1")
def f24(v: Views) -> DataFrame:
    lines = v.table("documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("text"))
    return lines.groupBy("doc_id").agg(F.sum(F.size(text.suspicious(F.col("text")))).alias("reasons"))


@query("f23_food", " SELECT product_id, regexp_matches(product_name, 'ring|bolt|gear') AS hardware FROM products")
def f23(v: Views) -> DataFrame:
    return v.products.select("product_id", F.col("product_name").rlike("ring|bolt|gear").alias("hardware"))


_NUM = "TRY_CAST(replace(replace({0}, '.', ''), ',', '.') AS DOUBLE)"
_HALF = "floor(({0}) * {1} + 0.5) / {1}.0::DOUBLE"


@query("fn16_offer_text", rf""", m AS (SELECT *, regexp_extract(text, 'je (\d{{1,2}}) x (\d+,\d+)-?(kg|g|l|ml|cl)', ['c', 'e', 'u']) AS many, regexp_extract(text, 'je (\d+)-(kg|g|l|ml|cl)\b', ['e', 'u']) AS one, regexp_extract(text, '1 (kg|l) = (\d{{1,4}}(?:,\d{{1,2}})?)', ['u', 'p']) AS up FROM texts)
 SELECT store_id, product_id, valid_from, price, CASE WHEN many.c <> '' THEN TRY_CAST(many.c AS INT) WHEN one.e <> '' THEN 1 END AS "count", CASE WHEN many.c <> '' THEN TRY_CAST(replace(many.e, ',', '.') AS DOUBLE) WHEN one.e <> '' THEN TRY_CAST(one.e AS DOUBLE) END AS "each",
 CASE WHEN many.c <> '' THEN many.u ELSE nullif(one.u, '') END AS unit, TRY_CAST(replace(up.p, ',', '.') AS DOUBLE) AS per_unit, nullif(up.u, '') AS base FROM m""", dates="valid_from")
def fn16(v: Views) -> DataFrame:
    pack, per = price.package(F.col("text")), price.stated_unit_price(F.col("text"))
    return v.texts.withColumns({"p": pack, "u": per}).select("store_id", "product_id", "valid_from", "price", "p.count", "p.each", "p.unit", F.col("u.price").alias("per_unit"), F.col("u.unit").alias("base"))


@query("fn4_unit_price", f" SELECT p_partkey AS product_id, CASE WHEN p_size > 0 THEN {_HALF.format('p_retailprice / (p_size / 1000.0::DOUBLE)', 10000)} END AS per_kg, CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'l' END AS base FROM part")
def fn4(v: Views) -> DataFrame:
    p = v.table("part")
    unit = F.when(F.col("p_size") % 2 == 0, "g").otherwise("ml")
    return p.select(F.col("p_partkey").alias("product_id"), price.unit_price(F.col("p_retailprice"), F.col("p_size").cast("double"), unit).alias("per_kg"), price.base_unit(unit).alias("base"))


@query("fn5_fn7_expected_price", f", e AS (SELECT *, {_HALF.format('grams / 1000.0::DOUBLE * 2.5::DOUBLE + 1e-9', 100)} AS x FROM products) SELECT product_id, CASE WHEN x BETWEEN 0.05 AND 500 THEN x END AS expected, CASE WHEN x BETWEEN 0.05 AND 500 THEN abs(x - 0.05) <= greatest(0.031, least(x, 0.05) * 0.0075) END AS near FROM e")
def fn5(v: Views) -> DataFrame:
    x = price.expected_price(F.col("grams").cast("double"), F.lit("g"), F.lit(2.5))
    return v.products.select("product_id", x.alias("expected"), price.close(x, F.lit(0.05)).alias("near"))


@query("fn6_gtin", r""", d AS (SELECT p_partkey AS product_id, lpad((p_partkey * 7919 + 40000000000)::VARCHAR, 12, '0') || (p_partkey % 10) AS code FROM part), s AS (SELECT product_id, code, list_sum([CAST(code[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END for i in range(1, 13)]) AS t FROM d)
 SELECT product_id, CASE WHEN (10 - t % 10) % 10 = CAST(code[13] AS INT) THEN code END AS gtin FROM s""")
def fn6(v: Views) -> DataFrame:
    p = F.col("p_partkey")
    code = F.concat(F.lpad((p * 7919 + 40000000000).cast("string"), 12, "0"), (p % 10).cast("string"))
    return v.table("part").select(p.alias("product_id"), price.gtin(code).alias("gtin"))


@query("fn9_fn10_former_price", f""", x AS (SELECT *, TRY_CAST(nullif(regexp_extract(text, '-(\\d{{1,2}})%', 1), '') AS DOUBLE) AS pct FROM texts), y AS (SELECT *, price / (1 - pct / 100) AS raw_ FROM x WHERE pct BETWEEN 0.5 AND 90),
 z AS (SELECT *, greatest(floor(raw_ * 10) / 10.0::DOUBLE - 0.01, 0) AS n FROM y), w AS (SELECT *, CASE WHEN abs(n + 0.0 - raw_) <= abs(n + 0.1 - raw_) THEN n + 0.0 ELSE n + 0.1 END AS b FROM z)
 SELECT store_id, product_id, valid_from, price, pct, CASE WHEN abs(b - raw_) <= greatest(0.06, raw_ * 0.035) THEN {_HALF.format("b", 100)} ELSE {_HALF.format("raw_", 100)} END AS former FROM w""", dates="valid_from")
def fn9(v: Views) -> DataFrame:
    found = v.texts.withColumn("pct", price.discount_percent(F.col("text"))).where("pct IS NOT NULL")
    return found.select("store_id", "product_id", "valid_from", "price", "pct", price.former_price(F.col("price"), F.col("pct")).alias("former"))


_EURO = "replace(printf('%.2f', {}), '.', ',') || ' €'"
_UP2 = lambda x: f"({_HALF.format(x, 100)})"


def _free(buy: int, pay: int, piece: str) -> str:
    whole, bundle = _UP2(f"{piece} * {buy}"), _UP2(f"{piece} * {pay}")
    return f"'free_item' AS kind, {buy} AS buy, {pay} AS pay, {bundle} AS bundle_price, {whole} AS regular_price, {_HALF.format(f'{bundle} / {buy}', 10000)} AS unit_price, {_UP2(f'{whole} - {bundle}')} AS saving, {_HALF.format(f'(1 - {bundle} / {whole}) * 100', 10)} AS \"percent\", '{buy} für {pay}' AS label, 0.99::DOUBLE AS confidence, NULL::DOUBLE AS special_price, NULL::INT AS minimum"


def _lower(kind: str, to: str, label: str, sure: float, least: str = "NULL") -> str:
    return f"'{kind}', NULL, NULL, price, NULL, NULL, {_UP2(f'price - {to}')}, NULL, {label} || {_EURO.format(to)}, {sure}, {to}, {least}"


_PROMO = f"""k AS (SELECT store_id, product_id, valid_from, price, {_UP2("price * 0.9::DOUBLE")} AS nine, {_UP2("price % 90 + 5")} AS low FROM offers),
 m AS (SELECT store_id, product_id, valid_from, price, {_free(3, 2, "price")} FROM k WHERE product_id % 9 = 0 AND {_UP2("price * 3")} > {_UP2("price * 2")} UNION ALL
 SELECT store_id, product_id, valid_from, price, {_free(3, 2, "2.5::DOUBLE")} FROM k WHERE product_id % 9 = 1 UNION ALL
 SELECT store_id, product_id, valid_from, price, {_free(4, 3, "price")} FROM k WHERE product_id % 9 = 2 UNION ALL
 SELECT store_id, product_id, valid_from, price, {_lower("tier_price", "low", "'ab 3 Stück · '", 0.99, "3")} FROM k WHERE product_id % 9 = 3 AND low < price UNION ALL
 SELECT store_id, product_id, valid_from, price, 'fixed_bundle', 2, NULL, low, {_UP2("price * 2")}, {_HALF.format("low / 2", 10000)}, CASE WHEN {_UP2("price * 2")} > low THEN {_UP2(f'{_UP2("price * 2")} - low')} END,
  CASE WHEN {_UP2("price * 2")} > low THEN {_HALF.format(f'(1 - low / {_UP2("price * 2")}) * 100', 10)} END, '2 für ' || {_EURO.format("low")}, 0.98, NULL, NULL FROM k WHERE product_id % 9 = 4 UNION ALL
 SELECT store_id, product_id, valid_from, price, {_lower("lidl_plus", "low", "'Lidl Plus · '", 1.0)} FROM k WHERE product_id % 9 = 5 AND low < price UNION ALL
 SELECT store_id, product_id, valid_from, price, {_lower("member_price", "low", "'Karte · '", 1.0)} FROM k WHERE product_id % 9 = 6 AND low < price)"""


def promoted(v: Views) -> DataFrame:
    """Offers with a wording of each kind, the price taken as the regular one."""
    de = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.", ",")
    some = de(price.half_up(F.col("price") % 90 + 5, 2))
    special = lambda kind, label: F.concat(F.lit(f"im Markt SPECIAL_PRICE kind={kind} label={label} price="), some, F.lit(" nur heute"))
    wordings = (
        F.lit("3 für 2 im Markt"), F.lit("2 + 1 gratis, je Stück 2,50 €"), F.lit("4 zahlen nur 3"), F.concat(F.lit("ab 3 Stück je "), some, F.lit(" €")), F.concat(F.lit("2 Stück für "), some, F.lit(" €")),
        special("lidl_plus", "Lidl Plus"), special("card", "Karte"), F.lit("nur online, je 500-g-Packung"), F.lit("30 für 2"),
    )
    return v.offers.select("store_id", "product_id", "valid_from", "price", F.element_at(F.array(*wordings), (F.col("product_id") % 9 + 1).cast("int")).alias("text"))


@query("fn21_promotions", f", {_PROMO} SELECT * FROM m", dates="valid_from")
def fn21(v: Views) -> DataFrame:
    found = promo.with_promotion(promoted(v), "text", "price", "price").where("promotion IS NOT NULL")
    return found.select("store_id", "product_id", "valid_from", "price", "promotion.*")


@query("f26_valid_promotions", f", {_PROMO} SELECT store_id, product_id, count(*) AS offers, count(*) FILTER (WHERE product_id % 9 < 3) AS pieces, count(*) FILTER (WHERE product_id % 9 IN (3, 5, 6)) AS lower_prices FROM m GROUP BY 1, 2")
def f26(v: Views) -> DataFrame:
    """Promotions that hold together, by kind: a null struct is one whose numbers don't."""
    found = promo.with_promotion(promoted(v), "text", "price", "price").where(promo.sure(F.col("promotion")))
    kind = F.col("promotion.kind")
    return found.groupBy("store_id", "product_id").agg(F.count("*").alias("offers"), F.count_if(kind == "free_item").alias("pieces"), F.count_if(F.col("promotion.special_price").isNotNull()).alias("lower_prices"))


@query(
    "f11_admission",
    f""", k AS (SELECT *, {_UP2("price % 90 + 5")} AS low FROM offers)
 SELECT store_id, product_id, valid_from, price, CASE WHEN product_id % 9 = 7 THEN 'online' WHEN price > 5000 OR product_id % 9 = 8 OR (product_id % 9 = 3 AND low >= price) THEN 'quality' WHEN product_id % 13 = 0 THEN 'store' WHEN product_id % 17 = 0 THEN 'date' END AS why FROM k""",
    dates="valid_from",
)
def f11(v: Views) -> DataFrame:
    """Why offers are not taken: sold online, their name, price or unclear wording, a store of another chain, or dates in the wrong order."""
    from korbwerk.operators.importer import assessed

    p, none = F.col("product_id"), F.lit(None)
    rows = promoted(v).join(v.products.select("product_id", "product_name", "grams"), "product_id").withColumnRenamed("text", "source_text")
    rows = rows.withColumns(
        {
            "regular_price": F.col("price"), "quantity": F.col("grams") * 10.0, "unit": F.lit("g"), "unit_price": none.cast("double"), "confidence": F.lit(0.95), "source_url": none.cast("string"), "local_store_offer": none.cast("boolean"),
            "retailer": F.lit("REWE"), "store_retailer": F.when(p % 13 != 0, "REWE"), "valid_to": F.date_add("valid_from", F.when(p % 17 == 0, -1).otherwise(5)),
        }
    )
    return assessed(rows).select("store_id", "product_id", "valid_from", "price", "why")


@query("fd1_parse_dates", r" SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 <> 3 AS parsed FROM orders", dates="day")
def fd1(v: Views) -> DataFrame:
    """Each order's date written in one of three formats and read back; a fourth, wrong one gives null."""
    o = v.table("orders")
    k, d = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    text_ = F.when(k == 0, F.date_format(d, "dd.MM.yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd.MM.yy")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    found = dates.parse_date(text_)
    return o.select("o_orderkey", F.coalesce(found, d).alias("day"), (found == d).isNotNull().alias("parsed"))


@query("fd2_fd5_validity", " SELECT store_id, product_id, valid_from, price, valid_from AS starts, valid_from + 6 AS ends FROM current_offers", dates="valid_from starts ends")
def fd2(v: Views) -> DataFrame:
    """A range without years, as leaflets print it, read back with the year inferred from the offer's start."""
    short = lambda c: F.concat(F.dayofmonth(c), F.lit("."), F.month(c), F.lit("."))
    wording = F.concat(F.lit("Gültig "), short(F.col("valid_from")), F.lit(" bis "), short(F.date_add("valid_from", 6)))
    found = v.current.withColumn("w", dates.validity(wording, F.col("valid_from")))
    return found.select("store_id", "product_id", "valid_from", "price", F.col("w.from").alias("starts"), F.col("w.to").alias("ends"))


@query("fd3_fd8_weeks", f""" SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS monday, date_trunc('week', o_orderdate)::DATE + 5 AS saturday, printf('KW %02d/%d', weekofyear(o_orderdate), isoyear(o_orderdate)) AS label,
 CASE WHEN date_trunc('week', o_orderdate)::DATE + 5 < date_trunc('week', {DAY}) THEN 'past' WHEN date_trunc('week', o_orderdate) = date_trunc('week', {DAY}) THEN 'current' WHEN date_trunc('week', o_orderdate)::DATE = date_trunc('week', {DAY})::DATE + 7 THEN 'next' ELSE 'future' END AS class FROM orders""", dates="monday saturday")
def fd3(v: Views) -> DataFrame:
    d = F.to_date("o_orderdate")
    week = dates.offer_week(d)
    return v.table("orders").select("o_orderkey", week["from"].alias("monday"), week["to"].alias("saturday"), dates.week_label(d).alias("label"), dates.week_class(week["from"], week["to"], as_of()).alias("class"))


@query("fd7_overlaps", f" SELECT store_id, count(*) AS n FROM archives WHERE day <= {DAY} AND {DAY} - 30 <= valid_to GROUP BY 1")
def fd7(v: Views) -> DataFrame:
    return v.archives.where(dates.overlaps(F.col("day"), F.col("valid_to"), F.date_add(as_of(), -30), as_of())).groupBy("store_id").agg(F.count("*").alias("n"))


@query("fg2_rectangles", """, b AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS x, l_suppkey % 700 AS y, l_quantity AS w FROM lineitem)
 SELECT l_orderkey, l_linenumber, w, x, y, round(sqrt(pow(greatest(x - 300, 250 - (x + w), 0), 2) + pow(greatest(y - 400, 350 - (y + 20), 0), 2)) * CASE WHEN greatest(x - 300, 250 - (x + w), 0) = 0 THEN 0.45 ELSE 1 END, 6) AS gap FROM b""")
def fg2(v: Views) -> DataFrame:
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), x.alias("x0"), y.alias("y0"))
    a = {"x0": F.col("x0"), "x1": F.col("x0") + F.col("w"), "y0": F.col("y0"), "y1": F.col("y0") + 20}
    b = {k: F.lit(float(n)) for k, n in (("x0", 250), ("x1", 300), ("y0", 350), ("y1", 400))}
    return rows.select("l_orderkey", "l_linenumber", "w", F.col("x0").cast("long").alias("x"), F.col("y0").cast("long").alias("y"), F.round(geo.rectangle_distance(a, b), 6).alias("gap"))


@query("fh1_fingerprint", " SELECT store_id, product_id, valid_from, price, sha256(concat_ws('|', page::VARCHAR, store_id::VARCHAR, lower(coalesce(NULL, '')), product_id::VARCHAR)) AS print FROM offers", dates="valid_from")
def fh1(v: Views) -> DataFrame:
    parts = [F.col("page"), F.col("store_id"), F.lit(""), F.col("product_id")]
    return v.offers.select("store_id", "product_id", "valid_from", "price", F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256).alias("print"))


@query("s5_page_links", r""" SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS links, array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), ' ') AS targets FROM pages""")
def s5(v: Views) -> DataFrame:
    found = text.links(F.col("html"))
    return v.table("pages").select("page_id", F.size(found).cast("long").alias("links"), F.array_join(found, " ").alias("targets"))


@query("html_visible_text", r""", b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<noscript\b.*?</noscript>', ' ', 'gis'), '<svg\b.*?</svg>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS t FROM pages)
 SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS visible FROM b""")
def html(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.visible_text(F.col("html")).alias("visible"))


@query("fj2_json_scalar", " SELECT event_id, coalesce(json_extract_string(props, '$.price'), json_extract_string(props, '$.k')) AS first_scalar FROM events")
def fj2(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.coalesce(F.get_json_object("props", "$.price"), F.get_json_object("props", "$.k")).alias("first_scalar"))
