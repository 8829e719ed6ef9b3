"""Offers out of the text of retailers' pages: lines become rows, and each retailer's card is a set of windows over them.

All parsers take a table (key, text) and return one row an offer: key, pos (of the line that gives it), name, price,
regular_price, app_price, quantity, unit, unit_price, unit_price_unit, valid_from, valid_to, source_text, confidence.
The lines of one text meet in one task, as a page is read from top to bottom; texts are spread. Of offers with equal
name, price and package the first counts. Null and empty texts give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import dates, names
from korbwerk.functions import price as P
from korbwerk.functions.text import online_only
from korbwerk.operators.extract import lines

CASELESS = names.CASELESS
OFFER = "pos name price regular_price app_price quantity unit unit_price unit_price_unit valid_from valid_to source_text confidence".split()
#: Lines that mark an offer, headings of pages, and wording that says an offer is sold in the store.
MARKERS = ("aktion", "knaller")
HEADINGS = ("aktion", "knaller", "angebote im markt", "top-angebote in deinem markt", "unsere angebots-highlights", "die aktuellen angebote findest du direkt im markt.", "zu allen angeboten", "zu den angeboten", "angebots-highlights")
NO_NAME_BEGINNINGS = ("versch.", "je ", "image", "rewe bonus", "gültig ", "diese woche")
SECTION, SECTION_ENDS = r"filial[\s-]*angebote", ("aktuelle prospekte", "filialen in der nähe", "stellenangebote für die filiale")
SHOP_LINES = ("filiale", "filiale & shop")
IN_STORE = ("in der filiale", "in unseren filialen", "filialpreis", "nur in der filiale", "im markt")
WEEK = r"Wochenangebote\s+Mo\.,?\s*(\d{1,2}\.\d{1,2}\.?)\s*[–-]\s*Sa\.,?\s*(\d{1,2}\.\d{1,2}\.?)"
WEEK_STOPS = ("alle wochenangebote", "angebote ab ")
APP_WORDS = r"\b(?:app|netto\+|coupon|vorteilspreis|digitaler\s+coupon)\b"
TRAILING_PRICE = r"\b\d{1,3}[.,]\d{2}\s*(?:\*|€)?\s*\([^)]*(?:kg|l)[^)]*\)\s*$"
PAIR = r"(?:statt|UVP)\s+(\d{1,3}[.,]\d{2})\s+(\d{1,3}[.,]\d{2})"
#: Confidence of each parser, and with no validity.
CONFIDENCE = {"rewe": 0.97, "edeka": 0.97, "edeka_flat": 0.93, "netto": 0.95, "netto_flat": 0.92, "aldi": 0.96, "aldi_undated": 0.74, "lidl": 0.86, "lidl_undated": 0.76}


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, CASELESS + pattern, group), F.lit(""))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(CASELESS + pattern)


def _any_start(low: Column, starts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(x)) for x in starts])


class _Page:
    """The lines of all texts, with windows over them."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.key, self.rows = key, lines(docs, key, text)
        self.order = Window.partitionBy(key).orderBy("pos")

    def over(self, first: int, last: int):
        return self.order.rowsBetween(first, last)

    def last(self, value: Column, first: int, last: int) -> Column:
        return F.last(value, ignorenulls=True).over(self.over(first, last))

    def first(self, value: Column, first: int, last: int) -> Column:
        return F.first(value, ignorenulls=True).over(self.over(first, last))

    def around(self, first: int, last: int, *columns: str) -> Column:
        return F.collect_list(F.struct("pos", *columns)).over(self.over(first, last))


def _joined(rows: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.filter(rows, keep), lambda x: x["line"]), " ")


def _offers(found: DataFrame, key: str) -> DataFrame:
    """The columns of an offer, nulls where a parser has none, each offer once."""
    own = set(found.columns)
    texts = {"name", "unit", "unit_price_unit", "valid_from", "valid_to", "source_text"}
    columns = [F.col(c) if c in own else F.lit(None).alias(c) for c in OFFER]
    typed = [c.cast("int" if n == "pos" else "date" if n.startswith("valid") else "string" if n in texts else "double").alias(n) for n, c in zip(OFFER, columns, strict=True)]
    same = Window.partitionBy(key, F.lower("name"), "price", "app_price", "quantity", "unit").orderBy("pos")
    return found.where("name <> '' AND price IS NOT NULL").select(key, *typed).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def _dated(found: DataFrame, docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """With the validity that the whole text states."""
    stated = docs.select(key, F.inline_outer(F.array(dates.inferred_validity(F.col(text), ref))).alias("valid_from", "valid_to", "_source", "_sure"))
    return found.drop("valid_from", "valid_to").join(stated.drop("_source", "_sure"), key)


def _measured(found: DataFrame, block: Column, sized: Column | None = None) -> DataFrame:
    """With package and unit price read out of the block."""
    found = found.withColumn("source_text", block).withColumn("_s", P.size(F.col("source_text") if sized is None else sized)).withColumn("_u", P.unit_price_of(F.col("source_text")))
    return found.withColumns({"quantity": F.col("_s.quantity"), "unit": F.col("_s.unit"), "unit_price": F.col("_u.price"), "unit_price_unit": F.col("_u.unit")}).drop("_s", "_u")


def rewe(docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """A marker line, a price within three lines below it, a package within four above it, and a name within six above that."""
    page = _Page(docs, key, text)
    line, low = F.col("line"), F.lower("line")
    fits = ~low.isin(*HEADINGS) & ~_has(line, K.EURO_PRICE) & ~_has(line, K.SIZE) & ~_any_start(low, NO_NAME_BEGINNINGS) & F.length(line).between(3, 180) & names.name_issue(line).isNull()
    rows = page.rows.withColumns({"price0": F.get(P.prices_without_units(line), F.lit(0)), "sized": _has(line, K.SIZE), "candidate": F.when(fits, names.clean_name(line))})
    rows = rows.withColumn("above", page.last(F.col("candidate"), -6, -1))
    rows = rows.withColumn("pack", page.last(F.when(F.col("sized"), F.struct("pos", "line", "above")), -4, -1)).withColumn("price", page.first(F.col("price0"), 1, 3)).withColumn("near", page.around(-5, 3, "line"))
    found = rows.where(low.isin(*MARKERS)).where("price IS NOT NULL AND pack.above IS NOT NULL")
    found = _measured(found.withColumn("name", F.col("pack.above")), _joined(F.col("near"), lambda x: x["pos"] >= F.col("pack.pos") - 1), F.col("pack.line"))
    return _offers(_dated(found.withColumn("confidence", F.lit(CONFIDENCE["rewe"])), docs, key, text, ref), key)


def edeka(docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """Headings `Angebot: name` with a fixed price within sixteen lines, and at times the app's; texts without any are searched as one line."""
    page = _Page(docs, key, text)
    fixed, app = r"Festpreis von\s+(\d+[.,]\d+)\s*€", r"App[\s-]*Preis von\s+(\d+[.,]\d+)\s*€"
    title = F.regexp_replace(_group(F.col("line"), r"^(?:#+\s*)?Angebot:\s*(.+)$", 1), CASELESS + r"\s+(?:App[-\s]*Preis|Festpreis|Gültig\s+ab|Tag:)\b.*$", "")
    rows = page.rows.withColumns({"name": names.clean_name(names.trimmed(title, " -–:")), "near": page.around(0, 15, "line")}).where(title.isNotNull())
    good = names.name_issue(F.col("name")).isNull() & ~F.lower("name").isin("angebot", "angebote der woche")
    found = _measured(rows.where(good), _joined(F.col("near"), lambda x: F.lit(True)))
    found = found.withColumns({"price": _number(_group(F.col("source_text"), fixed, 1)), "app_price": _number(_group(F.col("source_text"), app, 1)), "confidence": F.lit(CONFIDENCE["edeka"])}).where("price IS NOT NULL")
    found = found.select(key, *[c for c in OFFER if c in found.columns])

    rest = docs.join(found.select(key).distinct(), key, "left_anti").select(key, names.squeeze(F.col(text)).alias("flat"))
    card = CASELESS + r"Angebot\s*:?\s*([A-ZÄÖÜ0-9][^€]{2,100}?)\s+(?:App[-\s]*Preis.*?(\d+[.,]\d+)\s*€.*?)?Festpreis\s+von\s+(\d+[.,]\d+)\s*€(?=(.{0,350}))"
    hits = [F.regexp_extract_all("flat", F.lit(card), F.lit(g)).alias(n) for g, n in ((0, "card"), (4, "rest"))]
    flat = rest.select(key, F.posexplode(F.arrays_zip(*hits)).alias("pos", "c")).select(key, "pos", "c.card", "c.rest")
    flat = flat.withColumns({"name": names.clean_name(names.trimmed(F.regexp_extract("card", card, 1), " -–:")), "app_price": _number(F.nullif(F.regexp_extract("card", card, 2), F.lit(""))), "price": _number(F.regexp_extract("card", card, 3)), "confidence": F.lit(CONFIDENCE["edeka_flat"])})
    flat = _measured(flat.where(names.name_issue(F.col("name")).isNull()), F.concat("card", "rest"))
    return _offers(_dated(found.unionByName(flat.select(*found.columns)), docs, key, text, ref), key)


def netto(docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """Lines with a package within the section of store offers; prices up to the next such line, `statt` with the former one, and at times the app's lower one."""
    page = _Page(docs, key, text)
    line, low = F.col("line"), F.lower("line")
    ends = low.rlike("|".join(SECTION_ENDS))
    sections = page.rows.groupBy(key).agg(F.min(F.when(_has(line, SECTION), F.col("pos"))).alias("start"))
    rows = page.rows.join(sections, key).withColumn("inside", F.col("start").isNull() | (F.col("pos") > F.col("start")))
    after = F.col("inside") & ends & (F.col("pos") > F.coalesce(F.col("start") + 1, F.lit(0)))
    rows = rows.withColumn("over", F.coalesce(F.max(after.cast("int")).over(page.over(Window.unboundedPreceding, 0)), F.lit(0)) == 1).where("inside AND NOT over")
    only_size = _has(line, r"^\d+(?:[.,]\d+)?\s*(?:kg|g|l|ml|stück|stk\.?|becher|dose|flasche|pckg\.?|btl\.?)$") | (F.length(line) < 4)
    plain = F.when(F.length(line).between(3, 180), line)
    rows = rows.withColumn("sized", P.size(line)["quantity"].isNotNull())
    rows = rows.withColumn("name", names.clean_name(F.when(only_size, page.last(plain, -3, -1)).otherwise(line))).withColumn("own", F.lower(names.clean_name(line)))
    rows = rows.withColumns({"next": page.around(1, 11, "line", "sized", "own"), "near": page.around(-1, 11, "line")})
    shop = lambda x: F.lower(x["line"]).isin(*SHOP_LINES)
    other = lambda x: x["sized"] & (x["pos"] >= F.col("pos") + 2) & (x["own"] != F.lower("name"))
    stop = F.get(F.transform(F.filter(F.col("next"), lambda x: shop(x) | other(x)), lambda x: F.when(shop(x), x["pos"]).otherwise(F.greatest(F.col("pos") + 2, x["pos"] - 1))), F.lit(0))
    found = rows.where(F.col("sized") & ~names.is_noise_line(F.col("name")) & names.name_issue(F.col("name")).isNull())
    found = found.withColumn("stop", F.coalesce(stop, F.col("pos") + 12))
    found = _measured(found, _joined(F.col("near"), lambda x: x["pos"] < F.col("stop")), line)
    return _offers(_dated(_netto_prices(found).withColumn("confidence", F.lit(CONFIDENCE["netto"])), docs, key, text, ref), key)


def _netto_prices(found: DataFrame) -> DataFrame:
    block = F.col("source_text")
    promo = F.coalesce(_number(_group(block, PAIR, 2)), F.array_min(P.prices_without_units(block)))
    found = found.withColumns({"price": promo, "regular_price": _number(_group(block, PAIR, 1))})
    rest = F.when(_has(block, PAIR), F.regexp_replace(block, CASELESS + f"^.*?{PAIR}", "")).otherwise(block)
    lower = F.array_min(F.filter(P.prices_without_units(rest), lambda v: v < F.col("price")))
    return found.withColumn("app_price", F.when(_has(block, APP_WORDS) | _has(block, TRAILING_PRICE), lower))


def aldi(docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """Names above a package, with the lowest price up to a stop line; the last week header above gives the validity."""
    page = _Page(docs, key, text)
    line, low = F.col("line"), F.lower("line")
    week = F.when(_has(line, WEEK), F.struct(dates.any_date(F.regexp_extract(line, CASELESS + WEEK, 1), ref).alias("from"), dates.any_date(F.regexp_extract(line, CASELESS + WEEK, 2), ref).alias("to")))
    rows = page.rows.withColumns({"week": week, "sized": P.size(line)["quantity"].isNotNull() & ~_has(line, WEEK)})
    rows = rows.withColumn("valid", page.last(F.col("week"), Window.unboundedPreceding, 0)).withColumn("before", page.last(F.when(F.col("sized") | F.col("week").isNotNull(), F.col("pos")), Window.unboundedPreceding, -1))
    rows = rows.withColumn("part", ~names.is_noise_line(line) & ~_has(line, K.EURO_PRICE) & F.col("week").isNull() & ~_any_start(low, WEEK_STOPS))
    rows = rows.withColumns({"near": page.around(-4, 8, "line", "part"), "next": page.around(1, 8, "line", "week")})
    found = rows.where("sized")
    stop = F.get(F.transform(F.filter("next", lambda x: _any_start(F.lower(x["line"]), WEEK_STOPS) | (x["week"].isNotNull() & (x["pos"] > F.col("pos") + 1))), lambda x: x["pos"]), F.lit(0))
    begin = F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("pos") - 4)
    above = F.filter("near", lambda x: (x["pos"] >= begin) & (x["pos"] < F.col("pos")) & x["part"])
    found = found.withColumns({"stop": F.coalesce(stop, F.col("pos") + 9), "begin": begin, "parts": F.transform(above, lambda x: x["line"])})
    # Without a line above that can be a name, the package's own line is one.
    name = F.when(F.size("parts") > 0, F.array_join(F.slice("parts", F.greatest(F.size("parts") - 1, F.lit(1)), F.lit(2)), " ")).otherwise(line)
    found = _measured(found.withColumn("name", F.left(name, F.lit(180))), _joined(F.col("near"), lambda x: (x["pos"] >= F.col("begin")) & (x["pos"] < F.col("stop"))), line)
    vals = P.prices_without_units(F.col("source_text"))
    struck = _number(_group(F.col("source_text"), r"(?:statt|UVP|~+)\s*(\d{1,3}[.,]\d{2})", 1))
    found = found.withColumn("price", F.array_min(vals)).withColumn("regular_price", F.coalesce(F.when(struck > F.array_min(vals), struck), F.array_max(F.filter(vals, lambda v: v > F.col("price")))))
    found = found.withColumns({"valid_from": F.col("valid.from"), "valid_to": F.col("valid.to"), "confidence": F.when(F.col("valid").isNotNull(), CONFIDENCE["aldi"]).otherwise(CONFIDENCE["aldi_undated"])})
    return _offers(found.where(~names.is_noise_line(F.col("name"))), key)


def lidl(docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """Lines without a price or package, around which wording says that the offer is sold in the store; the last price of that block."""
    page = _Page(docs, key, text)
    rows = page.rows.withColumn("near", page.around(-3, 5, "line"))
    found = _measured(rows, _joined(F.col("near"), lambda x: F.lit(True)))
    block, line = F.col("source_text"), F.col("line")
    vals = P.prices_without_units(block)
    told = F.lower(block).rlike("|".join(IN_STORE)) & ~online_only(block, F.lit(None)) & _has(block, K.SIZE) & ~_has(line, K.EURO_PRICE) & ~_has(line, K.SIZE)
    found = found.where(told).withColumn("vals", vals).where(F.size("vals") > 0).withColumn("price", F.try_element_at("vals", F.lit(-1)))
    before = F.array_max(F.slice("vals", F.lit(1), F.size("vals") - 1))
    found = found.withColumns({"name": F.left(line, F.lit(180)), "regular_price": F.when(before > F.col("price"), before)})
    found = _dated(found, docs, key, text, ref)
    return _offers(found.withColumn("confidence", F.when(F.col("valid_from").isNotNull(), CONFIDENCE["lidl"]).otherwise(CONFIDENCE["lidl_undated"])), key)


PARSERS: dict[str, Callable[[DataFrame, str, str, Column], DataFrame]] = {"REWE": rewe, "EDEKA": edeka, "Netto Marken-Discount": netto, "ALDI SÜD": aldi, "Lidl": lidl}


def collect(docs: DataFrame, key: str, text: str, retailer: str, ref: Column) -> DataFrame:
    """The offers of all texts, each read by its retailer's parser, and unit prices worked out where none is stated."""
    found = [parse(docs.where(F.col(retailer) == name).select(key, text), key, text, ref).withColumn("retailer", F.lit(name)) for name, parse in PARSERS.items()]
    offers = reduce(DataFrame.unionByName, found)
    asked = F.coalesce("app_price", "price")
    own = F.when(F.lower("unit").isin("g", "kg", "ml", "l", "stück", "stk", "stk."), P.unit_price(asked, F.col("quantity"), F.col("unit")))
    return offers.withColumns({"unit_price": F.coalesce("unit_price", own), "unit_price_unit": F.coalesce("unit_price_unit", P.canonical_unit(F.col("unit")))})
