"""Prices, quantities, unit prices and barcodes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korbwerk import constants as K


def half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def german_number(text: Column) -> Column:
    """1.234,5 or 1234.5 as a number; null for anything else."""
    return F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text).try_cast("double")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def base_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("g", "kg", "100g"), "kg").when(u.isin("ml", "l", "cl", "100ml"), "l").otherwise("st")


def in_base(quantity: Column, unit: Column) -> Column:
    """A quantity in kilograms, litres or pieces."""
    u = F.lower(unit)
    return F.when(u.isin("g", "ml"), quantity / 1000).when(u == "cl", quantity / 100).otherwise(quantity)


def unit_price(price: Column, quantity: Column, unit: Column) -> Column:
    """Price of a base unit, to four digits; null without a positive quantity."""
    return F.when((quantity > 0) & (price > 0), half_up(price / in_base(quantity, unit), 4))


def expected_price(quantity: Column, unit: Column, per_unit: Column) -> Column:
    """What a package should cost by its unit price; null beyond 0.05 to 500."""
    x = half_up(in_base(quantity, unit) * per_unit + 1e-9, 2)
    return F.when(x.between(K.LEAST_PRICE, K.MOST_PACKAGE_PRICE), x)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(K.CLOSE_OFF), F.least(a, b) * K.CLOSE_SHARE)


def package(text: Column) -> Column:
    """(count, each, unit) of `je 6 x 0,33 l` or `je 400 g`; nulls where there is none."""
    many = r"(?i)\bje\s+(\d{1,2})\s*[x×]\s*(\d+(?:[.,]\d+)?)\s*[- ]?\s*(kg|g|l|ml|cl)\b"
    one = r"(?i)\bje\s+(\d+(?:[.,]\d+)?)\s*[- ]?\s*(kg|g|l|ml|cl)\b"

    def read(hit: Column) -> Column:
        count = _found(hit["many"], many).cast("int")
        return F.struct(
            F.when(count.isNotNull(), count).when(hit["one"].isNotNull(), 1).alias("count"),
            german_number(F.coalesce(_found(hit["many"], many, 2), _found(hit["one"], one))).alias("each"),
            F.lower(F.coalesce(_found(hit["many"], many, 3), _found(hit["one"], one, 2))).alias("unit"),
        )

    # A text is searched once for each pattern; the parts are read from what was found.
    return F.transform(F.array(F.struct(_found(text, many, 0).alias("many"), _found(text, one, 0).alias("one"))), read)[0]


def stated_unit_price(text: Column) -> Column:
    """(price, unit) of `1 kg = 4,73`."""
    pattern = r"(?i)\b1\s*(kg|l)\s*[=:]\s*(\d{1,4}(?:[.,]\d{1,2})?)"
    return F.struct(german_number(_found(text, pattern, 2)).alias("price"), F.lower(_found(text, pattern)).alias("unit"))


def discount_percent(text: Column) -> Column:
    """A reduction such as -25 % between 0.5 and 90."""
    found = [german_number(_found(text, "(?iu)" + p)) for p in K.PROMOTION_PATTERNS["percent"]]
    return F.coalesce(*[F.when(x.between(K.LEAST_PERCENT, K.MOST_PERCENT), half_up(x, 1)) for x in found])


def former_price(price: Column, percent: Column) -> Column:
    """The price before a reduction: the nearest one that ends in 9 cents, if it is near enough, else the computed one."""
    raw = price / (1 - percent / 100)
    ninth = F.greatest(F.floor(raw * 10) / 10.0 - 0.01, F.lit(0.0))
    choices = F.array(*[F.struct(F.abs(ninth + k / 10 - raw).alias("off"), half_up(ninth + k / 10, 2).alias("at")) for k in (0, 1)])
    best = F.array_min(choices)
    return F.when(best["off"] <= F.greatest(F.lit(K.NINTH_OFF), raw * K.NINTH_SHARE), best["at"]).otherwise(half_up(raw, 2))


def gtin(text: Column) -> Column:
    """The digits of a barcode if its length and check digit are right."""
    digits = F.regexp_replace(text, r"\D", "")
    body = F.split(F.reverse(F.substr(digits, F.lit(1), F.length(digits) - 1)), "")
    total = F.aggregate(F.transform(body, lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).isin(8, 12, 13, 14) & ((10 - total % 10) % 10 == F.substr(digits, F.length(digits)).try_cast("int")), digits)


def _numbers(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(group)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def _first(text: Column, pattern: str) -> Column:
    return F.get(_numbers(text, pattern), F.lit(0))


def prices_without_units(text: Column) -> Column:
    """All prices of a text, in order, but those of a kilogram or litre."""
    bare = text
    for part in K.UNIT_PRICE_PARTS:
        bare = F.regexp_replace(bare, "(?iU)" + part, " ")
    return _numbers(bare, K.ANY_PRICE)


def size(text: Column) -> Column:
    """(quantity, unit) of the first package in a text; of several in one pack all together."""
    bare = F.coalesce(text, F.lit(""))
    for part in (K.UNIT_PRICE_PARTS[1], K.UNIT_PRICE_PARTS[0], K.UNIT_PRICE_PARTS[2]):
        bare = F.regexp_replace(bare, "(?iU)" + part, " ")

    def read(t: Column) -> Column:
        many, one = (F.nullif(F.regexp_extract(t, "(?iU)" + p, 0), F.lit("")) for p in (K.MULTI_SIZE, K.SIZE))
        unit = lambda hit: F.lower(F.regexp_extract(hit, r"(?iU)([^\W\d]+\.?)$", 1))
        amount = lambda hit, i: F.get(_numbers(hit, r"(\d+(?:[.,]\d+)?)"), F.lit(i))
        # Each pattern is searched once, the second only where the first finds nothing.
        single = F.transform(F.array(one), lambda hit: F.struct(amount(hit, 0).alias("quantity"), unit(hit).alias("unit")))[0]
        return F.transform(F.array(many), lambda hit: F.when(hit.isNotNull(), F.struct((amount(hit, 0) * amount(hit, 1)).alias("quantity"), unit(hit).alias("unit"))).otherwise(single))[0]

    return F.transform(F.array(bare), read)[0]


def unit_price_of(text: Column) -> Column:
    """(price, unit) of the first unit price in a text, as it is written; 100 g and 100 ml count as their base unit."""
    hit = F.regexp_extract(text, "(?iU)" + K.UNIT_PRICE, 0)
    unit = F.regexp_replace(F.lower(F.regexp_extract(text, "(?iU)" + K.UNIT_PRICE, 1)), r"\s|\d", "")
    return F.struct(_first(hit, r"=\s*(?:€\s*)?(\d{1,3}(?:[.,]\d{1,2})?)").alias("price"), F.when(unit == "g", "kg").when(unit == "ml", "l").otherwise(F.nullif(unit, F.lit(""))).alias("unit"))


def canonical_unit(unit: Column) -> Column:
    u = F.replace(F.replace(F.lower(F.btrim(unit)), F.lit("stk."), F.lit("stück")), F.lit("stk"), F.lit("stück"))
    return F.when(u.isin("g", "kg"), "kg").when(u.isin("ml", "l"), "l").when(u.isin("stück", "st"), "Stück").otherwise(F.nullif(u, F.lit("")))


def normalised_unit_price(value: Column, stated: Column, unit: Column) -> Column:
    """(price, unit): a price for 100 g or 100 ml as one for a kilogram or litre."""
    s = F.regexp_replace(F.lower(F.coalesce(stated, F.lit(""))), " ", "")
    price = F.when(s.isin("100g", "100ml"), half_up(value * 10, 4)).otherwise(value)
    named = F.when(s.isin("100g", "kg", "1kg"), "kg").when(s.isin("100ml", "l", "1l"), "l").when(s.isin("stück", "st"), "Stück")
    return F.struct(price.alias("price"), F.when(value.isNotNull(), F.coalesce(named, canonical_unit(unit))).otherwise(canonical_unit(unit)).alias("unit"))


def _layout(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[  ]", " ")


def _layout_prices(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_layout(text), r"(?iU)\([^)]*(?:/|=|kg|l)[^)]*\)", " "), r"[–-]\s*\d+\s*%", " ")
    return F.filter(_numbers(bare, f"({K.LAYOUT_PATTERNS['price']})"), lambda v: v.between(0.01, K.MOST_PRICE))


def current_price(text: Column, retailer: Column) -> Column:
    """The price that is asked now: one with a star, else the first that is no deposit and doesn't stand behind the wording of another price."""
    bare = F.regexp_replace(_layout(text), "(?iU)" + K.LAYOUT_PATTERNS["deposit"], " ")

    def read(t: Column) -> Column:
        star = _first(t, K.LAYOUT_PATTERNS["star_price"])
        own = (retailer == "REWE") & t.rlike(r"(?iU)\b(?:Aktion|Knaller)\b")
        # A wording up to 18 characters before a price rules it out.
        kept = F.regexp_replace(t, "(?iU)(?:" + "|".join(K.NO_CURRENT_PRICE_AFTER) + r")(?:(?!\d{1,3}[.,]\d{2}).){0,13}(?<!\d)\d{1,3}[.,]\d{2}(?!\d)", " ")
        first = F.get(F.filter(_numbers(kept, f"({K.LAYOUT_PATTERNS['price']})"), lambda v: v.between(0.01, K.MOST_PRICE)), F.lit(0))
        return F.coalesce(star, F.when(own, F.get(_layout_prices(t), F.lit(0))).otherwise(first))

    return F.transform(F.array(bare), read)[0]


def regular_price(text: Column, current: Column) -> Column:
    """The price before: the one named so, if it is higher, else the first later price that is higher than the current one."""
    named = _first(_layout(text), K.LAYOUT_PATTERNS["regular"])
    later = F.get(F.filter(_layout_prices(text), lambda v, i: (i > 0) & (v > current)), F.lit(0))
    return F.when(named.isNotNull() & (current.isNull() | (named > current)), named).otherwise(later)


def price_triple(text: Column) -> Column:
    """(price, regular, app) of a block whose offer prices have stars; null without one."""
    stars, every = _numbers(text, r"(?<![\d.,])(\d{1,3}[.,]\d{2})\s*\*"), _numbers(text, r"(?<![\d.,])(\d{1,3}[.,]\d{2})(?!\d)")

    def read(x: Column) -> Column:
        chosen = F.try_element_at(x["stars"], F.lit(-1))
        above = F.filter(x["every"], lambda v: v > chosen)
        plus = text.rlike(r"(?i)lidl\s+plus") & (F.size(above) > 0)
        before = F.when((F.size(above) > 0) & text.rlike(r"(?iU)\buvp\b|\bstatt\b|-\d+%"), F.get(above, F.lit(0)))
        found = F.when(plus, F.struct(F.try_element_at(above, F.lit(-1)).alias("price"), F.lit(None).cast("double").alias("regular"), chosen.alias("app"))).otherwise(F.struct(chosen.alias("price"), before.alias("regular"), F.lit(None).cast("double").alias("app")))
        return F.when(chosen.isNotNull(), found)

    return F.transform(F.array(F.struct(stars.alias("stars"), every.alias("every"))), read)[0]


def embedded_price(text: Column) -> Column:
    """A price that is a line of its own, not below a kilogram's or litre's; else one with a star."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")

    def read(ls: Column) -> Column:
        own = F.filter(ls, lambda x, i: x.rlike(r"^\d{1,3}[.,]\d{2}\s*\*?$") & ~F.coalesce(F.lower(F.get(ls, i - 1)).rlike("kg-preis|l-preis|/ kg|/ l"), F.lit(False)))
        return _first(F.get(own, F.lit(0)), r"(\d{1,3}[.,]\d{2})")

    return F.coalesce(F.transform(F.array(lines), read)[0], _first(text, K.LAYOUT_PATTERNS["star_price"]))


def scanned_price(raw: Column) -> Column:
    """A price read by character recognition: 10,99 or 1099; null beyond 0.05 to 500."""
    direct = _first(raw, r"(?<!\d)(\d{1,3}[.,]\d{2})(?!\d)")
    digits = F.regexp_replace(raw, r"\D", "")
    value = F.coalesce(direct, F.when(F.length(digits).between(3, 5), digits.try_cast("double") / 100))
    return F.when(value.between(K.LEAST_PRICE, K.MOST_PACKAGE_PRICE), value)


def network_price(value: Column) -> Column:
    """A price in a JSON field, in euros or, above 500, in cents."""
    number = _first(F.regexp_replace(value, "[€ ]", ""), r"(\d{1,5}(?:[.,]\d{1,2})?)")
    return F.when(number > 500, half_up(number / 100, 2)).otherwise(number)


def effective_price(price: Column, app: Column, unit: Column | None = None) -> Column:
    """What an offer comes to: the app's price if there is one, else its own, else the unit price."""
    return F.coalesce(app, price, *([] if unit is None else [unit]))


def best_pack(quantities: Column, unit_prices: Column, price: Column) -> Column:
    """(quantity, unit_price): the pair, of equal places or of all if the lists differ in length, whose product is nearest to the price. Quantities and prices are of one base unit."""
    paired = F.arrays_zip(quantities.alias("q"), unit_prices.alias("u"))
    turned = F.arrays_zip(quantities.alias("q"), F.reverse(unit_prices).alias("u"))
    every = F.flatten(F.transform(quantities, lambda q: F.transform(unit_prices, lambda u: F.struct(q.alias("q"), u.alias("u")))))
    off = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.abs(x["q"] * x["u"] - price))
    same = F.size(quantities) == F.size(unit_prices)
    chosen = F.when(same & (off(paired) <= off(turned)), paired).when(same, turned).otherwise(every)
    best = F.array_min(F.transform(chosen, lambda x, i: F.struct(F.abs(x["q"] * x["u"] - price).alias("off"), i.alias("i"), x["q"].alias("quantity"), x["u"].alias("unit_price"))))
    return F.when(best.isNotNull(), F.struct(best["quantity"].alias("quantity"), best["unit_price"].alias("unit_price")))
