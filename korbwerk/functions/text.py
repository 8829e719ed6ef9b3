"""Names, keys, categories and markup, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from korbwerk.constants import CATEGORIES, MASTER_KEY_STEPS, ONLINE_ONLY, OTHER_CATEGORY, RETAILER_NAMES, SUSPICIOUS_NAMES

ACCENTS = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    """Letters without their accents; ß stays."""
    return F.translate(text, *ACCENTS)


def plain_key(text: Column) -> Column:
    """Lower case, letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9äöüß]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(F.lower(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def amount_label(quantity: Column) -> Column:
    """A quantity without needless zeros."""
    whole = quantity == F.floor(quantity)
    return F.when(whole, quantity.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.3f", quantity), r"\.?0+$", ""))


def master_key(name: Column, quantity: Column, unit: Column) -> Column:
    """The key under which offers of one product meet."""
    from korbwerk.functions.names import clean_name

    key = squeeze(reduce(lambda t, s: F.regexp_replace(t, *s), MASTER_KEY_STEPS, fold(F.lower(clean_name(name)))))
    unit = F.replace(F.replace(F.lower(unit), F.lit("liter"), F.lit("l")), F.lit("stück"), F.lit("st"))
    return F.substring(F.when(quantity.isNotNull() & (unit != ""), F.concat(key, F.lit("|"), amount_label(quantity), unit)).otherwise(key), 1, 320)


def family_key(name: Column) -> Column:
    """Groups variants of a product that differ in size."""
    steps = ((r"\b\d{2,3}\s*[x×]\s*\d{2,3}(?:\s*[x×]\s*\d{1,3})?\s*cm\b", " "), (r"\bgr(?:oesse|osse|oße)\s*[a-z0-9/-]+", " "), (r"[^a-z0-9ß]+", " "))
    return F.substring(squeeze(reduce(lambda t, s: F.regexp_replace(t, *s), steps, fold(F.lower(F.coalesce(name, F.lit("")))))), 1, 220)


def variant(name: Column) -> Column:
    return F.replace(F.regexp_extract(name, r"(?i)\b\d{2,3}\s*[x×]\s*\d{2,3}(?:\s*[x×]\s*\d{1,3})?\s*cm\b", 0), F.lit("×"), F.lit("x"))


def retailer(name: Column) -> Column:
    """The chain a shop's name belongs to; null for others."""
    low = F.lower(F.trim(name))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in RETAILER_NAMES.items()])


def category(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike("|".join(words)), name) for name, words in CATEGORIES.items()], F.lit(OTHER_CATEGORY))


def online_only(text: Column, url: Column) -> Column:
    """Whether the wording says that the offer isn't sold in the store."""
    return F.lower(F.concat_ws(" ", text, url)).rlike("|".join(ONLINE_ONLY))


def suspicious(name: Column) -> Column:
    """Reasons to doubt a product's name."""
    low = F.lower(name)
    found = [F.when(low.rlike(p), p) for p in SUSPICIOUS_NAMES] + [F.when(F.length(F.trim(name)) < 3, "short"), F.when(F.length(name) > 120, "long")]
    return F.array_compact(F.array(*found))


def display_name(brand: Column, name: Column) -> Column:
    doubled = F.startswith(F.lower(name), F.lower(brand))
    return F.when(brand.isNull() | (brand == "") | doubled, name).otherwise(F.concat_ws(" ", brand, name))


def tokens(text: Column, least: int = 3) -> Column:
    return F.filter(F.array_distinct(F.split(plain_key(text), " ")), lambda t: F.length(t) >= least)


def token_coverage(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags; the five named entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return squeeze(bare)


def links(html: Column) -> Column:
    """Targets of a page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
