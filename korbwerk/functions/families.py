"""Families of favourite products, whose members stand in for each other, as column expressions."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from korbwerk import constants as K


def _accented() -> list[tuple[str, str]]:
    """Each of a to z with all Latin letters that are it and marks."""
    found: dict[str, str] = defaultdict(str)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFKD", c.lower())
        if "a" <= base <= "z" and marks and all(map(unicodedata.combining, marks)):
            found[base] += c
    return sorted(found.items())


def plain_name(text: Column) -> Column:
    """A name in lower case with letters a to z and digits alone, without measures. A letter's mark parts words, as any other character does: `bär` is `ba r`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = reduce(lambda t, x: F.regexp_replace(t, f"[{x[1]}]", x[0] + " "), _accented(), F.regexp_replace(low, "®", ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9ß]+", " "), K.FAVOURITE_UNITS, " "), r"\s+", " "))


def exact_key(brand: Column, name: Column) -> Column:
    return F.concat_ws("::", plain_name(brand), plain_name(name))


def family(brand: Column, name: Column) -> Column:
    """The first family whose words stand in brand and name; null for none."""
    text = plain_name(F.concat_ws(" ", F.coalesce(brand, F.lit("")), F.coalesce(name, F.lit(""))))
    return F.transform(F.array(text), lambda t: F.coalesce(*[F.when(t.rlike("|".join(words)), key) for key, words in K.FAVOURITE_FAMILIES.items()]))[0]
