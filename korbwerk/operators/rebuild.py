"""Strict pages: offers whose name or price can't be right are rejected, and bad pages are replaced by the cards that several readings agree on.

Pages are judged by sums and only those found bad have their cards read; nothing of a page meets in one task but its counts and its rebuilt
cards, which are counted over a window, and nothing of a card but its readings.

Defined cases. Rows with a null page belong to no page: they are kept unjudged, and cards of no page are left out. A null name is rejected; null
prices, packages and unit prices are no evidence against an offer but where a price is expected. Repeated rows count each; a page keeps one rebuilt card a
name and price, that of the smallest id. Empty tables give empty results. Other columns are not carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import names
from korbwerk.functions import price as P
from korbwerk.functions.text import fold
from korbwerk.operators import relational as R

#: A page is bad from this share of unfit names on; readings agree from this share of common words on.
BAD_SHARE, AGREEMENT = 0.12, 0.6
LEAST_REBUILT = 2
#: Neighbours of a price tag lie in its row or column within so much; a card is at most so wide and high.
ROW, COLUMN, WIDEST, HIGHEST = 190.0, 230.0, 500.0, 580.0
#: Tags of a page that are compared within their page's row; those of a page with more meet by bands.
PAGE_TAGS = 128
VALUES = ["price", "quantity", "unit", "unit_price"]


def _words(name: Column) -> Column:
    found = F.regexp_extract_all(fold(F.lower(name)), F.lit("[a-z0-9äöüß]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*K.NOISE_WORDS)))


def _agreed(readings: Column) -> Column:
    """The reading (at, name, words) that most others support; of equals the one nearest to another, then the longest, then the first."""

    def scored(one: Column) -> Column:
        shares = F.transform(
            F.filter(readings, lambda other: other["at"] != one["at"]),
            lambda other: F.coalesce(F.try_divide(F.size(F.array_intersect(one["words"], other["words"])), F.least(F.size(one["words"]), F.size(other["words"]))), F.lit(0.0)),
        )
        return F.struct(F.size(F.filter(shares, lambda s: s >= AGREEMENT)).alias("support"), F.array_max(shares).alias("best"), F.length(one["name"]).alias("long"), (-one["at"]).alias("first"), one["name"].alias("name"))

    best = F.array_max(F.transform(readings, scored))
    return F.when(best["support"] >= 1, best["name"])


def _judged_names(rows: DataFrame, raw: str) -> DataFrame:
    """`rows` with the cleaned name of column `raw` and whether it is fit, null texts being empty; each different text is judged once, as the same few names stand on many pages."""
    text = F.col("raw_text")
    clean, strict = names.trimmed(names.clean_name(text), " -,:;.|/"), F.coalesce(names.strict_name(text), F.lit(False))
    return R.once_each(rows.withColumn("raw_text", F.coalesce(raw, F.lit(""))).drop(raw), ["raw_text"], clean=clean, strict=strict).withColumnRenamed("raw_text", raw)


def _named(cards: DataFrame, *more: Column) -> DataFrame:
    """(page_key, card_id, name) and `more` of the cards that have an agreed name; what different lists of readings agree on is worked out once for each, as the same few stand on many pages."""
    listed = cards.groupBy("page_key", "card_id").agg(F.array_sort(F.collect_set("names")).alias("lists"), *more)
    read = listed.select("lists").distinct().select("lists", F.explode("lists").alias("readings")).select("lists", F.posexplode("readings").alias("at", "raw"))
    fit = _judged_names(read, "raw").where("strict").groupBy("lists", F.col("clean").alias("name")).agg(F.min("at").alias("at"))
    readings = fit.groupBy("lists").agg(F.array_sort(F.collect_list(F.struct("at", "name", _words(F.col("name")).alias("words")))).alias("readings"))
    agreed = readings.select("lists", F.inline(F.array(F.struct(_agreed(F.col("readings")).alias("name"))))).dropna(subset=["name"])
    return listed.join(agreed, "lists").drop("lists")


def consensus_names(cards: DataFrame) -> DataFrame:
    """(page_key, card_id, name) of the cards of which at least two different readings that are fit names agree; `cards` has page_key, card_id and names, an array."""
    return _named(cards).select("page_key", "card_id", "name")


def _expected() -> Column:
    return P.expected_price(F.col("quantity"), F.col("unit"), F.col("unit_price"))


def judged(offers: DataFrame) -> DataFrame:
    """Offers (page_key, offer_id, name, price, quantity, unit, unit_price) of a page with strict, checked and correct."""
    rows = _judged_names(offers.where("page_key IS NOT NULL").select("page_key", "offer_id", "name", *VALUES), "name").drop("clean").withColumn("expected", _expected())
    checked = F.col("strict") & F.col("expected").isNotNull()
    return rows.withColumn("checked", checked).withColumn("correct", checked & F.coalesce(P.close(F.col("price"), F.col("expected")), F.lit(False))).drop("expected")


def rebuilt_cards(cards: DataFrame, *more: str) -> DataFrame:
    """(page_key, card_id, name, price) and the page's columns `more` of the cards (page_key, card_id, names, price, quantity, unit, unit_price) with an agreed name and no unit price against theirs; each name and price of a page once."""
    given = cards.where("page_key IS NOT NULL AND card_id IS NOT NULL AND price IS NOT NULL")
    named = _named(given, F.collect_list(F.struct(*VALUES, *more)).alias("given")).select("page_key", "card_id", "name", F.inline("given")).withColumn("expected", _expected())
    right = named.where(F.col("expected").isNull() | P.close(F.col("price"), F.col("expected")))
    keyed = right.withColumns({"key": F.lower("name"), "cents": F.round("price", 2)})
    return R.top(keyed, ["page_key", "key", "cents"], ["card_id", "price", "name"]).select("page_key", "card_id", "name", "price", *more)


def strict_pages(offers: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers that stand (page_key, offer_id, name, price, rebuilt), and per page checked, correct, rejected and recovered.

    A bad page is replaced if its cards give at least LEAST_REBUILT offers and at least half as many as stand on it.
    """
    rows = judged(offers)
    bad = ~F.col("strict") | (F.col("checked") & ~F.col("correct"))
    pages = rows.groupBy("page_key").agg(F.count("*").alias("n"), F.count_if(~F.col("strict")).alias("unfit"), F.count_if(~bad).alias("good"), F.count_if("checked").alias("checked"), F.count_if("correct").alias("correct"), F.count_if(bad).alias("rejected"))
    doubtful = pages.where((F.col("unfit") >= 1) & (F.col("unfit") / F.col("n") >= BAD_SHARE))
    # What a page needs goes with its cards, so these are read and rebuilt once.
    found = rebuilt_cards(cards.join(doubtful.select("page_key", "good"), "page_key"), "good")
    found = found.withColumn("recovered", F.count("*").over(Window.partitionBy("page_key"))).where(F.col("recovered") >= F.greatest(F.lit(LEAST_REBUILT), F.floor(F.col("good") / 2)))
    enough = found.groupBy("page_key").agg(F.max("recovered").alias("recovered"))
    kept = rows.where(~bad).join(enough, "page_key", "left_anti").select("page_key", "offer_id", "name", "price", F.lit(False).alias("rebuilt"))
    unpaged = offers.where("page_key IS NULL").select("page_key", "offer_id", "name", "price", F.lit(False).alias("rebuilt"))
    new = found.select("page_key", F.col("card_id").alias("offer_id"), "name", "price", F.lit(True).alias("rebuilt"))
    more = F.coalesce("recovered", F.lit(0))
    metrics = pages.join(enough, "page_key", "left").select("page_key", (F.col("checked") + more).alias("checked"), (F.col("correct") + more).alias("correct"), "rejected", more.alias("recovered"))
    return kept.unionByName(new).unionByName(unpaged), metrics


def card_cells(tags: DataFrame, width: float, height: float) -> DataFrame:
    """(page_key, tag_id, left, top, right, bottom): each price tag's card, cut half-way to the neighbours in its row and column.

    Tags are shuffled by page, once. A page of at most PAGE_TAGS tags is an array; of a larger one neighbours meet by bands of rows and of columns, not by all
    pairs. Tags with null coordinates are left out. Tags of one id are no neighbours of each other, but each has its own.
    """
    box = ["x0", "y0", "x1", "y1"]
    t = tags.select("page_key", "tag_id", *[F.col(c).cast("double").alias(c) for c in box]).dropna(subset=["page_key", *box])
    t = t.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}).withColumn("n", F.count("*").over(Window.partitionBy("page_key")))
    small, large = t.where(F.col("n") <= PAGE_TAGS).drop("n"), t.where(F.col("n") > PAGE_TAGS).drop("n")
    own = ["page_key", "tag_id", *box, "cx", "cy"]

    def nearest(along: str, o: Column, low: str, high: str, near: Column) -> tuple[Column, Column]:
        """The middles between a tag and the nearest of its neighbours before and after along one axis."""
        middle = (F.col(along) + o) / 2
        return F.max(F.when(near & (o < F.col(along)), middle)).alias(low), F.min(F.when(near & (o >= F.col(along)), middle)).alias(high)

    def limits(along: str, across: str, reach: float, low: str, high: str) -> DataFrame:
        """`nearest` among those within reach across the axis."""
        band = F.floor(F.col(across) / reach)
        near = large.select("page_key", F.col("tag_id").alias("other_id"), F.col(along).alias("o"), F.col(across).alias("oa"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
        met = large.withColumn("band", band).join(near, ["page_key", "band"]).where((F.col("tag_id") != F.col("other_id")) & (F.abs(F.col("oa") - F.col(across)) <= reach))
        return met.groupBy("page_key", "tag_id", *box).agg(*nearest(along, F.col("o"), low, high, F.lit(True)))

    packed = small.groupBy("page_key").agg(F.collect_list(F.struct(*own[1:])).alias("tags"))
    pairs = packed.select("page_key", "tags", F.posexplode("tags").alias("at", "a")).select("page_key", "at", "a.*", F.explode("tags").alias("o"))
    other = F.col("tag_id") != F.col("o.tag_id")
    row, column = other & (F.abs(F.col("o.cy") - F.col("cy")) <= ROW), other & (F.abs(F.col("o.cx") - F.col("cx")) <= COLUMN)
    near = pairs.groupBy("at", *own).agg(*nearest("cx", F.col("o.cx"), "l", "r", row), *nearest("cy", F.col("o.cy"), "t", "b", column)).drop("at")
    far = large.join(limits("cx", "cy", ROW, "l", "r"), ["page_key", "tag_id", *box], "left").join(limits("cy", "cx", COLUMN, "t", "b"), ["page_key", "tag_id", *box], "left")
    t = near.unionByName(far)
    c = F.col
    w, h = F.lit(float(width)), F.lit(float(height))
    t = t.withColumns({"l": F.greatest(F.lit(0.0), "l"), "r": F.least(w, "r"), "t": F.greatest(F.lit(0.0), "t"), "b": F.least(h, "b")})
    wide, high = c("r") - c("l") > F.least(w, F.lit(WIDEST)), c("b") - c("t") > F.least(h, F.lit(HIGHEST))
    most_w, most_h = F.least(w, F.lit(WIDEST)), F.least(h, F.lit(HIGHEST))
    left = F.when(wide, F.greatest(F.lit(0.0), c("cx") - most_w * 0.58)).otherwise(c("l"))
    right = F.when(wide, F.least(w, c("cx") + most_w * 0.42)).otherwise(c("r"))
    top = F.when(high, F.greatest(F.lit(0.0), c("cy") - most_h * 0.84)).otherwise(c("t"))
    bottom = F.when(high, F.least(h, c("cy") + most_h * 0.16)).otherwise(c("b"))
    top, bottom = F.greatest(F.lit(0.0), F.least(top, c("y0") - 55)), F.least(h, F.greatest(bottom, c("y1") + 30))
    return t.select("page_key", "tag_id", *[x.cast("long").alias(n) for n, x in (("left", left), ("top", top), ("right", right), ("bottom", bottom))])
