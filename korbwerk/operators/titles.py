"""Titles of cards, chosen among their lines by position and wording.

Each different text is judged once. A card's lines, which are those of one card on a page, meet in one row, where the choice is made by built-in expressions.

Defined cases. Lines of no card, and lines without a number, are left out; a null text is an empty line. Lines with equal numbers stand in the order of their
texts, repeated rows count as lines of their own. Null coordinates count as 0. A card without a line that can be a title has an empty one. Empty tables give
empty results; other columns are not carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import names

#: Lines above the package that are looked at, by wording alone and by position; how far above the tag a title is at most, and how much its lines differ in height.
DENSE, PLACED, FURTHEST, EVEN = 9, 7, 260.0, 7.0
WORD = r"[A-Za-zÄÖÜäöüß]{2,}"


def _judged(lines: DataFrame) -> DataFrame:
    """(raw, package, single, whole, part, whole_fits, part_fits) of each different text."""
    once = lines.select(F.coalesce("text", F.lit("")).alias("raw")).distinct()
    raw = F.col("raw")
    package = names.repaired(raw).rlike(names.CASELESS + K.TITLE_QUANTITY)
    once = once.select("raw", package.alias("package"), raw.rlike(names.CASELESS + K.TITLE_SINGLE_PACK).alias("single"), names.title_part(raw).alias("part"), names.trimmed(names.clean_name(raw), " -,:;.").alias("whole"))
    fit = once.select(F.explode(F.array("whole", "part")).alias("value")).distinct().withColumn("fits", names.usable_title(F.col("value")))
    both = once.join(fit.select(F.col("value").alias("whole"), F.col("fits").alias("whole_fits")), "whole")
    return both.join(fit.select(F.col("value").alias("part"), F.col("fits").alias("part_fits")), "part")


def _cards(lines: DataFrame, *columns: str) -> DataFrame:
    """A row a card with its judged lines in order."""
    rows = lines.where("card_key IS NOT NULL AND line_no IS NOT NULL").select("card_key", "line_no", F.coalesce("text", F.lit("")).alias("raw"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    rows = rows.join(_judged(rows.withColumnRenamed("raw", "text")), "raw")
    line = F.struct("line_no", "raw", "package", "single", "whole", "part", "whole_fits", "part_fits", *columns)
    return rows.groupBy("card_key").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _last(lines: Column, has: Callable[[Column], Column]) -> Column:
    """The number of the last line that `has` it, else the number of lines."""
    return F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(has(x), i))), F.size(lines))


def _numbered(lines: Column, keep: Callable[[Column, Column], Column], score: Callable[[Column, Column], Column], text: Callable[[Column], Column], *more: str) -> Column:
    """The lines kept, as (score, at, text), best first; of equals the later line."""
    rows = F.transform(lines, lambda x, i: F.when(keep(x, i), F.struct(score(x, i).cast("double").alias("score"), i.alias("at"), text(x).alias("text"), *[x[c].alias(c) for c in more])))
    return F.sort_array(F.filter(rows, lambda r: r.isNotNull()), asc=False)


def _in_order(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a["text"]).when(a["at"] < b["at"], F.concat_ws(" ", a["text"], b["text"])).otherwise(F.concat_ws(" ", b["text"], a["text"]))


def dense_titles(lines: DataFrame) -> DataFrame:
    """(card_key, title) of cards whose lines (card_key, line_no, text) have no positions.

    The last line that names a package ends the title's lines. Of the nine before it the one with the most words and letters nearest to it is the title; a
    single word, or one that opens a quotation, takes along a single word beside it. Without any the card's first line that can be a title is.
    """
    words = lambda t: F.regexp_count(t, F.lit(WORD))
    cards = _cards(lines).withColumn("end", _last(F.col("lines"), lambda x: x["package"] | x["single"]))
    end = F.col("end")
    value = lambda x: F.regexp_replace(x["part"], names.CASELESS + K.TITLE_HOUSE_BRAND, "")
    score = lambda x, i: words(value(x)) * 14 + F.least(F.length(value(x)), F.lit(50)) - (end - i) * 10 - F.when(words(value(x)) == 1, 30).otherwise(0)
    cards = cards.withColumn("found", _numbered(F.col("lines"), lambda x, i: (i < end) & (i >= end - DENSE) & x["part_fits"], score, value))

    def joined(best: Column) -> Column:
        alone = (words(best["text"]) == 1) | best["text"].rlike("^\\s*[„\"']")
        beside = F.filter("found", lambda c: alone & (F.abs(c["at"] - best["at"]) == 1) & (words(c["text"]) == 1) & (F.length(best["text"]) + F.length(c["text"]) + 1 <= K.LONGEST_TITLE))
        return _in_order(best, F.get(beside, F.lit(0)))

    first = F.get(F.filter("lines", lambda x: x["whole_fits"]), F.lit(0))["whole"]
    best = F.get("found", F.lit(0))
    return cards.select("card_key", F.coalesce(F.when(best.isNotNull(), joined(best)), first, F.lit("")).alias("title"))


def placed_titles(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """(card_key, title) of cards whose lines (card_key, line_no, text, y0, y1, max_height) stand above a price tag; `anchors` has card_key and top.

    Of the seven lines before the last package above the tag, the largest and nearest that can be a title is chosen, with the best one right beside it that
    is of its height. Without any, the lowest that can be one within 260 above the tag is. Repeated anchors of a card count once, by the smallest `top`.
    """
    tops = anchors.where("card_key IS NOT NULL AND top IS NOT NULL").groupBy("card_key").agg(F.min("top").alias("top"))
    cards = _cards(lines, "y0", "y1", "max_height").join(tops, "card_key")
    top, rows = F.col("top").cast("double"), F.col("lines")
    cards = cards.withColumn("end", _last(rows, lambda x: x["package"] & (x["y0"] < top)))
    end = F.col("end")
    below = F.coalesce(F.get(rows, end)["y0"], top)
    score = lambda x, i: x["max_height"] * 4.0 - F.greatest(below - x["y1"], F.lit(0.0)) * 0.22 + F.least(F.length(F.btrim(x["raw"])), F.lit(50)) * 0.08
    text = lambda x: F.btrim(x["raw"])
    near = _numbered(rows, lambda x, i: (i < end) & (i >= end - PLACED) & x["whole_fits"], score, text, "max_height")
    lowest = _numbered(rows, lambda x, i: (x["y1"] < top) & (top - x["y1"] <= FURTHEST) & x["whole_fits"], lambda x, i: i, text, "max_height")
    cards = cards.withColumn("near", near).withColumn("best", F.coalesce(F.get("near", F.lit(0)), F.get(lowest, F.lit(0))))
    best = F.col("best")
    beside = F.filter("near", lambda c: (F.abs(c["at"] - best["at"]) == 1) & (F.abs(c["max_height"] - best["max_height"]) <= EVEN))
    chosen = cards.select("card_key", F.coalesce(F.when(best.isNotNull(), _in_order(best, F.get(beside, F.lit(0)))), F.lit("")).alias("raw"))
    named = chosen.select("raw").distinct()
    whole = F.regexp_replace(names.clean_name(F.col("raw")), names.CASELESS + r"\s+(?:oder|und|mit|aus|von|für)$", "")
    named = named.select("raw", names.trimmed(whole, " -,:;.").alias("title"))
    return chosen.join(named, "raw").select("card_key", F.when(names.usable_title(F.col("title")), F.col("title")).otherwise("").alias("title"))
