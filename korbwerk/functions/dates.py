"""Offer weeks and validity, as column expressions. `ref` is the date that counts as today."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korbwerk.constants import LEAFLET_WEEKDAY, LONGEST_LEAFLET, MONTHS, VALIDITY

RANGE = r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})?\s*(?:bis|-|–)\s*(?:[A-Za-zÄÖÜäöü]+,?\s*)?(\d{1,2})\.(\d{1,2})\.?(\d{4})?"


def _digits(text: Column) -> Column:
    """A number of one to four digits; null for the empty text, which try_cast would only know by an exception a row."""
    return F.nullif(text, F.lit("")).cast("int")


def parse_date(text: Column) -> Column:
    """dd.MM.yyyy, yyyy-MM-dd or dd.MM.yy."""
    t = F.trim(text)
    day = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    part = lambda p, g: _digits(F.regexp_extract(t, p, g))
    de, iso = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    year = part(de, 3)
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.coalesce(day(year, part(de, 2), part(de, 1)), day(part(iso, 1), part(iso, 2), part(iso, 3)))


def nearest_year(day: Column, month: Column, ref: Column) -> Column:
    """The date with that day and month nearest to `ref`, at most half a year away."""
    at = lambda k: F.try_make_timestamp_ntz(F.year(ref) + k, month, day, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    this = at(0)
    return F.when(F.datediff(this, ref) > 180, at(-1)).when(F.datediff(this, ref) < -180, at(1)).otherwise(this)


def monday(day: Column) -> Column:
    return F.trunc(day, "WEEK")


def offer_week(day: Column) -> Column:
    """Monday to Saturday of a date's week."""
    return F.struct(monday(day).alias("from"), F.date_add(monday(day), 5).alias("to"))


def week_class(valid_from: Column, valid_to: Column, ref: Column) -> Column:
    now, coming = monday(ref), F.date_add(monday(ref), 7)
    return F.when(valid_to < now, "past").when((valid_from <= F.date_add(now, 6)) & (valid_to >= now), "current").when(valid_from <= F.date_add(coming, 6), "next").otherwise("future")


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def week_label(day: Column) -> Column:
    return F.format_string("KW %02d/%d", F.weekofyear(day), F.extract(F.lit("YEAROFWEEK"), day).cast("int"))


def any_date(text: Column, ref: Column) -> Column:
    """A full date, or a day and month in the year that is nearest to `ref`."""
    short = r"^(\d{1,2})\.(\d{1,2})\.?$"
    part = lambda g: _digits(F.regexp_extract(F.trim(text), short, g))
    return F.coalesce(parse_date(text), nearest_year(part(1), part(2), ref))


def _next_year(start: Column, end: Column) -> Column:
    """An end before its start is a year later."""
    return F.when(end < start, F.add_months(end, 12)).otherwise(end)


def iso_monday(year: Column, week: Column) -> Column:
    """The Monday of an ISO week; null beyond 1 to 53 or where the year lacks it."""
    first = F.trunc(F.try_make_timestamp_ntz(year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0.0)).cast("date"), "WEEK")
    day = F.date_add(first, (week - 1) * 7)
    return F.when(week.between(1, 53) & (F.extract(F.lit("YEAROFWEEK"), day) == year), day)


def calendar_week(week: Column, ref: Column) -> Column:
    """The Monday of an ISO week in the year in which it is nearest to `ref`; null beyond 1 to 53 or where the year lacks it."""

    days = [iso_monday(F.year(ref) + k, week) for k in (-1, 0, 1)]
    return F.array_min(F.filter(F.array(*[F.struct(F.abs(F.datediff(d, ref)).alias("off"), d.alias("day")) for d in days]), lambda x: x["day"].isNotNull()))["day"]


def inferred_validity(text: Column, ref: Column) -> Column:
    """struct(from, to, source, confidence): what the first wording that fits says, in order of precedence; null if none does. Years that are left out are inferred."""
    part = lambda p, g: F.regexp_extract(text, "(?iU)" + p, g) if p.count("(\\d") >= g else F.lit("")
    wordings = F.array(*[F.struct(F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), part(p, 1).alias("a"), part(p, 2).alias("b")) for source, confidence, p in VALIDITY])

    def dated(w: Column) -> Column:
        known = F.array(F.struct(any_date(w["a"], ref).alias("a"), any_date(w["b"], ref).alias("b"), calendar_week(F.when(w["a"].rlike(r"^[0-9]{1,2}$"), w["a"]).cast("int"), ref).alias("week")))

        def ends(d: Column) -> Column:
            is_ = lambda source: w["source"] == source
            start = F.when(is_("calendar_week"), d["week"]).when(is_("this_week_until"), monday(d["a"])).otherwise(d["a"])
            later = _next_year(d["a"], d["b"])
            end = F.when(is_("calendar_week") | is_("ab_montag"), F.date_add(start, 5)).when(is_("this_week_until"), d["a"]).when(is_("explicit_range"), d["b"])
            end = end.when(is_("this_week_range"), F.date_sub(later, F.when(F.weekday(later) == 6, 1).otherwise(0))).otherwise(later)
            return F.struct(start.alias("from"), end.alias("to"), w["source"].alias("source"), w["confidence"].alias("confidence"))

        return F.transform(known, ends)[0]

    # Dates are only read of wordings that are there.
    found = F.transform(F.filter(wordings, lambda w: w["a"] != ""), dated)
    return F.get(F.filter(found, lambda v: v["from"].isNotNull() & v["to"].isNotNull()), F.lit(0))


def period(kind: Column, ref: Column) -> Column:
    """Monday to Sunday of the current or the next week."""
    start = F.when(kind == "next", F.date_add(monday(ref), 7)).otherwise(monday(ref))
    return F.struct(start.alias("from"), F.date_add(start, 6).alias("to"))


def week_of_url(url: Column) -> Column:
    """The week number in a leaflet's address."""
    return F.nullif(F.regexp_extract(url, r"(?i)(?:kw|week|woche)[-_/]?(\d{1,2})(?!\d)", 1), F.lit("")).cast("int")


def validity(text: Column, ref: Column) -> Column:
    """struct(from, to) of a range such as `10.8. bis 16.8.` in a text; years that are left out are inferred."""
    part = lambda g: F.regexp_extract(text, RANGE, g).try_cast("int")
    full = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    to = F.when(part(6).isNotNull(), full(part(6), part(5), part(4))).otherwise(nearest_year(part(4), part(5), ref))
    start = F.when(part(3).isNotNull(), full(F.when(part(3) < 100, part(3) + 2000).otherwise(part(3)), part(2), part(1))).otherwise(nearest_year(part(1), part(2), F.coalesce(to, ref)))
    return F.when(start.isNotNull() & (to >= start), F.struct(start.alias("from"), to.alias("to")))


def leaflet_validity(text: Column, ref: Column) -> Column:
    """struct(from, to) that a leaflet's text states, by the first wording that gives a range: a first day, full days, weekdays, days after `gültig`, names of
    months, or a week. Years left out are that of `ref`; ranges that run backwards or over more than 14 days are none. Null if nothing fits."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[–—]", "-")
    names = "|".join([*MONTHS, "Maerz"])
    day = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    spelt = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), i)], F.lit("maerz"), F.lit(3))
    month = lambda name: F.try_element_at(spelt, F.lower(name))

    def parts(p: str, count: int) -> list[Column]:
        return [F.regexp_extract(t, "(?iU)" + p, g) for g in range(1, count + 1)]

    def number(x: Column) -> Column:
        return x.try_cast("int")

    def year(x: Column) -> Column:
        return F.when(number(x) < 100, number(x) + 2000).otherwise(number(x))

    def span(a: Column, b: Column) -> Column:
        return F.when((a <= b) & (F.datediff(b, a) <= LONGEST_LEAFLET), F.struct(a.alias("from"), b.alias("to")))

    def week_from(a: Column) -> Column:
        return F.when(a.isNotNull(), F.struct(a.alias("from"), F.date_add(a, 5).alias("to")))

    here = F.year(ref)
    d, m, y = parts(r"Gültig\s+ab\s+(\d{1,2})[.](\d{1,2})[.](\d{2,4})", 3)
    found = [week_from(day(year(y), number(m), number(d)))]
    d, m, y, d2, m2, y2 = parts(r"(\d{1,2})[.](\d{1,2})[.](\d{2,4})\s*[^\d\n]{0,25}-\s*[^\d\n]{0,25}(\d{1,2})[.](\d{1,2})[.](\d{2,4})", 6)
    found.append(span(day(year(y), number(m), number(d)), day(year(y2), number(m2), number(d2))))
    for p in (
        rf"{LEAFLET_WEEKDAY}(\d{{1,2}})[.]\s*(\d{{1,2}})[.]\s*[^\d\n]{{0,15}}-\s*{LEAFLET_WEEKDAY}(\d{{1,2}})[.]\s*(\d{{1,2}})[.]",
        r"gültig[^\d]{0,20}(\d{1,2})[.](\d{1,2})[.](?:\d{2,4})?\s*[^\d\n]{0,15}-\s*[^\d\n]{0,15}(\d{1,2})[.](\d{1,2})[.]",
    ):
        d, m, d2, m2 = parts(p, 4)
        found.append(span(day(here, number(m), number(d)), day(here, number(m2), number(d2))))
    d, m, y, d2, m2, y2 = parts(rf"(\d{{1,2}})[.]\s*({names})\s*(20\d{{2}})\s*[-]\s*(\d{{1,2}})[.]\s*({names})\s*(20\d{{2}})", 6)
    found.append(span(day(number(y), month(m), number(d)), day(number(y2), month(m2), number(d2))))
    w, y = parts(r"(\d{1,2})[.]\s*Woche\s*(20\d{2})", 2)
    # A week with a year decides even if the year lacks it.
    found.append(F.when(w != "", week_from(iso_monday(number(y), number(w)))).otherwise(week_from(iso_monday(here, number(parts(r"KW\s*(\d{1,2})\b", 1)[0])))))
    return F.coalesce(*found)


def page_validity(page: Column, document: Column, ref: Column) -> Column:
    """The validity of a page's text, else that of its document's."""
    # A fold holds the rules once, and reads the document only where the page says nothing.
    return F.aggregate(F.array(page, document), F.lit(None).cast("struct<from:date,to:date>"), lambda acc, text: F.coalesce(acc, leaflet_validity(text, ref)))
