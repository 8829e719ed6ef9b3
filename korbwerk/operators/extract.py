"""Offers out of leaflet text, page structure and JSON trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import price as P

PRICE = r"(?:^|[^\d,.])(\d{1,3}[,.]\d{2})\s*€"
UNIT_PRICE = r"(?i)\(?\b1\s*(?:kg|l)\s*[=:]\s*\d+(?:[.,]\d+)?\s*€?\)?"
NO_NAME = r"^(?:aktion|knaller|tiefpreis|angebot|gültig|je |ab |nur |statt |\(|\d|-)"


def _lines(text: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): the non-empty trimmed lines of each text."""
    return docs.select(key, F.posexplode(_lines(text)).alias("pos", "line"))


def card_offers(docs: DataFrame, key: str = "doc_id", text: str = "text", above: int = 6, below: int = 1) -> DataFrame:
    """One row a price line: its price, the nearest line above (at most `above`) that can be a name, and the package and unit price in the lines around.

    A text's lines are an array of its row, each judged once, and only price lines are made rows, with a bounded number of lines around; nothing is shuffled or sorted.
    """

    def judged(line: Column) -> Column:
        # Both patterns of prices need the sign, which is cheaper to look for; what is found is bound, as reading a number looks at it more than once.
        euro = F.contains(line, F.lit("€"))
        asked = F.transform(F.array(F.regexp_extract(F.regexp_replace(line, UNIT_PRICE, " "), PRICE, 1)), P.german_number)[0]
        usable = ~F.lower(line).rlike(NO_NAME) & line.rlike(r"\p{L}{3}") & ~(euro & line.rlike(PRICE))
        return F.struct(line.alias("line"), F.when(euro, asked).alias("price"), F.when(usable, line).alias("name"))

    def card(one: Column, i: Column) -> Column:
        first = F.greatest(i - above, F.lit(0))
        names = F.filter(F.slice("read", first + 1, i - first), lambda x: x["name"].isNotNull())
        around = F.array_join(F.transform(F.slice("read", first + 1, i - first + 1 + below), lambda x: x["line"]), " ")
        return F.when(one["price"].isNotNull(), F.struct(i.alias("pos"), one["price"].alias("price"), F.try_element_at(names, F.lit(-1))["name"].alias("name"), around.alias("around")))

    # Outer ones: for others Spark looks first whether they give rows, and would work everything out twice.
    rows = docs.select(key, F.explode_outer(F.array(F.transform(_lines(text), judged))).alias("read"))
    found = rows.select(key, F.inline_outer(F.filter(F.transform("read", card), lambda x: x["name"].isNotNull()))).where("name IS NOT NULL")
    found = found.select("*", F.explode_outer(F.array(P.package(F.col("around")))).alias("pack"))
    return found.select(key, "pos", "name", "price", (F.col("pack.count") * F.col("pack.each")).alias("quantity"), F.col("pack.unit").alias("unit"), P.stated_unit_price(F.col("around"))["price"].alias("unit_price"))


def week_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = r"(?i)\b(?:ab|vom)\s+\p{L}+,?\s+(\d{1,2}\.\d{1,2}\.)") -> DataFrame:
    """Each line with the last heading above it, such as the first day of the week it belongs to."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines(docs, key, text).withColumn("section", F.last(F.nullif(F.regexp_extract("line", heading, 1), F.lit("")), ignorenulls=True).over(w))


_STRING, _NO_BRACKET = r'(?s)"(?:[^"\\]++|\\.)*+"', r"[^\[\]{}]"
_NODE = "struct<path:string,value:variant,page:int>"


def _depth(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested, those in its strings left out."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, _STRING, ""), _NO_BRACKET, ""), "")

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def _fields(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _own_page(value: Column) -> Column:
    """The page number that an object states; an index counts from 0. Null for what is no object."""
    stated = [F.try_variant_get(value, f"$.{n}", "int") + (1 if "ndex" in n else 0) for n in sorted(K.MANIFEST_PAGE_NUMBERS, key=lambda n: "ndex" in n)]
    return F.coalesce(*stated)


def _children(node: Column) -> Column:
    """The nodes right below one; pages are carried down, and an element of a list of pages is a page by its place."""
    made = lambda path, value, page: F.struct(F.concat(*path).alias("path"), value.alias("value"), F.coalesce(_own_page(value), page).cast("int").alias("page"))
    within = lambda fields: F.transform(F.map_entries(fields), lambda e: made([node["path"], F.lit("."), e["key"]], e["value"], node["page"]))
    paged = F.lower(F.regexp_extract(node["path"], r"\.([^.\[\]]+)$", 1)).isin(*K.MANIFEST_PAGES)
    listed = lambda values: F.transform(values, lambda x, i: made([node["path"], F.lit("["), i, F.lit("]")], x, F.when(paged, i + 1).otherwise(node["page"])))
    # A value is taken apart once, as an object or as a list; to write it out only to see its first sign would cost its whole subtree at each level.
    parts = F.struct(_fields(node["value"]).alias("fields"), node["value"].try_cast("array<variant>").alias("values"))
    return F.transform(F.array(parts), lambda p: F.coalesce(within(p["fields"]), listed(p["values"]), F.array().cast(f"array<{_NODE}>")))[0]


def json_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value, page): every node of JSON texts and the number of the page that it belongs to.

    Each text is walked level by level within its row, so there is no bound on the number of nodes, no shuffle and no round
    of the driver. The parser refuses texts nested deeper than 1,000; these, null and broken texts have no nodes, and
    no other columns are carried along. Rows that repeat a key each give their nodes. An empty table gives an empty result.
    """
    value = F.try_parse_json(text)
    first = F.array(F.struct(F.lit("$").alias("path"), F.col("_value").alias("value"), _own_page(F.col("_value")).cast("int").alias("page"))).cast(f"array<{_NODE}>")
    roots = df.select(F.col(key), value.alias("_value"), _depth(F.col(text)).alias("_depth")).where("_value IS NOT NULL")

    def step(acc: Column, _: Column) -> Column:
        below = F.flatten(F.transform(acc["last"], _children)).cast(f"array<{_NODE}>")
        return F.transform(F.array(below), lambda new: F.struct(F.concat(acc["all"], new).cast(f"array<{_NODE}>").alias("all"), new.alias("last")))[0]

    levels = F.when(F.col("_depth") > 0, F.sequence(F.lit(1), F.col("_depth"))).otherwise(F.array().cast("array<int>"))
    nodes = F.aggregate(levels, F.struct(first.alias("all"), first.alias("last")), step, lambda acc: acc["all"])
    return roots.select(key, F.inline(nodes)).select(key, "path", F.to_json("value").alias("value"), "page")


def first_of(nodes: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The first scalar found under any of several names, by the names' order, then the shortest path."""
    leaf = F.regexp_extract("path", r"([^.\[\]]+)$", 1)
    place = F.coalesce(*[F.when(leaf == n, i) for i, n in enumerate(names)])
    scalar = ~F.col("value").rlike(r"^[\[{]")
    ranked = nodes.where(place.isNotNull() & scalar).groupBy(key).agg(F.min(F.struct(place.alias("i"), F.length("path").alias("n"), "path", "value")).alias("b"))
    return ranked.select(key, F.regexp_replace("b.value", '^"|"$', "").alias("value"))


def link_offers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, rank, url, score): links of a page ranked as leaflet candidates, PDF files and leaflet words first."""
    urls = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    rows = pages.select(key, F.posexplode(urls).alias("pos", "url")).groupBy(key, "url").agg(F.min("pos").alias("pos"))
    low = F.lower("url")
    score = F.when(low.rlike(r"\.pdf(?:[?#]|$)"), 50).otherwise(0) + F.when(low.rlike("prospekt|angebot|flyer|leaflet"), 20).otherwise(0) - F.when(low.rlike("agb|datenschutz|impressum"), 40).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return rows.withColumn("score", score).withColumn("rank", rank).select(key, "rank", "url", "score")


def classify_link(url: Column, product_id: Column, title: Column) -> Column:
    """Where a leaflet's link leads: a shop page, a local product, navigation or editorial content."""
    shop = url.rlike(r"/p/[^?#]*\d{4,}|flyx_content=p-")
    return F.when(shop, "ONLINE_ONLY").when(product_id.isNotNull(), "LOCAL_ONLY").when(F.coalesce(F.trim(title), F.lit("")) == "", "NAVIGATION").otherwise("EDITORIAL")
