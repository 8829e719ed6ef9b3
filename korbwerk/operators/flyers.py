"""Offers of flyers (JSON): pages whose links name products of the flyer's catalogue, and pages whose text tells of offers.

A flyer is a document `{"data": {"flyer": {"pages": [...], "products": ..., "texts": [...]}}}`. Its pages, links, products and texts become rows; links find their
product by a join on flyer and number, and texts are read by the parser of such pages. Nothing of a flyer meets in one task but the parsing of its JSON.

Defined cases. Null and broken documents and those without a list of pages are no flyers and give no rows; rows with a null key are left out. Repeated rows count
once. Of products with the same number the last one counts. A page's texts are put together by the names of its fields, then by path, as parsed objects keep no
order of their own. Empty tables give empty results; other columns are not carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import names
from korbwerk.functions import price as P
from korbwerk.operators import extract, parsers

FLYER = ["flyer_key", "flyer_id"]
#: A page's text of fewer characters is not read.
LEAST_TEXT = 20


def _entries(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _list(value: Column) -> Column:
    return value.try_cast("array<variant>")


def _at(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _is_object(value: Column) -> Column:
    return F.startswith(F.to_json(value), F.lit("{"))


def _text(value: Column) -> Column:
    """A scalar, or the first scalar that wraps an object's value, trimmed; null for none and for empty ones."""
    plain = lambda v: F.when(~F.to_json(v).rlike(r"^[\[{]"), v.try_cast("string"))
    read = lambda v: F.nullif(F.trim(F.coalesce(plain(v), *[plain(_at(_entries(v), w)) for w in K.JSON_WRAPPERS])), F.lit(""))
    return names.bound(value, read)


def _first_price(fields: Column, keys: Sequence[str]) -> Column:
    prices = F.transform(F.array(*map(F.lit, keys)), lambda k: P.network_price(_text(F.try_element_at(fields, k))))
    return F.get(F.array_compact(prices), F.lit(0))


def _has_any(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def local_evidence(fields: Column) -> Column:
    """Whether an object's own fields say that it is sold in stores."""
    flagged = F.exists(F.array(*map(F.lit, K.LOCAL_FLAGS)), lambda k: F.coalesce(F.to_json(F.try_element_at(fields, k)) == "true", F.lit(False)))
    return flagged | F.exists(F.array(*map(F.lit, K.LOCAL_FIELDS)), lambda k: F.coalesce(F.lower(_text(F.try_element_at(fields, k))).isin(*K.LOCAL_VALUES), F.lit(False)))


def shop_address(url: Column) -> Column:
    """Whether an address leads to a product of the retailer's shop."""
    host = F.lower(F.regexp_extract(url, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1))
    return F.coalesce(url.rlike("(?i)" + K.SHOP_QUERY) | ((F.endswith(host, F.lit(K.SHOP_HOST)) | (host == "")) & F.lower(url).rlike(K.SHOP_PATH)), F.lit(False))


def shop_signal(fields: Column) -> Column:
    """Whether an object's fields identify a product of the shop, by a product's number or by an address."""
    numbered = F.exists(F.array(*[_at(fields, k) for k in ("productId", "product_id")]), lambda v: F.coalesce(F.to_json(v).isin("null", '""'), F.lit(True)) == F.lit(False))
    return F.coalesce(numbered | F.exists(F.array(*map(F.lit, K.SHOP_ADDRESSES)), lambda k: shop_address(_text(F.try_element_at(fields, k)))), F.lit(False))


def flyers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(flyer_key, flyer_id, flyer): each different flyer once; `flyer` is a map of its fields."""
    rows = docs.select(F.col(key).cast("string").alias("flyer_key"), F.col(text).alias("doc")).dropna().distinct()
    flyer = _entries(F.try_variant_get(F.try_parse_json("doc"), "$.data.flyer", "variant"))
    return rows.select("flyer_key", F.sha2("doc", 256).alias("flyer_id"), flyer.alias("flyer")).where(_list(_at(F.col("flyer"), "pages")).isNotNull())


def pages(found: DataFrame) -> DataFrame:
    """(flyer_key, flyer_id, page, value, online, said): the pages by their place, from 1, whether one says that it is sold online alone, and its text with the flyer's own texts of that page."""
    rows = found.select(*FLYER, F.posexplode(_list(_at(F.col("flyer"), "pages"))).alias("at", "value")).where(_is_object(F.col("value"))).withColumn("page", F.col("at") + 1)
    nodes = extract.json_nodes(rows.select(F.concat_ws("/", "flyer_id", "page", F.hex("flyer_key")).alias("page_key"), F.to_json("value").alias("doc")), "page_key", "doc")
    field, scalar = F.lower(F.regexp_extract("path", r"^\$\.([^.\[]+)", 1)), ~F.col("value").rlike(r"^[\[{]") & (F.col("value") != "null")
    plain = F.when(F.startswith("value", F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).otherwise(F.col("value"))
    told = nodes.where(scalar & ~field.isin(*K.FLYER_IMAGES)).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct(field.alias("field"), F.length("path").alias("n"), "path", plain.alias("t")))).alias("parts"))
    rows = rows.withColumn("page_key", F.concat_ws("/", "flyer_id", "page", F.hex("flyer_key"))).join(told, "page_key", "left")
    own = F.array_join(F.filter(F.transform("parts", lambda x: x["t"]), lambda t: t != ""), "\n")
    rows = rows.select(*FLYER, "page", "value", F.coalesce(own, F.lit("")).alias("own")).withColumn("online", _has_any(F.col("own"), K.FLYER_ONLINE))
    rows = rows.join(_stated_texts(found, rows), [*FLYER, "page"], "left")
    return rows.select(*FLYER, "page", "value", "online", F.trim(F.concat_ws("\n", "stated", F.nullif("own", F.lit("")))).alias("said"))


def _stated_texts(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(flyer_key, flyer_id, page, stated): the flyer's `texts` by the page they name, by number (an index counts from 0) or by the page's id."""
    f = _entries(F.col("value"))
    texts = found.select(*FLYER, F.posexplode(_list(_at(F.col("flyer"), "texts"))).alias("at", "value"))
    number = F.coalesce(*[_text(_at(f, k)).try_cast("int") + (1 if "ndex" in k else 0) for k in K.MANIFEST_PAGE_NUMBERS])
    ref = F.coalesce(_text(_at(f, "pageId")), _text(_at(f, "page_id")))
    texts = texts.select(*FLYER, "at", number.alias("number"), ref.alias("ref"), F.coalesce(*[_text(_at(f, k)) for k in ("text", "content", "value", "label")]).alias("t")).where("t IS NOT NULL")
    ids = rows.select(*FLYER, "page", _text(_at(f, "id")).alias("ref")).where("ref IS NOT NULL").groupBy(*FLYER, "ref").agg(F.max("page").alias("by_id"))
    texts = texts.join(ids, [*FLYER, "ref"], "left").withColumn("page", F.coalesce("number", "by_id")).where("page IS NOT NULL")
    return texts.groupBy(*FLYER, "page").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("x")).select(*FLYER, "page", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("stated"))


def _catalogue(found: DataFrame) -> DataFrame:
    """(flyer_key, flyer_id, product_id, product): the flyer's products, a list or an object of them, by number."""
    listed = _at(F.col("flyer"), "products")
    values = F.coalesce(_list(listed), F.map_values(_entries(listed)))
    rows = found.select(*FLYER, F.posexplode(values).alias("at", "product")).where(_is_object(F.col("product")))
    rows = rows.select(*FLYER, "at", F.lower(_text(_at(_entries(F.col("product")), "productId"))).alias("product_id"), F.to_json("product").alias("product")).where(F.length("product_id") <= K.LONGEST_IDENTIFIER)
    return rows.groupBy(*FLYER, "product_id").agg(F.max_by("product", "at").alias("product"))


def _named(rows: DataFrame) -> DataFrame:
    """Rows with a fit name: `name` cleaned, and the package that it states. Each different name is judged once."""
    once = rows.select("raw").distinct().select("raw", names.clean_name(F.col("raw")).alias("name"))
    once = once.where((F.length("name") >= 3) & names.name_issue(F.col("name")).isNull()).withColumn("s", P.size(F.col("name")))
    return rows.join(once.select("raw", F.left("name", F.lit(180)).alias("name"), F.col("s.quantity").alias("quantity"), F.col("s.unit").alias("unit")), "raw")


def link_offers(found: DataFrame, on: DataFrame) -> DataFrame:
    """Offers of products that pages link to; without local evidence, a product's number in the link means that it is sold online."""
    links = on.select(*FLYER, "page", F.posexplode(_list(_at(_entries(F.col("value")), "links"))).alias("at", "link")).where(_is_object(F.col("link")))
    details = _entries(_at(_entries(F.col("link")), "productDetails"))
    links = links.select(*FLYER, "page", "at", "link", F.lower(_text(_at(details, "productId"))).alias("product_id"), _text(_at(details, "title")).alias("linked_title"))
    rows = links.join(_catalogue(found), [*FLYER, "product_id"]).withColumns({"l": _entries(F.col("link")), "p": _entries(F.parse_json("product"))})
    l, p = F.col("l"), F.col("p")
    said = F.concat_ws(" ", _text(_at(l, "url")), _text(_at(l, "title")), _text(_at(l, "label")), "product")
    title = _text(_at(p, "title"))
    rows = rows.select(
        *FLYER, "page", "at", "product_id", F.coalesce((local_evidence(l) | local_evidence(p)) & ~_has_any(said, K.NOT_LOCAL), F.lit(False)).alias("local"), _first_price(p, K.FLYER_PRICES).alias("price"), _first_price(p, K.FLYER_REGULAR_PRICES).alias("regular_price"),
        F.concat_ws(" ", _text(_at(p, "brand")), F.coalesce(title, "linked_title"), F.coalesce(_text(_at(p, "packageSize")), _text(_at(p, "content")))).alias("raw"), F.when(title.isNotNull(), "catalogue").when(F.col("linked_title").isNotNull(), "link").alias("title_from"),
        F.coalesce(_text(_at(p, "canonicalUrl")), _text(_at(p, "url")), _text(_at(l, "url"))).alias("url"), F.coalesce(_text(_at(p, "image")), _text(_at(p, "imageUrl"))).alias("image_url"),
    )
    return _named(rows.where("price IS NOT NULL")).withColumn("kind", F.lit("link"))


def text_offers(on: DataFrame, ref: Column) -> DataFrame:
    """Offers that the texts of pages tell of, all of them local; pages that say they are sold online alone are not read."""
    texts = on.where(~F.col("online") & (F.length("said") >= LEAST_TEXT)).select(F.to_json(F.struct(*FLYER, "page")).alias("page_key"), "said")
    read = parsers.lidl(texts, "page_key", "said", ref)
    at = F.from_json("page_key", "flyer_key string, flyer_id string, page int")
    return read.select(at.alias("k"), F.col("name"), "price", "regular_price", "quantity", "unit").select("k.*", "name", "price", "regular_price", "quantity", "unit", F.lit(True).alias("local"), F.lit("text").alias("kind"))


def flyer_offers(docs: DataFrame, key: str, text: str, ref: Column) -> DataFrame:
    """(flyer_key, page, kind, product_id, title_from, name, price, regular_price, quantity, unit, local, url, image_url): offers of links, then of texts; of those with
    equal names in any case, prices, packages, pages and places of sale the first counts. `ref` is the day that counts as today."""
    found = flyers(docs, key, text)
    on = pages(found)
    rows = link_offers(found, on).unionByName(text_offers(on, ref), allowMissingColumns=True)
    same = ["flyer_key", "page", F.lower(F.trim("name")).alias("_name"), F.round("price", 2).alias("_price"), "quantity", "unit", "local"]
    kept = F.struct("kind", "product_id", "title_from", "name", "price", "regular_price", "url", "image_url")
    first = rows.groupBy(*same).agg(F.min_by(kept, F.struct("kind", F.coalesce("at", F.lit(0)), "name", "flyer_id")).alias("f"))
    return first.select("flyer_key", "page", "f.kind", "f.product_id", "f.title_from", "f.name", "f.price", "f.regular_price", "quantity", "unit", "local", "f.url", "f.image_url")
