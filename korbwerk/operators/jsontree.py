"""Offers out of JSON trees: fields of objects, identifiers, pages and containers of leaflet manifests.

A tree is a table of its nodes (`extract.json_nodes`: key, path, value). What belongs to one object is found by its
path, so all of this is grouping and joining by paths, however the trees are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import names
from korbwerk.functions import price as P

LEAF, PARENT = r"\.([^.\[\]]+)$", r"(?:\.[^.\[\]]+|\[\d+\])$"


def _leaf(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, LEAF, 1), F.lit(""))


def _up(path: Column) -> Column:
    return F.regexp_replace(path, PARENT, "")


def _plain(value: Column) -> Column:
    """A scalar's text; null for objects, arrays and JSON's null."""
    return F.when(~value.rlike(r"^[\[{]") & (value != "null"), F.when(F.startswith(value, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value))


def objects(nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, json, fields): every object of the trees, with a map of its fields' scalars; a field that is an object stands for the first scalar that wraps its value.

    Nodes are read once: each tells its own object, and if it is a scalar the object that it is a field of and the one whose field it wraps. Paths come out of a
    generator, so that whatever filters them leaves the shuffle as it is and all that read a tree's objects share it.
    """
    path, outer = F.col("path"), _up(F.col("path"))
    text = F.nullif(_plain(F.col("value")), F.lit(""))
    order = F.array_position(F.array(*[F.lit(w) for w in K.JSON_WRAPPERS]), _leaf(path)).cast("int")
    none = F.lit(None).cast("string")

    def told(text: Column) -> Column:
        said = lambda object_, field, rank: F.struct(object_.alias("object"), none.alias("json"), F.struct(field.alias("field"), rank.cast("int").alias("rank"), text.alias("text")).alias("said"))
        own = F.when(_leaf(path).isNotNull(), said(outer, _leaf(path), F.lit(-1)))
        wrapped = F.when((order > 0) & _leaf(outer).isNotNull(), said(_up(outer), _leaf(outer), order))
        return F.when(text.isNotNull(), F.array_compact(F.array(own, wrapped)))

    nothing = F.struct(none.alias("field"), F.lit(None).cast("int").alias("rank"), none.alias("text"))
    itself = F.array(F.struct(path.alias("object"), F.col("value").alias("json"), F.when(F.lit(False), nothing).alias("said")))
    rows = nodes.select(key, F.inline(F.when(F.startswith("value", F.lit("{")), itself).otherwise(names.bound(text, told))))
    met = rows.groupBy(key, "object").agg(F.collect_list("json").alias("jsons"), F.array_sort(F.collect_list("said")).alias("said"))
    first = F.filter("said", lambda x, i: (i == 0) | (F.get("said", i - 1)["field"] != x["field"]))
    fields = F.map_from_entries(F.transform(first, lambda x: F.struct(x["field"], x["text"])))
    met = met.select(key, "object", "jsons", fields.alias("fields"))
    return met.select(key, F.inline(F.transform("jsons", lambda j: F.struct(F.col("object").alias("path"), j.alias("json"), F.col("fields").alias("fields")))))


def field(names_: Sequence[str], of: str = "fields") -> Column:
    """The first of several fields that an object has."""
    return F.coalesce(*[F.try_element_at(of, F.lit(n)) for n in names_])


def identifiers(ids: Sequence[str] = K.MANIFEST_IDS, of: str = "fields") -> Column:
    """All identifiers of an object, from its fields and out of its addresses, in lower case."""
    own = F.array_compact(F.array(*[F.lower(F.trim(F.try_element_at(of, F.lit(n)))) for n in ids]))
    urls = [F.coalesce(F.try_element_at(of, F.lit(n)), F.lit("")) for n in K.MANIFEST_URLS]
    found = F.flatten(F.array(*[F.regexp_extract_all(u, F.lit("(?i)" + p), F.lit(1)) for u in urls for p in K.URL_IDS]))
    return F.array_distinct(F.filter(F.concat(own, found), lambda x: (x != "") & (F.length(x) <= K.LONGEST_IDENTIFIER)))


def _parts(path: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(path, r"\[\d+\]", "")), r"\.")


def on_page(path: Column) -> Column:
    return F.arrays_overlap(_parts(path), F.array(*map(F.lit, K.MANIFEST_PAGES)))


def in_catalogue(path: Column) -> Column:
    """Whether a node is in a list of products that belongs to no page."""
    return F.arrays_overlap(_parts(path), F.array(*map(F.lit, K.MANIFEST_CATALOGUES))) & ~on_page(path)


def container(path: Column) -> Column:
    """The path of the innermost container (such as a hotspot) that holds a node; null outside of one."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(.*\.(?:" + "|".join(K.MANIFEST_CONTAINERS) + r")(?:\[\d+\])?)(?=[.\[]|$)", 1), F.lit(""))


def page_path(path: Column) -> Column:
    """The path of the page that holds a node."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(.*?\.(?:" + "|".join(K.MANIFEST_PAGES) + r")\[\d+\])", 1), F.lit(""))


def sold_online(json: Column, fields: Column) -> Column:
    """Whether an object, or anything in it, says that it is sold online alone."""
    flag = F.exists(F.map_entries(fields), lambda e: (e["key"].isin(*K.ONLINE_FLAGS) & (e["value"] == "true")) | (e["key"].isin(*K.ONLINE_FIELDS) & F.lower(e["value"]).rlike("|".join(K.ONLINE_VALUES))))
    inside = json.rlike('"(?:' + "|".join(K.ONLINE_FLAGS) + r')"\s*:\s*true') | F.lower(json).rlike("|".join(K.ONLINE_TEXTS))
    return flag | inside


def all_text(nodes: DataFrame, key: str) -> DataFrame:
    """(key, text): all scalars of a tree, in order of their paths, as one text."""
    told = nodes.withColumn("t", _plain(F.col("value"))).where("t IS NOT NULL")
    return told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "t"))).alias("c")).select(key, F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("text"))


def network_offers(found: DataFrame, key: str) -> DataFrame:
    """Objects with a name and a price that something marks as offers: (key, name, price, regular_price, app_price, quantity, unit, valid_from, valid_to, image_url), each once."""
    signal = F.lower("json").rlike("|".join(K.JSON_OFFER_SIGNALS))
    rows = found.select(key, "path", F.trim(field(K.JSON_NAMES)).alias("name"), P.network_price(field(K.JSON_PRICES)).alias("price"), P.network_price(field(K.JSON_REGULAR_PRICES)).alias("regular_price"), P.network_price(field(K.JSON_APP_PRICES)).alias("app_price"), P.size(field(K.JSON_SIZES)).alias("s"), field(K.JSON_VALID_FROM).alias("valid_from"), field(K.JSON_VALID_TO).alias("valid_to"), field(K.JSON_IMAGES).alias("image_url"), signal.alias("signal"))
    rows = rows.where(F.col("signal") & F.col("price").isNotNull() & F.length("name").between(3, 220)).select("*", F.col("s.quantity").alias("quantity"), F.col("s.unit").alias("unit"))
    same = [key, F.lower("name").alias("_name"), "price", "quantity", "unit", "valid_from", "valid_to"]
    first = rows.groupBy(*same).agg(F.min_by(F.struct("name", "regular_price", "app_price", "image_url"), "path").alias("f"))
    return first.select(key, "f.name", "price", "f.regular_price", "f.app_price", "quantity", "unit", "valid_from", "valid_to", "f.image_url")


def gathered(found: DataFrame, key: str) -> DataFrame:
    """(key, container, page_path, ids, name, price, regular_price, online, nodes): what the objects in each container of a page say together; of each field the first by path, in containers of a bounded number of objects."""
    inside = found.withColumns({"container": container(F.col("path")), "page_path": page_path(F.col("path"))}).where("container IS NOT NULL AND page_path IS NOT NULL")
    said = inside.select(
        key, "container", "page_path", "path", identifiers().alias("ids"), field(K.JSON_NAMES).alias("name"), P.network_price(field(K.JSON_PRICES)).alias("price"), P.network_price(field(K.JSON_REGULAR_PRICES)).alias("regular"), sold_online(F.col("json"), F.col("fields")).alias("online"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length("path"), "path"))).alias(c)
    together = said.groupBy(key, "container").agg(F.min("page_path").alias("page_path"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), first("name"), first("price"), first("regular").alias("regular_price"), F.max("online").alias("online"), F.count("*").alias("nodes"))
    return together.where(F.col("nodes") <= K.MOST_CONTAINER_NODES)


def page_numbers(found: DataFrame, key: str) -> DataFrame:
    """(key, page_path, page): the number each page gives itself; an index counts from 0; else its place."""
    pages = found.withColumn("page_path", page_path(F.col("path"))).where("path = page_path")
    index = F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in ("pageIndex", "page_index")]).try_cast("int") + 1
    stated = field([n for n in K.MANIFEST_PAGE_NUMBERS if "ndex" not in n]).try_cast("int")
    return pages.select(key, "page_path", F.coalesce(stated, index, F.regexp_extract("page_path", r"\[(\d+)\]$", 1).cast("int") + 1).alias("page"))


def manifest_offers(found: DataFrame, key: str) -> DataFrame:
    """Offers of a leaflet's pages: (key, page, product_id, name, price, regular_price).

    A container that lacks a name or price takes them from the catalogue, if its identifiers lead to one product alone. What is sold online, has no price or
    no fit name is left out; of equal names, prices and pages the one with the smallest path counts.
    """
    spots = gathered(found, key)
    goods = found.where(in_catalogue(F.col("path")) & container(F.col("path")).isNull()).select(key, identifiers().alias("ids"), field(K.JSON_NAMES).alias("name"), P.network_price(field(K.JSON_PRICES)).alias("price"))
    goods = goods.select(key, F.explode("ids").alias("id"), F.struct("name", "price").alias("g"))
    hits = spots.select(key, "container", F.explode("ids").alias("id")).join(goods, [key, "id"]).groupBy(key, "container").agg(F.collect_set("g").alias("gs"), F.min("id").alias("product_id"))
    unique = hits.where(F.size("gs") == 1).select(key, "container", "product_id", F.col("gs")[0].alias("g"))
    unique = unique.select(key, "container", "product_id", F.col("g.name").alias("g_name"), F.col("g.price").alias("g_price"))
    rows = spots.join(unique, [key, "container"], "left").join(page_numbers(found, key), [key, "page_path"]).where("NOT online")
    name = names.clean_name(F.coalesce("name", "g_name"))
    rows = rows.select(key, "page", "container", "product_id", name.alias("name"), F.coalesce("price", "g_price").alias("price"), "regular_price").where("price IS NOT NULL").where(names.name_issue(F.col("name")).isNull())
    first = rows.groupBy(key, "page", "name", "price").agg(F.min_by(F.struct("product_id", "regular_price"), "container").alias("f"))
    return first.select(key, "page", "f.product_id", "name", "price", "f.regular_price")
