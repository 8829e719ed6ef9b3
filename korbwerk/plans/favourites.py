"""Registered queries: offers that match favourites, exactly or by family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.functions import families
from korbwerk.operators import relational as R
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views

#: Names by product, with the family that each belongs to.
NAMES = (
    ("Freeway Cola 1,5 l", "cola"), ("Orangina", "orange-lemonade"), ("7-Up", "lemon-lime"), ("Mineralwasser still", "mineral-water"), ("Butter 250 g", "butter"), ("Filterkaffee", "coffee"), ("Yoghurt mild", "yogurt"),
    ("H-Milch 3,5%", "milk"), ("Riffels Paprika", "potato-chips"), ("Colorwaschmittel", "laundry-detergent"), ("Klopapier", "toilet-paper"), ("Pom Bär", ""), ("Buttermilch", ""),
)


@query("fs18_favourite_matches", f""", n AS (SELECT product_id, brand, product_id % 13 + 1 AS k, brand || '/' || product_id % 13 AS same, (ARRAY{[f for _, f in NAMES]})[product_id % 13 + 1] AS family FROM products)
 SELECT DISTINCT o.store_id, product_id, n.family, EXISTS (SELECT 1 FROM n f WHERE f.product_id % 200 = 0 AND f.same = n.same) AS exact, n.family <> '' AND EXISTS (SELECT 1 FROM n f WHERE f.product_id % 200 = 0 AND f.family = n.family) AS alternative FROM current_offers o JOIN n USING (product_id)""")
def fs18(v: Views) -> DataFrame:
    """Current offers with their family, and whether they match a favourite (every 200th product) by brand and name or by family; joined by keys that occur once."""
    name = F.element_at(F.array(*[F.lit(n) for n, _ in NAMES]), (F.col("product_id") % len(NAMES) + 1).cast("int"))
    named = R.once_each(v.products.select("product_id", "brand", name.alias("name")), ["brand", "name"], key=families.exact_key(F.col("brand"), F.col("name")), family=F.coalesce(families.family(F.col("brand"), F.col("name")), F.lit("")))
    goods = named.select("product_id", "key", "family")
    liked = goods.where(F.col("product_id") % 200 == 0)
    exact, alternative = liked.select("key", F.lit(True).alias("exact")).distinct(), liked.where("family <> ''").select("family", F.lit(True).alias("alternative")).distinct()
    found = v.current.select("store_id", "product_id").distinct().join(goods, "product_id").join(exact, "key", "left").join(alternative, "family", "left")
    return found.select("store_id", "product_id", "family", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("exact", "alternative")])
