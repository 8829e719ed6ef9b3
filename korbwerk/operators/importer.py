"""Import of collected offers as tables: admission, keys, resolution and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import names, promo, text
from korbwerk.operators.relational import once_each, top, upsert

OFFER_KEY = ["store_id", "product_key", "valid_from", "price"]


def rejection(wording: Column, price: Column, valid_from: Column, earliest: Column) -> Column:
    """Why an offer isn't taken: online, quality or date; null if it is."""
    online = text.online_only(wording, F.lit(None))
    return F.when(online, "online").when((price <= 0) | (price > 5000), "quality").when(valid_from.isNull() | (valid_from < earliest), "date")


def assessed(collected: DataFrame) -> DataFrame:
    """Adds `why`: online, quality, store or date where a collected offer isn't taken, and the promotion read from its wording.

    Rows have product_name, price, regular_price, quantity, unit, unit_price, confidence, source_text, source_url, local_store_offer, retailer, store_retailer,
    valid_from and valid_to. Wording of several pieces that can't be read for certain counts against an offer's quality.
    """
    c = F.col
    # Of the price only its bounds count, so a name is judged once for all prices that it has.
    judged = ["product_name", "quantity", "unit", "unit_price", "confidence"]
    rows = once_each(collected, judged, _fit=names.offer_quality(c("product_name"), F.lit(1.0), *[c(x) for x in judged[1:]])["accepted"])
    rows = promo.with_promotion(rows, "source_text", "price", "regular_price")
    fit = c("_fit") & (c("price") > 0) & (c("price") <= K.MOST_PRICE)
    unclear = promo.signalled(c("source_text")) & ~F.coalesce(promo.sure(c("promotion")), F.lit(False))
    why = (
        F.when(~F.coalesce("local_store_offer", F.lit(True)) | text.online_only(c("source_text"), c("source_url")), "online")
        .when(~F.coalesce(fit, F.lit(False)) | unclear, "quality")
        .when(~F.coalesce(c("store_retailer") == c("retailer"), F.lit(False)), "store")
        .when(~F.coalesce(c("valid_to") >= c("valid_from"), F.lit(False)), "date")
    )
    return rows.withColumn("why", why).drop("_fit")


def keyed(collected: DataFrame) -> DataFrame:
    """Adds product_key, promotion and a fingerprint of what was seen where."""
    key = text.master_key(F.col("product_name"), F.col("quantity"), F.col("unit"))
    seen = [F.col("page").cast("string"), F.lower(F.trim("product_name")), F.col("price").cast("string"), F.trim("source_url")]
    return collected.withColumns({"product_key": key, "promotion": promo.multibuy(F.col("source_text"), F.col("price")), "fingerprint": F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in seen]), 256)})


def import_offers(collected: DataFrame, known: DataFrame, earliest: Column) -> tuple[DataFrame, DataFrame]:
    """(offers after the import, counts by outcome). Collected rows have store_id, product_name, quantity, unit, price, valid_from, valid_to, page, source_text, source_url, seq.

    Of rows with one key the last by `seq` counts. `known` has the offer key, valid_to and source_url; a new row's values replace those of its key.
    """
    judged = keyed(collected).withColumn("why", rejection(F.col("source_text"), F.col("price"), F.col("valid_from"), earliest))
    new = top(judged.where("why IS NULL"), OFFER_KEY, [F.desc("seq")]).select(*OFFER_KEY, "valid_to", "source_url")
    counts = judged.groupBy(F.coalesce("why", F.lit("imported")).alias("outcome")).agg(F.count("*").alias("n"))
    return upsert(known, new, OFFER_KEY), counts
