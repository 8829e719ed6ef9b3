"""Registered queries: quality of offers, runs and leaflets, by fixed formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.operators import relational as R
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views


def offer_score(quantity: Column, unit_price: Column, words: Column, mark: Column, confidence: Column) -> Column:
    """Acceptance score of an offer: 0.50, and more for a package, for a telling name and for the extraction's confidence."""
    pack = F.when(quantity > 0, 0.22).when(unit_price > 0, 0.15).otherwise(0.0)
    name = F.when((words >= 2) | mark, 0.13).otherwise(0.07)
    sure = F.when(confidence >= 0.9, 0.15).when(confidence >= 0.75, 0.10).when(confidence >= 0.6, 0.05).otherwise(0.0)
    return F.lit(0.5) + pack + name + sure


def accepted(score: Column, price: Column, quantity: Column, unit_price: Column, words: Column, confidence: Column, least: float = 0.72) -> Column:
    bare = ~F.coalesce(quantity > 0, F.lit(False)) & ~F.coalesce(unit_price > 0, F.lit(False)) & (words < 2) & (confidence < 0.9)
    return F.coalesce((price > 0) & (price <= 5000) & (words >= 1) & ~bare & (F.round(score, 6) >= least), F.lit(False))


@query("f12_offer_quality", """, o AS (SELECT p_partkey AS product_id, p_retailprice AS price, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS quantity, CASE WHEN p_size % 2 = 0 THEN 2.5 END AS up, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS words, p_partkey % 5 = 0 AS mark, p_partkey % 50 / 50.0::DOUBLE AS conf FROM part),
 s AS (SELECT *, 0.5 + CASE WHEN quantity > 0 THEN 0.22 WHEN up > 0 THEN 0.15 ELSE 0 END + CASE WHEN words >= 2 OR mark THEN 0.13 ELSE 0.07 END + CASE WHEN conf >= 0.9 THEN 0.15 WHEN conf >= 0.75 THEN 0.10 WHEN conf >= 0.6 THEN 0.05 ELSE 0 END AS score FROM o)
 SELECT product_id, round(score::DOUBLE, 6) AS score, price <= 5000 AND NOT (NOT coalesce(quantity > 0, false) AND NOT coalesce(up > 0, false) AND words < 2 AND conf < 0.9) AND round(score::DOUBLE, 6) >= 0.72 AS accepted FROM s""")
def f12(v: Views) -> DataFrame:
    p, n = F.col("p_partkey"), F.col("p_size")
    o = v.table("part").select(p.alias("product_id"), F.col("p_retailprice").alias("price"), F.when(n % 3 != 0, n).alias("quantity"), F.when(n % 2 == 0, 2.5).alias("up"), F.when(p % 4 == 0, 1).otherwise(2).alias("words"), (p % 5 == 0).alias("mark"), (p % 50 / 50.0).alias("conf"))
    c = F.col
    score = offer_score(c("quantity"), c("up"), c("words"), c("mark"), c("conf"))
    return o.select("product_id", F.round(score, 6).alias("score"), accepted(score, c("price"), c("quantity"), c("up"), c("words"), c("conf")).alias("accepted"))


def freshness(status: Column, started: Column, cutoff: Column) -> Column:
    """State of a source by its latest run; failures come before staleness."""
    return F.when(status.isNull(), "unknown").when(status == "failed", "failed").when(status == "no_offers", "empty").when(started < cutoff, "stale").when(status == "success", "current").otherwise(status)


_STATE = "CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'failed' THEN 'failed' WHEN status = 'no_offers' THEN 'empty' WHEN started_at < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 36 HOUR THEN 'stale' WHEN status = 'success' THEN 'current' ELSE status END"
RECENT_RUNS = 4


@query("w2_freshness", f""", recent AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at DESC, run_id DESC) AS r FROM runs QUALIFY r <= 4),
 last AS (SELECT store_id, any_value(run_id) FILTER (WHERE r = 1) AS run_id, any_value({_STATE}) FILTER (WHERE r = 1) AS state, arg_min(run_id, r) FILTER (WHERE source_key LIKE '%:web') AS web_run, arg_min(run_id, r) FILTER (WHERE source_key LIKE '%:pdf') AS pdf_run FROM recent GROUP BY 1)
 SELECT store_id, coalesce(run_id, 0) AS run_id, coalesce(state, 'unknown') AS state, coalesce(web_run, 0) AS web_run, coalesce(pdf_run, 0) AS pdf_run FROM stores LEFT JOIN last USING (store_id) WHERE active AND verified""")
def w2(v: Views) -> DataFrame:
    """The state of each released store's latest run, and the latest web and PDF runs among its last four; 0 where there is none."""
    order = Window.partitionBy("store_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    recent = v.runs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= RECENT_RUNS)
    cutoff = F.lit("2024-01-30 00:00:00").cast("timestamp") - F.expr(f"INTERVAL {K.STALE_HOURS} HOURS")
    of = lambda kind: F.min_by(F.when(F.endswith("source_key", F.lit(kind)), F.col("run_id")), F.when(F.endswith("source_key", F.lit(kind)), F.col("r")))
    first = F.min_by(F.struct("run_id", "status", "started_at"), "r")
    last = recent.groupBy("store_id").agg(first.alias("first"), of(":web").alias("web_run"), of(":pdf").alias("pdf_run"))
    found = v.stores.where("active AND verified").select("store_id").join(last, "store_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c.split(".")[-1])
    return found.select("store_id", none("first.run_id"), freshness(F.col("first.status"), F.col("first.started_at"), cutoff).alias("state"), none("web_run"), none("pdf_run"))


_COVER = """, j AS (SELECT a.store_id, a.day, a.pages, o.page FROM archives a LEFT JOIN offers o ON a.store_id = o.store_id AND (a.valid_from IS NULL OR a.valid_from = o.valid_from) AND a.valid_to = o.valid_to),
 g AS (SELECT store_id, day, count(page) AS offers, count(*) FILTER (WHERE page BETWEEN 1 AND pages) AS linked, count(*) FILTER (WHERE page > pages) AS invalid FROM j GROUP BY 1, 2),
 r AS (SELECT *, CASE WHEN offers = 0 THEN 0 ELSE floor(linked / offers::DOUBLE * 10000 + 0.5) / 100.0::DOUBLE END AS coverage FROM g)
"""


def provenance(v: Views) -> DataFrame:
    """Per leaflet: offers, those on one of its pages, those on pages it lacks, coverage and release state."""
    o = v.offers.select("store_id", "valid_to", F.col("valid_from").alias("o_from"), "page")
    joined = v.archives.join(o, (v.archives["store_id"] == o["store_id"]) & (v.archives["valid_to"] == o["valid_to"]) & (v.archives["valid_from"].isNull() | (v.archives["valid_from"] == o["o_from"])), "left").drop(o["store_id"], o["valid_to"])
    found = joined.groupBy("store_id", "day").agg(F.count("page").alias("offers"), F.count_if(F.col("page").between(1, F.col("pages"))).alias("linked"), F.count_if(F.col("page") > F.col("pages")).alias("invalid"))
    c = R.rate(F.col("linked"), F.col("offers"), 2)
    state = F.when(F.col("offers") == 0, "no_offers").when((c >= 99) & (F.col("invalid") == 0), "released").when(c >= 95, "review").otherwise("blocked")
    return found.withColumns({"coverage": c, "state": state})


@query("a10_provenance_report", _COVER + " SELECT *, CASE WHEN offers = 0 THEN 'no_offers' WHEN coverage >= 99 AND invalid = 0 THEN 'released' WHEN coverage >= 95 THEN 'review' ELSE 'blocked' END AS state FROM r", dates="day")
def a10(v: Views) -> DataFrame:
    return provenance(v)


@query("a10_provenance_totals", _COVER + " SELECT store_id, sum(offers)::BIGINT AS offers, sum(linked)::BIGINT AS linked, sum(invalid)::BIGINT AS invalid FROM r GROUP BY ROLLUP (store_id)")
def a10_totals(v: Views) -> DataFrame:
    return provenance(v).rollup("store_id").agg(*[F.sum(c).alias(c) for c in ("offers", "linked", "invalid")])


def run_score(imports: Column, package: Column, unit: Column, image: Column, prov: Column, occurrence: Column, suspicious: Column) -> Column:
    """Quality score of a run from its rates in percent."""
    share = lambda r, w: F.least(r / 100.0, F.lit(1.0)) * w
    total = share(imports, 25.0) + share(package, 15.0) + share(unit, 15.0) + share(image, 15.0) + share(prov, 25.0) + share(occurrence, 5.0) - F.least(suspicious, F.lit(20.0))
    return F.floor(F.greatest(F.lit(0.0), F.least(total, F.lit(100.0))) * 10 + 0.5) / 10.0


@query("a9_run_quality", """, o AS (SELECT retailer, count(*) AS received, count(*) FILTER (WHERE local) AS imported, count(*) FILTER (WHERE product_id % 3 <> 0) AS units, count(*) FILTER (WHERE page <= 5) AS linked, count(*) FILTER (WHERE seen > 0) AS seen FROM offers JOIN stores USING (store_id) GROUP BY 1),
 p AS (SELECT retailer, count(DISTINCT product_id) AS products, count(DISTINCT CASE WHEN grams > 10 THEN product_id END) AS packs, count(DISTINCT CASE WHEN source IN ('official_product', 'retailer_cdn') THEN product_id END) AS official,
   count(DISTINCT CASE WHEN source = 'prospect_crop' THEN product_id END) AS crops FROM offers JOIN stores USING (store_id) JOIN products USING (product_id) LEFT JOIN (SELECT product_id, source FROM media WHERE active) m USING (product_id) GROUP BY 1),
 r AS (SELECT retailer, received, imported, floor(imported / received::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS imports, floor(packs / products::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS package, floor(units / received::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS unit,
   floor(least(100.0, floor(official / products::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE + floor(crops / products::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE * 0.5) * 10 + 0.5) / 10.0::DOUBLE AS image, floor(linked / received::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS prov, 100.0 AS occ FROM o JOIN p USING (retailer)),
 s AS (SELECT *, floor((least(imports / 100, 1) * 25 + least(package / 100, 1) * 15 + least(unit / 100, 1) * 15 + least(image / 100, 1) * 15 + least(prov / 100, 1) * 25 + 5) * 10 + 0.5) / 10.0::DOUBLE AS score,
   CASE retailer WHEN 'REWE' THEN 150 WHEN 'Lidl' THEN 120 WHEN 'Netto Marken-Discount' THEN 250 WHEN 'ALDI SÜD' THEN 130 WHEN 'ALDI NORD' THEN 130 WHEN 'EDEKA' THEN 60 WHEN 'PENNY' THEN 100 ELSE 50 END AS expected, CASE retailer WHEN 'REWE' THEN 50 WHEN 'Lidl' THEN 35 ELSE 20 END AS min_image FROM r)
 SELECT retailer, imported, score, CASE WHEN imported = 0 OR imports < 50 THEN 'FAIL' WHEN imports < 80 OR prov < 95 OR package < 45 OR image < min_image OR score < 80 THEN 'WARN' ELSE 'PASS' END AS quality, CASE WHEN imported < expected * 0.3 THEN 'FAIL' WHEN imported < expected * 0.8 THEN 'WARN' ELSE 'PASS' END AS benchmark FROM s""")
def a9(v: Views) -> DataFrame:
    stores = v.stores.select("store_id", "retailer")
    own = v.offers.join(stores, "store_id")
    o = own.groupBy("retailer").agg(F.count("*").alias("received"), F.count_if("local").alias("imported"), F.count_if(F.col("product_id") % 3 != 0).alias("units"), F.count_if(F.col("page") <= 5).alias("linked"), F.count_if(F.col("seen") > 0).alias("seen"))
    kinds = v.media.where("active").groupBy("product_id").agg(F.max(F.col("source").isin("official_product", "retailer_cdn")).alias("official"), F.max(F.col("source") == "prospect_crop").alias("crop"))
    p = own.select("retailer", "product_id").distinct().join(v.products, "product_id").join(kinds, "product_id", "left").groupBy("retailer").agg(F.count("*").alias("products"), F.count_if(F.col("grams") > 10).alias("packs"), F.count_if("official").alias("official"), F.count_if("crop").alias("crops"))
    j = o.join(p, "retailer")
    c, rate = F.col, R.rate
    image = F.floor(F.least(F.lit(100.0), rate(c("official"), c("products")) + rate(c("crops"), c("products")) * 0.5) * 10 + 0.5) / 10.0
    r = j.select("retailer", "imported", rate(c("imported"), c("received")).alias("imports"), rate(c("packs"), c("products")).alias("package"), rate(c("units"), c("received")).alias("unit"), image.alias("image"), rate(c("linked"), c("received")).alias("prov"), rate(c("seen"), c("received")).alias("occ"))
    s = r.withColumn("score", run_score(c("imports"), c("package"), c("unit"), c("image"), c("prov"), c("occ"), F.lit(0.0)))
    of = lambda table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c("retailer")), F.lit(other))
    expected, least_image = of(K.EXPECTED_OFFERS, K.EXPECTED_OFFERS_ELSE), of(K.MIN_IMAGE_RATE, K.MIN_IMAGE_RATE_ELSE)
    low = (c("imports") < K.MIN_IMPORT_RATE) | (c("prov") < K.MIN_PROVENANCE_RATE) | (c("package") < K.MIN_PACKAGE_RATE) | (c("image") < least_image) | (c("score") < 80)
    quality = F.when((c("imported") == 0) | (c("imports") < 50), "FAIL").when(low, "WARN").otherwise("PASS")
    benchmark = F.when(c("imported") < expected * K.FAIL_COUNT_RATIO, "FAIL").when(c("imported") < expected * K.PASS_COUNT_RATIO, "WARN").otherwise("PASS")
    return s.select("retailer", "imported", "score", quality.alias("quality"), benchmark.alias("benchmark"))


@query("a7_import_summary", r""" SELECT store_id, count(*) AS received, count(*) FILTER (WHERE why IS NULL) AS imported, count(*) FILTER (WHERE why = 'online') AS online, count(*) FILTER (WHERE why = 'quality') AS quality, count(*) FILTER (WHERE why = 'date') AS date
 FROM (SELECT t.store_id, CASE WHEN regexp_matches(lower(text), 'nur\s+online') THEN 'online' WHEN price > 5000 THEN 'quality' WHEN valid_from < DATE '1996-01-01' THEN 'date' END AS why FROM texts t) GROUP BY 1""")
def a7(v: Views) -> DataFrame:
    from korbwerk.operators.importer import rejection

    found = v.texts.withColumn("why", rejection(F.col("text"), F.col("price"), F.col("valid_from"), F.lit("1996-01-01").cast("date")))
    counts = [F.count_if(F.col("why") == w).alias(w) for w in ("online", "quality", "date")]
    return found.groupBy("store_id").agg(F.count("*").alias("received"), F.count_if(F.col("why").isNull()).alias("imported"), *counts)


@query("a18_match_rate", " SELECT store_id, count(*) AS anchors, count(*) FILTER (WHERE page <= 4) AS matched, floor(count(*) FILTER (WHERE page <= 4) / count(*)::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS rate, max(count(*)) OVER () AS most FROM offers GROUP BY 1")
def a18(v: Views) -> DataFrame:
    per = v.offers.groupBy("store_id").agg(F.count("*").alias("anchors"), F.count_if(F.col("page") <= 4).alias("matched"))
    return per.select("store_id", "anchors", "matched", R.rate(F.col("matched"), F.col("anchors")).alias("rate"), F.max("anchors").over(Window.partitionBy()).alias("most"))
