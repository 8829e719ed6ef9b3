"""Registered queries: corrections, pages, regions on a page, reviews, runs and golden results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions.text import fold
from korbwerk.operators import relational as R
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views

_ALIASES = ", aliases AS (SELECT product_id, lower(brand) || ' ' || product_name AS alias_key, CASE WHEN grams % 3 = 0 THEN 'admin-correction' WHEN grams % 3 = 1 THEN 'import' ELSE 'merge' END AS source FROM products)"


def aliases(v: Views) -> DataFrame:
    g = F.col("grams") % 3
    return v.products.select("product_id", F.concat_ws(" ", F.lower("brand"), "product_name").alias("alias_key"), F.when(g == 0, "admin-correction").when(g == 1, "import").otherwise("merge").alias("source"))


@query("j2_corrected_aliases", _ALIASES + " SELECT brand, a.alias_key, count(*) AS n FROM products p JOIN aliases a USING (product_id) WHERE source = 'admin-correction' GROUP BY 1, 2")
def j2(v: Views) -> DataFrame:
    return v.products.join(aliases(v).where("source = 'admin-correction'"), "product_id").groupBy("brand", "alias_key").agg(F.count("*").alias("n"))


@query(
    "j15_named_on_pages",
    """, pages_ AS (SELECT store_id, valid_from, page, upper(string_agg(product_name, ' / ' ORDER BY product_id, price)) AS text FROM offers JOIN products USING (product_id) GROUP BY 1, 2, 3)
 SELECT o.store_id, o.product_id, o.valid_from, o.price, min(p.page) AS page FROM offers o JOIN products USING (product_id) JOIN pages_ p ON p.store_id = o.store_id AND p.valid_from = o.valid_from AND contains(lower(p.text), lower(product_name)) WHERE length(product_name) >= 5 GROUP BY 1, 2, 3, 4""",
    dates="valid_from",
)
def j15(v: Views) -> DataFrame:
    """The first page of a store's leaflet on which an offer's name stands, without regard to case and accents."""
    named = v.offers.join(v.products.select("product_id", "product_name"), "product_id")
    pages = named.groupBy("store_id", "valid_from", "page").agg(F.array_sort(F.collect_list(F.struct("product_id", "price", "product_name"))).alias("c"))
    pages = pages.select("store_id", "valid_from", F.col("page").alias("on"), fold(F.lower(F.upper(F.array_join(F.transform("c", lambda x: x["product_name"]), " / ")))).alias("text"))
    found = named.withColumn("needle", fold(F.lower("product_name"))).where(F.length("needle") >= 5).join(pages, ["store_id", "valid_from"]).where(F.contains("text", F.col("needle")))
    return found.groupBy("store_id", "product_id", "valid_from", "price").agg(F.min("on").alias("page"))


_BOXES = ", b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n, (l_partkey * 37 % 300)::DOUBLE AS x, (l_partkey * 53 % 300)::DOUBLE AS y FROM lineitem)"


@query(
    "j24_prices_in_regions",
    _BOXES
    + """, j AS (SELECT p.page, p.n, p.x, p.y, r.n AS region, p.x + 15 BETWEEN r.x AND r.x + 80 AND p.y + 10 BETWEEN r.y AND r.y + 60 AS inside,
   greatest(least(p.x + 30, r.x + 80) - greatest(p.x, r.x), 0) * greatest(least(p.y + 20, r.y + 60) - greatest(p.y, r.y), 0) / 600.0::DOUBLE AS share FROM b p JOIN b r ON p.page = r.page AND NOT (p.n = r.n AND p.x = r.x AND p.y = r.y))
 SELECT page, n, x, y, count(*) AS regions, round(max(share), 6) AS share FROM j WHERE inside OR share >= 0.25 GROUP BY 1, 2, 3, 4""",
)
def j24(v: Views) -> DataFrame:
    """Prices that lie in a link's region on their page, by their centre or a quarter of their area."""
    k = F.col("l_partkey")
    b = v.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), (k * 37 % 300).cast("double").alias("x"), (k * 53 % 300).cast("double").alias("y")).distinct()
    r = b.select("page", F.col("n").alias("m"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    wide = F.greatest(F.least(F.col("x") + 30, F.col("rx") + 80) - F.greatest("x", "rx"), F.lit(0.0))
    high = F.greatest(F.least(F.col("y") + 20, F.col("ry") + 60) - F.greatest("y", "ry"), F.lit(0.0))
    inside = (F.col("x") + 15).between(F.col("rx"), F.col("rx") + 80) & (F.col("y") + 10).between(F.col("ry"), F.col("ry") + 60)
    j = b.join(r, "page").where(~((F.col("n") == F.col("m")) & (F.col("x") == F.col("rx")) & (F.col("y") == F.col("ry")))).withColumn("share", wide * high / 600.0)
    return j.where(inside | (F.col("share") >= 0.25)).groupBy("page", "n", "x", "y").agg(F.count("*").alias("regions"), F.round(F.max("share"), 6).alias("share"))


@query("t7_best_discounts", " SELECT store_id, product_id, valid_from, price, row_number() OVER (PARTITION BY store_id ORDER BY floor((1 - price / reference_price) * 1000 + 0.5) / 10.0::DOUBLE DESC, price, product_id, valid_from) AS place FROM price_references WHERE reference_price > price", dates="valid_from")
def t7(v: Views) -> DataFrame:
    """Each store's offers by their reduction, then their price."""
    r = v.references.where(F.col("reference_price") > F.col("price")).withColumn("d", F.floor((1 - F.col("price") / F.col("reference_price")) * 1000 + 0.5) / 10.0)
    return R.ranked(r, ["store_id"], [F.desc("d"), "price", "product_id", "valid_from"], "place").select("store_id", "product_id", "valid_from", "price", "place")


@query("t8_regions", " SELECT n_nationkey AS region_id, n_name AS name, n_regionkey AS status FROM nation ORDER BY status DESC, name")
def t8(v: Views) -> DataFrame:
    n = v.table("nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("status"))
    return n.orderBy(F.desc("status"), "name")


_KM = "(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(u.lat)) / 2), 2) + cos(radians(u.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(u.lon)) / 2), 2))))"


@query("u10_selected_and_near", f" SELECT user_id, store_id FROM favourites INTERSECT SELECT u.user_id, s.store_id FROM users u JOIN stores s ON s.lat IS NOT NULL WHERE s.active AND s.verified AND {_KM} <= u.radius_km")
def u10(v: Views) -> DataFrame:
    """Favourite stores that are released and within the radius."""
    return R.pairs_in_radius(v.favourites, v.users, v.stores.where("verified"))


_REVIEWS = ", old AS (SELECT l_orderkey AS id, l_linenumber % 2 = 0 AS quick, max(l_returnflag) AS verdict FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2 = 0) = 1), new AS (SELECT o_orderkey AS id, o_orderstatus AS verdict FROM orders WHERE o_custkey % 3 <> 0)"


@query("d12_quick_reviews", _REVIEWS + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR o.quick = false THEN o.verdict ELSE n.verdict END AS verdict, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' WHEN o.quick THEN 'replaced' ELSE 'protected' END AS what FROM old o FULL JOIN new n ON o.id = n.id")
def d12(v: Views) -> DataFrame:
    """Quick reviews are added, or replace quick ones; a full review stays."""
    line = v.table("lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 2 == 0).alias("quick")).agg(F.max("l_returnflag").alias("old"))
    old = R.top(line, ["id"], ["quick"])
    new = v.table("orders").where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("new"))
    j = old.join(new, "id", "full_outer")
    stays = F.col("new").isNull() | (F.coalesce("quick", F.lit(True)) == F.lit(False))
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").when(F.col("quick"), "replaced").otherwise("protected")
    return j.select("id", F.when(stays, F.col("old")).otherwise(F.col("new")).alias("verdict"), what.alias("what"))


@query(
    "d13_watched_runs",
    """, l AS (SELECT *, lead(started_at) OVER (PARTITION BY store_id ORDER BY started_at, run_id) AS next FROM runs), t AS (SELECT *, status = 'running' AND epoch(coalesce(next, TIMESTAMP '2024-02-01 00:00:00')) - epoch(started_at) > 550 AS stuck FROM l)
 SELECT store_id, count(*) AS runs, count(*) FILTER (WHERE stuck) AS timed_out, arg_max(CASE WHEN stuck THEN 'timeout' ELSE status END, (stuck, started_at, run_id)) AS state FROM t GROUP BY 1""",
)
def d13(v: Views) -> DataFrame:
    """Runs that are still running when the watchdog's limit is over time out; a time-out is never overwritten by a later state."""
    after = F.coalesce(F.lead("started_at").over(Window.partitionBy("store_id").orderBy("started_at", "run_id")), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    seconds = after.cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    t = v.runs.withColumn("stuck", (F.col("status") == "running") & (seconds > K.WATCHDOG_SECONDS)).withColumn("state", F.when(F.col("stuck"), "timeout").otherwise(F.col("status")))
    return t.groupBy("store_id").agg(F.count("*").alias("runs"), F.count_if("stuck").alias("timed_out"), F.max_by("state", F.struct("stuck", "started_at", "run_id")).alias("state"))


_GOLD = """, e AS (SELECT o.store_id, o.product_id, o.valid_from, o.price, s.retailer FROM current_offers o JOIN stores s USING (store_id)),
 want AS (SELECT * REPLACE (CASE WHEN product_id % 10 = 0 THEN price + 0.02 WHEN product_id % 10 = 1 THEN price + 0.01 ELSE price END AS price), price AS id_price FROM e WHERE product_id % 7 <> 0),
 got AS (SELECT *, price AS id_price FROM e WHERE product_id % 11 <> 0),
 j AS (SELECT coalesce(g.retailer, w.retailer) AS retailer, g.price IS NOT NULL AND w.price IS NOT NULL AND abs(g.price - w.price) <= 0.011 AS hit, g.price IS NOT NULL AS got, w.price IS NOT NULL AS wanted
  FROM got g FULL JOIN want w ON g.store_id = w.store_id AND g.product_id = w.product_id AND g.valid_from = w.valid_from AND g.id_price = w.id_price),
 c AS (SELECT retailer, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE got AND NOT hit) AS fp, count(*) FILTER (WHERE wanted AND NOT hit) AS fn FROM j GROUP BY 1)
 SELECT retailer, tp, fp, fn, floor(tp / (tp + fp)::DOUBLE * 10000 + 0.5) / 100.0::DOUBLE AS "precision", floor(tp / (tp + fn)::DOUBLE * 10000 + 0.5) / 100.0::DOUBLE AS recall, tp / (tp + fp)::DOUBLE >= 0.99 AND tp / (tp + fn)::DOUBLE >= 0.99 AS pass FROM c"""


def golden(got: DataFrame, want: DataFrame, key: list[str], by: str) -> DataFrame:
    """Counts, precision and recall by group: rows with a price within the tolerance are hits; one that is off counts as too much and as missing."""
    j = got.select(*key, F.col(by).alias("g_by"), F.col("price").alias("g")).join(want.select(*key, F.col(by).alias("w_by"), F.col("price").alias("w")), key, "full_outer")
    hit = F.coalesce(F.abs(F.col("g") - F.col("w")) <= K.GOLDEN_TOLERANCE, F.lit(False))
    c = j.groupBy(F.coalesce("g_by", "w_by").alias(by)).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("w").isNotNull() & ~hit).alias("fn"))
    tp = F.col("tp")
    enough = lambda x: tp >= K.GOLDEN_LEAST * (tp + F.col(x))
    return c.select(by, "tp", "fp", "fn", R.rate(tp, tp + F.col("fp"), 2).alias("precision"), R.rate(tp, tp + F.col("fn"), 2).alias("recall"), (enough("fp") & enough("fn")).alias("pass"))


@query("a12_golden_results", _GOLD)
def a12(v: Views) -> DataFrame:
    e = v.current.join(v.stores.select("store_id", "retailer"), "store_id").select("store_id", "product_id", "valid_from", "retailer", "price", F.col("price").alias("id_price"))
    p = F.col("product_id")
    want = e.where(p % 7 != 0).withColumn("price", F.when(p % 10 == 0, F.col("price") + 0.02).when(p % 10 == 1, F.col("price") + 0.01).otherwise(F.col("price")))
    return golden(e.where(p % 11 != 0), want, ["store_id", "product_id", "valid_from", "id_price"], "retailer")


@query("fs19_fs20_labels", " SELECT user_id, CASE WHEN count(*) = 1 THEN min(retailer) ELSE count(*) || ' Märkte' END AS label, count(DISTINCT retailer) AS chains FROM favourites JOIN stores USING (store_id) GROUP BY 1")
def fs19(v: Views) -> DataFrame:
    """A user's markets in a few words: the chain that the market's text names, or their number."""
    from korbwerk.functions.text import retailer

    j = v.favourites.join(v.stores, "store_id").withColumn("chain", F.coalesce(retailer(F.concat_ws(" ", F.lit("Prospekt"), "retailer", F.lit("KW 25"))), F.col("retailer")))
    return j.groupBy("user_id").agg(F.when(F.count("*") == 1, F.min("chain")).otherwise(F.concat(F.count("*"), F.lit(" Märkte"))).alias("label"), F.count_distinct("chain").alias("chains"))


@query("s12_embedded_state", " SELECT event_id, props AS state FROM events")
def s12(v: Views) -> DataFrame:
    """JSON that a page carries in a script, read back from the page."""
    html = F.concat(F.lit('<html><script>var x = 1;</script><script id="state" type="application/json">'), "props", F.lit("</script><p>y</p></html>"))
    return v.table("events").select("event_id", F.regexp_extract(html, r'(?is)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1).alias("state"))


@query("s14_leaflet_list", " SELECT store_id, day, valid_from::VARCHAR AS starts, '/prospekt/' || store_id AS url FROM archives WHERE valid_from IS NOT NULL", dates="day")
def s14(v: Views) -> DataFrame:
    """Leaflets out of a page's anchors, with the range of dates in their titles."""
    from korbwerk.functions.dates import parse_date

    title = F.concat(F.lit("Angebote vom "), F.coalesce(F.date_format("valid_from", "dd.MM.yyyy"), F.lit("bald")), F.lit(" bis "), F.date_format("valid_to", "dd.MM.yyyy"))
    html = F.concat(F.lit('<a class="x" href="/prospekt/'), "store_id", F.lit('" title="'), title, F.lit('">Blättern</a>'))
    a = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*?title="([^"]*)"'
    told = F.regexp_extract(html, a, 2)
    found = v.archives.select("store_id", "day", parse_date(F.regexp_extract(told, r"vom\s+(\d{1,2}\.\d{1,2}\.\d{4})", 1)).alias("d"), F.regexp_extract(html, a, 1).alias("url"))
    return found.where("d IS NOT NULL").select("store_id", "day", F.col("d").cast("string").alias("starts"), "url")


@query(
    "w8_plausible_rows",
    """, r AS (SELECT store_id, product_name, grams, valid_from, price, page, CASE WHEN page % 3 = 0 THEN 0.08 ELSE abs(price - floor(price * (96 + page % 5 * 2) + 0.5) / 100.0::DOUBLE) / greatest(price, 0.05) END AS off FROM offers JOIN products USING (product_id))
 SELECT store_id, product_name, grams, valid_from, arg_min(price, (off, page, price)) AS price, round(min(off), 6) AS off FROM r GROUP BY 1, 2, 3, 4""",
    dates="valid_from",
)
def w8(v: Views) -> DataFrame:
    """Of rows with one name, package and validity the one whose price fits its unit price best; 0.08 off where that can't be told."""
    shown = F.floor(F.col("price") * (96 + F.col("page") % 5 * 2) + 0.5) / 100.0
    off = F.when(F.col("page") % 3 == 0, K.PLAUSIBLE_ELSE).otherwise(F.abs(F.col("price") - shown) / F.greatest("price", F.lit(K.LEAST_PRICE)))
    rows = v.offers.join(v.products, "product_id").withColumn("off", off)
    return rows.groupBy("store_id", "product_name", "grams", "valid_from").agg(F.min_by("price", F.struct("off", "page", "price")).alias("price"), F.round(F.min("off"), 6).alias("off"))
