"""Registered queries over persisted state: upserts of market snapshots, and cached extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.plans.registry import query
from korbwerk.plans.views import Views
from korbwerk.sources.snapshots import ExtractionCache, Snapshot, fresh_root

SPLIT = "1996-01-01"
#: Markets share so many folders of the snapshot, however many there are.
SHARDS = 96


@query(
    "k4_market_snapshot",
    f""", a AS (SELECT store_id, product_id, max((price, valid_from)) AS m FROM offers WHERE valid_from < DATE '{SPLIT}' GROUP BY 1, 2), b AS (SELECT store_id, product_id, max((price, valid_from)) AS m FROM offers WHERE valid_from >= DATE '{SPLIT}' AND store_id % 3 <> 0 GROUP BY 1, 2)
 SELECT store_id, product_id, coalesce(b.m[1], a.m[1]) AS price, coalesce(b.m[2], a.m[2]) AS valid_from FROM a FULL JOIN b USING (store_id, product_id)""",
    dates="valid_from",
)
def k4(v: Views) -> DataFrame:
    """The highest price of a product in a market: a first load, then later offers of two of three markets, and these once more."""
    s = Snapshot(v.spark, fresh_root(v.spark, "snapshot"), "store_id long, product_id long, price double, valid_from date, shard int", ["store_id", "product_id", "shard"], "shard")
    offers = v.offers.withColumn("shard", F.pmod("store_id", F.lit(SHARDS)).cast("int"))
    late = F.col("valid_from") >= F.lit(SPLIT).cast("date")
    changed = offers.where(late & (F.col("store_id") % 3 != 0))
    for batch in (offers.where(~late), changed, changed):
        s.upsert(batch)
    return s.read().drop("shard")


@query(
    "k6_cached_lines",
    """, c AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha256, coalesce(text, '') AS text FROM documents)
 SELECT sha256, CASE WHEN sha256 < '8' THEN 'v2' ELSE 'v1' END AS version, len(list_filter(string_split(text, chr(10)), lambda l: l <> ''))::INT AS lines FROM c""",
)
def k6(v: Views) -> DataFrame:
    """Lines of each text, by content: all by version 1, then those with small keys by version 2; what is held under the newest version stands."""
    cache = ExtractionCache(v.spark, fresh_root(v.spark, "extractions"), "string")
    text = F.coalesce("text", F.lit(""))
    docs = v.table("documents").select(F.sha2(text, 256).alias("sha256"), text.alias("text"))
    lines = lambda new: new.select("sha256", F.filter(F.split("text", "\n", -1), lambda x: x != "").alias("result"))
    old = cache.extracted(docs, "v1", lines)
    new = cache.extracted(docs.where("sha256 < '8'"), "v2", lines)
    rest = old.join(new.select("sha256"), "sha256", "left_anti")
    return new.withColumn("version", F.lit("v2")).unionByName(rest.withColumn("version", F.lit("v1"))).select("sha256", "version", F.size("result").alias("lines"))
