"""The domain's tables, derived from the driver's generic tables, as DataFrames and as the same DuckDB CTEs.

Only whole-number arithmetic and one rounding rule (half up, by floor) are used, which both engines evaluate alike.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korbwerk.constants import MEDIA_PRIORITY, RETAILERS

AS_OF = "1998-06-15"
#: Spells of an offer, in days.
VALID_DAYS, FAVOURITES = 180, 6
STATUSES = {"purchase": "success", "view": "no_offers", "click": "warning", "error": "failed", "signup": "running"}


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100.0


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def stores(self) -> DataFrame:
        s = F.col("s_suppkey")
        place = lambda k, at: F.when(s % 17 != 0, at + (s * k % 1000) / 1000.0)
        return self.table("supplier").select(
            s.alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.element_at(F.array(*map(F.lit, RETAILERS)), (F.col("s_nationkey") % 7 + 1).cast("int")).alias("retailer"),
            place(37, 50.0).alias("lat"),
            place(53, 7.0).alias("lon"),
            (s % 11 != 0).alias("active"),
            (s % 3 != 0).alias("verified"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"), F.col("p_size").alias("grams"), F.col("p_type").alias("kind"))

    @property
    def _offered(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            F.to_date("l_shipdate").alias("valid_from"),
            cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            (F.col("l_returnflag") != "R").alias("local"),
            F.col("l_linenumber").alias("page"),
        )

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("store_id", "product_id", "valid_from", "price").agg(F.max("local").alias("local"), F.max("page").alias("page"), F.count("*").alias("seen")).withColumn("valid_to", F.date_add("valid_from", VALID_DAYS))

    @cached_property
    def offers(self) -> DataFrame:
        """One row for each (store, product, valid_from, price)."""
        return self._merged(self._offered)

    @cached_property
    def offers_by_product(self) -> DataFrame:
        """`offers`, merged where their product stands: a join with large products needs no shuffle of its own."""
        return self._merged(self._offered.repartition("product_id"))

    @cached_property
    def current(self) -> DataFrame:
        return self.offers.where((F.col("valid_from") <= as_of()) & (F.col("valid_to") >= as_of()) & F.col("local"))

    @cached_property
    def users(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(c.alias("user_id"), (50.0 + (c * 37 % 1000) / 1000.0).alias("lat"), (7.0 + (c * 53 % 1000) / 1000.0).alias("lon"), (15 + c % 35).alias("radius_km"))

    @cached_property
    def bought(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user_id"))
        return self.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"), "l_quantity").join(orders, "k")

    @cached_property
    def items(self) -> DataFrame:
        return self.bought.groupBy("user_id", "product_id").agg(F.sum("l_quantity").alias("quantity"))

    @cached_property
    def favourites(self) -> DataFrame:
        visits = self.bought.groupBy("user_id", "store_id").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "store_id"))
        return visits.withColumn("r", rank).where(F.col("r") <= FAVOURITES).select("user_id", "store_id")

    @cached_property
    def runs(self) -> DataFrame:
        status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv]), F.col("event_type"))
        kind = F.when(F.col("event_id") % 2 == 0, ":web").otherwise(":pdf")
        return self.table("events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("store_id"), F.col("ts").alias("started_at"), status.alias("status"), F.concat(F.lit("source"), kind).alias("source_key"), "value")

    @cached_property
    def references(self) -> DataFrame:
        """A former price for two of three products' offers; at times below the price."""
        p = F.col("product_id")
        return self.offers.where(p % 3 != 0).select("store_id", "product_id", "valid_from", "price", cents(F.col("price") * (95 + p % 4 * 10) / 100.0).alias("reference_price"), F.when(p % 2 == 0, "regular").otherwise("uvp").alias("reference_type"))

    @cached_property
    def archives(self) -> DataFrame:
        """A leaflet for two of three days on which a store has offers; every seventh store's leaflets have no first day."""
        days = self.offers.select("store_id", F.col("valid_from").alias("day")).distinct()
        number = F.datediff("day", F.lit("1970-01-01").cast("date"))
        return days.where((number + F.col("store_id")) % 3 != 0).select(
            "store_id", "day", F.when(F.col("store_id") % 7 != 0, F.col("day")).alias("valid_from"), F.date_add("day", VALID_DAYS).alias("valid_to"), (4 + F.col("store_id") % 4).alias("pages")
        )

    @cached_property
    def media(self) -> DataFrame:
        sources = F.array(*map(F.lit, MEDIA_PRIORITY))
        p, i = F.col("product_id"), F.col("i")
        rows = self.products.select("product_id", F.explode(F.when(F.col("grams") % 4 > 0, F.sequence(F.lit(1), F.col("grams") % 4))).alias("i"))
        return rows.select((p * 4 + i).alias("media_id"), "product_id", F.element_at(sources, ((p + i) % 5 + 1).cast("int")).alias("source"), ((p * i) % 3 == 0).alias("is_primary"), ((p + i) % 7 != 0).alias("active"))

    @cached_property
    def texts(self) -> DataFrame:
        """Wording of each offer as a retailer's card would have it."""
        de = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.", ",")
        p, price = F.col("product_id"), F.col("price")
        pay = F.element_at(
            F.array(
                F.lit(""), F.lit("3 für 2"), F.lit("2 + 1 gratis"), F.concat(F.lit("-"), (p % 60 + 5).cast("string"), F.lit("%")), F.concat(F.lit("ab 3 Stück "), de(cents(price * 0.8)), F.lit(" €")), F.lit("nur online")
            ),
            (p % 6 + 1).cast("int"),
        )
        pack = F.when(p % 2 == 0, F.concat(F.lit("je "), (p % 9 + 1) * 100, F.lit("-g-Packung"))).otherwise(F.concat(F.lit("je "), p % 5 + 2, F.lit(" x 0,33-l-Fl.")))
        return self.offers.select("store_id", "product_id", "valid_from", "price", F.concat_ws(" ", pack, F.concat(F.lit("(1 kg = "), de(cents(price * 2)), F.lit(" €)")), pay).alias("text"))


_SOURCES = ", ".join(f"'{x}'" for x in MEDIA_PRIORITY)
_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items())
_DE = "replace(printf('%.2f', {}), '.', ',')"
_CENTS = "floor(({}) * 100 + 0.5) / 100.0::DOUBLE"

SQL = f"""
stores AS (SELECT s_suppkey AS store_id, s_name AS store_name, (ARRAY[{", ".join(f"'{x}'" for x in RETAILERS)}])[s_nationkey % 7 + 1] AS retailer,
  CASE WHEN s_suppkey % 17 <> 0 THEN 50.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE END AS lat,
  CASE WHEN s_suppkey % 17 <> 0 THEN 7.0::DOUBLE + (s_suppkey * 53 % 1000) / 1000.0::DOUBLE END AS lon, s_suppkey % 11 <> 0 AS active, s_suppkey % 3 <> 0 AS verified FROM supplier),
products AS (SELECT p_partkey AS product_id, p_brand AS brand, p_name AS product_name, p_size AS grams, p_type AS kind FROM part),
offers AS (SELECT l_suppkey AS store_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS valid_from, {_CENTS.format("l_extendedprice / l_quantity")} AS price,
  max(l_returnflag <> 'R') AS local, max(l_linenumber) AS page, count(*) AS seen, CAST(l_shipdate AS DATE) + {VALID_DAYS} AS valid_to FROM lineitem GROUP BY 1, 2, 3, 4, 8),
current_offers AS (SELECT * FROM offers WHERE valid_from <= DATE '{AS_OF}' AND valid_to >= DATE '{AS_OF}' AND local),
users AS (SELECT c_custkey AS user_id, 50.0::DOUBLE + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lat, 7.0::DOUBLE + (c_custkey * 53 % 1000) / 1000.0::DOUBLE AS lon, 15 + c_custkey % 35 AS radius_km FROM customer),
bought AS (SELECT o_custkey AS user_id, l_partkey AS product_id, l_suppkey AS store_id, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
items AS (SELECT user_id, product_id, sum(l_quantity) AS quantity FROM bought GROUP BY 1, 2),
favourites AS (SELECT user_id, store_id FROM (SELECT user_id, store_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, store_id) AS r FROM bought GROUP BY 1, 2) WHERE r <= {FAVOURITES}),
runs AS (SELECT event_id AS run_id, user_id AS store_id, ts AS started_at, CASE event_type {_STATUS} END AS status, 'source' || CASE WHEN event_id % 2 = 0 THEN ':web' ELSE ':pdf' END AS source_key, value FROM events),
price_references AS (SELECT store_id, product_id, valid_from, price, {_CENTS.format("price * (95 + product_id % 4 * 10) / 100.0::DOUBLE")} AS reference_price, CASE WHEN product_id % 2 = 0 THEN 'regular' ELSE 'uvp' END AS reference_type FROM offers WHERE product_id % 3 <> 0),
archives AS (SELECT DISTINCT store_id, valid_from AS day, CASE WHEN store_id % 7 <> 0 THEN valid_from END AS valid_from, valid_from + {VALID_DAYS} AS valid_to, 4 + store_id % 4 AS pages FROM offers WHERE (date_diff('day', DATE '1970-01-01', valid_from) + store_id) % 3 <> 0),
media AS (SELECT product_id * 4 + i AS media_id, product_id, (ARRAY[{_SOURCES}])[(product_id + i) % 5 + 1] AS source, (product_id * i) % 3 = 0 AS is_primary, (product_id + i) % 7 <> 0 AS active FROM (SELECT product_id, unnest(range(1, grams % 4 + 1)) AS i FROM products)),
texts AS (SELECT store_id, product_id, valid_from, price, concat_ws(' ', CASE WHEN product_id % 2 = 0 THEN 'je ' || (product_id % 9 + 1) * 100 || '-g-Packung' ELSE 'je ' || (product_id % 5 + 2) || ' x 0,33-l-Fl.' END,
  '(1 kg = ' || {_DE.format(_CENTS.format("price * 2"))} || ' €)', (ARRAY['', '3 für 2', '2 + 1 gratis', '-' || (product_id % 60 + 5) || '%', 'ab 3 Stück ' || {_DE.format(_CENTS.format("price * 0.8::DOUBLE"))} || ' €', 'nur online'])[product_id % 6 + 1]) AS text FROM offers)
"""
