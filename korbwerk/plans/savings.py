"""The savings plan: which stores to visit, one to three or any number, what to buy where, and what the trip costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.constants import EUR_PER_KM, MAX_STORES, WORTH_SAVING
from korbwerk.functions.geo import haversine_km
from korbwerk.functions.price import half_up
from korbwerk.operators import relational as R
from korbwerk.operators.trips import all_plans, round_trip_km
from korbwerk.plans.registry import query
from korbwerk.plans.views import Views


def store_sets(candidates: DataFrame, most: int = MAX_STORES) -> DataFrame:
    """(user_id, stores): every set of one to `most` of a user's candidate stores (user_id, store_id), in order of id."""
    sets = candidates.select("user_id", F.array("store_id").alias("stores"))
    found = [sets]
    for _ in range(1, most):
        sets = sets.join(candidates, "user_id").where(F.col("store_id") > F.element_at("stores", -1)).select("user_id", F.array_append("stores", F.col("store_id")).alias("stores"))
        found.append(sets)
    return reduce(DataFrame.unionByName, found)


def evaluated(sets: DataFrame, offers: DataFrame, items: DataFrame, users: DataFrame, stores: DataFrame) -> DataFrame:
    """Each set with the cheapest purchase it allows: goods, covered items, stores used, kilometres and total."""
    best = offers.groupBy("store_id", "product_id").agg(F.min("price").alias("price"))
    wanted = items.join(best, "product_id").select("user_id", "product_id", "store_id", "price", "quantity")
    inside = sets.withColumn("store_id", F.explode("stores")).join(wanted, ["user_id", "store_id"])
    picked = inside.groupBy("user_id", "stores", "product_id").agg(F.min(F.struct("price", "store_id", "quantity")).alias("p"))
    goods = picked.groupBy("user_id", "stores").agg(F.sum(F.col("p.price") * F.col("p.quantity")).alias("goods"), F.count("*").alias("covered"), F.array_sort(F.collect_set("p.store_id")).alias("used"))
    places = stores.where("lat IS NOT NULL").select(F.col("store_id"), "lat", "lon")
    stops = goods.select("user_id", "stores", F.explode("used").alias("store_id")).join(places, "store_id").groupBy("user_id", "stores").agg(F.array_sort(F.collect_list(F.struct("store_id", "lat", "lon"))).alias("stops"))
    home = users.select("user_id", F.struct("lat", "lon").alias("home"))
    found = goods.join(stops, ["user_id", "stores"], "left").join(home, "user_id")
    none = F.array().cast("array<struct<store_id:bigint,lat:double,lon:double>>")
    found = found.withColumn("km", round_trip_km(F.col("home"), F.coalesce("stops", none)))
    return found.select("user_id", "stores", "used", "covered", half_up(F.col("goods"), 2).alias("goods"), "km", half_up(F.col("goods") + F.col("km") * EUR_PER_KM, 2).alias("total"))


def plans(found: DataFrame, offered: DataFrame) -> DataFrame:
    """The best set of each user: most items covered, then the least total in cents, the fewest stores used, the cheapest goods; with the best single store that covers as many as are offered."""
    w = Window.partitionBy("user_id").orderBy(F.desc("covered"), "total", F.size("used"), "goods", "used", F.size("stores"), "stores")
    best = found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    full = found.join(offered, "user_id").where((F.size("stores") == 1) & (F.col("covered") == F.col("offered")))
    single = full.groupBy("user_id").agg(F.min(F.struct("total", F.col("stores")[0].alias("store_id"))).alias("s"))
    saving = F.col("s.total") - F.col("total")
    return (
        best.join(offered, "user_id").join(single, "user_id", "left")
        .select("user_id", F.array_join("used", ",").alias("store_ids"), "offered", "covered", "goods", half_up(F.col("km"), 3).alias("km"), "total", F.col("s.store_id").alias("single_store"), F.col("s.total").alias("single_total"), half_up(saving, 2).alias("saving"), ((saving > WORTH_SAVING) & (F.size("used") > 1)).alias("worth_it"))
    )


def savings_plan(v: Views, most: int = MAX_STORES) -> DataFrame:
    """Plans of all users over the current offers of their selected stores."""
    selected = R.selected_stores(v.users, v.favourites, v.stores)
    offers = v.current.join(selected, "store_id", "left_semi")
    mine = v.items.join(selected, "user_id").join(offers.groupBy("store_id", "product_id").agg(F.min("price").alias("price")), ["store_id", "product_id"])
    offered = mine.groupBy("user_id").agg(F.count_distinct("product_id").alias("offered"))
    candidates = mine.select("user_id", "store_id").distinct()
    return plans(evaluated(store_sets(candidates, most), offers, v.items, v.users, v.stores), offered)


_H = lambda a, b: f"(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
_SELECTED = f""",
selected AS (SELECT f.user_id, f.store_id FROM favourites f JOIN users u USING (user_id) JOIN stores s USING (store_id) WHERE s.active AND s.verified AND NOT coalesce({_H("u", "s")} > u.radius_km, false)),
best AS (SELECT store_id, product_id, min(price) AS price FROM current_offers WHERE store_id IN (SELECT store_id FROM selected) GROUP BY 1, 2),
mine AS (SELECT i.user_id, i.product_id, s.store_id, b.price, i.quantity FROM items i JOIN selected s USING (user_id) JOIN best b USING (store_id, product_id)),
offered AS (SELECT user_id, count(DISTINCT product_id) AS offered FROM mine GROUP BY 1),
c AS (SELECT DISTINCT user_id, store_id FROM mine),
sets AS (SELECT user_id, [store_id] AS stores FROM c UNION ALL SELECT a.user_id, [a.store_id, b.store_id] FROM c a JOIN c b ON a.user_id = b.user_id AND a.store_id < b.store_id
  UNION ALL SELECT a.user_id, [a.store_id, b.store_id, d.store_id] FROM c a JOIN c b ON a.user_id = b.user_id AND a.store_id < b.store_id JOIN c d ON d.user_id = a.user_id AND b.store_id < d.store_id),
picked AS (SELECT s.user_id, s.stores, m.product_id, min((m.price, m.store_id, m.quantity)) AS p FROM sets s JOIN mine m ON m.user_id = s.user_id AND list_contains(s.stores, m.store_id) GROUP BY 1, 2, 3),
goods AS (SELECT user_id, stores, sum(p[1] * p[3]) AS goods, count(*) AS covered, list_sort(list_distinct(list(p[2]))) AS used FROM picked GROUP BY 1, 2),
legs AS (SELECT g.user_id, g.stores, u.lat AS hlat, u.lon AS hlon, list((s.store_id, s.lat, s.lon) ORDER BY s.store_id) FILTER (WHERE s.lat IS NOT NULL) AS st FROM goods g, unnest(g.used) x(sid) JOIN stores s ON s.store_id = sid JOIN users u ON u.user_id = g.user_id GROUP BY 1, 2, 3, 4),
p0 AS (SELECT user_id, stores, hlat, hlon, unnest(st) AS s FROM legs WHERE st IS NOT NULL),
perm AS (SELECT a.user_id, a.stores, a.hlat, a.hlon, [a.s] AS path, (SELECT len(l.st) FROM legs l WHERE l.user_id = a.user_id AND l.stores = a.stores) AS n FROM p0 a),
"""


def _route_sql() -> str:
    """The nearest-neighbour trip in three steps, each taking the nearest stop left."""
    d = lambda alat, alon, b: f"(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians({b}[2]) - radians({alat})) / 2), 2) + cos(radians({alat})) * cos(radians({b}[2])) * pow(sin((radians({b}[3]) - radians({alon})) / 2), 2))))"
    return f"""
r0 AS (SELECT user_id, stores, hlat, hlon, hlat AS lat, hlon AS lon, 0.0::DOUBLE AS km, coalesce(st, []) AS lft FROM legs),
r1 AS (SELECT user_id, stores, hlat, hlon, km, lft, list_min([({d("lat", "lon", "x")}, x[1], x[2], x[3]) for x in lft]) AS t, lat, lon FROM r0),
q1 AS (SELECT user_id, stores, hlat, hlon, coalesce(t[3], lat) AS lat, coalesce(t[4], lon) AS lon, km + coalesce(t[1], 0) AS km, [x for x in lft if x[1] <> t[2]] AS lft FROM r1),
r2 AS (SELECT user_id, stores, hlat, hlon, km, lft, list_min([({d("lat", "lon", "x")}, x[1], x[2], x[3]) for x in lft]) AS t, lat, lon FROM q1),
q2 AS (SELECT user_id, stores, hlat, hlon, coalesce(t[3], lat) AS lat, coalesce(t[4], lon) AS lon, km + coalesce(t[1], 0) AS km, [x for x in lft if x[1] <> t[2]] AS lft FROM r2),
r3 AS (SELECT user_id, stores, hlat, hlon, km, lft, list_min([({d("lat", "lon", "x")}, x[1], x[2], x[3]) for x in lft]) AS t, lat, lon FROM q2),
q3 AS (SELECT user_id, stores, hlat, hlon, coalesce(t[3], lat) AS lat, coalesce(t[4], lon) AS lon, km + coalesce(t[1], 0) AS km FROM r3),
trips AS (SELECT user_id, stores, 1.25::DOUBLE * (km + {d("lat", "lon", "(0, hlat, hlon)")}) AS km FROM q3),
ev AS (SELECT g.user_id, g.stores, used, covered, floor(goods * 100 + 0.5) / 100.0::DOUBLE AS goods, km, floor((goods + km * 0.15::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS total FROM goods g JOIN trips USING (user_id, stores)),
best1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY covered DESC, total, len(used), goods, used, len(stores), stores) AS r FROM ev QUALIFY r = 1),
single AS (SELECT user_id, min((total, stores[1])) AS s FROM ev JOIN offered USING (user_id) WHERE len(stores) = 1 AND covered = offered GROUP BY 1)
"""


_PLAN_SQL = (
    _SELECTED.replace("perm AS (SELECT a.user_id, a.stores, a.hlat, a.hlon, [a.s] AS path, (SELECT len(l.st) FROM legs l WHERE l.user_id = a.user_id AND l.stores = a.stores) AS n FROM p0 a),\n", "").replace(
        "p0 AS (SELECT user_id, stores, hlat, hlon, unnest(st) AS s FROM legs WHERE st IS NOT NULL),\n", ""
    )
    + _route_sql()
    + """ SELECT b.user_id, array_to_string(used, ',') AS store_ids, offered, covered, goods, floor(km * 1000 + 0.5) / 1000.0::DOUBLE AS km, total, s[2] AS single_store, s[1] AS single_total,
 floor((s[1] - total) * 100 + 0.5) / 100.0::DOUBLE AS saving, s[1] - total > 0.01 AND len(used) > 1 AS worth_it FROM best1 b JOIN offered USING (user_id) LEFT JOIN single USING (user_id)"""
)


@query("o1_savings_plan", _PLAN_SQL)
def o1(v: Views) -> DataFrame:
    return savings_plan(v)


_ALL_SQL = (
    _SELECTED.split("sets AS (")[0].replace("FROM favourites f", "FROM (SELECT DISTINCT user_id, store_id FROM bought) f")
    + """l AS (SELECT user_id, list(store_id ORDER BY store_id) AS l FROM c GROUP BY 1),
sets AS (SELECT user_id, [l[i] for i in range(1, len(l) + 1) if (m >> (i - 1)) & 1 = 1] AS stores FROM l, unnest(range(1, 1::BIGINT << len(l))) t(m)),
picked AS (SELECT s.user_id, s.stores, m.product_id, min((m.price, m.store_id, m.quantity)) AS p FROM sets s JOIN mine m ON m.user_id = s.user_id AND list_contains(s.stores, m.store_id) GROUP BY 1, 2, 3),
goods AS (SELECT user_id, stores, sum(p[1] * p[3]) AS goods, count(*) AS covered, list_sort(list_distinct(list(p[2]))) AS used FROM picked GROUP BY 1, 2),
legs AS (SELECT g.user_id, g.used, u.lat AS hlat, u.lon AS hlon, coalesce(list((s.store_id, s.lat, s.lon) ORDER BY s.store_id) FILTER (WHERE s.lat IS NOT NULL), []) AS st FROM (SELECT DISTINCT user_id, used FROM goods) g, unnest(g.used) x(sid) JOIN stores s ON s.store_id = sid JOIN users u ON u.user_id = g.user_id GROUP BY 1, 2, 3, 4),
walked AS (WITH RECURSIVE w(user_id, used, hlat, hlon, lat, lon, km, lft) AS (
  SELECT user_id, used, hlat, hlon, hlat, hlon, 0.0::DOUBLE, st FROM legs
  UNION ALL
  SELECT user_id, used, hlat, hlon, t[3], t[4], km + t[1], [x for x in lft if x[1] <> t[2]] FROM (SELECT *, list_min([(WAY, x[1], x[2], x[3]) for x in lft]) AS t FROM w WHERE len(lft) > 0) q) SELECT * FROM w WHERE len(lft) = 0),
ev AS (SELECT g.user_id, g.stores, g.used, covered, floor(goods * 100 + 0.5) / 100.0::DOUBLE AS goods, km, floor((goods + km * 0.15::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS total FROM goods g JOIN (SELECT user_id, used, 1.25::DOUBLE * (km + HOME) AS km FROM walked) USING (user_id, used)),
best1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY covered DESC, total, len(used), goods, used) AS r FROM ev QUALIFY r = 1),
single AS (SELECT user_id, min((total, stores[1])) AS s FROM ev JOIN offered USING (user_id) WHERE len(stores) = 1 AND covered = offered GROUP BY 1)
 SELECT b.user_id, array_to_string(used, ',') AS store_ids, offered, covered, goods, floor(km * 1000 + 0.5) / 1000.0::DOUBLE AS km, total, s[2] AS single_store, s[1] AS single_total,
 floor((s[1] - total) * 100 + 0.5) / 100.0::DOUBLE AS saving, s[1] - total > 0.01 AND len(used) > 1 AS worth_it, coalesce(covered = offered AND len(used) = 1 AND s[2] = used[1], false) AS one_market
 FROM best1 b JOIN offered USING (user_id) LEFT JOIN single USING (user_id)"""
).replace("WAY", "(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(x[2]) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(x[2])) * pow(sin((radians(x[3]) - radians(lon)) / 2), 2))))").replace(
    "HOME", "(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(hlat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(hlat)) * pow(sin((radians(hlon) - radians(lon)) / 2), 2))))"
)


@query("o1_o6_unlimited_plan", _ALL_SQL)
def o6(v: Views) -> DataFrame:
    """The best plan over any number of stores, of all that a user ever bought from, and whether one store covers all that is on offer."""
    selected = R.selected_stores(v.users, v.bought.select("user_id", "store_id").distinct(), v.stores)
    best = v.current.groupBy("store_id", "product_id").agg(F.min("price").alias("price"))
    found, offered = all_plans(v.items.join(selected, "user_id").join(best, ["store_id", "product_id"]), v.users, v.stores)
    one = (F.col("covered") == F.col("offered")) & (F.col("single_store").cast("string") == F.col("store_ids"))
    return plans(found, offered).withColumn("one_market", F.coalesce(one, F.lit(False)))


@query(
    "o7_route_legs",
    f""", near AS (SELECT f.user_id, f.store_id, s.lat, s.lon, u.lat AS hlat, u.lon AS hlon, {_H("u", "s")} AS km FROM favourites f JOIN users u USING (user_id) JOIN stores s USING (store_id) WHERE s.active AND s.verified AND s.lat IS NOT NULL AND NOT coalesce({_H("u", "s")} > u.radius_km, false)),
 r AS (SELECT *, row_number() OVER w AS leg, coalesce(lag(lat) OVER w, hlat) AS plat, coalesce(lag(lon) OVER w, hlon) AS plon FROM near WINDOW w AS (PARTITION BY user_id ORDER BY km, store_id)),
 g AS (SELECT user_id, leg, store_id, floor({_H("(SELECT plat AS lat, plon AS lon)", "x").replace("(SELECT plat AS lat, plon AS lon).lat", "plat").replace("(SELECT plat AS lat, plon AS lon).lon", "plon").replace("x.lat", "lat").replace("x.lon", "lon")} * 10 + 0.5) / 10.0::DOUBLE AS leg_km FROM r WHERE leg <= 3)
 SELECT user_id, leg, store_id, leg_km, floor(sum(leg_km) OVER (PARTITION BY user_id ORDER BY leg) * 10 + 0.5) / 10.0::DOUBLE AS so_far FROM g""",
)
def o7(v: Views) -> DataFrame:
    """The legs of each user's trip to the three nearest selected stores, rounded to 0.1 km, with the total of the rounded legs."""
    near = R.selected_stores(v.users, v.favourites, v.stores).join(v.stores.where("lat IS NOT NULL").select("store_id", "lat", "lon"), "store_id").join(v.users.select("user_id", F.col("lat").alias("hlat"), F.col("lon").alias("hlon")), "user_id")
    near = near.withColumn("km", haversine_km(F.col("hlat"), F.col("hlon"), F.col("lat"), F.col("lon")))
    w = Window.partitionBy("user_id").orderBy("km", "store_id")
    legs = near.withColumn("leg", F.row_number().over(w)).where(F.col("leg") <= MAX_STORES)
    before = [F.coalesce(F.lag(c).over(w), h) for c, h in (("lat", F.col("hlat")), ("lon", F.col("hlon")))]
    legs = legs.withColumn("leg_km", half_up(haversine_km(*before, F.col("lat"), F.col("lon")), 1))
    return legs.select("user_id", "leg", "store_id", "leg_km", half_up(F.sum("leg_km").over(w), 1).alias("so_far"))


def greedy_cover(mine: DataFrame, steps: int = MAX_STORES) -> DataFrame:
    """(user_id, step, store_id, items, cost): the store that covers most of what is left, then the next, at most `steps`; of equals the cheaper, then the smaller id.

    Products that the same stores have are counted together first, so a user has at most one entry for each set of their selected stores, which are at most
    FAVOURITES, however many items there are. The steps run over that array; the input is read once.
    """
    by_product = mine.groupBy("user_id", "product_id").agg(F.array_sort(F.collect_list(F.struct("store_id", (F.col("price") * F.col("quantity")).alias("cost")))).alias("at"))
    together = by_product.select("user_id", F.transform("at", lambda x: x["store_id"]).alias("stores"), F.inline("at"))
    entries = together.groupBy("user_id", "stores", "store_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    users = entries.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("stores", "store_id", "n", "cost"))).alias("left"))
    chosen = "array<struct<items:bigint,cost:double,store_id:bigint>>"

    def step(acc: Column, _: Column) -> Column:
        def score(s: Column) -> Column:
            own = F.filter(acc["left"], lambda x: x["store_id"] == s)
            items = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"])
            cost = half_up(F.aggregate(own, F.lit(0.0), lambda a, x: a + x["cost"]), 2)
            return F.struct((-items).alias("items"), cost.alias("cost"), s.cast("long").alias("store_id"))

        best = F.array_min(F.transform(F.array_distinct(F.transform(acc["left"], lambda x: x["store_id"])), score))

        def taken(b: Column) -> Column:
            left = F.filter(acc["left"], lambda x: ~F.array_contains(x["stores"], b["store_id"]))
            return F.struct(left.alias("left"), F.when(b.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], b)).alias("out"))

        return F.transform(F.array(best), taken)[0]

    start = F.struct("left", F.array().cast(chosen).alias("out"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["out"])
    found = users.select("user_id", F.posexplode(out).alias("step", "s"))
    return found.select("user_id", (F.col("step") + 1).alias("step"), "s.store_id", (-F.col("s.items")).alias("items"), "s.cost")


_STEP = """
s{i} AS (SELECT user_id, store_id, count(DISTINCT product_id) AS items, floor(sum(price * quantity) * 100 + 0.5) / 100.0::DOUBLE AS cost FROM l{i} GROUP BY 1, 2),
g{i} AS (SELECT *, {i} AS step FROM s{i} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY items DESC, cost, store_id) = 1),
l{j} AS (SELECT * FROM l{i} l WHERE NOT EXISTS (SELECT 1 FROM l{i} b JOIN g{i} g ON b.user_id = g.user_id AND b.store_id = g.store_id WHERE b.user_id = l.user_id AND b.product_id = l.product_id))"""


@query("o9_greedy_cover", _SELECTED.split("offered AS")[0] + "l1 AS (SELECT * FROM mine)," + ",".join(_STEP.format(i=i, j=i + 1) for i in (1, 2, 3)) + " SELECT user_id, step, store_id, items, cost FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)")
def o9(v: Views) -> DataFrame:
    selected = R.selected_stores(v.users, v.favourites, v.stores)
    best = v.current.groupBy("store_id", "product_id").agg(F.min("price").alias("price"))
    mine = v.items.join(selected, "user_id").join(best, ["store_id", "product_id"])
    return greedy_cover(mine).select("user_id", "step", "store_id", "items", "cost")


@query("o8_category_plan", " SELECT kind, brand, arg_min(store_id, (price, store_id)) AS store_id, min(price) AS price FROM current_offers JOIN products USING (product_id) GROUP BY 1, 2")
def o8(v: Views) -> DataFrame:
    best = v.current.join(v.products, "product_id").groupBy("kind", "brand").agg(F.min(F.struct("price", "store_id")).alias("b"))
    return best.select("kind", "brand", "b.store_id", "b.price")


@query("o10_missing_items", " SELECT user_id, count(*) AS missing FROM items WHERE product_id NOT IN (SELECT product_id FROM current_offers) GROUP BY 1")
def o10(v: Views) -> DataFrame:
    return v.items.join(v.current, "product_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("missing"))
