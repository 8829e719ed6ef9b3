"""Shopping trips without a limit of stores: subsets of each user's stores, searched within bounds.

A set of stores costs its goods, each bought where it is cheapest within the set, and the trip to the stores that are used. Two bounds hold for a set and
for all that it grows into: goods never cost less than with all stores, and a trip is never shorter than one to any two of its stores. What the bounds rule out
against a plan that is known already is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korbwerk.constants import EUR_PER_KM, ROUTE_FACTOR
from korbwerk.functions.geo import haversine_km
from korbwerk.functions.price import half_up

#: Stores decided within one row before its sets become rows of their own, so that a row holds at most 2 ** STEP sets.
STEP = 8


def _leg(a: Column, b: Column) -> Column:
    return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])


def round_trip_km(home: Column, stops: Column) -> Column:
    """Kilometres of a trip that always goes to the nearest stop left (of equally near ones the one with the smallest id), then home."""

    def step(acc: Column, _: Column) -> Column:
        ways = F.transform(acc["left"], lambda s: F.struct(_leg(acc["at"], s).alias("km"), s["store_id"].alias("store_id"), s.alias("stop")))
        to = F.array_min(ways)
        return F.struct(to["stop"].alias("at"), (acc["km"] + to["km"]).alias("km"), F.filter(acc["left"], lambda s: s["store_id"] != to["store_id"]).alias("left"))

    start = F.struct(F.struct(F.lit(0).cast("long").alias("store_id"), home["lat"].alias("lat"), home["lon"].alias("lon")).alias("at"), F.lit(0.0).alias("km"), stops.alias("left"))
    return F.aggregate(stops, start, step, lambda acc: acc["km"] + F.when(F.size(stops) > 0, _leg(acc["at"], home)).otherwise(0.0)) * ROUTE_FACTOR


def profiles(wanted: DataFrame) -> DataFrame:
    """(user_id, options, items): a user's items added up where the same stores sell them in the same order of price; `options` are (store_id, cost) in that order."""
    best = wanted.dropna(subset=["user_id", "product_id", "store_id", "price", "quantity"]).groupBy("user_id", "product_id", "store_id").agg(F.min("price").alias("price"), F.max("quantity").alias("quantity"))
    option = F.struct("price", "store_id", (F.col("price") * F.col("quantity")).alias("cost"))
    ranked = best.groupBy("user_id", "product_id").agg(F.array_sort(F.collect_list(option)).alias("at"))
    rows = ranked.select("user_id", F.transform("at", lambda x: x["store_id"]).alias("ranking"), F.posexplode(F.transform("at", lambda x: x["cost"])).alias("place", "cost"))
    summed = rows.groupBy("user_id", "ranking", "place").agg(F.sum("cost").alias("cost"), F.count("*").alias("items"))
    found = summed.groupBy("user_id", "ranking").agg(F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("costs"), F.max("items").alias("items"))
    return found.select("user_id", F.transform("costs", lambda c: F.struct(F.get("ranking", c["place"]).alias("store_id"), c["cost"].alias("cost"))).alias("options"), "items")


def homes(found: DataFrame, users: DataFrame, stores: DataFrame) -> DataFrame:
    """A row a user: `places` (their stores by id; without coordinates they cost no way), `must` (stores that alone sell an item), `least` (goods with all stores) and `home`."""
    goods = found.groupBy("user_id").agg(F.sum(F.col("options")[0]["cost"]).alias("least"), F.sort_array(F.collect_set(F.when(F.size("options") == 1, F.col("options")[0]["store_id"]))).alias("must"))
    known = stores.select("store_id", "lat", "lon").dropDuplicates(["store_id"])
    mine = found.select("user_id", F.explode("options.store_id").alias("store_id")).distinct().join(known, "store_id", "left")
    places = mine.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("store_id").cast("long").alias("store_id"), "lat", "lon"))).alias("places"))
    return goods.join(places, "user_id").join(users.select("user_id", F.struct("lat", "lon").alias("home")).dropDuplicates(["user_id"]), "user_id", "left")


def priced(sets: DataFrame) -> DataFrame:
    """Each set (user_id, stores, with its user's places, home and wanted) with goods, covered items, stores used, kilometres and total; sets that sell nothing give no row.

    A set is priced within its row, so no set is shuffled for it.
    """
    cheapest = F.transform("wanted", lambda w: F.struct(F.get(F.filter(w["options"], lambda o: F.array_contains("stores", o["store_id"])), F.lit(0)).alias("o"), w["items"].alias("items")))
    bought = F.filter(cheapest, lambda b: b["o"].isNotNull())

    def summed(b: Column) -> Column:
        goods = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x["o"]["cost"])
        covered = F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x["items"])
        return F.struct(goods.alias("goods"), covered.alias("covered"), F.array_sort(F.array_distinct(F.transform(b, lambda x: x["o"]["store_id"]))).alias("used"))

    goods = sets.select("user_id", "stores", "places", "home", F.inline(F.transform(F.array(bought), summed))).where(F.size("used") > 0)
    stops = F.filter("places", lambda p: F.array_contains("used", p["store_id"]) & p["lat"].isNotNull() & p["lon"].isNotNull())
    trips = goods.withColumn("way", stops).select(*[c for c in goods.columns if c not in ("places", "home")], F.inline(F.array(F.struct(F.coalesce(round_trip_km(F.col("home"), F.col("way")), F.lit(0.0)).alias("km")))))
    return trips.select("user_id", "stores", "used", "covered", half_up(F.col("goods"), 2).alias("goods"), "km", half_up(F.col("goods") + F.col("km") * EUR_PER_KM, 2).alias("total"))


def _grown(first: int) -> Column:
    """The sets that a row's set grows into by the optional stores `first` to `first` + STEP, as far as the bounds allow; the set itself is one of them."""
    ways, none = F.col("ways"), F.array().cast("array<struct<chosen:array<int>,tour:double>>")

    def add(acc: Column, i: Column) -> Column:
        def with_store(s: Column) -> Column:
            chosen = F.array_append(s["chosen"], i)
            return F.struct(chosen.alias("chosen"), F.greatest(s["tour"], F.array_max(F.transform(chosen, lambda j: F.get(F.get(ways, i), j)))).alias("tour"))

        return F.concat(acc, F.filter(F.transform(acc, with_store), lambda s: F.col("least") + s["tour"] * (ROUTE_FACTOR * EUR_PER_KM) <= F.col("bound")))

    start = F.concat(none, F.array(F.struct(F.col("chosen"), F.col("tour"))))
    return F.aggregate(F.slice("optional", first + 1, STEP), start, add)


def worthwhile(at: DataFrame, bounds: DataFrame) -> DataFrame:
    """(user_id, stores), and what else `at` has of the user: every set that may cost no more than `bound` (user_id, bound) and sells whatever only one store sells.

    The number of sets still doubles with each store that bounds can't rule out; they are rows, not one row's array, beyond 2 ** STEP.
    """
    numbers = lambda has: F.filter(F.transform("places", lambda p, i: F.when(F.array_contains("must", p["store_id"]) == F.lit(has), i)), lambda i: i.isNotNull())
    home = F.col("home")
    # The way to two stores and back; one store counts there and back, unknown places nothing.
    ways = F.transform("places", lambda a: F.transform("places", lambda b: F.coalesce(_leg(home, a) + _leg(a, b) + _leg(b, home), F.lit(0.0))))
    rows = at.join(bounds, "user_id").select(*at.columns, "bound", ways.alias("ways"), numbers(True).alias("chosen"), numbers(False).alias("optional"))
    widest = rows.agg(F.max(F.size("optional"))).first()[0] or 0
    tour = F.coalesce(F.array_max(F.flatten(F.transform("chosen", lambda i: F.transform("chosen", lambda j: F.get(F.get("ways", i), j))))), F.lit(0.0))
    rows = rows.withColumn("tour", tour)
    kept = [c for c in rows.columns if c not in ("chosen", "tour")]
    for first in range(0, widest, STEP):
        rows = rows.select(*kept, F.inline(_grown(first)))
    return rows.where(F.size("chosen") > 0).select(*at.columns, F.sort_array(F.transform("chosen", lambda i: F.get("places", i)["store_id"])).alias("stores"))


def all_plans(wanted: DataFrame, users: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, offered): of each user the sets that can be the best plan, every single store among them, priced as in `priced`; and the number of items on offer.

    `wanted` has user_id, product_id, store_id, price and quantity, an item in a store that sells it. Rows with a null in one of these are left out; of repeated ones
    the lowest price and the largest quantity count. Users without coordinates, and users that `users` lacks, have no way to go. An empty table gives no plans; further
    columns are ignored.
    """
    found = profiles(wanted)
    wanted = found.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("options", "items"))).alias("wanted"))
    at = homes(found, users, stores).join(wanted, "user_id")
    all_of = F.col("places.store_id")
    known_sets = at.select("*", F.explode(F.array_distinct(F.concat(F.array(all_of), F.transform(all_of, lambda s: F.array(s))))).alias("stores"))
    offered = found.groupBy("user_id").agg(F.sum("items").alias("offered"))
    known = priced(known_sets)
    bounds = known.join(offered, "user_id").where("covered = offered").groupBy("user_id").agg((F.min("total") + 0.01).alias("bound"))
    return known.unionByName(priced(worthwhile(at, bounds))), offered
