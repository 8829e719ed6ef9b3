"""Selections, joins, aggregates, windows and set operations over offers, stores and runs.

All functions take and return DataFrames. Orders have tie-breaks, so results are the same in every run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.constants import NEXT_DAYS
from korbwerk.functions import geo

#: Rows of one place that stand in one array at most; a task holds the pairs of two arrays at once.
TOGETHER = 128


def valid_on(offers: DataFrame, day: Column, local: bool = True) -> DataFrame:
    found = offers.where((F.col("valid_from") <= day) & (F.col("valid_to") >= day))
    return found.where("local") if local else found


def upcoming(offers: DataFrame, day: Column, days: int = NEXT_DAYS) -> DataFrame:
    return offers.where((F.col("valid_from") > day) & (F.col("valid_from") <= F.date_add(day, days)))


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def selected_stores(users: DataFrame, favourites: DataFrame, stores: DataFrame) -> DataFrame:
    """(user_id, store_id): a user's favourite stores that are active, verified and within the radius; without coordinates the radius isn't asked."""
    far = geo.haversine_km(F.col("u.lat"), F.col("u.lon"), F.col("s.lat"), F.col("s.lon")) > F.col("u.radius_km")
    found = favourites.alias("f").join(users.alias("u"), "user_id").join(stores.alias("s").where("active AND verified"), "store_id")
    return found.where(~F.coalesce(far, F.lit(False))).select("user_id", "store_id")


def _cells(lat: Column, lon: Column, km: Column, size: float) -> Column:
    """All cells of `size` degrees that a circle can touch, as an array of (cy, cx)."""
    up = km / 111.0
    # A degree of longitude is shortest at the circle's edge that is nearest to a pole.
    across = up / F.cos(F.radians(F.least(F.abs(lat) + up, F.lit(89.0))))
    ys = F.sequence(F.floor((lat - up) / size), F.floor((lat + up) / size))
    xs = F.sequence(F.floor((lon - across) / size), F.floor((lon + across) / size))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def _together(rows: DataFrame, at: Sequence[str], what: str) -> DataFrame:
    """`rows` as arrays of `what`, nulls included: one for each different row of the columns `at`, or several if more than TOGETHER stand there."""
    number = F.row_number().over(Window.partitionBy(*at).orderBy(F.lit(0)))
    listed = rows.select(*at, what, F.floor((number - 1) / TOGETHER).alias("_chunk")).groupBy(*at, "_chunk").agg(F.collect_list(what).alias("_filled"), F.count("*").cast("int").alias("_n"))
    none = F.lit(None).cast(rows.schema[what].dataType)
    return listed.select(*at, F.concat("_filled", F.array_repeat(none, F.col("_n") - F.size("_filled"))).alias(f"{what}s"))


def _met(left: DataFrame, right: DataFrame, km: Column, l: Column, r: Column, on: Sequence[str], size: float, digits: int | None) -> DataFrame:  # noqa: E741
    """Pairs (l, r, km) as `within` has them, of any columns of both sides.

    Different positions are joined by cells of latitude and longitude and measured once. The rows that stand at each are arrays until the end: pairs of
    positions carry these through the joins, so what is shuffled and kept doesn't grow with the pairs of rows, which are made last and go nowhere.
    """
    here, there = [*on, "_lat", "_lon", "_km"], [*on, "_rlat", "_rlon"]
    placed = lambda df, name, what, lat, lon, *more: df.where("lat IS NOT NULL AND lon IS NOT NULL").select(what.alias(name), *on, F.col("lat").alias(lat), F.col("lon").alias(lon), *more)
    ls, rs = _together(placed(left, "_l", l, "_lat", "_lon", km.alias("_km")), here, "_l"), _together(placed(right, "_r", r, "_rlat", "_rlon"), there, "_r")
    # Few positions can stand for many rows: what each step adds is dealt out anew, else it would stay in the few tasks of the positions.
    a = ls.select(*here).distinct().select("*", F.inline(_cells(F.col("_lat"), F.col("_lon"), F.col("_km"), size))).repartition(*here, "cy", "cx")
    b = rs.select(*there).distinct().select("*", F.floor(F.col("_rlat") / size).alias("cy"), F.floor(F.col("_rlon") / size).alias("cx"))
    apart = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("_rlat"), F.col("_rlon"))
    near = a.join(b, [*on, "cy", "cx"]).withColumn("km", apart).where(F.col("km") <= F.col("_km"))
    near = near.select(*here, "_rlat", "_rlon", (F.col("km") if digits is None else F.round("km", digits)).alias("km")).repartition(*here, "_rlat", "_rlon")
    both = near.join(rs, there).join(ls, here).select("_ls", "_rs", "km")
    return both.select(F.explode("_ls").alias("l"), "_rs", "km").select("l", F.explode("_rs").alias("r"), "km")


def within(left: DataFrame, right: DataFrame, km: Column | float, on: Sequence[str] = (), size: float = 0.25, digits: int | None = None) -> DataFrame:
    """Pairs l, r (as structs) of places with coordinates at most `km` of the left one apart, and equal in the columns `on`; `km` is rounded to `digits`."""
    return _met(left, right, km if isinstance(km, Column) else F.lit(float(km)), F.struct("*"), F.struct("*"), on, size, digits)


def stores_in_radius(places: DataFrame, stores: DataFrame, key: str, digits: int | None = None) -> DataFrame:
    """(key, store_id, km): active stores with coordinates within a place's radius."""
    found = _met(places, stores.where("active"), F.col("radius_km"), F.col(key), F.col("store_id"), (), 0.25, digits)
    return found.select(F.col("l").alias(key), F.col("r").alias("store_id"), "km")


def pairs_in_radius(pairs: DataFrame, users: DataFrame, stores: DataFrame) -> DataFrame:
    """(user_id, store_id): those of `pairs`, each once, whose store is active and within the user's radius; only these pairs are measured."""
    met = pairs.select("user_id", "store_id").alias("f").join(users.alias("u"), "user_id").join(stores.alias("s").where("active"), "store_id")
    return met.where(geo.haversine_km(F.col("u.lat"), F.col("u.lon"), F.col("s.lat"), F.col("s.lon")) <= F.col("u.radius_km")).select("user_id", "store_id").distinct()


def pairs_out_of_radius(pairs: DataFrame, users: DataFrame, stores: DataFrame) -> DataFrame:
    """(user_id, store_id): those of `pairs` whose store isn't an active one within the user's radius; only these pairs are measured. Users and stores have each id once."""
    met = pairs.select("user_id", "store_id").alias("f").join(users.alias("u"), "user_id", "left").join(stores.alias("s").where("active"), "store_id", "left")
    near = geo.haversine_km(F.col("u.lat"), F.col("u.lon"), F.col("s.lat"), F.col("s.lon")) <= F.col("u.radius_km")
    return met.where(~F.coalesce(near, F.lit(False))).select("user_id", "store_id")


def once_each(df: DataFrame, by: Sequence[str], **found: Column) -> DataFrame:
    """`df` with columns that depend on the columns `by` alone, nulls included: they are worked out once for each different row of these, as the same wordings stand in many places.

    They are made rows of (`inline`): a filter on a plain column of different rows would be moved before these are found, and be worked out for every row of `df`.
    """
    keys = {c: f"_by_{c}" for c in by}
    once = df.select(*by).distinct().select(*[F.col(c).alias(k) for c, k in keys.items()], F.inline(F.array(F.struct(*[x.alias(n) for n, x in found.items()]))))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return df.join(once, same).drop(*keys.values())


def rate(part: Column, whole: Column, digits: int = 1, empty: float = 0.0) -> Column:
    """A percentage; `empty` where there is nothing to divide by. One factor scales it: a second product would round halves apart."""
    x = F.floor(part / F.nullif(whole.cast("double"), F.lit(0.0)) * float(100 * 10**digits) + 0.5) / float(10**digits)
    return F.coalesce(x, F.lit(empty))


def mode(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The most frequent values of each group; of equally frequent ones the smallest."""
    counts = df.groupBy(*by, *values).agg(F.count("*").alias("n"))
    return top(counts, by, [F.desc("n"), *values])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """Rows of both by key: new values win; columns in `fill` are only set where the old one is null."""
    joined = old.alias("o").join(new.alias("n"), list(key), "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in fill else F.coalesce(f"n.{c}", f"o.{c}")
    return joined.select(*key, *[pick(c).alias(c) for c in old.columns if c not in key])


def add_missing(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All of the first, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), list(key), "left_anti"))


def identical_groups(offers: DataFrame, key: Sequence[str], collect: str) -> DataFrame:
    return offers.groupBy(*key).agg(F.array_sort(F.collect_set(collect)).alias(f"{collect}s"), F.count("*").alias("n"))
