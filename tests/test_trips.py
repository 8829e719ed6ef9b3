"""Savings plans without a limit of stores, against all subsets."""

import math
import random
from itertools import combinations

from pyspark.sql import functions as F

from korbwerk.constants import EUR_PER_KM, ROUTE_FACTOR
from korbwerk.operators import trips
from korbwerk.plans.savings import plans

WANTED = "user_id long, product_id long, store_id long, price double, quantity double"
PLACE = "lat double, lon double"


def km(a, b):
    half = lambda x, y: math.sin((math.radians(y) - math.radians(x)) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1])))


def trip(home, stops):
    at, way, left = home, 0.0, dict(stops)
    while left:
        s = min(left, key=lambda s: (km(at, left[s]), s))
        way, at = way + km(at, left[s]), left.pop(s)
    return (way + km(at, home)) * ROUTE_FACTOR if stops else 0.0


def best_of_all(items, places, home):
    """(total, number of stores, goods, stores) of the best set; `items` maps a product to {store: (price, quantity)}."""
    found = []
    for n in range(1, len(places) + 1):
        for chosen in combinations(sorted(places), n):
            picks = [min((p, s, q) for s, (p, q) in at.items() if s in chosen) for at in items.values() if set(at) & set(chosen)]
            if len(picks) == len(items):
                goods, used = sum(p * q for p, _, q in picks), sorted({s for _, s, _ in picks})
                way = trip(home, {s: places[s] for s in used if places[s]}) if home else 0.0
                found.append((math.floor((goods + way * EUR_PER_KM) * 100 + 0.5) / 100, len(used), round(goods, 2), used))
    return min(found)


def test_any_number_of_stores_as_by_all_subsets(spark):
    rng = random.Random(5)
    wanted, users, stores, want = [], [], [], {}
    for user in range(12):
        home = None if user == 3 else (50 + rng.random(), 7 + rng.random())
        places = {user * 100 + k: None if rng.random() < 0.1 else (50 + rng.random(), 7 + rng.random()) for k in range(1, 5 + user % 9)}
        items = {p: {s: (round(rng.uniform(0.5, 9), 2), 1.0 + p % 3) for s in rng.sample(sorted(places), rng.randint(1, min(5, len(places))))} for p in range(1, 9)}
        places = {s: places[s] for s in places if any(s in at for at in items.values())}
        users.append((user, *(home or (None, None))))
        stores += [(s, *(at or (None, None))) for s, at in places.items()]
        wanted += [(user, p, s, price, q) for p, at in items.items() for s, (price, q) in at.items()]
        want[user] = best_of_all(items, places, home)
    assert max(len({s for u, _, s, _, _ in wanted if u == user}) for user in range(12)) >= 10
    rows = spark.createDataFrame(wanted + wanted[:7] + [(1, None, 101, 1.0, 1.0), (2, 1, None, 0.1, 1.0), (4, 77, 401, None, 1.0)], WANTED)
    found, offered = trips.all_plans(rows.withColumn("lat", F.lit("clash")), spark.createDataFrame(users, f"user_id long, {PLACE}"), spark.createDataFrame(stores, f"store_id long, {PLACE}"))
    got = {r.user_id: (r.total, len(r.store_ids.split(",")), r.goods, [int(x) for x in r.store_ids.split(",")]) for r in plans(found, offered).collect()}
    assert got == want


def test_bounds_leave_out_far_stores_but_not_single_ones(spark):
    near, far = (50.0, 7.0), (53.0, 7.0)
    stores = spark.createDataFrame([(1, *near), (2, *far), (3, 50.01, 7.0)], f"store_id long, {PLACE}")
    users = spark.createDataFrame([(1, *near)], f"user_id long, {PLACE}")
    wanted = spark.createDataFrame([(1, p, s, 2.0 - 0.1 * (s == 2) - 0.5 * (s == 3 and p == 2), 1.0) for p in (1, 2) for s in (1, 2, 3)], WANTED)
    found = trips.profiles(wanted)
    at = trips.homes(found, users, stores)
    sets = {tuple(r.stores) for r in trips.worthwhile(at, spark.createDataFrame([(1, 4.0)], "user_id long, bound double")).collect()}
    assert sets == {(1,), (3,), (1, 3)}
    rows, _ = trips.all_plans(wanted, users, stores)
    assert {tuple(r.stores) for r in rows.collect()} >= {(1,), (2,), (3,), (1, 2, 3)}


def test_no_wishes_no_plans(spark):
    empty = spark.createDataFrame([], WANTED)
    rows, offered = trips.all_plans(empty, spark.createDataFrame([], f"user_id long, {PLACE}"), spark.createDataFrame([], f"store_id long, {PLACE}"))
    assert rows.count() == 0 and offered.count() == 0
