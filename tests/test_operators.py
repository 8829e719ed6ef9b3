"""Operators on small tables with known answers."""

import datetime as dt
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korbwerk.operators import extract, importer, matching, parsers, relational
from korbwerk.plans import quality, savings
from korbwerk.sources import tables
from korbwerk.streaming import ingest


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_cheapest(n, m, rnd):
    cost = np.array([[rnd.randint(0, 50) for _ in range(m)] for _ in range(n)], float)
    pairs = matching.cheapest_pairs(cost)
    assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    k = min(n, m)
    best = min(sum(cost[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert sum(cost[r, c] for r, c in pairs) == pytest.approx(best)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_matching_is_largest(n, m, rnd):
    allowed = np.array([[rnd.random() < 0.4 for _ in range(m)] for _ in range(n)])
    pairs = matching.most_pairs([np.flatnonzero(row).tolist() for row in allowed], m)
    assert all(allowed[p] for p in pairs) and len({c for _, c in pairs}) == len(pairs)
    best = max(len(s) for k in range(min(n, m) + 1) for s in itertools.combinations([(r, c) for r in range(n) for c in range(m) if allowed[r, c]], k) if len({r for r, _ in s}) == len({c for _, c in s}) == k)
    assert len(pairs) == best


def test_matching_of_long_chains():
    """Each row has two columns, the last one a single one, so that all rows must move on by one."""
    n = 5000
    pairs = matching.most_pairs([[i] if i == n - 1 else [i + 1, i] for i in range(n)], n)
    assert len(pairs) == n and len({c for _, c in pairs}) == n


def test_near_pairs_equal_all_pairs():
    rng = np.random.default_rng(5)
    a, b = rng.uniform(-300, 900, (120, 2)), rng.uniform(-300, 900, (140, 2))
    want = [[j for j in range(140) if np.hypot(*(b[j] - p)) <= 185.0] for p in a]
    assert matching.near_pairs(a, b, 185.0) == want


def test_matching_of_odd_boxes(spark):
    box = "page_key long, kind string, box_id long, x0 double, y0 double, x1 double, y1 double, cost string"
    rows = [(1, "label", 1, 0.0, 0.0, 2.0, 2.0, "x"), (1, "price", 1, 0.0, 9.0, 2.0, 9.0, "x"), (1, "price", 1, 0.0, 9.0, 2.0, 9.0, "x"), (1, "label", 2, None, 0.0, 1.0, 1.0, "x"), (None, "label", 3, 5.0, 5.0, 5.0, 5.0, "x"), (None, "price", 4, 5.0, 5.0, 5.0, 5.0, "x"), (2, "price", 5, 0.0, 0.0, 1.0, 1.0, "x")]
    boxes = spark.createDataFrame(rows, box)
    assert sorted(map(str, map(tuple, matching.match_anchors(boxes).collect()))) == ["(1, 1, 1)", "(None, 3, 4)"]
    assert sorted(map(str, map(tuple, matching.assign_prices(boxes).collect()))) == ["(1, 1, 1, 8.0)", "(None, 3, 4, 0.0)"]
    for f in (matching.match_anchors, matching.assign_prices, matching.price_groups):
        assert f(boxes.limit(0)).collect() == []


def test_similar_names(spark):
    names = spark.createDataFrame([(1, "Bio Vollmilch frisch"), (2, "Bio Vollmilch frisch"), (3, "Bio Vollmilch frische"), (4, "Zahnpasta Minze"), (5, None)], "product_id long, product_name string")
    assert [(r.left_id, r.right_id) for r in matching.similar_names(names).collect()] == [(1, 3)]


def test_similar_names_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(7)
    names = ["kartoffelsalat", "kartofelsalat", "vollkornbrot", "vollkornbrote", "weizenmehl type405", "weizenmehltype405", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "ab" * 60, "ab" * 65]
    for _ in range(120):
        name = "".join(rng.choice(list("abcde "), rng.integers(8, 60)))
        at = int(rng.integers(0, len(name)))
        names += [name, name[:at] + "x" + name[at + 1 :], name[:at] + name[at + 1 :], name[:at] + "yz" + name[at:]]
    names = [x for x in dict.fromkeys(" ".join(x.split()) for x in names) if len(x) >= 8]
    got = matching.similar_names(spark.createDataFrame(list(enumerate(names)), "product_id long, product_name string")).collect()
    want = {(i, j) for j, y in enumerate(names) for i, x in enumerate(names[:j]) if SequenceMatcher(None, x, y).ratio() >= 0.92}
    assert len(want) > 100 and sorted((r.left_id, r.right_id) for r in got) == sorted(want)


def plan_tables(spark, offers):
    stores = spark.createDataFrame([(1, "A", 50.0, 7.01), (2, "B", 50.0, 7.02)], "store_id long, store_name string, lat double, lon double")
    users = spark.createDataFrame([(1, 50.0, 7.0)], "user_id long, lat double, lon double")
    items = spark.createDataFrame([(1, p, 1.0) for p in (1, 2, 3)], "user_id long, product_id long, quantity double")
    return spark.createDataFrame(offers, "store_id long, product_id long, price double"), items, users, stores


@pytest.mark.parametrize(("offers", "stores", "covered"), [([(1, 1, 1.0), (1, 2, 2.0), (2, 3, 1.5)], "1,2", 3), ([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 1.5), (2, 3, 1.4)], "1", 3), ([(2, 1, 1.0)], "2", 1)])
def test_savings_plan(spark, offers, stores, covered):
    o, items, users, where = plan_tables(spark, offers)
    candidates = o.select(F.lit(1).cast("long").alias("user_id"), "store_id").distinct()
    offered = spark.createDataFrame([(1, len({p for _, p, _ in offers}))], "user_id long, offered long")
    got = savings.plans(savings.evaluated(savings.store_sets(candidates), o, items, users, where), offered).first()
    assert (got["store_ids"], got["covered"]) == (stores, covered)
    assert got["total"] == pytest.approx(got["goods"] + got["km"] * 0.15, abs=0.02)


def test_greedy_cover(spark):
    mine = spark.createDataFrame([(1, 1, 1, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (1, 2, 2, 9.0, 1.0), (1, 2, 3, 1.0, 1.0)], "user_id long, store_id long, product_id long, price double, quantity double")
    assert [(r.step, r.store_id, r.items) for r in savings.greedy_cover(mine).orderBy("step").collect()] == [(1, 1, 2), (2, 2, 1)]


def test_stores_in_radius_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    places = spark.createDataFrame([(i, float(a), float(b), float(r)) for i, (a, b, r) in enumerate(zip(rng.uniform(49, 52, 30), rng.uniform(6, 9, 30), rng.uniform(1, 90, 30), strict=True))], "place long, lat double, lon double, radius_km double")
    stores = spark.createDataFrame([(i, float(a), float(b), True) for i, (a, b) in enumerate(zip(rng.uniform(49, 52, 60), rng.uniform(6, 9, 60), strict=True))] + [(99, None, None, True)], "store_id long, lat double, lon double, active boolean")
    from korbwerk.functions.geo import haversine_km

    want = places.alias("p").crossJoin(stores.alias("s")).where(haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("s.lat"), F.col("s.lon")) <= F.col("radius_km")).select("place", "store_id")
    got = relational.stores_in_radius(places, stores, "place").select("place", "store_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_card_offers_and_sections(spark):
    docs = spark.createDataFrame([(1, "Gurken frisch\nje 400-g-Packung\n(1 kg = 2,50 €)\n1,00 €\n\nAktion\n2,00 €"), (2, None), (3, "")], "doc_id long, text string")
    got = extract.card_offers(docs, above=3, below=0).orderBy("pos").collect()
    assert [(r.name, r.price, r.quantity, r.unit) for r in got] == [("Gurken frisch", 1.0, 400.0, "g")]
    weeks = spark.createDataFrame([(1, "x\nab Montag, 10.8.\na\nab Montag, 17.8.\nb")], "doc_id long, text string")
    assert [r.section for r in extract.week_sections(weeks).orderBy("pos").collect()] == [None, "10.8.", "10.8.", "17.8.", "17.8."]


def test_parsers(spark):
    """Cards of each layout, odd pages, and repeated ones."""
    pages = {
        "REWE": "Angebote im Markt\nBio Gurken\nje 500 g (1 kg = 3,98)\nAktion\nKnaller\n1,99 €\nAktion\nohne Packung",
        "EDEKA": "Start Angebot Edler Käse Festpreis von 2,49 € Angebot Butter mild App-Preis von 1,19 € Festpreis von 1,49 € je 250 g",
        "Netto Marken-Discount": "vorher Milch 1 l 0,99\nFilial-Angebote\nKaffee gemahlen 500 g\nstatt 7,99 5,49\nCoupon 4,99\nFiliale\nKekse 200 g\n1,29\nAktuelle Prospekte\nSaft 1 l\n2,00",
        "ALDI SÜD": "Wochenangebote Mo., 17.8. – Sa., 22.8.\nfrische Brezel\n4 Stück\nstatt 1,99 1,49 €\nAlle Wochenangebote",
        "Lidl": "Ananas süß\nje 1 kg\nnur in der Filiale 1,79 €",
    }
    ref, out = F.lit(dt.date(2026, 8, 16)), {}
    for layout, text in pages.items():
        rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "lorem\n" * 3000, "x"), (5, "1,99 €\n500 g\nAktion\nFiliale", "x")]
        docs = spark.createDataFrame(rows, "id long, text string, name string").select("id", "text")
        got = parsers.PARSERS[layout](docs.where("id > 1").unionByName(docs.where("id = 1").limit(1)), "id", "text", ref).where("id = 1").collect()
        out[layout] = sorted((r.name, r.price, r.regular_price, r.app_price, r.quantity, r.unit) for r in got)
        assert parsers.PARSERS[layout](docs.limit(0), "id", "text", ref).count() == 0
    assert out == {
        "REWE": [("Bio Gurken", 1.99, None, None, 500.0, "g")],
        "EDEKA": [("Butter mild", 1.49, None, 1.19, 250.0, "g"), ("Edler Käse", 2.49, None, None, 250.0, "g")],
        "Netto Marken-Discount": [("Kaffee gemahlen 500 g", 5.49, 7.99, 4.99, 500.0, "g"), ("Kekse 200 g", 1.29, None, None, 200.0, "g")],
        "ALDI SÜD": [("frische Brezel", 1.49, 1.99, None, 4.0, "stück")],
        "Lidl": [("Ananas süß", 1.79, None, None, 1.0, "kg")],
    }


def test_crowded_pages_are_errors(spark):
    boxes = spark.range(matching.MOST_BOXES + 1).select(F.lit(1).cast("long").alias("page_key"), F.lit("label").alias("kind"), F.col("id").alias("box_id"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    with pytest.raises(ValueError, match="more than"):
        matching.assign_prices(boxes)


def test_json_nodes(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"price":"2"}]},"value":3}'), (2, "no json"), (3, None)], "id long, doc string")
    nodes = extract.json_nodes(df, "id", "doc")
    deep = spark.createDataFrame([(1, "[" * 40 + "7" + "]" * 40)], "id long, doc string")
    assert extract.json_nodes(deep, "id", "doc").count() == 41
    strings = spark.createDataFrame([(1, '{"a":"}]{[ \\\\\\" ]","b":[{}]}'), (1, "3")], "id long, doc string")
    assert sorted(r.path for r in extract.json_nodes(strings, "id", "doc").collect()) == ["$", "$", "$.a", "$.b", "$.b[0]"]
    assert extract.json_nodes(df.limit(0), "id", "doc").collect() == []
    assert {r.path for r in nodes.collect()} == {"$", "$.a", "$.a.b", "$.a.b[0]", "$.a.b[1]", "$.a.b[1].price", "$.value"}
    assert [tuple(r) for r in extract.first_of(nodes, "id", ["price", "value"]).collect()] == [(1, "2")]


def test_json_nodes_beyond_a_million(spark):
    """No bound on the nodes of a run: more than the default limit of recursive queries."""
    doc = F.concat(F.lit('{"a":['), F.array_join(F.sequence(F.lit(1), F.lit(1000)), ","), F.lit("]}"))
    nodes = extract.json_nodes(spark.range(1200).select("id", doc.alias("doc")), "id", "doc")
    assert nodes.agg(F.count("*"), F.max("path")).first()[:] == (1200 * 1002, "$.a[9]")


def test_json_nodes_inherit_pages(spark):
    doc = '{"page":"9","x":{"y":1},"pages":[{"v":1},{"pageIndex":6,"w":{"u":[{"k":2}]}},5]}'
    nodes = extract.json_nodes(spark.createDataFrame([(1, doc)], "id long, doc string"), "id", "doc")
    assert {r.path: r.page for r in nodes.collect()} == {"$": 9, "$.page": 9, "$.x": 9, "$.x.y": 9, "$.pages": 9, "$.pages[0]": 1, "$.pages[0].v": 1, "$.pages[1]": 7, "$.pages[1].pageIndex": 7, "$.pages[1].w": 7, "$.pages[1].w.u": 7, "$.pages[1].w.u[0]": 7, "$.pages[1].w.u[0].k": 7, "$.pages[2]": 3}


def test_import_keeps_last_and_counts(spark):
    d = dt.date(2026, 8, 17)
    rows = [(1, "Milch", 1.0, "l", 0.99, d, d, 1, "", "u1", 1), (1, "Milch", 1.0, "l", 0.99, d, d, 2, "", "u2", 2), (1, "Käse", 1.0, "kg", 5.0, d, d, 1, "nur online", "", 3), (1, "Gold", 1.0, "g", 9000.0, d, d, 1, "", "", 4), (1, "Alt", 1.0, "g", 1.0, None, d, 1, "", "", 5)]
    new = spark.createDataFrame(rows, "store_id long, product_name string, quantity double, unit string, price double, valid_from date, valid_to date, page int, source_text string, source_url string, seq long")
    known = spark.createDataFrame([(1, "milch|1l", d, 0.99, None, "old"), (2, "brot", d, 1.0, None, "old")], "store_id long, product_key string, valid_from date, price double, valid_to date, source_url string")
    offers, counts = importer.import_offers(new, known, F.lit(d))
    assert {(r.store_id, r.product_key, r.source_url) for r in offers.collect()} == {(1, "milch|1l", "u2"), (2, "brot", "old")}
    assert dict(counts.collect()) == {"imported": 2, "online": 1, "quality": 1, "date": 1}


def test_reconcile(spark):
    m = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 9.0, 3.0), (1, 3, 9.0, 50.0), (1, 4, 7.0, None)], "page_key long, label_id long, price double, expected double")
    a = spark.createDataFrame([(1, 1, 3.01), (1, 2, 3.0)], "page_key long, anchor_id long, price double")
    assert sorted((r.label_id, r.price, r.state) for r in matching.reconcile(m, a).collect() if r.price) == [(1, 2.0, "kept"), (2, 3.0, "corrected"), (4, 7.0, "kept")]


def test_freshness_order(spark):
    now = F.lit(dt.datetime(2026, 8, 17))
    state = lambda s, d: spark.range(1).select(quality.freshness(F.lit(s).cast("string"), F.lit(d), now)).first()[0]
    old, new = dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 18)
    assert [state("failed", old), state("no_offers", old), state("success", old), state("success", new), state(None, new)] == ["failed", "empty", "stale", "current", "unknown"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"product_name": "Milch", "price": 1.5}\n')
    rows = tables.collected(spark, str(tmp_path / "in"))
    assert (rows.first()["local_store_offer"], rows.first()["confidence"]) == (True, 0.5)
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"<html>")
    assert tables.leaflets(spark, str(tmp_path / "pdf")).count() == 1
    tables.write_csv(rows.select("product_name", "price"), str(tmp_path / "csv"))
    assert "product_name;price" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    tables.write_parquet(rows.select("product_name", "price"), str(tmp_path / "pq"), ["price"])
    assert tables.payload(spark.read.parquet(str(tmp_path / "pq")), "price", ["product_name"]).first()["json"] == '{"product_name":"Milch"}'


def test_stream_takes_each_offer_once(spark, tmp_path):
    t = dt.datetime(2026, 8, 17)
    df = spark.createDataFrame([("a", t), ("a", t), ("b", t)], "fingerprint string, collected_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    ingest.import_stream(spark, str(tmp_path / "in"), "fingerprint string, collected_at timestamp", lambda b, _: seen.extend(r.fingerprint for r in b.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["a", "b"]


def test_rates_round_halves_by_one_product(spark):
    """23/80 and 153/480 end in a half, which 100 * 10 and 100 * 100 in turn would round down or up otherwise."""
    rows = spark.createDataFrame([(23, 80), (153, 480), (1, 16)], "part long, whole long")
    got = rows.select(relational.rate(F.col("part"), F.col("whole")).alias("a"), relational.rate(F.col("part"), F.col("whole"), 2).alias("b")).collect()
    want = [(np.floor(p / w * 1000 + 0.5) / 10.0, np.floor(p / w * 10000 + 0.5) / 100.0) for p, w in ((23, 80), (153, 480), (1, 16))]
    assert [tuple(r) for r in got] == want


def test_rows_at_one_position_are_pairs_of_their_own(spark):
    """Thirty users and twenty stores at three positions, one of them without coordinates; distances are rounded where positions meet."""
    spots = [(50.0, 7.0), (50.1, 7.1), (None, 7.0)]
    users = spark.createDataFrame([(i, *spots[i % 3], 1.0 if i % 2 else 20.0) for i in range(30)], "user_id long, lat double, lon double, radius_km double")
    stores = spark.createDataFrame([(i, *spots[i % 3], i % 5 != 0) for i in range(20)], "store_id long, lat double, lon double, active boolean")
    got = relational.stores_in_radius(users, stores, "user_id", digits=3).collect()
    half = np.radians(0.05)
    apart = round(float(2 * 6371.0088 * np.arcsin(np.sqrt(np.sin(half) ** 2 * (1 + np.cos(np.radians(50.0)) * np.cos(np.radians(50.1)))))), 3)
    want = {(u, s) for u in range(30) for s in range(20) if u % 3 < 2 and s % 3 < 2 and s % 5 and (u % 3 == s % 3 or u % 2 == 0)}
    assert len(got) == len(want) and {(r.user_id, r.store_id) for r in got} == want and {r.km for r in got} == {0.0, apart}
    asked = spark.createDataFrame([(u, s) for u in range(31) for s in range(0, 21, 2)] * 2, "user_id long, store_id long")
    near = [tuple(r) for r in relational.pairs_in_radius(asked, users, stores).collect()]
    assert sorted(near) == sorted(p for p in want if p[1] % 2 == 0)


def test_once_each_keeps_nulls_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "b"), (4, "a", None), (4, "a", None)], "id int, x string, y string")
    got = relational.once_each(rows, ["x", "y"], z=F.concat_ws("-", F.coalesce("x", F.lit("0")), "y"))
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 'a', None, 'a')", "(2, None, None, '0')", "(3, 'a', 'b', 'a-b')", "(4, 'a', None, 'a')", "(4, 'a', None, 'a')"]


def test_prefix_names_form_no_pairs_of_a_brand(spark, sf_dir):
    """Products of a brand meet by beginnings of their names, so the join has the name among its keys."""
    from korbwerk.plans import catalog

    plan = catalog.QUERIES["u7_prefix_names"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("product_name" in line for line in joins)


def test_costs_of_an_assignment_are_not_rounded(spark):
    """Sums of costs are rounded by who sums them, so each cost is whole."""
    rows = [(1, kind, i, x, 100.0 * i, x, 100.0 * i) for i in range(3) for kind, x in (("label", 0.0), ("price", 1.0 / 3 + i))]
    found = matching.assign_prices(spark.createDataFrame(rows, "page_key long, kind string, box_id long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted(r.cost for r in found) == [1.0 / 3, 1.0 / 3 + 1, 1.0 / 3 + 2]
