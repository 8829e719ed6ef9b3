"""Steps that grew too fast: what is read once, and what isn't called once a page."""

from pyspark.sql import functions as F

from korbwerk.functions import dates, names, promo
from korbwerk.operators import extract, importer, jsontree, layout, matching, rebuild, relational, trips


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_titles_and_qualities_are_worked_out_once(spark):
    text = spark.createDataFrame([("Zarte\nButterkekse\nje 500 g",), (None,)], "text string")
    title = text.select(names.title_of(F.col("text")).alias("t"))
    assert plan(title).count("aggregate(") == 1
    assert [r.t for r in title.collect()] == ["Zarte Butterkekse", ""]
    judged = text.select(names.offer_quality(F.col("text"), F.lit(1.0), F.lit(1.0), F.lit("g"), F.lit(None).cast("double"), F.lit(0.9)).alias("q"))
    assert plan(judged).count("regexp_extract_all(") == 1


def test_page_offers_read_each_text_once(spark):
    blocks = spark.createDataFrame([(1, "Zarte Butterkekse\nje 500 g"), (2, "Zarte Butterkekse\nje 500 g"), (2, "2,99 €")], "page_key long, text string")
    found = layout.described(blocks)
    assert "Deduplicate" in plan(found) or "Distinct" in plan(found)
    assert sorted((r.page_key, r.name, r.quantity) for r in found.collect() if r.name) == [(1, "Zarte Butterkekse", 500.0), (2, "Zarte Butterkekse", 500.0)]


def test_pages_are_solved_in_batches(spark):
    nan = float("nan")
    rows = [(1, "price", 1, 0.0, 0.0, 10.0, 10.0), (1, "price", 2, 30.0, 0.0, 40.0, 10.0), (1, "price", 3, 90.0, 0.0, 99.0, 10.0), (1, "label", 4, 0.0, 0.0, 9.0, 9.0), (None, "price", 5, 0.0, 0.0, 1.0, 1.0), (2, "price", 6, nan, 0.0, 1.0, 1.0), (2, "price", 7, 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "page_key long, kind string, box_id long, x0 double, y0 double, x1 double, y1 double")
    found = matching.price_groups(boxes)
    assert "FlatMapGroupsInArrow" not in plan(found)
    assert sorted((r.box_id, r.page_key, r.group_id) for r in found.collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (5, None, 5), (7, 2, 7)]
    tags = boxes.where("kind = 'price'").select("page_key", F.col("box_id").alias("tag_id"), "x0", "y0", "x1", "y1", F.lit(1.0).alias("price"))
    assert "FlatMapGroupsInArrow" not in plan(layout.tag_groups(tags))


def test_trees_are_walked_once(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": "x", "price": {"value": 2}}, "c": [1, {"d": null, "e": true}]}'), (2, "{"), (3, None), (4, "[]"), (4, '{"k": 1}'), (4, '{"k": 2}')], "id long, doc string")
    found = jsontree.objects(extract.json_nodes(docs, "id", "doc"), "id")
    assert plan(found).count("parse_json(") == 1
    rows = sorted((r.id, r.path, r.json, sorted(r.fields.items())) for r in found.collect())
    assert [r for r in rows if r[0] < 4] == [
        (1, "$", '{"a":{"b":"x","price":{"value":2}},"c":[1,{"d":null,"e":true}]}', []),
        (1, "$.a", '{"b":"x","price":{"value":2}}', [("b", "x"), ("price", "2")]),
        (1, "$.a.price", '{"value":2}', [("value", "2")]),
        (1, "$.c[1]", '{"d":null,"e":true}', [("e", "true")]),
    ]
    assert [r[:3] for r in rows if r[0] == 4] == [(4, "$", '{"k":1}'), (4, "$", '{"k":2}')]


def test_dates_that_are_not_there_raise_nothing(spark):
    text = spark.createDataFrame([("Diese Woche 15.6. bis 20.6.",), ("KW 25",), ("KW ٢٥",), ("",)], "text string")
    found = text.select(dates.inferred_validity(F.col("text"), F.lit("1998-06-15").cast("date")).alias("v"))
    assert "try_cast" not in plan(found)
    assert [str(r.v and r.v["from"]) for r in found.collect()] == ["1998-06-15", "1998-06-15", "None", "None"]


def test_sets_of_stores_are_priced_without_a_shuffle(spark):
    place = "struct<store_id:bigint,lat:double,lon:double>"
    rows = [(1, [1, 2], [(1, None, None), (2, None, None)], (50.0, 7.0), [([(1, 2.0), (2, 3.0)], 1), ([(2, 4.0)], 2)]), (1, [9], [], None, [([(1, 2.0)], 1)])]
    sets = spark.createDataFrame(rows, f"user_id long, stores array<bigint>, places array<{place}>, home struct<lat:double,lon:double>, wanted array<struct<options:array<struct<store_id:bigint,cost:double>>,items:bigint>>")
    found = trips.priced(sets)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, [1, 2], [1, 2], 3, 6.0, 0.0, 6.0)]


def test_names_of_collected_offers_are_judged_once(spark):
    text = ["product_name", "unit", "source_text", "source_url", "retailer", "store_retailer"]
    columns = ", ".join([f"{c} string" for c in text] + [f"{c} double" for c in ("price", "regular_price", "quantity", "unit_price", "confidence")] + ["local_store_offer boolean", "valid_from date", "valid_to date"])
    row = lambda price: ("Zarte Butterkekse", "g", "im Markt", None, "REWE", "REWE", price, None, 500.0, None, 0.95, True, None, None)
    found = importer.assessed(spark.createDataFrame([row(2.0), row(None), row(-1.0), row(6000.0)], columns))
    assert "Distinct" in plan(found) or "Deduplicate" in plan(found)
    assert sorted((r.price or 0, r.why) for r in found.collect()) == [(-1.0, "quality"), (0, "quality"), (2.0, "date"), (6000.0, "quality")]


def test_filters_stay_above_what_is_worked_out_once(spark):
    words = spark.createDataFrame([("ab",), ("ab",), (None,), ("c",)], "word string")
    found = relational.once_each(words, ["word"], long=F.length("word") > 1).where("long")
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [word", 1)[1]
    assert "length(" not in below
    assert [r.word for r in found.collect()] == ["ab", "ab"]


def test_lists_of_readings_are_agreed_on_once(spark):
    same = ["Feine Butter", "Feine Butter mild"]
    rows = [(1, "a", same), (1, "b", same), (2, "a", ["Feine Butter"]), (2, "a", ["Frische Sahne", "Feine Butter mild"]), (3, "c", ["Feine Butter", None]), (3, "d", None)]
    found = rebuild.consensus_names(spark.createDataFrame(rows, "page_key long, card_id string, names array<string>"))
    assert "Aggregate [lists" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page_key, r.card_id, r.name) for r in found.collect()) == [(1, "a", "Feine Butter mild"), (1, "b", "Feine Butter mild"), (2, "a", "Feine Butter mild")]


def test_wordings_of_promotions_are_read_once(spark):
    rows = [("3 für 2", 1.0), ("3 für 2", 2.0), (None, 1.0), ("im Markt SPECIAL_PRICE kind=card label=Karte price=1,50 nur heute", 2.0), ("SPECIAL_PRICE kind=lidl_plus label=Plus price=1,50", 1.0)]
    found = promo.with_promotion(spark.createDataFrame(rows, "text string, price double"), "text", "price", "price")
    assert found.columns == ["text", "price", "promotion"] and ("Distinct" in plan(found) or "Deduplicate" in plan(found))
    got = sorted((r.text or "", r.price, r.promotion and (r.promotion["kind"], r.promotion["saving"], r.promotion["label"])) for r in found.collect())
    assert got == [("", 1.0, None), ("3 für 2", 1.0, ("free_item", 1.0, "3 für 2")), ("3 für 2", 2.0, ("free_item", 2.0, "3 für 2")), (rows[4][0], 1.0, None), (rows[3][0], 2.0, ("member_price", 0.5, "Karte · 1,50 €"))]


def test_cards_of_a_text_are_read_within_their_row(spark):
    text = "Gurken frisch\nje 2 x 400 g\n1,00 €\n\nTomaten rot\nje 500 g (1 kg = 2,50 €)\n(1 kg = 2,50 €)\n2,00 €\nsüß\n3,00 €"
    docs = spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id long, text string")
    found = extract.card_offers(docs, above=2, below=1)
    assert "Window" not in plan(found) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.pos, r.name, r.price, r.quantity, r.unit, r.unit_price) for r in found.where("doc_id = 1").orderBy("pos").collect()]
    assert got == [(2, "Gurken frisch", 1.0, 800.0, "g", None), (8, "süß", 3.0, None, None, None)]
    assert found.where("doc_id IS NULL").count() == len(got)


def test_pairs_of_places_are_made_last(spark):
    """What is shuffled are pairs of positions with arrays; 300 users and 200 stores of one position, and ids that are null, meet above the joins."""
    users = spark.createDataFrame([(i, 50.0, 7.0, 10) for i in range(300)] + [(None, 50.0, 7.0, 10), (301, 51.0, 7.0, 1), (302, None, 7.0, 10)], "user_id long, lat double, lon double, radius_km int")
    stores = spark.createDataFrame([(i, 50.01, 7.0, True) for i in range(200)] + [(None, 50.01, 7.0, True), (201, 50.01, 7.0, False), (202, 53.0, 7.0, True)], "store_id long, lat double, lon double, active boolean")
    found = relational.stores_in_radius(users, stores, "user_id", digits=6)
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert top.count("Generate explode") == 2
    rows = [tuple(r) for r in found.collect()]
    ids = [*range(300), None], [*range(200), None]
    assert len(rows) == 301 * 201 and {r[:2] for r in rows} == {(u, s) for u in ids[0] for s in ids[1]} and {r[2] for r in rows} == {1.111951}


def test_favourites_are_read_once_to_be_measured(spark):
    users = spark.createDataFrame([(1, 50.0, 7.0, 10), (2, None, None, 10)], "user_id long, lat double, lon double, radius_km int")
    stores = spark.createDataFrame([(1, 50.01, 7.0, True), (2, 50.01, 7.0, False), (3, 53.0, 7.0, True), (4, None, None, True)], "store_id long, lat double, lon double, active boolean")
    liked = spark.createDataFrame([(u, s) for u in (1, 2, 9, None) for s in (1, 2, 3, 4, 9)], "user_id long, store_id long")
    found = relational.pairs_out_of_radius(liked, users, stores)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in liked.collect()} - {(1, 1)} and found.count() == 19
