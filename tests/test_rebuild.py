"""Strict pages against plain loops, and their odd cases."""

import random

from pyspark.sql import functions as F

from korbwerk.operators import rebuild
from korbwerk.plans.views import Views

CARD = "page_key long, card_id string, names array<string>, price double, quantity double, unit string, unit_price double"
OFFER = "page_key long, offer_id string, name string, price double, quantity double, unit string, unit_price double"
TAG = "page_key long, tag_id long, x0 double, y0 double, x1 double, y1 double"


def plain_cell(tag, tags, width, height):
    x0, y0, x1, y1 = tag[1:]
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    others = [((a + c) / 2, (b + d) / 2) for i, a, b, c, d in tags if i != tag[0]]
    row = [x for x, y in others if abs(y - cy) <= 190]
    column = [y for x, y in others if abs(x - cx) <= 230]
    left = max([0.0] + [(cx + x) / 2 for x in row if x < cx])
    right = min([float(width)] + [(cx + x) / 2 for x in row if x >= cx])
    top = max([0.0] + [(cy + y) / 2 for y in column if y < cy])
    bottom = min([float(height)] + [(cy + y) / 2 for y in column if y >= cy])
    wide, high = min(width, 500.0), min(height, 580.0)
    if right - left > wide:
        left, right = max(0.0, cx - wide * 0.58), min(float(width), cx + wide * 0.42)
    if bottom - top > high:
        top, bottom = max(0.0, cy - high * 0.84), min(float(height), cy + high * 0.16)
    return int(left), int(max(0.0, min(top, y0 - 55))), int(right), int(min(float(height), max(bottom, y1 + 30)))


def test_cells_equal_a_plain_loop(spark):
    rnd = random.Random(5)
    pages = {p: [] for p in range(5)}
    for p, tags in pages.items():
        for i in range(1 + p * 12):
            x, y = rnd.uniform(-50, 900), rnd.uniform(-50, 1250)
            tags.append((i, x, y, x + rnd.uniform(5, 120), y + rnd.uniform(5, 90)))
        tags.extend([(1000 + i, *t[1:]) for i, t in enumerate(tags[:2])])
    rows = [(p, *t) for p, tags in pages.items() for t in tags] + [(9, 1, None, 0.0, 1.0, 1.0), (None, 1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, TAG).withColumn("band", F.lit("clash"))
    found = {(r.page_key, r.tag_id): (r.left, r.top, r.right, r.bottom) for r in rebuild.card_cells(df, 1000, 1300).collect()}
    assert found == {(p, t[0]): plain_cell(t, tags, 1000, 1300) for p, tags in pages.items() for t in tags}
    assert rebuild.card_cells(df.limit(0), 1000, 1300).collect() == []


def test_names_that_readings_agree_on(spark):
    cases = {
        "longest": (["Feine Butter", "Feine Butter mild"], "Feine Butter mild"),
        "alone": (["Feine Butter", "Feine Butter", None], None),
        "apart": (["Feine Butter", "Frische Vollmilch"], None),
        "supported": (["Frische Vollmilch", "Feine Butter", "Feine Butter mild", "Butter mild gesalzen"], "Feine Butter mild"),
        "first of equals": (["Feine Butter mild", "Feine Butter herb"], "Feine Butter mild"),
        "clipped": (["Feine Butter", "Feine Butter pr"], None),
        "empty": ([], None),
        "null": (None, None),
        "long": (["Feine Butter " * 2000, "Feine Butter"], None),
    }
    df = spark.createDataFrame([(1, k, v[0], 1.0, None, None, None) for k, v in cases.items()], CARD).withColumn("name", F.lit("clash"))
    found = {r.card_id: r.name for r in rebuild.consensus_names(df).collect()}
    assert {k: found.get(k) for k in cases if k != "long"} == {k: v[1] for k, v in cases.items() if k != "long"}


def test_bad_pages_are_replaced(spark):
    def offers(page, good, unfit, wrong=0):
        rows = [(page, f"g{i}", f"Feine Butter {'abcdefghij'[i]}xyz", 2.0, 500.0, "g", 4.0) for i in range(good)]
        rows += [(page, f"u{i}", None if i % 2 else "Feine pr", 1.0, None, None, None) for i in range(unfit)]
        return rows + [(page, f"w{i}", "Feine Butter wild", 3.0, 500.0, "g", 4.0) for i in range(wrong)]

    def cards(page, n, price=2.5, per=None):
        return [(page, f"c{i}", [f"Frische {w}", f"Frische {w} mild"], price, 500.0, "g", per) for i, w in enumerate(["Vollmilch", "Sahne", "Molke", "Buttermilch"][:n])]

    rows = offers(1, 4, 1) + offers(2, 8, 1) + offers(3, 6, 2) + offers(4, 2, 0, 3) + offers(5, 0, 1) + offers(6, 4, 1) + [(None, "free", None, 1.0, None, None, None)]
    given = cards(1, 2) + cards(2, 4) + cards(3, 2) + cards(4, 4) + cards(5, 1) + cards(6, 3, per=9.0) + cards(1, 2) + [(None, "c", ["Frische Sahne", "Frische Sahne mild"], 1.0, None, None, None)]
    clash = F.lit("clash")
    kept, metrics = rebuild.strict_pages(spark.createDataFrame(rows, OFFER).withColumn("strict", clash), spark.createDataFrame(given, CARD).withColumn("name", clash))
    found = {}
    for r in kept.collect():
        found.setdefault(r.page_key, []).append((r.offer_id, r.rebuilt))
    assert sorted(found[1]) == [("c0", True), ("c1", True)]  # 1 of 5 unfit; as many cards as half of 4, repeated cards once
    assert sorted(found[2]) == [(f"g{i}", False) for i in range(8)]  # 1 of 9 is below the share
    assert sorted(found[3]) == [(f"g{i}", False) for i in range(6)]  # two cards are fewer than half of six
    assert sorted(found[4]) == [("g0", False), ("g1", False)]  # wrong prices alone make no bad page
    assert 5 not in found and sorted(found[6]) == [(f"g{i}", False) for i in range(4)]  # one card is too few; cards against their unit price don't count
    assert found[None] == [("free", False)]
    sums = {r.page_key: (r.checked, r.correct, r.rejected, r.recovered) for r in metrics.collect()}
    assert sums == {1: (6, 6, 1, 2), 2: (8, 8, 1, 0), 3: (6, 6, 2, 0), 4: (5, 2, 3, 0), 5: (0, 0, 1, 0), 6: (4, 4, 1, 0)}
    none = spark.createDataFrame([], OFFER)
    assert [x.collect() for x in rebuild.strict_pages(none, spark.createDataFrame([], CARD))] == [[], []]


def test_cards_of_tags_with_one_id(spark):
    """Two tags of one id far apart keep their own neighbours."""
    rows = [(1, 7, 100.0, 100.0, 160.0, 130.0), (1, 7, 700.0, 900.0, 760.0, 930.0), (1, 8, 300.0, 100.0, 360.0, 130.0), (1, 9, 500.0, 900.0, 560.0, 930.0)]
    df = spark.createDataFrame(rows, "page_key long, tag_id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in rebuild.card_cells(df, 1000, 1300).collect())
    alone = sorted(tuple(r) for one in (0, 1) for r in rebuild.card_cells(df.where(F.col("tag_id") != 7).union(spark.createDataFrame([rows[one]], df.schema)), 1000, 1300).where("tag_id = 7").collect())
    assert [r for r in got if r[1] == 7] == alone and len(got) == 4


def test_tags_of_a_page_meet_within_its_row(spark, monkeypatch):
    """Pages of more tags than an array holds, whose tags meet by bands, have the same cells."""
    rnd = random.Random(8)
    rows = [(p, i % 11, x, y, x + 60, y + 30) for p in range(2) for i in range(12 + p) for x, y in [(rnd.uniform(0, 900), rnd.uniform(0, 1200))]]
    tags = spark.createDataFrame(rows + rows[:1] * 2 + [(0, None, 1.0, 1.0, 5.0, 5.0)], TAG).repartition("page_key")
    cells = rebuild.card_cells(tags, 1000, 1300)
    within = sorted(map(str, cells.collect()))
    assert "posexplode(tags" in cells._jdf.queryExecution().optimizedPlan().toString() and len(within) == 28
    monkeypatch.setattr(rebuild, "PAGE_TAGS", 12)
    assert sorted(map(str, rebuild.card_cells(tags, 1000, 1300).collect())) == within
    monkeypatch.setattr(rebuild, "PAGE_TAGS", 0)
    assert sorted(map(str, rebuild.card_cells(tags, 1000, 1300).collect())) == within


def test_offers_are_merged_where_their_product_stands(spark, sf_dir):
    """A join of these offers with products shuffles them once, and a judged name goes along once."""
    v = Views(spark, sf_dir)
    plan = v.offers_by_product.join(v.products.hint("merge"), "product_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and v.offers_by_product.exceptAll(v.offers).count() == 0
    offers = spark.createDataFrame([(1, "a", "Feine Butter", 1.0, None, None, None), (1, "b", None, 1.0, None, None, None)], OFFER)
    rows = rebuild.judged(offers)
    assert [(r.offer_id, r.name, r.strict) for r in rows.orderBy("offer_id").collect()] == [("a", "Feine Butter", True), ("b", "", False)]
