"""Lines, price anchors and offers of pages against plain versions, and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from korbwerk.operators import layout

WORD = "page_key long, word_id long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, cell string"
BLOCK = "page_key long, block_id long, x0 double, y0 double, x1 double, y1 double, text string, retailer string"
TAG = "page_key long, tag_id long, x0 double, y0 double, x1 double, y1 double, price double"


def plain_lines(words):
    lines = []
    for w in sorted(words, key=lambda w: ((w[4] + w[6]) / 2, w[3], w[1])):
        centre, tolerance = (w[4] + w[6]) / 2, max(10.0, min(20.0, (w[6] - w[4]) * 0.55))
        for line in lines[: -6 : -1]:
            if abs(sum((x[4] + x[6]) / 2 for x in line) / len(line) - centre) <= tolerance:
                line.append(w)
                break
        else:
            lines.append([w])
    return sorted((min(w[4] for w in line), min(w[3] for w in line), [w[2] for w in sorted(line, key=lambda w: w[3])]) for line in lines)


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_a_plain_fold(spark, seed):
    rnd = random.Random(seed)
    words = []
    for page in range(4):
        for i in range(60):
            y, x = rnd.uniform(0, 400), rnd.uniform(0, 500)
            words.append((page, i, f"w{i}", x, y, x + 30, y + rnd.uniform(5, 60), rnd.random(), "clash"))
    found = layout.line_groups(spark.createDataFrame(words, WORD)).collect()
    for page in range(4):
        mine = sorted((r.y0, r.x0, r.text.split(" ")) for r in found if r.page_key == page)
        assert mine == plain_lines([w for w in words if w[0] == page])


def test_lines_of_odd_words(spark):
    rows = [(None, 1, None, 0.0, 0.0, 5.0, 10.0, None, "x"), (None, 2, "b", 9.0, 0.0, 12.0, 10.0, 0.5, "x"), (1, 3, "a", None, 0.0, 1.0, 1.0, 0.1, "x"), (2, 4, "c", 0.0, 0.0, 1.0, 1.0, 0.25, "x"), (2, 4, "c", 0.0, 0.0, 1.0, 1.0, 0.75, "x")]
    df = spark.createDataFrame(rows, WORD)
    assert sorted((str(r.page_key), r.line_no, r.text, r.confidence) for r in layout.line_groups(df).collect()) == [("2", 1, "c c", 0.5), ("None", 1, " b", 0.5)]
    assert layout.line_groups(df.limit(0)).collect() == []


def plain_anchors(blocks):
    """blocks (id, x0, y0, x1, y1, price, app); those without a price and those with a loyalty price name the programme."""
    labels = [b for b in blocks if b[5] is None or b[6] is not None]
    priced = [b for b in sorted(blocks) if b[5] is not None]
    used, out = set(), []
    for a in priced:
        if a[0] in used:
            continue
        partner = None
        for b in priced:
            if a[6] is not None or b[6] is not None or b[0] == a[0] or b[0] in used:
                continue
            box = min(a[1], b[1]) - 18, min(a[2], b[2]) - 10, max(a[3], b[3]) + 18, max(a[4], b[4]) + 10
            named = any(x[1] < box[2] and x[3] > box[0] and x[2] < box[3] and x[4] > box[1] for x in labels)
            if b[2] >= a[2] and b[5] < a[5] and max(b[2] - a[4], a[2] - b[4], 0) <= 45 and abs(a[1] + a[3] - b[1] - b[3]) / 2 <= 55 and named:
                partner = b
                break
        if partner:
            used.add(partner[0])
        out.append((a[0], partner and partner[0], a[5], partner[5] if partner else a[6]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_anchors_equal_a_plain_fold(spark, seed):
    rnd = random.Random(seed)
    rows, plain = [], {p: [] for p in range(6)}
    for page in plain:
        for i in range(40):
            x, y, price = rnd.uniform(0, 150), rnd.uniform(-40, 260), rnd.randint(100, 999) / 100
            kind = rnd.random()
            text = "nur mit Lidl Plus" if kind < 0.2 else f"{price + 3:.2f}\n{price:.2f}* mit Lidl Plus" if kind < 0.3 else f"{price:.2f} *"
            box = (x, y, x + rnd.uniform(10, 60), y + rnd.uniform(5, 90))
            rows.append((page, i, *box, text, "LIDL"))
            plain[page].append((i, *box, *((None, None) if kind < 0.2 else (round(price + 3, 2), price) if kind < 0.3 else (price, None))))
    found = layout.price_anchors(spark.createDataFrame(rows, BLOCK)).collect()
    for page, blocks in plain.items():
        mine = sorted((r.block_id, r.partner_id, r.price, r.app_price) for r in found if r.page_key == page)
        assert mine == plain_anchors(blocks)
    assert any(r.partner_id is not None for r in found)


def test_anchors_of_odd_blocks(spark):
    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0, None, None), (None, 2, 0.0, 0.0, 1.0, 1.0, "1,99*", None), (2, 3, None, 0.0, 1.0, 1.0, "1,99*", None), (3, 4, 0.0, 0.0, 1.0, 1.0, "1,99*", None)]
    df = spark.createDataFrame(rows, BLOCK).withColumn("cell", F.lit("clash"))
    assert [(r.page_key, r.block_id, r.partner_id, r.price) for r in layout.price_anchors(df).collect()] == [(3, 4, None, 1.99)]
    assert layout.price_anchors(df.limit(0)).collect() == []


def test_offers_of_crowded_and_empty_pages(spark):
    """A crowded page gives each tag its own block, by what the unit prices say; a page of tags alone, or of blocks alone, gives none."""
    blocks, tags = [], []
    for i in range(30):
        x, y, price = i % 6 * 60.0, i // 6 * 60.0, 100 + i * 37
        blocks.append((1, i, x, y, x + 55, y + 25, f"Feine Ware Nummer {chr(65 + i % 26)}{chr(97 + i % 7)}x\nje 500 g\n(1 kg = {price * 2 // 100},{price * 2 % 100:02d})", "REWE"))
        tags.append((1, i, x + 10, y + 28, x + 45, y + 50, price / 100))
    blocks += [(2, 1, 0.0, 0.0, 50.0, 20.0, "Guter Käse\nje 100 g", "REWE"), (4, 1, 0.0, 0.0, 50.0, 20.0, "Guter Käse am Stück", None), (5, 1, 0.0, 0.0, 50.0, 20.0, None, "REWE")]
    tags += [(3, 1, 0.0, 0.0, 5.0, 5.0, 1.99), (4, 1, 0.0, 30.0, 50.0, 40.0, 2.49), (4, 2, 0.0, 30.0, 50.0, 40.0, 1.99), (5, 1, 0.0, 30.0, 50.0, 40.0, 1.0), (None, 1, 0.0, 0.0, 1.0, 1.0, 1.0), (6, 1, 0.0, 0.0, 1.0, 1.0, None)]
    found = layout.page_offers(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(tags, TAG)).collect()
    assert sorted((r.tag_id, r.block_id, r.price) for r in found if r.page_key == 1) == [(i, i, (100 + i * 37) / 100) for i in range(30)]
    assert [(r.page_key, r.name, r.price, r.app_price, r.cost) for r in found if r.page_key != 1] == [(4, "Guter Käse am Stück", 2.49, 1.99, None)]
