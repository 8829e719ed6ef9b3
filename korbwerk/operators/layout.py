"""Leaflet pages as tables of words, blocks and price tags: lines of words, price anchors, offers.

A page's order-dependent steps (lines that grow, anchors that use up their partners, tags that merge) are folds over the boxes of
one page, which are a leaflet page's and meet in one task; candidates of all steps are found by joins and expressions.

Defined cases, for all functions. Boxes with null coordinates are left out; null texts count as empty. A null page is a page of its own only where said. Repeated boxes are boxes
of their own, ties go by id. Empty tables give empty results. Other columns are not carried along, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk import constants as K
from korbwerk.functions import names
from korbwerk.functions import price as P
from korbwerk.functions.geo import gap
from korbwerk.operators.matching import ACCEPT_COST, cheapest_pairs, each_page

BOX = ["x0", "y0", "x1", "y1"]
#: A word joins one of the last LINES lines whose mean centre is within 0.55 of its height, at least 10 and at most 20.
LINES, LEAST_OFF, MOST_OFF, OFF_SHARE = 5, 10.0, 20.0, 0.55
#: A second price below or beside one, at most so far off, is the loyalty programme's if that is named around both.
PARTNER_GAP, PARTNER_SHIFT, AROUND = 45.0, 55.0, (18.0, 10.0)
CELL = 64.0
LOYALTY = r"(?iU)\bmit\s+lidl\s+plus\b"
LINE = "page_key long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, max_height double, confidence double"


def _boxed(df: DataFrame, *more: str) -> DataFrame:
    return df.select("page_key", *more, *[F.col(c).cast("double").alias(c) for c in BOX]).dropna(subset=BOX)


def _lines_of(page: pa.Table) -> pa.Table:
    rows = page.to_pydict()
    x0, y0, x1, y1 = (rows[c] for c in BOX)
    centre = [(a + b) / 2 for a, b in zip(y0, y1, strict=True)]
    lines: list[list] = []  # [sum of centres, words]
    for i in sorted(range(len(centre)), key=lambda i: (centre[i], x0[i], rows["word_id"][i])):
        off = max(LEAST_OFF, min(MOST_OFF, (y1[i] - y0[i]) * OFF_SHARE))
        line = next((x for x in reversed(lines[-LINES:]) if abs(x[0] / len(x[1]) - centre[i]) <= off), None)
        if line is None:
            lines.append([centre[i], [i]])
        else:
            line[0] += centre[i]
            line[1].append(i)
    out = []
    for _, words in lines:
        words = sorted(words, key=lambda i: x0[i])
        sure = [rows["confidence"][i] for i in words if rows["confidence"][i] is not None]
        out.append((" ".join(rows["text"][i] or "" for i in words), min(x0[i] for i in words), min(y0[i] for i in words), max(x1[i] for i in words), max(y1[i] for i in words), max(y1[i] - y0[i] for i in words), sum(sure) / len(sure) if sure else None))
    out.sort(key=lambda r: (r[2], r[1]))
    key = rows["page_key"][0]
    cols = list(zip(*out, strict=True))
    return pa.table({"page_key": pa.array([key] * len(out), pa.int64()), "line_no": pa.array(range(1, len(out) + 1), pa.int32()), "text": pa.array(cols[0], pa.string())} | {n: pa.array(c, pa.float64()) for n, c in zip(("x0", "y0", "x1", "y1", "max_height", "confidence"), cols[1:], strict=True)})


def line_groups(words: DataFrame) -> DataFrame:
    """words (page_key, word_id, text, x0, y0, x1, y1, confidence) -> the page's lines, from top to bottom.

    Words are taken by the height of their centre. Each joins the newest of the last five lines whose mean centre, of the words it has by then, is near; else it begins a line.
    A null page is a page of its own.
    """
    return _boxed(words, "word_id", "text", F.col("confidence").cast("double").alias("confidence")).groupBy("page_key").applyInArrow(_lines_of, LINE)


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def _renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("page_key",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def price_anchors(blocks: DataFrame) -> DataFrame:
    """blocks (page_key, block_id, x0, y0, x1, y1, text) -> one anchor a selling price: (page_key, block_id, partner_id, box, price, regular_price, app_price).

    Blocks are taken in order of their ids, each used once. A block without a loyalty price uses up the first unused block not above it with a lower
    price, near below or beside it, if the programme is named in the corridor around both: that one's price becomes its loyalty price, and their boxes one.
    Rows of a null page have no anchors.
    """
    blocks = _boxed(blocks, "block_id", F.coalesce("text", F.lit("")).alias("text")).where("page_key IS NOT NULL")
    priced = blocks.withColumn("p", P.price_triple(F.col("text"))).where("p IS NOT NULL").select("page_key", "block_id", *BOX, "p.price", "p.regular", "p.app")
    alone = priced.where("app IS NULL")
    near = _renamed(alone, "a_").withColumn("cell", F.explode(_cells(F.col("a_y0"), F.col("a_y1") + PARTNER_GAP)))
    pairs = near.join(_renamed(alone, "b_").withColumn("cell", F.floor(F.col("b_y0") / CELL)), ["page_key", "cell"])
    shift = F.abs((F.col("a_x0") + F.col("a_x1")) - (F.col("b_x0") + F.col("b_x1"))) / 2
    pairs = pairs.where((F.col("a_block_id") != F.col("b_block_id")) & (F.col("b_y0") >= F.col("a_y0")) & (F.col("b_price") < F.col("a_price")) & (gap(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1")) <= PARTNER_GAP) & (shift <= PARTNER_SHIFT))
    low = lambda c, by: F.least("a_" + c, "b_" + c) - by
    high = lambda c, by: F.greatest("a_" + c, "b_" + c) + by
    label = _renamed(blocks.where(F.col("text").rlike(LOYALTY)).select("page_key", *BOX), "l_", ("page_key",)).withColumnRenamed("page_key", "l_page")
    named = (F.col("page_key") == F.col("l_page")) & (F.col("l_x1") > low("x0", AROUND[0])) & (F.col("l_x0") < high("x1", AROUND[0])) & (F.col("l_y1") > low("y0", AROUND[1])) & (F.col("l_y0") < high("y1", AROUND[1]))
    pairs = pairs.join(label, named, "left_semi")
    options = pairs.groupBy("page_key", F.col("a_block_id").alias("block_id")).agg(F.array_sort(F.collect_set("b_block_id")).alias("options"))
    pages = priced.join(options, ["page_key", "block_id"], "left").groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("block_id", F.coalesce("options", F.array().cast("array<bigint>")).alias("options")))).alias("blocks"))
    ids, taken = "array<bigint>", "array<struct<block_id:bigint,partner_id:bigint>>"

    def step(acc: Column, block: Column) -> Column:
        partner = F.get(F.filter(block["options"], lambda b: ~F.array_contains(acc["used"], b)), F.lit(0))
        one = F.struct(block["block_id"].cast("bigint").alias("block_id"), partner.cast("bigint").alias("partner_id"))
        more = F.struct(F.when(partner.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], partner.cast("bigint"))).alias("used"), F.array_append(acc["out"], one).cast(taken).alias("out"))
        return F.when(F.array_contains(acc["used"], block["block_id"].cast("bigint")), acc).otherwise(more)

    start = F.struct(F.array().cast(ids).alias("used"), F.array().cast(taken).alias("out"))
    anchors = pages.select("page_key", F.inline(F.aggregate("blocks", start, step, lambda acc: acc["out"])))
    partner = _renamed(priced.select("page_key", "block_id", *BOX, "price"), "b_").withColumnRenamed("b_block_id", "partner_id")
    found = anchors.join(priced, ["page_key", "block_id"]).join(partner, ["page_key", "partner_id"], "left")
    box = [F.least(c, "b_" + c).alias(c) for c in ("x0", "y0")] + [F.greatest(c, "b_" + c).alias(c) for c in ("x1", "y1")]
    return found.select("page_key", "block_id", "partner_id", *box, "price", F.col("regular").alias("regular_price"), F.coalesce("b_price", "app").alias("app_price"))


def _merged_tags(rows: list[tuple]) -> list[tuple]:
    """Price tags (tag_id, price, box) of one label, which lie over each other, put together one after another."""
    groups: list[list] = []  # [id of the first tag, prices, box]
    for i, price, *b in sorted(rows, key=lambda r: r[0]):
        area = max((b[2] - b[0]) * (b[3] - b[1]), 1)

        def same(g: list[float], b: list[float] = b, area: float = area) -> bool:
            over = max(min(g[2], b[2]) - max(g[0], b[0]), 0) * max(min(g[3], b[3]) - max(g[1], b[1]), 0)
            share = over / min(max((g[2] - g[0]) * (g[3] - g[1]), 1), area)
            close = abs(g[0] + g[2] - b[0] - b[2]) / 2 < K.SAME_LABEL_X and abs(g[1] + g[3] - b[1] - b[3]) / 2 < K.SAME_LABEL_Y
            return share >= K.SAME_LABEL_SHARE or (share > 0 and close)

        hit = next((g for g in groups if same(g[2])), None)
        if hit is None:
            groups.append([i, [price], b])
            continue
        g = hit[2]
        hit[2] = [min(g[0], b[0]), min(g[1], b[1]), max(g[2], b[2]), max(g[3], b[3])]
        if price not in hit[1]:
            hit[1].append(price)
    return [(i, prices, *box) for i, prices, box in groups]


_LABEL = {"tag_id": ("bigint", pa.int64()), "prices": ("array<double>", pa.list_(pa.float64()))} | dict.fromkeys(BOX, ("double", pa.float64()))
_CHOSEN = {"block_id": ("bigint", pa.int64()), "tag_id": ("bigint", pa.int64()), "cost": ("double", pa.float64())}


def _label_pages(tags: DataFrame) -> DataFrame:
    """(page_key, labels): a page's price labels in one row."""
    tags = _boxed(tags, F.col("tag_id").cast("long").alias("tag_id"), F.col("price").cast("double").alias("price")).where("page_key IS NOT NULL AND price > 0")
    return each_page(tags, ["tag_id", "price", *BOX], _merged_tags, _LABEL).withColumnRenamed("found", "labels")


def _rows_of(array: str) -> Column:
    """A generator of an array's structs. The array is read whole, so that all that read it share its shuffle."""
    return F.inline(F.transform(array, lambda x: x))


def tag_groups(tags: DataFrame) -> DataFrame:
    """tags (page_key, tag_id, x0, y0, x1, y1, price) -> one row a price label: the id of its first tag, its box and prices."""
    return _label_pages(tags).select("page_key", _rows_of("labels"))


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the shorter interval that both have."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1.0))


def assignment_cost(retailer: Column) -> Column:
    """What it costs to give a description (d_ columns) the price label (g_ columns): distance, the retailer's layout, and how far the label's prices are from the price that package and unit price give."""
    d, g = (lambda c: F.col("d_" + c)), (lambda c: F.col("g_" + c))
    across, down = _overlap(d("x0"), d("x1"), g("x0"), g("x1")), _overlap(d("y0"), d("y1"), g("y0"), g("y1"))
    far = F.hypot(gap(d("x0"), d("x1"), g("x0"), g("x1")), gap(d("y0"), d("y1"), g("y0"), g("y1"))) * F.when((across > 0.25) | (down > 0.25), 0.45).otherwise(1.0)
    shift = F.abs((d("x0") + d("x1")) - (g("x0") + g("x1"))) / 2
    when = lambda test, value: F.when(test, value).otherwise(0.0)
    netto = when(d("y0") > g("y0") + 18, 450 + (d("y0") - g("y0")) * 3)
    aldi = when(d("y0") > g("y0") + 50, 260 + (d("y0") - g("y0")) * 1.5)
    rewe = when(shift > 180, 60.0) + when(d("y0") > g("y1") + 4, 180 + (d("y0") - g("y1")) * 2.2) + when(g("y0") > d("y1") + 95, 60.0)
    layout = F.when(retailer == "Netto Marken-Discount", netto).when(retailer == "ALDI SÜD", aldi).when(retailer == "REWE", rewe).otherwise(0.0)
    off = F.array_min(F.transform(g("prices"), lambda p: F.abs(p - d("expected")) / F.greatest(d("expected"), F.lit(0.05))))
    economy = F.least(off, F.lit(3.0)) * 1500 - F.when(off <= 0.02, 520).when(off <= 0.05, 280).when(off <= 0.10, 90).otherwise(0)
    return far + shift * 0.20 + layout + F.coalesce(economy, F.lit(0.0)) - when(across > 0.15, 30.0) - when(down > 0, 20.0)


def _cheapest(rows: list[tuple]) -> list[tuple]:
    """The pairs (block_id, tag_id, cost) of a page that cost least together."""
    ds, gs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if len(ds) == len(gs) == 1:
        return [r for r in rows[-1:] if r[2] <= ACCEPT_COST]
    at_d, at_g = {d: i for i, d in enumerate(ds)}, {g: i for i, g in enumerate(gs)}
    cost = np.zeros((len(ds), len(gs)))
    for d, g, c in rows:
        cost[at_d[d], at_g[g]] = c
    return [(ds[r], gs[c], float(cost[r, c])) for r, c in cheapest_pairs(cost) if cost[r, c] <= ACCEPT_COST]


def described(blocks: DataFrame) -> DataFrame:
    """Blocks with what they say: name (null if it can't be a product's), package, unit price, and the price that both give. Each different text is read once."""
    texts = blocks.select("text").distinct()
    said = [names.title_of(F.col("text")).alias("line"), P.size(F.col("text")).alias("s"), P.stated_unit_price(F.col("text")).alias("u")]
    rows = _once(_once(texts, said), [names.offer_name(F.col("line")).alias("title")])
    fit = names.plausible_word(F.col("title")) & names.name_issue(F.col("title")).isNull()
    pack = [F.col("s.quantity").alias("quantity"), F.col("s.unit").alias("unit"), F.col("u.price").alias("unit_price"), F.col("u.unit").alias("unit_price_unit")]
    expected = P.expected_price(F.col("s.quantity"), F.col("s.unit"), F.col("u.price"))
    rows = rows.select("text", F.array(F.struct(F.when(fit, F.col("title")).alias("name"), *pack, expected.alias("expected"))).alias("said"))
    return blocks.join(rows, "text").select(*blocks.columns, _rows_of("said"))


def _once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """`df` with more columns, made by a generator of one row: filters and joins above don't repeat what they are made of."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _fallback(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each price label the nearest block that can be a description, with the block right above it if that is one of the six nearest and belongs to it."""
    across = lambda a, b: _overlap(F.col(a + "x0"), F.col(a + "x1"), F.col(b + "x0"), F.col(b + "x1"))
    pairs = _renamed(labels, "g_", ("page_key", "tag_id", "alone")).join(_renamed(blocks.where("name IS NOT NULL"), "d_", ("page_key",)), "page_key")
    shift = F.abs((F.col("d_x0") + F.col("d_x1")) - (F.col("g_x0") + F.col("g_x1"))) / 2
    upright = gap(F.col("d_y0"), F.col("d_y1"), F.col("g_y0"), F.col("g_y1"))
    beside = ((shift <= 165) | (across("d_", "g_") >= 0.08)) & (F.col("d_y0") <= F.col("g_y1") + 65) & (F.col("g_y0") - F.col("d_y1") <= 300)
    pairs = pairs.where(F.when(F.col("alone"), (shift <= 420) & (upright <= 230)).otherwise(beside))
    penalty = upright + shift * 0.22 + F.when(F.col("d_y0") > F.col("g_y1"), 90).otherwise(0) - 35 - F.when(F.col("d_quantity").isNotNull() | F.col("d_unit_price").isNotNull(), 45).otherwise(0)
    nearest = F.row_number().over(Window.partitionBy("page_key", "tag_id").orderBy(penalty, "d_block_id"))
    six = pairs.withColumn("k", nearest).where("k <= 6").groupBy("page_key", "tag_id").agg(F.array_sort(F.collect_list(F.struct("k", *[F.col("d_" + c).alias(c) for c in ("block_id", "text", *BOX)]))).alias("c"))

    def joined(c: Column) -> Column:
        best = c[0]
        fits = lambda b: (b["y1"] <= best["y0"] + 3) & (best["y0"] - b["y1"]).between(0, 45) & (_overlap(b["x0"], b["x1"], best["x0"], best["x1"]) >= 0.25)
        above = F.get(F.filter(F.slice(c, 2, 5), fits), F.lit(0))
        return F.struct(best["block_id"].alias("block_id"), F.concat_ws("\n", above["text"], best["text"]).alias("text"))

    return six.select("page_key", "tag_id", names.bound(F.col("c"), joined).alias("f")).select("page_key", "tag_id", "f.*")


def page_offers(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """Offers of pages, price labels first: (page_key, tag_id, block_id, name, price, app_price, regular_price, quantity, unit, unit_price, unit_price_unit, cost).

    blocks (page_key, block_id, x0, y0, x1, y1, text, retailer), tags (page_key, tag_id, x0, y0, x1, y1, price). Descriptions
    are blocks with a product's name and a package or unit price; they get the labels at the least total cost a page, and labels that are left the nearest block (cost null).
    A price far from what package and unit price give is replaced by the page's price that is near to that. Offers of too low a quality are left out.
    """
    blocks = described(_boxed(blocks, F.col("block_id").cast("long").alias("block_id"), F.coalesce("text", F.lit("")).alias("text"), "retailer").where("page_key IS NOT NULL"))
    pages = _label_pages(tags)
    no = reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(w)) for w in K.NO_DESCRIPTIONS])
    descriptions = blocks.where(F.col("name").isNotNull() & ~no & (F.col("quantity").isNotNull() | F.col("unit_price").isNotNull()))
    met = _renamed(descriptions, "d_", ("page_key", "retailer")).join(pages, "page_key")
    pairs = met.select("page_key", "retailer", *[c for c in met.columns if c.startswith("d_")], _rows_of("labels").alias(*["g_" + c for c in _LABEL]))
    costs = pairs.select("page_key", F.col("d_block_id").alias("block_id"), F.col("g_tag_id").alias("tag_id"), assignment_cost(F.col("retailer")).alias("cost"))
    chosen = each_page(costs, list(_CHOSEN), _cheapest, _CHOSEN).withColumnRenamed("found", "chosen")
    labels = pages.join(chosen, "page_key", "left").withColumn("page_prices", F.flatten("labels.prices"))
    labels = labels.select("page_key", "chosen", "page_prices", (F.size("labels") == 1).alias("alone"), _rows_of("labels"))
    own = F.get(F.filter("chosen", lambda c: c["tag_id"] == F.col("tag_id")), F.lit(0))
    labels = _once(labels, [own["block_id"].alias("block_id"), own["cost"].alias("cost")]).drop("chosen")
    prices = ["prices", "page_prices"]
    first = labels.where("block_id IS NOT NULL").select("page_key", "tag_id", "block_id", *prices, "cost").join(blocks.select("page_key", "block_id", "text"), ["page_key", "block_id"])
    left = labels.where("block_id IS NULL").drop("block_id", "cost")
    second = _fallback(left.drop(*prices), blocks).join(left.select("page_key", "tag_id", *prices), ["page_key", "tag_id"]).withColumn("cost", F.lit(None).cast("double"))
    return _priced(described(first.unionByName(second)))


def _priced(rows: DataFrame) -> DataFrame:
    """Prices of described labels: the one nearest to what is expected, else the highest; a lower one is the loyalty price."""
    e = F.col("expected")
    off = lambda p: F.abs(p - e) / F.greatest(e, F.lit(0.05))
    nearest = lambda ps: F.array_min(F.transform(ps, lambda p: F.struct(off(p).alias("off"), F.abs(p - e).alias("by"), p.alias("p"))))["p"]
    own = F.when(e.isNull() | (F.size("prices") == 1), F.array_max("prices")).otherwise(nearest(F.col("prices")))
    near = nearest(F.filter("page_prices", lambda p: F.abs(p - e) <= F.greatest(F.lit(0.03), 0.018 * e)))
    rows = _once(rows, [own.alias("own"), near.alias("near")])
    price = F.when(off(F.col("own")) > 0.10, F.coalesce("near", "own")).otherwise(F.col("own"))
    rows = _once(rows, [price.alias("price"), F.array_min(F.filter("prices", lambda p: p < F.col("own"))).alias("app")])
    rows = _once(rows, [F.when(F.col("app") < F.col("price"), F.col("app")).alias("app_price"), P.regular_price(F.col("text"), F.col("price")).alias("regular_price")])
    good = names.offer_quality(F.col("name"), F.col("price"), F.col("quantity"), F.col("unit"), F.col("unit_price"), F.lit(0.99))["accepted"]
    return rows.where(F.col("name").isNotNull() & good).select("page_key", "tag_id", "block_id", "name", "price", "app_price", "regular_price", "quantity", "unit", "unit_price", "unit_price_unit", "cost")
