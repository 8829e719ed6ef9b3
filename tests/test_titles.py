"""Titles out of lines, against plain versions; validity of leaflets; German order."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from korbwerk.functions import dates, names
from korbwerk.operators import titles

#: Texts with (title part, whole text fits, part fits, names a package, names a single piece).
TEXTS = {
    "Zarte Butterkekse": ("Zarte Butterkekse", True, True, False, False),
    "Gouda": ("Gouda", True, True, False, False),
    "Tomaten": ("Tomaten", True, True, False, False),
    "„Hausmarke": ("„Hausmarke", True, True, False, False),
    "je 500 g": ("", False, False, True, False),
    "je Topf": ("je Topf", False, False, False, True),
    "Spanien": ("Spanien", False, False, False, False),
    "versch. Sorten": ("", False, False, False, False),
    "": ("", False, False, False, False),
    "Knusper Vollmilch Klasse I": ("Knusper Vollmilch", False, True, False, False),
    "Spanien Zarte Mandarinen": ("Zarte Mandarinen", True, True, False, False),
}
LINES = "card_key long, line_no long, text string, y0 double, y1 double, max_height double"


def count(text):
    return sum(len(w) >= 2 for w in "".join(c if c.isalpha() else " " for c in text).split())


def dense(lines):
    judged = [TEXTS[x] for x in lines]
    end = max([i for i, j in enumerate(judged) if j[3] or j[4]], default=len(lines))
    found = sorted(((count(p) * 14 + min(len(p), 50) - (end - i) * 10 - 30 * (count(p) == 1), i, p) for i, (p, _, fits, *_) in enumerate(judged) if fits and end - 9 <= i < end), reverse=True)
    if not found:
        return next((x for x, j in zip(lines, judged) if j[1]), "")
    _, at, best = found[0]
    for _, i, p in found[1:]:
        if (count(best) == 1 or best[0] in "„\"'") and abs(i - at) == 1 and count(p) == 1 and len(best) + len(p) < 65:
            return f"{best} {p}" if at < i else f"{p} {best}"
    return best


def placed(lines, top):
    fits = [TEXTS[t][1] for t, *_ in lines]
    end = max([i for i, (t, y0, *_) in enumerate(lines) if TEXTS[t][3] and y0 < top], default=len(lines))
    below = lines[end][1] if end < len(lines) else top
    found = sorted(((h * 4 - max(0, below - y1) * 0.22 + min(len(t), 50) * 0.08, i, t) for i, (t, _, y1, h) in enumerate(lines) if fits[i] and end - 7 <= i < end), reverse=True)
    if not found:
        found = [(0, i, t) for i, (t, _, y1, _) in enumerate(lines) if fits[i] and y1 < top and top - y1 <= 260][-1:]
    if not found:
        return ""
    at = found[0][1]
    chosen = sorted([found[0][1:]] + [f[1:] for f in found[1:] if abs(f[1] - at) == 1 and abs(lines[f[1]][3] - lines[at][3]) <= 7][:1])
    words = [t for _, t in chosen]
    return words[0] if len(set(words)) == 1 else " ".join(words)


def cards(rng, n):
    return {k: [(rng.choice(list(TEXTS)), float(y0 := i * 30 + rng.randint(0, 5)), y0 + (h := rng.choice([10.0, 14.0, 25.0])), h) for i in range(rng.randint(1, 13))] for k in range(n)}


def rows(found):
    return [(k, i, *line) for k, lines in found.items() for i, line in enumerate(lines)]


def test_dense_titles_as_by_a_plain_loop(spark):
    found = cards(random.Random(1), 80)
    table = spark.createDataFrame(rows(found) + [(None, 1, "Gouda", 0.0, 1.0, 1.0), (3, None, "Gouda", 0.0, 1.0, 1.0), (900, 1, None, None, None, None)], LINES)
    got = {r.card_key: r.title for r in titles.dense_titles(table.withColumn("title", F.lit("clash")).withColumn("raw", F.lit(1))).collect()}
    assert got == {k: dense([t for t, *_ in lines]) for k, lines in found.items()} | {900: ""}


def test_placed_titles_as_by_a_plain_loop(spark):
    found = cards(random.Random(2), 80)
    tops = {k: 60.0 + k * 5 for k in found}
    anchors = spark.createDataFrame([(k, t) for k, t in tops.items()] + [(1, 999.0), (None, 1.0), (2, None), (901, 5.0)], "card_key long, top double")
    got = {r.card_key: r.title for r in titles.placed_titles(spark.createDataFrame(rows(found), LINES), anchors).collect()}
    assert got == {k: placed(lines, tops[k]) for k, lines in found.items()}


def test_titles_of_no_lines(spark):
    none = spark.createDataFrame([], LINES)
    assert titles.dense_titles(none).count() == 0
    assert titles.placed_titles(none, spark.createDataFrame([], "card_key long, top double")).count() == 0


def test_cut_title_parts(spark):
    cases = {"A - Rote Äpfel": "Rote Äpfel", "Rote Äpfel, ab": "Rote Äpfel", "Portugal Birnen je 2 Stück": "Birnen", None: ""}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", names.title_part(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_leaflet_validity(spark):
    cases = {
        "Gültig ab 3.8.26": (date(2026, 8, 3), date(2026, 8, 8)),
        "Gültig ab 31.2.26, 1.3.26 - 7.3.26": (date(2026, 3, 1), date(2026, 3, 7)),
        "1.3.2026 - 16.3.2026": None,
        "Di. 30.12. - Sa. 3.1.": None,
        "Mo 3. 8. bis einschl. - Sa 8. 8.": (date(2026, 8, 3), date(2026, 8, 8)),
        "gültig von 3.8.2026 – 8.8.": (date(2026, 8, 3), date(2026, 8, 8)),
        "30. Dezember 2025 - 3. JANUAR 2026": (date(2025, 12, 30), date(2026, 1, 3)),
        "2. März 2026 - 7. Maerz 2026": (date(2026, 3, 2), date(2026, 3, 7)),
        "53. Woche 2026": (date(2026, 12, 28), date(2027, 1, 2)),
        "53. Woche 2025, KW 7": None,
        "KW 54 KW 7": None,
        "kw 7": (date(2026, 2, 9), date(2026, 2, 14)),
        "": None,
        None: None,
    }
    ref = F.lit("2026-05-01").cast("date")
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", dates.leaflet_validity(F.col("t"), ref).alias("v"), dates.page_validity(F.col("t"), F.lit("KW 1"), ref).alias("w")).collect()
    assert {r.t: tuple(r.v) if r.v else None for r in rows} == cases
    assert {r.t: tuple(r.w) for r in rows} == {t: v or (date(2025, 12, 29), date(2026, 1, 3)) for t, v in cases.items()}


@pytest.mark.parametrize("name", ["fd5_inferred_validity", "fs7_title"])
def test_wordings_are_read_once_each(spark, sf_dir, name):
    """The rules work on different wordings below a join, not on each product's row."""
    from korbwerk.plans import catalog

    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    rules = [i for i, line in enumerate(plan) if "Project [" in line and "regexp_extract" in line or "Aggregate" in line and "regexp_extract" in line]
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert joins and all(i > joins[0] for i in rules) and any("Aggregate" in line for line in plan)
