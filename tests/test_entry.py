"""The driver's contract, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["a3_distinct_offers", "a4_cheapest_offer", "j13_offers_of_archives", "w5_preferred_media", "fn21_promotions", "o8_category_plan", "a10_provenance_totals", "u7_prefix_names", "g2_rewe", "g4_netto", "g9_manifest_offers", "f11_admission", "f13_name_issue", "m1_assignment", "m2_matching", "a12_golden_results", "fd5_inferred_validity", "j12_same_store", "o9_greedy_cover", "w2_freshness", "j18_learned_brand", "k4_market_snapshot", "m7_page_metrics", "o1_savings_plan", "o1_o6_unlimited_plan", "g10_flyer_offers", "fs8_placed_titles", "fd6_leaflet_validity", "t7_german_order"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm(tuple(r[c] for c in want.columns) for r in got.collect()) == norm(want.fetchall())
