"""Families of favourites."""

from pyspark.sql import functions as F

from korbwerk.functions import families


def test_names_and_families(spark):
    cases = {
        ("Coca Cola", "Zero 1,5 l"): ("zero 1", "cola"),
        (None, "Cola-Butter 250 g®"): ("cola butter", "cola"),
        ("Hof", "Kærgarden"): ("k rgarden", None),
        ("Hof", "Pom Bär"): ("pom ba r", None),
        ("Melitta", "Caffè Crema"): ("caffe crema", "coffee"),
        ("Hof", "Buttermilch"): ("buttermilch", None),
        (None, None): ("", None),
        ("7 UP", ""): ("", "lemon-lime"),
        ("", "8 Rollen Klopapier"): ("klopapier", "toilet-paper"),
    }
    rows = spark.createDataFrame(list(cases), "b string, n string")
    got = {(r.b, r.n): (r.p, r.f) for r in rows.select("b", "n", families.plain_name(F.col("n")).alias("p"), families.family(F.col("b"), F.col("n")).alias("f")).collect()}
    assert got == cases
