"""Readers and writers of the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTED = """source_key string, store_name string, retailer string, product_name string, category string, price double, regular_price double, app_price double, unit_price double,
 unit_price_unit string, quantity double, unit string, valid_from string, valid_to string, source_text string, source_url string, image_url string, image_alt string, local_store_offer boolean, confidence double"""


def collected(spark: SparkSession, path: str) -> DataFrame:
    """Collected offers from JSON lines, with the defaults of absent fields."""
    return spark.read.schema(COLLECTED).json(path).fillna({"local_store_offer": True, "confidence": 0.5})


def leaflets(spark: SparkSession, path: str) -> DataFrame:
    """PDF files by content: address, size and SHA-256; other files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.where(F.startswith("content", F.lit(b"%PDF"))).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def new_content(found: DataFrame, known: DataFrame, key: Sequence[str] = ("store_id", "sha256")) -> DataFrame:
    """Files that aren't archived yet, each content once."""
    return found.dropDuplicates(list(key)).join(known.select(*key), list(key), "left_anti")


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with a header, as the support bundle has it."""
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def payload(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, json): the columns of each row as a JSON object."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))
