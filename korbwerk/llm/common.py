"""What the corpus operators share: the shared scratch folder, input tables, text expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else; where all is ASCII, lower() says the same and is faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def word_count(col: Column) -> Column:
    """Number of tokens of a text, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal digits, modulo `mod`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="korbwerk-")
        spark.conf.set("spark.checkpoint.dir", found)
        _delete_on_exit(spark, found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


class Scratch:
    """Tables written to the shared folder; they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, p = _fs(spark, self.root)
        fs.mkdirs(p)
        _delete_on_exit(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def folder(self, name: str) -> str:
        """A folder of this name, for files that are not tables."""
        fs, p = _fs(self.spark, self.path(name))
        fs.mkdirs(p)
        return self.path(name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        fs, p = _fs(self.spark, self.path(name))
        fs.delete(p, True)
