"""A training-data pipeline over the documents table: five operators of korbwerk.llm, one a stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns of documents.

Defined cases. Documents whose text is null, empty or without a letter of a learned language's script go in the first
stage, with every other column null they are treated the same. Of equal texts, and of rows with equal ids and texts,
one stays. Ties are broken by id, then by a hash of the text. Documents with null ids stay and come first in the token
files. An empty table gives an empty result. Extra columns are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korbwerk.llm import decontaminate, language, mixing, ngram_join, token_files
from korbwerk.llm.common import Scratch, table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those without one in the script of a learned language; texts in several languages stay."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    aside = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score", "_text")}  # these are the prediction's names
    found = language.predict(docs.withColumnsRenamed(aside), model, keep=[aside.get(c, c) for c in docs.columns])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of at least 0.8."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of a benchmark item's shingles."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that the sources' words come to their targets."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns where each document stands in them."""
    return token_files.tokenised(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's documents are written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
