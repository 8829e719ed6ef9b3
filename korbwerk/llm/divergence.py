"""Source divergence audit: how far the sources of a language are from each other, and which terms set them apart.

One CountVectorizer a language, with a minimum number of documents and no other bound on its vocabulary, turns each
document into an exact sparse vector of term counts. The vectors are summed by source, as a summariser would but in
whole numbers, and pairs of sources are evaluated from their sparse sums alone: terms that one of the two or neither
has are counted by how often a count occurs, so only terms of both sources meet in a join.

All shares are whole numbers, p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), and are worked out in decimals.

The vocabulary of one language at a time passes through the driver, as it does in every CountVectorizer: terms that
stand in at least `min_docs` documents. Languages are fitted one after another, each from its own partition of a table
of the documents' terms. Rankings of terms keep `top` of each group; rankings of pairs are whole, so the result has as
many pair rows as there are ordered pairs of sources.

Defined cases. Null text, lang and source count as ''. Each row is a document, repeated rows too. A source without
terms is compared as all others are; a language without kept terms gives pairs of value 0, one of a single source
gives no pairs. Ties go by the item's UTF-8 bytes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch, ascii_lower

#: What stands between terms, which are runs of ASCII letters and of whatever is not ASCII. Splitting takes time linear in the text, unlike extracting all matches.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
VOCABULARY = 2**31 - 1
#: Stands in every document, so that a language of enough documents never has an empty vocabulary; no term is empty.
ALWAYS = ""


def share(count: Column, total: Column, terms: Column, smooth: int = SMOOTH, scale: int = SCALE) -> Column:
    """p of a term by its count, the group's total and the size of the vocabulary; null without terms."""
    whole = lambda x: x.cast("decimal(20,0)")
    up, down = whole(count + smooth) * F.lit(scale).cast("decimal(11,0)"), whole(total) + whole(terms * smooth)
    return F.when(terms > 0, 1 + F.call_function("div", up, down))


def term_table(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang_no, lang, n_docs) of every language, and source and terms of every document, partitioned by lang_no."""
    read = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    langs = read.groupBy("lang").agg(F.count("*").alias("n_docs"))
    langs = scratch.keep(langs.withColumn("lang_no", F.row_number().over(Window.orderBy("lang"))), "langs")  # a row a language
    terms = F.split(ascii_lower(F.concat(F.lit(" "), F.col("text"))), BETWEEN)  # the blank before each text makes ALWAYS its first term
    read.join(langs, "lang").select("lang_no", "source", terms.alias("terms")).write.partitionBy("lang_no").parquet(scratch.path("terms"))
    return langs, docs.sparkSession.read.schema("source string, terms array<string>, lang_no int").parquet(scratch.path("terms"))


def vectors(terms: DataFrame, min_docs: int = MIN_DOCS) -> tuple[list[str], DataFrame]:
    """The vocabulary of one language and its documents as (source, v), v the sparse vector's indices and values."""
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(min_docs), vocabSize=VOCABULARY).fit(terms)
    return model.vocabulary, model.transform(terms).select("source", F.unwrap_udt("v").alias("v"))


def _batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums within each batch: every (source, index) of it once."""
    for batch in batches:
        v = batch.column("v")
        indices, values = v.field("indices"), v.field("values")
        source = batch.column("source").dictionary_encode()
        sizes = np.diff(indices.offsets.to_numpy())
        at = np.repeat(source.indices.to_numpy().astype(np.int64) << 32, sizes) | indices.flatten().to_numpy().astype(np.int64)
        keys, place = np.unique(at, return_inverse=True)
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, place, values.flatten().to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([source.dictionary.take(pa.array(keys >> 32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], ["source", "index", "count"])


def source_sums(found: DataFrame) -> DataFrame:
    """(source, index, count): the sum of the vectors of each source, without zeros; batches are summed up before the shuffle."""
    return found.mapInArrow(_batch_sums, "source string, index int, count long").groupBy("source", "index").agg(F.sum("count").alias("count"))


def source_counts(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages (lang_no, lang, terms: V), groups (lang_no, source) and the groups' counts (lang_no, source, term, count)."""
    spark = docs.sparkSession
    langs, terms = term_table(docs, scratch)
    sizes, parts = [], []
    for row in langs.where(F.col("n_docs") >= min_docs).select("lang_no").orderBy("lang_no").collect():
        words, found = vectors(terms.where(F.col("lang_no") == row.lang_no), min_docs)
        named = spark.createDataFrame(list(enumerate(words)), "index int, term string").where(F.col("term") != ALWAYS)
        counts = source_sums(found).join(named, "index").select(F.lit(row.lang_no).alias("lang_no"), "source", "term", "count")
        parts.append(f"counts-{row.lang_no}")
        scratch.keep(counts, parts[-1])
        sizes.append((row.lang_no, len(words) - 1))
    schema = "lang_no int, source string, term string, count long"
    counts = spark.read.schema(schema).parquet(*map(scratch.path, parts)) if parts else spark.createDataFrame([], schema)
    sized = langs.join(spark.createDataFrame(sizes, "lang_no int, terms long"), "lang_no", "left")
    return sized.select("lang_no", "lang", F.coalesce("terms", F.lit(0)).alias("terms")), terms.select("lang_no", "source").distinct(), counts


def pair_values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang_no, source, item, value) of all ordered pairs of groups of a language.

    `groups` has terms (V), kept (its terms), total (N) and zero (p of a count of 0), `counts` has p and its group's zero.
    """
    often = counts.groupBy("lang_no", "source", "p").agg(F.count("*").alias("n"))
    other = groups.select("lang_no", F.col("source").alias("item"), F.col("zero").alias("other"))
    alone = often.join(other, "lang_no").where(F.col("source") != F.col("item"))
    alone = alone.groupBy("lang_no", "source", "item").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("other"))).alias("alone"))

    q = counts.select("lang_no", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("q_zero"))
    met = counts.join(q, ["lang_no", "term"]).where(F.col("source") < F.col("item"))
    more = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q_zero")) - F.abs(F.col("q") - F.col("zero"))
    met = met.groupBy("lang_no", "source", "item").agg(F.count("*").alias("both"), F.sum(more).alias("more"))

    b = groups.select("lang_no", F.col("source").alias("item"), F.col("kept").alias("b_kept"), F.col("zero").alias("b_zero"))
    pairs = groups.join(b, "lang_no").where(F.col("source") < F.col("item")).join(met, ["lang_no", "source", "item"], "left")
    pairs = pairs.join(alone, ["lang_no", "source", "item"], "left")
    pairs = pairs.join(alone.select("lang_no", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("b_alone")), ["lang_no", "source", "item"], "left")
    none = F.col("terms") - F.col("kept") - F.col("b_kept") + F.coalesce("both", F.lit(0))
    parts = [F.col("alone"), F.col("b_alone"), F.col("more"), none * F.abs(F.col("zero") - F.col("b_zero"))]
    value = sum((F.coalesce(x, F.lit(0)) for x in parts), F.lit(0)).cast("long")
    both_ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return pairs.select("lang_no", F.explode(both_ways).alias("w"), value.alias("value")).select("lang_no", "w.source", "w.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: a source's distance to each other source of its language, and the terms it uses more than its language does."""
    scratch = Scratch(docs.sparkSession, "divergence")
    langs, groups, counts = source_counts(docs, scratch, min_docs)
    sums = counts.groupBy("lang_no", "source").agg(F.sum("count").alias("total"), F.count("*").alias("kept"))
    groups = groups.join(sums, ["lang_no", "source"], "left").join(langs.drop("lang"), "lang_no")
    groups = groups.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    groups = scratch.keep(groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms"), smooth, scale)), "groups")
    counts = counts.join(groups.select("lang_no", "source", "total", "terms", "zero"), ["lang_no", "source"])
    counts = scratch.keep(counts.withColumn("p", share(F.col("count"), F.col("total"), F.col("terms"), smooth, scale)).drop("total"), "shares")
    order = Window.partitionBy("lang_no", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))

    whole = counts.groupBy("lang_no", "term").agg(F.sum("count").alias("all"))
    totals = groups.groupBy("lang_no").agg(F.sum("total").alias("total"))
    of_lang = counts.join(whole, ["lang_no", "term"]).join(totals, "lang_no")
    above = of_lang.withColumn("value", F.col("p") - share(F.col("all"), F.col("total"), F.col("terms"), smooth, scale)).where("value > 0")
    terms = ranked(above.select("lang_no", "source", F.col("term").alias("item"), "value"), "term").where(F.col("rank") <= top)
    pairs = ranked(pair_values(groups, counts), "pair")
    return pairs.unionByName(terms).join(langs.select("lang_no", "lang"), "lang_no").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
