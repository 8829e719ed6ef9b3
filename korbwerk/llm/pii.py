"""Personal data: pattern spans, and an information-theoretic search for terms that give them away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity.
Every term of a document that holds an entity is a candidate; all documents say how strongly it reveals the entity.
With document frequencies df over all N documents,

    information(entity) = log2(N / df(entity))
    disclosed(entity; term) = log2(N * df(term, entity) / (df(term) * df(entity)))

A term discloses an entity if it gives away at least the share `disclosure` of its information, and if so many common
documents have a probability of at most `chance` (the lesser of Markov's and Chernoff's bounds) were the two
independent. Entities of one text can pass that where N is 20 or more. Each occurrence of a disclosing term in a
document that holds the entity becomes a span of kind `term`. Pattern spans are generalised to their kind and terms to
a placeholder; terms that disclose everything are removed (`sanitised`).

Terms are words of 4 letters and more, shorter ones of at least 2 that begin with a capital or are Hangul, and the
overlapping pairs of letters of scripts written without spaces (Han, kana; a lone letter stands for itself). Case is
ignored in all counts, so a short capitalised word is as common as its lower-case twin.

All of it is built-in expressions. The patterns are written with possessive repeats and look-behinds so that they
find what the plain patterns find in linear time on any text, without deep recursion.

Defined cases. Null texts are empty and have no spans. Repeated rows count as documents each and get the same
spans. Null ids are allowed. An empty table gives an empty
result. Extra columns are not carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch, ascii_lower

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = r"[A-Za-z0-9._%+\-]", r"[A-Za-z0-9\-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20\-])[0-9](?:[\x20\-]?[0-9]){11,18}+(?![\x20\-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: What a text without a match lacks, cheaper to look for than the pattern.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20\-]?[0-9][\x20\-]?[0-9][\x20\-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
LETTER = r"[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
TERM = rf"{UNSPACED}++|(?<!{LETTER})(?:{LETTER}{{4,}}+|(?:\p{{Lu}}{LETTER}|\p{{IsHangul}}{{2}}){LETTER}?+(?!{LETTER}))"
#: All words that a term may be, for the counts over all documents.
ANY_TERM = rf"{UNSPACED}++|{LETTER}{{2,}}+"
DISCLOSURE, CHANCE = 0.85, 0.05
SPANS = "array<struct<s:int,e:int,v:string>>"


#: Arrays are scanned in slices of so many elements, so that long ones take linear time.
SLICE = 512


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine) -> Column:
    """For each whole number of an array what those before it come to by `combine` (a sum or a maximum of numbers from 0 on), and last what all come to."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def joined(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda y: combine(acc["at"], y))
        return F.struct(combine(acc["at"], part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def scanned(xs: Column) -> Column:
        zero = F.lit(0).alias("at")
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(SLICE))
        parts = F.transform(starts, lambda i: F.aggregate(F.slice(xs, i, SLICE), F.struct(zero, F.array().cast("array<int>").alias("out")), step))
        return F.aggregate(parts, F.struct(zero, F.array().cast("array<array<int>>").alias("out")), joined, lambda acc: F.array_append(F.flatten(acc["out"]), acc["at"]))

    return bound(values, scanned)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (s, e, v): code-point offsets and text, from the lengths of what stands between them."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")).cast("array<struct<gap:string,hit:string>>")

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))

        def out(ends: Column) -> Column:
            every = F.transform(pairs, lambda x, i: F.struct((F.get(ends, i + 1) - F.length(x["hit"])).alias("s"), F.get(ends, i + 1).alias("e"), x["hit"].alias("v")))
            return F.filter(every, lambda x: x["v"].isNotNull())

        return bound(running(lengths, lambda a, x: a + x), out)

    return bound(zipped, placed)


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": F.length(digits).between(12, 19) & luhn(digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """array<struct<s, e, v, k>> of the valid pattern matches of a text, kind by kind; k is the kind's place in KINDS."""
    none = F.array().cast(SPANS.replace("v:string", "v:string,k:int"))

    def of(k: int, name: str) -> Column:
        hits = F.filter(matches(text, PATTERNS[name]), lambda x: valid(name, x["v"]))
        return F.when(text.rlike(HINTS[name]), F.transform(hits, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(k).alias("k")))).otherwise(none)

    return F.concat(*[of(k, name) for k, name in enumerate(KINDS)])


def span_text(spans: Column) -> Column:
    """kind:start:end of spans (s, k, e), by start, then kind, then end, comma-joined."""
    names = F.array(*[F.lit(x) for x in (*KINDS, "term")])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _entity(x: Column) -> Column:
    return F.concat(x["k"].cast("string"), F.lit(":"), ascii_lower(x["v"]))


def _rewritten(text: Column, spans: Column, put) -> Column:
    """The text with what `put` gives for each span (from a place on, of a span) instead of the spans, which are taken in order; of overlapping ones the part before the first one's end is gone."""

    def done(xs: Column) -> Column:
        def pieces(ends: Column) -> Column:
            each = F.transform(xs, lambda x, i: F.concat(F.substr(text, F.get(ends, i) + 1, F.greatest(x["s"] - F.get(ends, i), F.lit(0))), put(F.get(ends, i), x)))
            return F.concat(F.array_join(each, ""), F.substr(text, F.element_at(ends, -1) + 1))

        return bound(running(F.transform(xs, lambda x: x["e"]), lambda a, x: F.greatest(a, x)), pieces)

    return bound(F.array_sort(spans), done)


def _blanked(text: Column, base: Column) -> Column:
    """The text with its spans overwritten by spaces, so that offsets stay and no term lies in a span."""
    return _rewritten(text, base, lambda at, x: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], at), F.lit(0))))


def _split_run(run: Column) -> Column:
    """Places (from 0) and texts of the terms of a match: overlapping pairs of letters of unspaced scripts, else the match."""
    pairs = F.transform(F.sequence(F.lit(0), F.length(run) - 2), lambda i: F.struct(i.alias("i"), F.substr(run, i + 1, F.lit(2)).alias("v")))
    return F.when(run.rlike(f"^{UNSPACED}") & (F.length(run) > 2), pairs).otherwise(F.array(F.struct(F.lit(0).alias("i"), run.alias("v"))))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """doc_id, spans array<struct<s, k, e, full>>, clean and sha256 of every document; k = 4 for terms, full where a term discloses all; clean is the sanitised text, null where there is no span, and sha256 that of the document's text after sanitising."""
    scratch = Scratch(docs.sparkSession, "personal")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.length(text).alias("t2"), text.alias("text"), base_spans(text).alias("base"))
    base = base.select("doc_id", "t1", "t2", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"), F.when(F.size("base") == 0, F.sha2("text", 256)).alias("same"))
    base = scratch.keep(base, "base")
    n_docs = F.lit(float(max(1, base.count())))

    # Exact copies are worked on once and count n times.
    holders = base.where(F.size("base") > 0).groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("text").alias("text"))
    holders = scratch.keep(holders, "holders")
    entities = holders.select("t1", "t2", "n", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    held = entities.groupBy("entity").agg(F.sum("n").alias("held"))
    entities = scratch.keep(entities.join(held, "entity"), "entities")

    rest = holders.select("t1", "t2", _blanked(F.col("text"), F.col("base")).alias("rest"))
    zipped = F.arrays_zip(F.split("rest", TERM, -1).alias("gap"), F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)).alias("hit"))
    words = rest.select("t1", "t2", F.posexplode(zipped).alias("at", "x")).select("t1", "t2", "at", F.length("x.gap").alias("gap"), F.col("x.hit").alias("hit"))
    before = Window.partitionBy("t1", "t2").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("s", F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.length("hit")).over(before), F.lit(0))).where(F.col("hit").isNotNull())
    words = words.select("t1", "t2", "s", F.explode(_split_run(F.col("hit"))).alias("x"))
    words = words.select("t1", "t2", (F.col("s") + F.col("x.i")).cast("int").alias("s"), (F.col("s") + F.col("x.i") + F.length("x.v")).cast("int").alias("e"), F.lower("x.v").alias("term"))
    words = scratch.keep(words, "words")

    runs = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(ANY_TERM), F.lit(0)), lambda x: F.transform(_split_run(x), lambda y: y["v"])))
    # Most texts have no unspaced script; what they hold is found faster.
    found = F.when(text.rlike(UNSPACED), runs).otherwise(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]{2,}+"), F.lit(0)))
    said = docs.select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.count("*").alias("said"))

    information = F.log2(n_docs / F.col("held"))
    # No term of more documents than this discloses enough even if it stands in all documents of the entity.
    possible = F.log2(n_docs / F.greatest("said", "held")) >= disclosure * information - 1e-6
    near = words.select("t1", "t2", "term").distinct().join(said, "term").join(entities, ["t1", "t2"]).where((information > 0) & possible)
    near = scratch.keep(near.select("t1", "t2", "n", "entity", "held", "term", "said"), "near")

    scored = near.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.first("held").alias("held"), F.first("said").alias("said"))
    scored = scored.withColumn("said", F.greatest("said", "both"))
    disclosed = F.log2(n_docs * F.col("both") / (F.col("said") * F.col("held").cast("double")))
    expected = F.col("said") * F.col("held").cast("double") / n_docs
    ratio = F.log(expected / F.col("both"))
    by_chance = F.least(ratio, F.col("both") * (ratio + 1) - expected)
    scored = scored.where((disclosed >= disclosure * information) & (expected < F.col("both")) & (by_chance <= math.log(chance)))
    scored = scratch.keep(scored.select("entity", "term", (F.col("said") <= F.col("both")).alias("full")), "scored")

    marked = near.join(scored, ["entity", "term"]).groupBy("t1", "t2", "term").agg(F.max("full").alias("full"))
    terms = words.join(marked, ["t1", "t2", "term"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e", "full")).alias("terms"))
    terms = scratch.keep(terms, "terms")
    pattern = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(False).alias("full")))
    spans = F.concat(pattern, F.coalesce("terms", F.array().cast("array<struct<s:int,k:int,e:int,full:boolean>>")))
    found = base.join(terms, ["t1", "t2"], "left").select("doc_id", spans.alias("spans"), "text", "same")
    clean = F.when(F.col("text").isNotNull(), sanitised(F.col("text"), F.col("spans")))
    return found.withColumn("clean", clean).select("doc_id", "spans", "clean", F.coalesce("same", F.sha2("clean", 256)).alias("sha256"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans generalised to [kind], and fully disclosing terms removed; of overlapping spans the first in order stands for those that begin inside it."""
    names = F.array(*[F.lit(f"[{x}]") for x in (*KINDS, "term")])
    return _rewritten(text, spans, lambda at, x: F.when((x["s"] < at) | x["full"], F.lit("")).otherwise(F.get(names, x["k"])))
