"""URL filters: host rules, then a weighted vocabulary searched with an Aho-Corasick automaton.

The automaton is built once per Python worker from a weighted vocabulary, a mapping or a table of (term, weight) of
at most MAX_TERMS terms, which is sent to the workers. Only the url column is read, so the operator is one narrow
pass without a shuffle.

Defined cases. Null, empty or scheme-less urls have an empty host and path, no rule and the verdict `allow`.
Repeated rows are judged one by one. An empty table gives an empty result. Other columns of the input are kept
only if asked for through `keep`; names that clash with the verdict's columns are taken from the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A single strict term rejects; soft terms reject when at least `SOFT_HITS` different ones occur.
STRICT_TERMS = ("adult", "casino", "hentai", "nude", "poker", "porn", "sex", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "bets", "bonus", "cheap", "click", "deal", "farm", "free", "jackpot", "loan", "pills", "prize", "spam", "track", "win")
SOFT_HITS = 2
#: A vocabulary table may have so many terms; they are held by the driver and every worker.
MAX_TERMS = 1_000_000
#: (verdict, host, path prefix); the longest fitting rule decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

RESULT = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def term_weights(strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_hits: int = SOFT_HITS) -> dict[str, float]:
    """A weight of 1 rejects: strict terms weigh 1, soft ones an equal share of it."""
    return {t: 1.0 / soft_hits for t in soft} | {t: 1.0 for t in strict}


def vocabulary(terms: DataFrame) -> dict[str, float]:
    """The weights of a table (term, weight): 1 and more is strict, less is soft. Terms are A-Z lower-cased; of repeated ones the largest weight counts; null or empty terms and weights that are null, NaN or not positive are left out."""
    term = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    usable = terms.where((F.col("term") != "") & (F.col("weight") > 0) & ~F.isnan(F.col("weight").cast("double")))
    rows = usable.groupBy(term.alias("term")).agg(F.max(F.col("weight").cast("double")).alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the vocabulary has more than {MAX_TERMS} terms")
    return {r.term: r.weight for r in rows}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class UrlJudge:
    def __init__(self, rules=RULES, weights: dict[str, float] | None = None):
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.weights = term_weights() if weights is None else weights
        self.automaton = ahocorasick.Automaton()
        for term in self.weights:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict, labels = None, None, host.split(".")
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            for prefix, said in self.rules.get(name, ()):
                if path.startswith(prefix) and (best is None or len(name + prefix) > len(best)):
                    best, verdict = name + prefix, said
        return best, verdict

    def terms(self, url: str) -> set[str]:
        """Vocabulary terms that stand alone: no ASCII letter or digit touches them."""
        found, low = set(), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
        edge = lambda i: not (0 <= i < len(low) and low[i].isascii() and low[i].isalnum())
        for end, term in self.automaton.iter(low) if self.weights else ():
            if edge(end - len(term)) and edge(end + 1):
                found.add(term)
        return found

    def __call__(self, url: str | None) -> tuple:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        found = self.terms(url or "")
        strict = sum(self.weights[t] >= 1.0 for t in found)
        weight = sum(self.weights[t] for t in found)
        return host, path, rule, verdict or ("block" if weight >= 1.0 else "allow"), strict, len(found) - strict, weight


def judge_urls(pages: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules=RULES, weights: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and the hit counts to the `keep` columns of every row; `weights` may be a table (see `vocabulary`)."""
    weights = vocabulary(weights) if isinstance(weights, DataFrame) else weights

    @F.pandas_udf(RESULT)
    def judged(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = UrlJudge(rules, weights)
        for batch in urls:
            yield pd.DataFrame([judge(None if pd.isna(u) else u) for u in batch], columns=NAMES)

    keep = [k for k in keep if k not in NAMES]
    row = F.struct(*[pages[k] for k in keep]).alias("_row")  # names of kept columns can't clash with the verdict's struct
    found = pages.select(*[row] * bool(keep), judged(pages[url]).alias("_judged"))
    return found.select(*["_row.*"] * bool(keep), "_judged.*")
