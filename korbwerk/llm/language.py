"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores.

The model has, for each language, log probabilities of hashed letter trigrams (with word edges) and the scripts it
is written in, both counted on labelled documents. A word is a run of letters; its score in a language is the sum
of its trigrams' log probabilities, and languages that are not written in the word's script are no candidates. A
Viterbi pass with a switching penalty labels all words of a text; runs of equal labels are its spans.

The model is fitted on at most about `train_docs` documents a language (drawn by a hash of the id) and has
BUCKETS values a language, so what is sent to the tasks is bounded by the number of languages. Scoring is one
narrow pass.

Defined cases. Null texts and texts without a letter are `und` with score 0. A text whose letters are all in
scripts of no learned language gets the language with most training documents, score 0. With no labelled rows all
texts are `und`; with more than MAX_LANGS labels training fails. Ties go to the language that sorts first. Repeated rows get equal results; an empty table gives an
empty result; extra columns are not carried along unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, TRAIN_DOCS, PENALTY, SCRIPT_SHARE, PIECE = 1 << 16, 20_000, 12.0, 0.01, 2 << 20
#: The model has BUCKETS values a language and is held by the driver and every worker, so labels are bounded.
MAX_LANGS = 2000
#: First and last code points of letters by script; a fixed table of Unicode blocks.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
)
NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
NO_CANDIDATE = -50.0

_tables: tuple[np.ndarray, np.ndarray] | None = None


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower-case letter (0: no letter) and its script."""
    global _tables
    if _tables is None:
        low, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                y = x.lower()
                low[c] = ord(y) if len(y) == 1 else c
        for name, first, last in SCRIPTS:
            script[first : last + 1] = NAMES.index(name)
        _tables = low, script
    return _tables


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigram buckets of all letters; for each word the position of its first letter among them, the row, the script, and its first and last code point within the row."""
    low, scripts = _characters()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    rows_at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    letters = low[points]
    is_letter = letters > 0
    begin = is_letter.copy()
    begin[1:] &= ~is_letter[:-1]
    edges = rows_at[(rows_at < len(points))]
    begin[edges] = is_letter[edges]
    at = np.flatnonzero(is_letter)
    first = np.flatnonzero(begin)
    starts = np.searchsorted(at, first)
    lone = letters[at].astype(np.uint64)
    before, after = np.zeros_like(lone), np.zeros_like(lone)
    before[1:], after[:-1] = lone[:-1], lone[1:]
    before[starts] = 0
    ends = np.concatenate((starts[1:], [len(at)])) - 1 if len(starts) else starts
    after[ends] = 0
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + lone * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    buckets = (mixed >> np.uint64(48)).astype(np.int64)
    row = np.searchsorted(rows_at, first, "right") - 1
    return buckets, starts, row, scripts[points[first]], first - rows_at[row], at[ends] + 1 - rows_at[row] if len(starts) else first


class Model:
    def __init__(self, counts: pd.DataFrame, docs: dict[str, int]):
        """counts: lang, bucket (scripts follow the trigram buckets), n."""
        self.langs = sorted(docs)
        wide = np.zeros((BUCKETS + len(NAMES), len(self.langs)))
        place = {x: i for i, x in enumerate(self.langs)}
        if len(counts):
            wide[counts["bucket"].to_numpy(), counts["lang"].map(place).to_numpy()] = counts["n"].to_numpy()
        grams, scripts = wide[:BUCKETS] + 0.1, wide[BUCKETS:]
        self.scores = np.log(grams / grams.sum(axis=0)).astype(np.float32)
        self.candidates = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.usual = min(range(len(self.langs)), key=lambda i: (-docs[self.langs[i]], i), default=0)

    def labels(self, first: np.ndarray, counts: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
        """The best label of each word; rows begin at `first` and have `counts` words. All rows advance together, the longest last."""
        order = np.argsort(-counts, kind="stable")
        first, counts = first[order], counts[order]
        n_lang, out = scores.shape[1], np.zeros(len(scores), np.int32)
        kind = np.uint8 if n_lang <= 256 else np.uint16
        came = np.empty((len(scores), n_lang), kind)
        active = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), "right")
        own = np.arange(n_lang, dtype=kind)
        best = scores[first[: active[0]]] if len(active) else None
        for t in range(1, len(active)):
            a = active[t]
            best = best.copy() if t == 1 else best
            stay, top = best[:a], best[:a].argmax(axis=1)
            jump = np.take_along_axis(stay, top[:, None], 1) - penalty
            moved = jump > stay
            at = first[:a] + t
            came[at] = np.where(moved, top[:, None].astype(kind), own)
            best[:a] = np.where(moved, jump, stay) + scores[at]
        if len(active):
            last = best.argmax(axis=1).astype(np.int32)
            for t in range(len(active) - 1, -1, -1):
                a = active[t]
                at = first[:a] + t
                out[at] = last[:a]
                if t:
                    last[:a] = came[at, last[:a]]
        return out

    def judge(self, data: np.ndarray, offsets: np.ndarray, penalty: float) -> tuple:
        """Per row: language index (-1 without letters) and score; per word: row, begin, end, label and whether it had candidates."""
        rows = len(offsets) - 1
        buckets, starts, row, script, begin, end = word_features(data, offsets)
        lang, score = np.full(rows, -1), np.zeros(rows)
        if not len(starts) or not self.langs:
            return lang, score, row, begin, end, np.zeros(len(row), np.int32), np.zeros(len(row), bool)
        letters = np.diff(np.concatenate((starts, [len(buckets)])))
        scores = np.add.reduceat(self.scores[buckets], starts, axis=0)
        fits = self.candidates[script]
        any_fits = fits.any(axis=1)
        scores = np.where(fits, scores, np.float32(NO_CANDIDATE) * letters[:, None].astype(np.float32))
        scores[~any_fits] = 0
        ends = np.searchsorted(row, np.arange(rows + 1))
        counts = np.diff(ends)
        label = self.labels(ends[:-1], counts, scores, penalty)
        n = len(self.langs)
        held = np.bincount(row[any_fits] * n + label[any_fits], weights=letters[any_fits], minlength=rows * n).reshape(rows, n)
        total = np.bincount(row, weights=letters, minlength=rows)
        lang = np.where(total > 0, np.where(held.sum(axis=1) > 0, held.argmax(axis=1), self.usual), -1)
        score = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0)
        return lang, score, row, begin, end, label, any_fits


def train(docs: DataFrame, label: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fits a model on rows with a label, at most about `train_docs` a language."""
    docs = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(label).count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"there are more than {MAX_LANGS} languages")
    if not sizes:
        return Model(pd.DataFrame({"lang": [], "bucket": [], "n": []}), {})
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, train_docs / v))]), F.col(label))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < share * (1 << 30))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from korbwerk.llm import tokens

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, last, data, offsets in tokens.pieces(*tokens.as_bytes(batch.column("text")), limit=PIECE):
                buckets, starts, row, script, _, _ = word_features(data, offsets)
                letters = np.diff(np.concatenate((starts, [len(buckets)])))
                of = langs[first:last]
                for lang in set(of):
                    mine = (of == lang)[row]
                    into = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    into[:BUCKETS] += np.bincount(buckets[np.repeat(mine, letters)], minlength=BUCKETS)
                    into[BUCKETS:] += np.bincount(script[mine], weights=letters[mine], minlength=len(NAMES)).astype(np.int64)
        for lang, into in sums.items():
            held = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(into[held])], ["lang", "bucket", "n"])

    counts = drawn.select("text", F.col(label).alias("lang")).mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas(), sizes)


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """`keep` columns (but for those with the result's names) with lang_pred and score, and with spans array<struct<start, end, lang>> (code points, end exclusive) if asked for."""

    keep = [k for k in keep if k not in ("lang_pred", "score", "_text", *["spans"] * spans)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from korbwerk.llm import tokens

        names = np.array([*model.langs, "und"], dtype=object)
        source = "text" if "text" in keep else "_text"
        for batch in batches:
            # A record batch a piece: what goes back is no larger at once than what is worked on.
            for first, last, data, offsets in tokens.pieces(*tokens.as_bytes(batch.column(source)), limit=PIECE):
                lang, score, row, begin, end, label, fits = model.judge(data, offsets, penalty)
                arrays = [*[batch.column(k).slice(first, last - first) for k in keep], pa.array(names[lang], pa.string()), pa.array(score, pa.float64())]
                if spans:
                    row, begin, end, label = row[fits], begin[fits], end[fits], label[fits]
                    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])))) if len(row) else np.zeros(0, int)
                    stop = np.concatenate((new[1:], [len(row)])) - 1 if len(new) else new
                    lists: list[list[dict]] = [[] for _ in range(last - first)]
                    for r, s, e, k in zip(row[new].tolist(), begin[new].tolist(), end[stop].tolist(), label[new].tolist(), strict=True):
                        lists[r].append({"start": s, "end": e, "lang": model.langs[k]})
                    arrays.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", *["spans"] * spans])

    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, *[F.col("text").alias("_text")] * ("text" not in keep)).mapInArrow(judged, f"{fields}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans)


def held_out(doc_id: Column) -> Column:
    from korbwerk.llm.common import id_crc

    return id_crc(doc_id, 4) == 2
