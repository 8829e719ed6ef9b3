"""LM scoring with an Elias-Fano n-gram trie that is built and queried in shards.

Level 1 of the trie is the vocabulary: the sorted 64-bit hashes of all words in an Elias-Fano sequence, so a word's id
is its rank. A node of level k is a context (the id of a node of level k - 1) and a word id. A shard of a level holds
the contexts of its nodes, monotone pointers from each context to its range of nodes, the word ids of the nodes
relative to their context, all as Elias-Fano sequences with their directories, and the nodes' smoothed probabilities
as 16-bit logarithms. A lookup finds the context, takes its range from the pointers and does a successor search
within it. Exact counts are kept for words alone, for the base score; those of longer n-grams are files of their own
that are deleted when the next level is built.

Each level is counted over the whole training text in one pass: a task counts its own text, sends sorted and packed
counts to shards that split all n-grams evenly by hash, and a shard's task sums them and writes one file into the
shared folder, to be memory-mapped by the tasks of the next pass. The number of shards grows with the number of
tokens. N-grams that occur once are kept. Those of order 2 and more that occur fewer than `min_count` times are pruned
if asked for; one is only counted if its context was kept, which loses none that is frequent enough.

Probabilities are interpolated with absolute discounting: p(w | context) = max(c - D, 0) / c(context) + b(context) *
p(w | shorter context), where b is what discounting and pruning leave, and level 1 is (c + 1) / (N + V + 1). A text
starts in the context of the end token.

Defined cases. Null, empty and blank texts are the end token alone. A training set without rows gives the uniform
probability 1 to every token. Repeated rows count as often as they occur; null ids are hashed as the empty text.
An empty table gives an empty result. Extra columns are not carried along unless named in `keep`.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korbwerk.llm import elias_fano
from korbwerk.llm.common import Scratch, id_crc

ORDER, MIN_COUNT, DISCOUNT = 3, 1, 0.75
#: Probabilities are kept as -log10(p) in units of 1 / SCALE, from 0 to 65534 / SCALE.
SCALE = 4096.0
#: A task sends its counts on when it holds so many different n-grams.
HELD, PIECE = 2_000_000, 4 << 20
#: Tokens of the training text for which there is a shard of each level above the first, and the fewest shards.
SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 4
MISSING = -1


# --- files -----------------------------------------------------------------------------------------------------


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that says where each array begins, then the arrays, aligned to 8 bytes; moved into place when complete."""
    from korbwerk.llm.token_files import _storage

    spec, at = {}, 0
    for key, a in arrays.items():
        spec[key] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    storage, path = _storage(folder)
    part = f"{path}/.{uuid.uuid4().hex}"
    with storage.open_output_stream(part) as out:
        out.write(head)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    storage.move(part, f"{path}/{name}")


_mapped: dict[str, dict[str, np.ndarray]] = {}


def _map(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; files of a remote store are copied to an unnamed local one first."""
    key = f"{folder}/{name}"
    if key not in _mapped:
        from korbwerk.llm.token_files import _storage

        if len(_mapped) > 4096:
            _mapped.clear()
        storage, path = _storage(folder)
        if storage.type_name == "local":
            source = open(f"{path}/{name}", "rb")  # noqa: SIM115
        else:
            source = tempfile.TemporaryFile()  # noqa: SIM115
            with storage.open_input_stream(f"{path}/{name}") as f:
                while block := f.read(8 << 20):
                    source.write(block)
            source.flush()
        with source:
            view = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(source.fileno()).st_size else b""
        start = view.find(b"\n") + 1
        _mapped[key] = {k: np.frombuffer(view, dtype=t, count=n, offset=start + at) for k, (t, at, n) in json.loads(view[:start]).items()}
    return _mapped[key]


# --- counting --------------------------------------------------------------------------------------------------


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class _Sums:
    """Counts of keys that come in parts; parts are merged as soon as they are as many as what is merged already."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(HELD // 2, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.keys, self.counts = _merge(*[np.concatenate(x) for x in zip((self.keys, self.counts), *self.parts, strict=True)])
            self.parts, self.waiting = [], 0
        return self.keys, self.counts


def _shard(keys: np.ndarray, level: int, shards: int) -> np.ndarray:
    """Shard of a key: a range of hashes on level 1 (so that ids follow the hashes), an even split by hash above."""
    from korbwerk.llm.tokens import mix64

    spread = keys if level == 1 else mix64(keys)
    return ((spread >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, which Spark's shuffle compression makes small; planes of zeros at the top are left out. The first byte is the number of planes."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplane(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def _packets(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """(shard, keys, counts) of sorted keys, as differences in byte planes."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, int)
    ends = np.concatenate((cut[1:], [len(keys)])).astype(int)
    k = [_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cut, ends, strict=False)]
    c = [_planes(counts[a:b]) for a, b in zip(cut, ends, strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32), pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["shard", "k", "c"])


def _shard_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Summed counts of each shard from packets sorted by shard."""
    at, sums = None, _Sums()
    for batch in batches:
        for s, k, c in zip(*[batch.column(x).to_pylist() for x in ("shard", "k", "c")], strict=True):
            if s != at and at is not None:
                yield at, *sums.settle()
                sums = _Sums()
            at = s
            sums.add(np.cumsum(_unplane(k), dtype=np.uint64), _unplane(c))
    if at is not None:
        yield at, *sums.settle()


class Trie:
    """Looks up words and n-grams in the files of a folder. `bases[k]` has the number of nodes of level k + 1 in shards before each; totals end it."""

    def __init__(self, folder: str, bases: list[list[int]], tokens: int, docs: int):
        self.folder, self.bases, self.tokens, self.docs = folder, bases, tokens, docs

    @property
    def words(self) -> int:
        return self.bases[0][-1]

    @property
    def end(self) -> int:
        """The id of the end token, after those of all words."""
        return self.words

    @property
    def outcomes(self) -> float:
        """What a token's count and one is divided by: all training tokens, the different ones, and one."""
        return self.tokens + self.words + bool(self.docs) + 1.0

    def shards(self, level: int) -> int:
        return len(self.bases[level - 1]) - 1

    def by_shard(self, level: int, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard of a level with the places of its entries."""
        n = self.shards(level)
        shard = shard.astype(np.uint16 if n < 1 << 16 else np.int64)  # short integers are sorted by radix
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(n + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            yield s, order[cut[s] : cut[s + 1]]

    def shard_of(self, level: int, node: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(np.array(self.bases[level - 1]), node, "right") - 1, self.shards(level) - 1)

    def _sequence(self, level: int, s: int, name: str) -> elias_fano.EliasFano:
        arrays = _map(self.folder, f"level{level}-{s:05d}")
        if f"={name}" not in arrays:
            arrays[f"={name}"] = elias_fano.EliasFano(arrays, name)
        return arrays[f"={name}"]

    def look_words(self, hashes: np.ndarray, *names: str) -> list[np.ndarray]:
        """Ids of words, MISSING where unknown, and their values by name: count, prob, or back, the code of the backoff weight."""
        out = [np.full(len(hashes), MISSING, np.int64), *[np.zeros(len(hashes), np.int64) for _ in names]]
        for s, mine in self.by_shard(1, _shard(hashes, 1, self.shards(1))):
            if self.bases[0][s] < self.bases[0][s + 1]:
                self._fill(out, 1, s, mine, self._sequence(1, s, "key").find(hashes[mine]), names)
        return out

    def look(self, level: int, context: np.ndarray, word: np.ndarray, *names: str) -> list[np.ndarray]:
        """Node ids of n-grams whose context and word exist, MISSING where there is none, and their values by name."""
        out = [np.full(len(word), MISSING, np.int64), *[np.zeros(len(word), np.int64) for _ in names]]
        for s, mine in self.by_shard(level, _shard(_key(context, word), level, self.shards(level))):
            if self.bases[level - 1][s] == self.bases[level - 1][s + 1]:
                continue
            place = self._sequence(level, s, "context").find(context[mine].astype(np.uint64))
            held = place >= 0
            mine, place = mine[held], place[held]
            lo, hi = (x.astype(np.int64) for x in self._sequence(level, s, "pointer").get_pair(place))
            relative = place.astype(np.uint64) * np.uint64(self.words + 1) + word[mine].astype(np.uint64)
            self._fill(out, level, s, mine, self._sequence(level, s, "child").find(relative, lo, hi), names)
        return out

    def _fill(self, out: list[np.ndarray], level: int, s: int, mine: np.ndarray, found: np.ndarray, names: Sequence[str]) -> None:
        hit = np.flatnonzero(found >= 0)
        mine, found = mine[hit], found[hit]
        out[0][mine] = found + self.bases[level - 1][s]
        for values, name in zip(out[1:], names, strict=True):
            file = f"back{level}-{s:05d}" if name == "back" else f"level{level}-{s:05d}"
            if name != "back" or self._exists(file):
                values[mine] = _map(self.folder, file)[name][found]

    def counts(self, level: int, node: np.ndarray) -> np.ndarray:
        """How often each node occurs, while the level's counts are kept; the end token as a context occurs once a document."""
        out = np.zeros(len(node))
        known = np.flatnonzero((node >= 0) & (node < self.bases[level - 1][-1]))
        for s, mine in self.by_shard(level, self.shard_of(level, node[known])):
            mine = known[mine]
            folder, name = (self.folder, f"level1-{s:05d}") if level == 1 else (f"{self.folder}/counts{level}", f"{s:05d}")
            out[mine] = _map(folder, name)["count"][node[mine] - self.bases[level - 1][s]]
        return np.where(node == self.end, self.docs, out) if level == 1 else out

    def end_back(self) -> int:
        """The code of the end token's backoff weight as a context; 0, the weight 1, if it has none."""
        return int(_map(self.folder, "back-end")["back"][0]) if self._exists("back-end") else 0

    def tokens_of(self, ids: np.ndarray, back: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tokens, with each row's end token, from the ids of the different words and each word's place among them; whether a token begins a row; and the row ends."""
        ends = np.cumsum(counts + 1)
        out = np.full(len(back) + len(counts), self.end, np.int64)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = ids[back]
        first = np.zeros(len(out), bool)
        first[ends - counts - 1] = True
        return out, first, ends

    def contexts(self, hashes: np.ndarray, per_row: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The context node of each token's n-gram of a length, MISSING where there is none, and its word id."""
        some, back = np.unique(hashes, return_inverse=True)
        ids, first, _ = self.tokens_of(self.look_words(some)[0], back, per_row)
        shorter = ids
        for k in range(2, level):
            known, context, word, back = self.ngrams(shorter, ids, first, k)
            shorter = np.full(len(ids), MISSING, np.int64)
            shorter[known] = self.look(k, context, word)[0][back]
        return self.context(shorter, first, level), ids

    def ngrams(self, shorter: np.ndarray, ids: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens whose n-gram may exist, the different ones' contexts and words, and each place's one among them."""
        context = self.context(shorter, first, level)
        known = np.flatnonzero((context >= 0) & (ids >= 0))
        some, back = np.unique(_key(context[known], ids[known]), return_inverse=True)
        return known, (some >> np.uint64(32)).astype(np.int64), (some & np.uint64(0xFFFFFFFF)).astype(np.int64), back

    def context(self, shorter: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
        """The context node of each token's n-gram of a length: the node, one shorter, of the token before; the end token's at the start of a row, for bigrams."""
        context = np.concatenate(([MISSING], shorter[:-1]))
        context[first] = self.end if level == 2 else MISSING
        return context

    def _exists(self, name: str) -> bool:
        from pyarrow import fs

        from korbwerk.llm.token_files import _storage

        key = f"{self.folder}/{name}"
        if key not in _mapped and key not in _present:
            storage, path = _storage(self.folder)
            _present[key] = storage.get_file_info(f"{path}/{name}").type == fs.FileType.File
        return key in _mapped or _present[key]


#: Whether a file of backoff weights is there; asked only once all are written.
_present: dict[str, bool] = {}


def _key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def _count_tasks(level: int, shards: int, trie: Trie | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from korbwerk.llm import tokens

        sums = _Sums()
        for batch in batches:
            for _, _, data, offsets in tokens.pieces(*tokens.as_bytes(batch.column("text")), limit=PIECE):
                words, per_row = tokens.word_hashes(data, offsets)
                if level > 1:
                    context, ids = trie.contexts(words, per_row, level)
                    known = (context >= 0) & (ids >= 0)
                    words = _key(context[known], ids[known])
                found, n = np.unique(words, return_counts=True)
                sums.add(found, n.astype(np.uint64))
            if len(sums.keys) > HELD:
                keys, counts = sums.settle()
                yield _packets(keys, counts, _shard(keys, level, shards))
                sums = _Sums()
        keys, counts = sums.settle()
        yield _packets(keys, counts, _shard(keys, level, shards))

    return count


def _log_code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * SCALE), 0, 65535).astype("<u2")


def _code_value(code: np.ndarray) -> np.ndarray:
    """The probability of a code; that of the largest code, which also stands for missing nodes, is 0."""
    return np.where(code >= 65535, 0.0, 10.0 ** (-code / SCALE))


def _vocabulary(folder: str):
    """Writes the shards of level 1: words, their counts, and the logarithms of count and one, in units of 1 / SCALE, which their probabilities follow from."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in _shard_sums(batches):
            sequence = elias_fano.build(keys, 1 << 64)
            prob = np.rint(np.log10(counts + 1.0) * SCALE).astype("<u2")
            _write(folder, f"level1-{s:05d}", {f"key.{k}": v for k, v in sequence.items()} | {"count": counts.astype("<u4" if counts.max() < 2**32 else "<u8"), "prob": prob})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "nodes": [len(keys)], "total": [int(counts.sum())]})

    return build


def _level(folder: str, trie: Trie, level: int, min_count: int, discount: float, last: bool):
    """Writes the shards of a level and returns, packed by shard of the level below, what each context's kept nodes take of its count."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = trie.bases[level - 2][-1]
        for s, keys, counts in _shard_sums(batches):
            if min_count > 1:
                kept = counts >= np.uint64(min_count)
                keys, counts = keys[kept], counts[kept]
            context = (keys >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, int)
            ends = np.concatenate((first, [len(keys)]))
            used = context[first]
            place = np.repeat(np.arange(len(first)), np.diff(ends))
            share = _log_code((counts - discount) / np.maximum(trie.counts(level - 1, used), 1)[place])
            if not last:
                _write(f"{folder}/counts{level}", f"{s:05d}", {"count": counts.astype("<u4" if not len(counts) or counts.max() < 2**32 else "<u8")})
            taken = np.add.reduceat(counts - discount, first) if len(first) else np.zeros(0)
            child = place.astype(np.uint64) * np.uint64(trie.words + 1) + (keys & np.uint64(0xFFFFFFFF))
            n, parts = len(keys), {"context": elias_fano.build(used.astype(np.uint64), below + 1)}
            del keys, counts, context, place
            parts["pointer"] = elias_fano.build(ends.astype(np.uint64), n + 1, searched=False)
            parts["child"] = elias_fano.build(child, max(1, len(first)) * (trie.words + 1))
            _write(folder, f"level{level}-{s:05d}", {f"{x}.{k}": v for x, part in parts.items() for k, v in part.items()} | {"prob": share})
            # The end token, as a context the first after all words, has a shard of its own.
            of = np.where(used < below, trie.shard_of(level - 1, used), trie.shards(level - 1))
            packets = _packets(used.astype(np.uint64), np.rint(taken * 1000).astype(np.uint64), of)
            yield pa.RecordBatch.from_arrays([*packets.columns, pa.nulls(len(packets), pa.int64())], ["shard", "k", "c", "nodes"])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([n], pa.int64())], ["shard", "k", "c", "nodes"])

    return build


def _backoffs(folder: str, trie: Trie, level: int):
    """Writes the backoff weight of each node of a level; the end token's, of level 1, has a file of its own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = trie.bases[level - 1]
        for s, node, taken in _shard_sums(batches):
            share = 1.0 - taken / 1000.0 / np.maximum(trie.counts(level, node.astype(np.int64)), 1)
            if s == trie.shards(level):
                _write(folder, "back-end", {"back": _log_code(share)})
            else:
                full = np.zeros(bases[s + 1] - bases[s], "<u2")
                full[node.astype(np.int64) - bases[s]] = _log_code(share)
                _write(folder, f"back{level}-{s:05d}", {"back": full})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32())})

    return build


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, shards: int | None = None) -> Trie:
    """Builds the trie of the texts of `docs` in the shared folder; `shards` of each level, or as many as the text asks for."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "trie")
    folder = scratch.root
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    packet = "shard int, k binary, c binary"

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.repartitionById(n, F.col("shard")).sortWithinPartitions("shard")  # hashes would put some shards together

    def bases(rows, n: int) -> list[int]:
        sizes = dict(rows)
        return [0, *np.cumsum([sizes.get(s, 0) for s in range(n)]).tolist()]

    n = shards or max(LEAST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = dealt(texts.mapInArrow(_count_tasks(1, n, None), packet), n)
    found = scratch.keep(counted.mapInArrow(_vocabulary(folder), "shard int, nodes long, total long"), "sizes1").collect()
    n_docs = docs.count()
    trie = Trie(folder, [bases(((r.shard, r.nodes) for r in found), n)], sum(r.total for r in found) + n_docs, n_docs)
    for level in range(2, order + 1):
        if max(trie.bases[-1][-1], trie.words) >= 2**32 - 1:
            raise ValueError("a level of the trie may have at most 2**32 - 2 nodes")
        n = shards or max(LEAST_SHARDS, -(-trie.tokens // SHARD_TOKENS))
        scratch.folder(f"counts{level}")
        counted = dealt(texts.mapInArrow(_count_tasks(level, n, trie), packet), n)
        built = scratch.keep(counted.mapInArrow(_level(folder, trie, level, min_count, discount, level == order), packet + ", nodes long"), f"sizes{level}")
        taken = dealt(built.where(F.col("k").isNotNull()).select("shard", "k", "c"), trie.shards(level - 1))
        scratch.keep(taken.mapInArrow(_backoffs(folder, trie, level - 1), "shard int"), f"backoffs{level}")
        trie = Trie(folder, [*trie.bases, bases(((r.shard, r.nodes) for r in built.where("nodes IS NOT NULL").select("shard", "nodes").collect()), n)], trie.tokens, n_docs)
        for done in (f"sizes{level}", f"counts{level - 1}"):
            scratch.drop(done)
    return trie


def token_probabilities(trie: Trie, hashes: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts and model probabilities of all tokens, and the row ends. Every table is asked once for each different word or n-gram."""
    order = len(trie.bases)
    some, back = np.unique(hashes, return_inverse=True)
    words, count, prob, weights = trie.look_words(some, "count", "prob", "back")
    ids, first, ends = trie.tokens_of(words, back, per_row)
    at = np.full(len(ids), len(some), np.int64)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    at[inner] = back
    counts = np.append(count, trie.docs)[at]
    # The end token comes last in these tables; a word that the model doesn't know has the code 0, as one that never occurred.
    p = (np.append(10.0 ** (prob / SCALE), trie.docs + 1.0) / trie.outcomes)[at]
    start = _code_value(np.array([trie.end_back()]))[0]
    weight = np.append(_code_value(weights), start)[at]
    shorter = ids
    for level in range(2, order + 1):
        known, context, word, back = trie.ngrams(shorter, ids, first, level)
        seen = trie.context(shorter, first, level) >= 0
        weight = np.concatenate(([1.0], weight[:-1]))
        weight[first] = start if level == 2 else 1.0
        nodes, prob, *weights = trie.look(level, context, word, "prob", *["back"] * (level < order))
        own = np.zeros(len(ids))
        own[known] = np.where(nodes >= 0, _code_value(prob), 0.0)[back]
        p = np.where(seen, own + weight * p, p)
        if level < order:
            shorter, weight = np.full(len(ids), MISSING, np.int64), np.ones(len(ids))
            shorter[known], weight[known] = nodes[back], _code_value(weights[0])[back]
    return counts, p, ends


def score(docs: DataFrame, trie: Trie, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns with n_tokens, n_known, train_tokens, base_score and score of every text."""

    keep = [k for k in keep if k not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "_text")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from korbwerk.llm import tokens

        for batch in batches:
            parts = []
            for _, _, data, offsets in tokens.pieces(*tokens.as_bytes(batch.column("_text")), limit=PIECE):
                words, per_row = tokens.word_hashes(data, offsets)
                counts, p, ends = token_probabilities(trie, words, per_row)
                starts = ends - per_row - 1
                base = np.log10((counts + 1.0) / trie.outcomes)
                parts.append((per_row + 1, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            n = pa.array(np.full(len(cols[0]), trie.tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(cols[0]), pa.array(cols[1]), n, pa.array(cols[2]), pa.array(cols[3])], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(scored, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return id_crc(doc_id, 7) == 2
