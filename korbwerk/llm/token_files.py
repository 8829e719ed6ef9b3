"""Token ids as flat binary files.

A data set is a folder of shards in ascending doc_id order. Shard k has `part-k.bin`, the token ids of its documents
as little-endian unsigned integers without separators, of 2 bytes if the vocabulary has at most 65536 ids and else
of 4, and `part-k.idx`, the 64-bit little-endian
offsets of its documents counted in ids from the start of the shard, one more than it has documents, and
`part-k.doc`, their doc_ids as 64-bit little-endian integers. A manifest table has a row a shard: shard, docs, ids,
width (bytes an id), and base, the ids in all shards before it, a prefix sum. The files are read by memory mapping, of
a remote store by ranges.

Rows are range-partitioned by id, so a shard is written by one task, under a name of the attempt that is moved into
place when complete; a task that is run again puts the same bytes there. Only the manifest (one row a shard) is
summed in one place.

Texts go to the tokenizer whole. Only where the loaded file says that no token spans white space and that nothing but
lower-casing is done to plain characters (`word_wise`), a text of these is cut at white space and its words are looked
up in a bounded cache that the tokenizer fills.

Defined cases. Null texts are empty and hold the end id only. Rows with equal ids are ordered by text; null ids come
first and are written as NO_ID. An empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Words that an encoder keeps from batch to batch, and texts that it looks up at once.
CACHE, BATCH = 500_000, 1024
NO_ID = -(2**63)
#: Documents read back at once.
ROWS = 20_000
#: Texts of these characters only are normalised by lower-casing, and their white space is ASCII.
PLAIN = r"[\t\n\r -~\u00a1-\u024f]*"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The steps before the model of a tokenizer whose words may be encoded one by one.
WORD_WISE = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def word_wise(spec: dict) -> bool:
    """Whether a tokenizer's file has these steps before its model, nothing after it, and no added tokens but special ones."""
    steps = {k: (spec.get(k) or {}).get("normalizers" if k == "normalizer" else "pretokenizers") for k in WORD_WISE}
    return steps == WORD_WISE and not spec.get("post_processor") and all(t["special"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))


class Encoder:
    """Encodes texts as the tokenizer does with add_special_tokens=False."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.cache = Tokenizer.from_file(path), cache, {}
        self.plain = regex.compile(PLAIN) if word_wise(json.loads(self.tokenizer.to_str())) else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[word] = array("I", found.ids).tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = []
        for text in texts:
            plain = self.plain and self.plain.fullmatch(text) and not any(t in text for t in self.special)
            cut.append(text.lower().split() if plain else None)
        new = set().union(*[c for c in cut if c]) - self.cache.keys()
        # A letter and a mark after it are never one token, so the word may be known without the mark.
        tails = [w for w in new if w[-1] in ".,!" and w[-2:-1].isalpha()]
        self._learn(list((new - set(tails)) | {w[:-1] for w in tails if w[:-1] not in self.cache} | {w[-1] for w in tails}))
        for w in tails:
            self.cache[w] = self.cache[w[:-1]] + self.cache[w[-1]]
        known = self.cache.__getitem__
        for text, words in zip(texts, cut, strict=True):
            yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if words is None else b"".join(map(known, words))
        for w in list(islice(reversed(self.cache), max(0, len(self.cache) - self.limit))):
            del self.cache[w]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which later tasks of the same worker go on with."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_width(path: str) -> int:
    """Bytes an id: the fewest of 2 and 4 that hold the tokenizer's whole vocabulary."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _storage(folder: str):
    """The file system of a folder's address and the path on it, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Numbers:
    """A file's numbers by ranges: memory-mapped where the folder is a file path, else read through its file system."""

    def __init__(self, folder: str, name: str, dtype: str):
        storage, path = _storage(folder)
        self.dtype, self.local = np.dtype(dtype), storage.type_name == "local"
        if self.local:
            self.size = os.path.getsize(f"{path}/{name}") // self.dtype.itemsize
            self.data = np.memmap(f"{path}/{name}", dtype=dtype, mode="r") if self.size else np.zeros(0, dtype)
        else:
            self.file = storage.open_input_file(f"{path}/{name}")
            self.size = self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.local:
            return self.data[part]
        first, last, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at(max(0, last - first) * self.dtype.itemsize, first * self.dtype.itemsize), self.dtype)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, width: int | None = None, shards: int | None = None) -> DataFrame:
    """Writes the data set and returns its manifest (shard, docs, ids, width, base)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    width = width or id_width(tokenizer)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        storage, path = _storage(folder)
        encode, offsets, names, at, attempt = encoder(tokenizer), [0], [], 0, uuid.uuid4().hex
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        with storage.open_output_stream(f"{path}/.{attempt}.bin") as out:
            for batch in batches:
                texts = batch.column("text")
                names += [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
                for i in range(0, len(texts), BATCH):
                    for ids in encode(texts.slice(i, BATCH).to_pylist()):
                        out.write((ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()) + end)
                        at += len(ids) // 4 + 1
                        offsets.append(at)
        if len(offsets) > 1:
            for kind, numbers in (("idx", offsets), ("doc", names)):
                with storage.open_output_stream(f"{path}/.{attempt}.{kind}") as out:
                    out.write(np.array(numbers, dtype="<i8").tobytes())
            for kind in ("bin", "idx", "doc"):
                storage.move(f"{path}/.{attempt}.{kind}", f"{path}/part-{shard:06d}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": [len(offsets) - 1], "ids": [at], "width": pa.array([width], pa.int32())})
        else:
            storage.delete_file(f"{path}/.{attempt}.bin")

    scratch = Scratch(spark, "tokens")
    manifest = scratch.keep(ordered.mapInArrow(put, "shard int, docs long, ids long, width int"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.keep(manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "manifest")


def new_folder(docs: DataFrame) -> str:
    scratch = Scratch(docs.sparkSession, "token-files")
    return scratch.root


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files alone."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base, width in zip(*[batch.column(c).to_pylist() for c in ("shard", "base", "width")], strict=True):
                offsets, names, ids = (Numbers(folder, f"part-{shard:06d}.{kind}", t) for kind, t in (("idx", "<i8"), ("doc", "<i8"), ("bin", f"<u{width}")))
                for i in range(0, len(names), ROWS):
                    ends, found = offsets[i : i + ROWS + 1], names[i : i + ROWS]
                    crc = [zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(found, mask=found == NO_ID), pa.array(base + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, width: int | None = None) -> DataFrame:
    """Writes `docs` to a folder of its own in the shared folder, and reads it back."""
    folder, tokenizer = new_folder(docs), tokenizer or tokenizer_path()
    return read(write(docs, folder, tokenizer, end_id, width), folder)
