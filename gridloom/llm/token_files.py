"""Operator 7: token ids in fixed-width bit-packed files.

A file holds the ids of whole documents in order, each id in the fewest bits that the
vocabulary needs.  Ids are packed in blocks of ``BLOCK``; the header has each block's
byte offset, so any range is read by unpacking only the blocks it touches, all ids of
a block at once in numpy.  Layout, little-endian:

    magic "GLTK", version, width, block size, id count, document count     32 bytes
    byte offset of each block, and of the end                              8 each
    document ids; where each document's ids start, and the end             8 each
    blocks, each padded to a byte

Files are written by Spark as the binary column of a Parquet dataset, one row a file of
about ``FILE_IDS`` ids, with the shard, its place there and the ids before it.  So they
land in any store that Spark writes to, and its commit protocol covers lost executors
and repeated tasks.  Shards are range partitions by document id.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizers_io import Shared, library_tokenizer, spec

MAGIC, VERSION = b"GLTK", 1
#: Stands for a null document id.
NO_ID = -(1 << 63)
BLOCK = 1 << 14
FILE_IDS = 1 << 20
#: Chunks that a worker remembers; when there are more, it forgets the long ones, which are seldom met again.
CHUNKS_KEPT = 500_000
KEPT_SHARE, LONGEST = 0.7, 64
_WIDE = re.compile("[^\x00-\xff]")
_WORD_AND_SIGNS = re.compile(r"([A-Za-z\u00df-\u00f6\u00f8-\u00ff]+)([#*$%&|.,;:!?]+)")
_HEAD = struct.Struct("<4sHHIIQQ")


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest first."""
    if width < 32 and len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width % 8 == 0:
        return np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8), bitorder="little")
    return np.packbits(bits.reshape(-1, 32)[:, :width], bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if width % 8 == 0:
        out = np.zeros((n, 4), dtype=np.uint8)
        out[:, : width // 8] = data[: n * width // 8].reshape(n, -1)
        return out.view("<u4").ravel()
    first = np.arange(n, dtype=np.int64) * width
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at, value = first >> 3, np.zeros(n, dtype=np.uint64)
    for k in range((width + 14) // 8):
        value |= padded[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (first & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_file(doc_ids: list[int], documents: list[np.ndarray], width: int) -> bytes:
    """One file of whole documents."""
    starts = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype("<u8")
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    first = _HEAD.size + 8 * (len(blocks) + 1) + 8 * len(doc_ids) + 8 * len(starts)
    places = (first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])).astype("<u8")
    head = _HEAD.pack(MAGIC, VERSION, width, BLOCK, len(blocks), len(ids), len(doc_ids))
    return b"".join([head, places.tobytes(), np.array(doc_ids, dtype="<i8").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.width, self.block, blocks, self.n_ids, n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        self._bytes = np.frombuffer(data, dtype=np.uint8)
        at = _HEAD.size
        self._places = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at + 8 * n_docs).astype(np.int64)

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``, unpacking only the blocks between."""
        if not 0 <= start <= end <= self.n_ids:
            raise IndexError((start, end))
        if start == end:
            return np.empty(0, np.uint32)
        low, high = start // self.block, (end - 1) // self.block
        parts = [
            unpack(self._bytes[self._places[b] : self._places[b + 1]], min(self.block, self.n_ids - b * self.block), self.width)
            for b in range(low, high + 1)
        ]
        return np.concatenate(parts)[start - low * self.block : end - low * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


# Fixed value: the pattern of words, single digits and runs of signs that such files split by.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def declared(file: dict[str, Any]) -> tuple[bool, bool]:
    """Whether a tokenizer's file says that white space parts what is encoded, and that case is folded.

    Normalisers may only compose characters, make one space of white space, and fold case; the
    pre-tokenizer must keep nothing but the matches of ``_SPLIT``, as bytes; the model must be
    plain byte-pair merging without a choice of its own.  Anything else takes the library's whole path.
    """

    def flat(step: dict[str, Any] | None, inner: str) -> list[dict[str, Any]]:
        return [] if step is None else step[inner] if step["type"] == "Sequence" else [step]

    normal, pre, model = flat(file["normalizer"], "normalizers"), flat(file["pre_tokenizer"], "pretokenizers"), file["model"]
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    known = all(n["type"] in ("NFC", "Lowercase") or n == spaces for n in normal)
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    as_bytes = len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    plain = model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
    parts = known and as_bytes and pre[0] == split and plain
    return parts, parts and any(n["type"] == "Lowercase" for n in normal)


class Encoder:
    """The library's ids of a text, remembered by what stands between spaces and line feeds.

    Only for tokenizers that drop white space and look at nothing across it, which their file
    must declare (``declared``) and is checked on samples: then a text's ids are those of its parts, one after another.  If the
    tokenizer also folds case and parts words from the signs behind them, as is checked
    too, remembered parts serve for more chunks; plain words go straight to the
    library's model where that gives the same.
    """

    def __init__(self, data: bytes) -> None:
        self.tokenizer = library_tokenizer(data)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._known: dict[str, bytes] = {"": b""}
        parts, folds = declared(spec(data))
        text = "a b\nc  d\n e"
        whole = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.parts = parts and whole == [i for p in text.split() for i in self._ids(p)]
        self.folds = folds and self._ids("A\u00c9B\u00d8C") == self._ids("a\u00e9b\u00f8c")
        self.words = all(self._ids(word + signs) == self._ids(word) + self._ids(signs) for word in ("a", "there", "\u00e9t\u00e9") for signs in (".", ",", "!!", "%%%", "|"))
        self.bare = all(self._ids(w) == [t.id for t in self.tokenizer.model.tokenize(w)] for w in ("a", "there", "unthinkingly", "zqxv"))
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text, followed by ``end``."""
        last = end.to_bytes(4, "little")
        if not self.parts:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array([*x.ids, end], dtype=np.uint32) for x in found]
        split = [self._folded(t).replace("\n", " ").split(" ") for t in texts]
        known = self._known
        missing = set().union(*split).difference(known)
        if len(known) + len(missing) > CHUNKS_KEPT:
            self._known = known = self._short(known)
            missing = set().union(*split).difference(known)
        self._learn(missing)
        out = [np.frombuffer(b"".join([known[c] for c in parts]) + last, dtype="<u4") for parts in split]
        for chunk in missing:
            if len(chunk) > LONGEST:
                del known[chunk]
        return out

    @staticmethod
    def _short(known: dict[str, bytes]) -> dict[str, bytes]:
        """The shortest half, or a little less."""
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
        most = int(np.searchsorted(np.cumsum(np.bincount(lengths)), KEPT_SHARE * len(known), side="right"))
        return {c: ids for c, ids in known.items() if len(c) < most}

    def _folded(self, text: str) -> str:
        """The text in lower case, if the tokenizer folds case itself, all is Latin-1 and no special token appears in either."""
        if not self.folds or not text.isascii() and _WIDE.search(text) is not None:
            return text
        low = text.lower()
        return text if self.mark in low and any(token in low for token in self.special) else low

    def _learn(self, chunks: set[str]) -> None:
        """Add what the library makes of each chunk; a word with signs behind it is put together of the two."""
        known, pairs, ask = self._known, [], set()
        for chunk in chunks:
            m = _WORD_AND_SIGNS.fullmatch(chunk) if self.words else None
            if m is None:
                ask.add(chunk)
            else:
                pairs.append((chunk, m[1], m[2]))
                ask.update(part for part in m.groups() if part not in known)
        todo = []
        tokenize = self.tokenizer.model.tokenize
        for chunk in ask:
            if self.bare and chunk.isascii() and chunk.isalpha() and chunk.islower():
                known[chunk] = array("I", [t.id for t in tokenize(chunk)]).tobytes()
            else:
                todo.append(chunk)
        for at in range(0, len(todo), 4096):
            some = todo[at : at + 4096]
            for chunk, x in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[chunk] = array("I", x.ids).tobytes()
        for chunk, word, signs in pairs:
            known[chunk] = known[word] + known[signs]


FILES = "shard int, file int, first bigint, n_docs bigint, n_ids bigint, content binary"


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every row's whole text, then ``end``, in ascending ``doc_id`` order; the dataset read back.

    Null texts count as empty: their one id is ``end``.  Rows of one id stand side by side,
    ordered by text.  Null ids come first and are stored as ``NO_ID``, which an id must not
    be.  An empty table gives a dataset without rows.  Texts are shuffled once, by
    range; ids never.
    """
    spark = df.sparkSession
    shared = Shared(spark, tokenizer_path)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: Encoder = shared.build("encoder", Encoder)
        width = max(1, int(max(encoder.vocabulary - 1, end)).bit_length())
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        file, first, doc_ids, documents, held = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            fields = (shard, file, first, len(doc_ids), held, encode_file(doc_ids, documents, width))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(fields, kinds, strict=True)], names=["shard", "file", "first", "n_docs", "n_ids", "content"])

        for batch in common.steps(batches, "text"):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist(), end), strict=True):
                doc_ids.append(NO_ID if key is None else key)
                documents.append(ids)
                held += len(ids)
                if held >= FILE_IDS:
                    yield flush()
                    file, first, doc_ids, documents, held = file + 1, first + held, [], [], 0
        if doc_ids:
            yield flush()

    ordered.mapInArrow(run, FILES).write.option("compression", "none").mode("errorifexists").parquet(path)
    return spark.read.schema(FILES).parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    What stands before each shard comes from one sum per shard; their number is that of
    the partitions written, not of the documents.
    """
    spark = files.sparkSession
    sums = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(sums):
        before[shard] = total
        total += sums[shard]
    shared = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "content")), strict=True):
                file = TokenFile(content)
                ids = file.read(0, file.n_ids).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(file.starts[:-1].tolist(), file.starts[1:].tolist(), strict=True)]
                out: dict[str, Any] = {
                    "doc_id": pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == NO_ID), "start": pa.array(file.starts[:-1] + (shared.value[shard] + first), pa.int64()),
                    "n_tokens": pa.array(np.diff(file.starts), pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return files.select("shard", "first", "content").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def scratch_path(spark: SparkSession) -> str:
    """A new place for files in the shared checkpoint folder; they go when the application ends."""
    common.checkpoint_dir(spark)
    name = f"{spark.sparkContext.getCheckpointDir()}/gridloom-token-files-{uuid.uuid4().hex}"
    common.discard(spark, name, at_exit=True)
    return name
