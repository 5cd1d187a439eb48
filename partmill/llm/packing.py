"""Token ids in fixed-width bit-packed files.

A file holds ids of `bits` bits each (the least that hold the vocabulary), least
significant bit first. Ids are packed in blocks of BLOCK ids, every block
starting on a byte, so the block of id k starts at byte (k // BLOCK) * BLOCK *
bits / 8 and unpacks alone. A file ends in its index, as little-endian longs:
the documents' ids, their ends in ids, their nulls, and a footer of counts. Each
task writes one file and returns one row about it. The manifest, written when all
tasks have ended, lists these rows in order with the ids before each file. So
lost or repeated tasks leave files that no reader sees.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.llm.common import shared_dir, ship, table, text_bytes

BLOCK = 1 << 16
END = 2
MAGIC = 0x314B4150


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """BLOCK ids at a time, each block from a whole byte on."""
    out = []
    for k in range(0, len(ids), BLOCK):
        part = ids[k : k + BLOCK].astype("<u4")
        if bits == 16:
            out.append(part.astype("<u2").tobytes())
        else:
            flat = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
            out.append(np.packbits(flat.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of a block as uint32."""
    raw = np.frombuffer(data, np.uint8, -(-count * bits // 8))
    if bits == 16:
        return raw.view("<u2").astype(np.uint32)
    flat = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = flat
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(count)


def store(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class PackedFile:
    """Random access to the ids of one file."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(40, size - 40), "<i8")
        magic, self.bits, self.n_docs, self.n_ids, self.data = (int(x) for x in foot)
        if magic != MAGIC:
            raise ValueError(f"not a packed file: {path}")
        index = self.file.read_at(self.n_docs * 17, size - 40 - self.n_docs * 17)
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs)
        self.nulls = np.frombuffer(index, np.uint8, self.n_docs, self.n_docs * 16).astype(bool)
        self.ends = np.frombuffer(index, "<i8", self.n_docs, self.n_docs * 8)

    def ids(self, start: int, end: int) -> np.ndarray:
        out = []
        for k in range(start // BLOCK, -(-end // BLOCK)):
            lo, hi = k * BLOCK, min(self.n_ids, (k + 1) * BLOCK)
            block = unpack(self.file.read_at(-(-(hi - lo) * self.bits // 8), lo * self.bits // 8), self.bits, hi - lo)
            out.append(block[max(start, lo) - lo : min(end, hi) - lo])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def documents(self):
        """(doc_id, ids) in order; a block is unpacked once and only the pending one is held."""
        held, at, left = np.empty(0, np.uint32), 0, np.empty(0, np.uint32)
        start = 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.ends.tolist()):
            parts, need = [left[: end - start]], end - start - min(len(left), end - start)
            left = left[end - start :]
            while need > 0:
                hi = min(self.n_ids, at + BLOCK)
                held = unpack(self.file.read_at(-(-(hi - at) * self.bits // 8), at * self.bits // 8), self.bits, hi - at)
                at = hi
                parts.append(held[:need])
                left, need = held[need:], need - min(len(held), need)
            yield None if null else doc, np.concatenate(parts)
            start = end


def write_file(rows: Iterator[tuple], folder: str, part: int, bits: int) -> tuple[str, int, int] | None:
    """Name, documents and ids of a new file of rows (doc_id, ids); none without rows."""
    first = next(rows, None)
    if first is None:
        return None
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
    doc_ids, nulls, ends, pending, held, total = [], [], [], [], 0, 0
    with fs.open_output_stream(f"{base}/{name}") as out:
        for doc, ids in chain([first], rows):
            total += len(ids)
            doc_ids.append(doc or 0)
            nulls.append(doc is None)
            ends.append(total)
            pending.append(ids)
            held += len(ids)
            if held >= 16 * BLOCK:
                flat = np.concatenate(pending)
                whole = held // BLOCK * BLOCK
                out.write(pack(flat[:whole], bits))
                pending, held = [flat[whole:]], held - whole
        if held:
            out.write(pack(np.concatenate(pending), bits))
        out.write(np.array(doc_ids, "<i8").tobytes() + np.array(ends, "<i8").tobytes() + np.array(nulls, np.uint8).tobytes())
        out.write(np.array([MAGIC, bits, len(ends), total, 0], "<i8").tobytes())
    return name, len(ends), total


def write_packed(rows: DataFrame, folder: str, bits: int, encode: Callable[[bytes], np.ndarray]) -> None:
    """Files and a manifest of `rows` (doc_id long, data binary) in the order of their partitions; `encode` makes data ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = ((doc, encode(data)) for b in batches for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if got := write_file(own, folder, part, bits):
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "name", "docs", "ids"), (part, *got)))])

    files, before = [], 0
    for _, name, docs, ids in sorted(rows.mapInArrow(run, "part long, name string, docs long, ids long").collect()):  # a row per file
        files.append({"name": name, "before": before, "docs": docs, "ids": ids})
        before += ids
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"bits": bits, "block": BLOCK, "files": files}).encode())


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files that the manifest in `folder` lists, a task per file."""
    fs, base = store(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for b in batches:
            for name, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows = []
                for doc, ids in PackedFile(fs, f"{base}/{name}").documents():
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out)

    names = spark.createDataFrame([(k, x["name"], x["before"]) for k, x in enumerate(files)], "k int, name string, before long")
    return names.repartitionById(max(1, len(files)), "k").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


# ---- encoding ----------------------------------------------------------------

_BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
BYTE_LEVEL = {b: chr(b) for b in _BYTES} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _BYTES)}
_WORKER: dict[str, Encoder] = {}


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian uint32; a piece has few, for which struct is quicker than numpy."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """A word-end BPE tokenizer on the pieces of a text between white space, each encoded once and kept.

    Texts are normalised to NFC, lower case and single spaces and cut at white
    space before the merges, so a piece's ids don't depend on its neighbours.
    A piece of letters below U+0130, with or without `.,!` after it, goes
    straight to the merges; every other one through the whole tokenizer. Texts
    with the separators U+001C to U+001F, which only Python counts as white
    space, do so whole.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kept: dict[str, bytes] = {}
        self.most = most
        self.marks = {m: self._plain(m) for m in (".", ",", "!", ".,", "!!", "...", "")}

    def _plain(self, text: str) -> bytes:
        return as_bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: set[str]) -> None:
        """Keep the ids of new pieces, and those of their letters alone, which are pieces too."""
        kept, tokenize = self.kept, self.model.tokenize
        for piece in pieces:
            body = piece.rstrip(".,!")
            tail = self.marks.get(piece[len(body) :])
            plain = body.isascii()
            if tail is not None and body.isalpha() and (plain or (max(body) < "İ" and unicodedata.is_normalized("NFC", body))):
                word = body.lower()
                ids = kept.get(word)
                if ids is None:
                    letters = word if plain else "".join(BYTE_LEVEL[b] for b in word.encode())
                    ids = kept[word] = as_bytes([t.id for t in tokenize(letters)])
                kept[piece] = ids + tail
            else:
                kept[piece] = self._plain(piece)

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._plain(text)
        pieces = text.split()
        new = set(pieces).difference(self.kept)
        if new:
            if len(self.kept) > self.most:  # bounds the memory; a text's own pieces are kept until it is encoded
                self.kept.clear()
                new = set(pieces)
            self._learn(new)
        return b"".join(map(self.kept.__getitem__, pieces))


def encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def packed(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int, end: int = END, order: list | None = None) -> DataFrame:
    """Encode `docs`, write them to `folder` in ascending order and read them back: doc_id, start, n_tokens, ids_crc32.

    Ordered by doc_id, null first; rows with equal doc_ids in any order, or by
    `order`. Repeated rows are written as often as they come.
    """
    spark = ship(docs.sparkSession)
    docs = docs if order else docs.select("doc_id", "text")
    by = order or [F.col("doc_id").asc_nulls_first()]
    ranged = docs.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    rows = ranged.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))

    def encode(data: bytes) -> np.ndarray:
        return np.append(np.frombuffer(encoder(tokenizer)(data.decode()), "<u4"), np.uint32(end))

    write_packed(rows, folder, width(vocabulary), encode)  # one Python worker a task
    return read_packed(spark, folder)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark), 49_408)
