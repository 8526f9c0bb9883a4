"""Token-id files: fixed-width bit packing with block offsets.

A file holds, one after another: the packed ids in blocks of ``block_tokens`` ids; the byte
offset of each block (one more than there are blocks); the first token of each document (one
more than there are documents); the doc_ids; a byte per document that is 1 for a null doc_id; a
tail of fixed size. All numbers are little-endian. Each id takes ``bits`` bits, the fewest that
hold the vocabulary, so eight ids take ``bits`` bytes and numpy packs and unpacks whole blocks by
shifts. Any range of ids is read by seeking to its blocks.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, held, new_path, partitions, slices, staged, texts_of
from .pieces import Chunked, special_cutter
from .token_counts import byte_letters

MAGIC = b"TMTOKEN1"
TAIL = struct.Struct("<8sIIQQQ")
BLOCK_TOKENS = 8192


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold each id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as one little-endian stream of ``bits`` bits each."""
    n = len(ids)
    groups = np.zeros(-(-n // 8) * 8, np.uint64)
    groups[:n] = ids
    groups = groups.reshape(-1, 8)
    out = np.zeros((len(groups), bits), np.uint64)
    for byte in range(bits):
        for i in range(8 * byte // bits, min(7, (8 * byte + 7) // bits) + 1):
            shift = 8 * byte - i * bits
            out[:, byte] |= groups[:, i] >> np.uint64(shift) if shift >= 0 else groups[:, i] << np.uint64(-shift)
    return out.astype(np.uint8).tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed stream, as unsigned 32-bit integers."""
    rows = -(-n // 8)
    raw = np.zeros(rows * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)[: rows * bits]
    raw = raw.reshape(rows, bits)
    out = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(8):
        got = np.zeros(rows, np.uint64)
        for byte in range(i * bits // 8, (i * bits + bits - 1) // 8 + 1):
            shift, value = 8 * byte - i * bits, raw[:, byte].astype(np.uint64)
            got |= value << np.uint64(shift) if shift >= 0 else value >> np.uint64(-shift)
        out[:, i] = got & mask
    return out.reshape(-1)[:n]


class TokenWriter:
    """Writes one token file; holds a block of ids and the document index."""

    def __init__(self, path: str, bits: int, block_tokens: int = BLOCK_TOKENS):
        if block_tokens % 8:
            raise ValueError("a block holds a multiple of 8 ids")
        files, name = fs.FileSystem.from_uri(path)
        files.create_dir(os.path.dirname(name), recursive=True)
        self._out = files.open_output_stream(name)
        self.bits, self.block_tokens = bits, block_tokens
        self._waiting: list[np.ndarray] = []
        self._n_waiting = 0
        self._offsets = [0]
        self._starts = [0]
        self._ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._ids.append(doc_id)
        self._starts.append(self._starts[-1] + len(ids))
        self._waiting.append(ids)
        self._n_waiting += len(ids)
        if self._n_waiting >= self.block_tokens:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // self.block_tokens * self.block_tokens
        for at in range(0, full, self.block_tokens):
            data = pack(ids[at : min(at + self.block_tokens, full)], self.bits)
            self._out.write(data)
            self._offsets.append(self._offsets[-1] + len(data))
        self._waiting, self._n_waiting = [ids[full:]], len(ids) - full

    def close(self) -> tuple[int, int]:
        """Ends the file; returns its numbers of documents and tokens."""
        self._flush(last=True)
        n_docs, n_tokens = len(self._ids), self._starts[-1]
        for values, kind in ((self._offsets, "<u8"), (self._starts, "<u8"), ([x or 0 for x in self._ids], "<i8"), ([x is None for x in self._ids], "u1")):
            self._out.write(np.array(values, kind).tobytes())
        self._out.write(TAIL.pack(MAGIC, self.bits, self.block_tokens, n_tokens, n_docs, len(self._offsets) - 1))
        self._out.close()
        return n_docs, n_tokens


class TokenFile:
    """Random access to one token file."""

    def __init__(self, path: str):
        files, name = fs.FileSystem.from_uri(path)
        self._in = files.open_input_file(name)
        size = self._in.size()
        magic, self.bits, self.block_tokens, self.n_tokens, self.n_docs, n_blocks = TAIL.unpack(self._in.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        length = 8 * (n_blocks + 1) + 8 * (self.n_docs + 1) + 9 * self.n_docs
        index = self._in.read_at(length, size - TAIL.size - length)
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1)
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, 8 * (n_blocks + 1)).astype(np.int64)
        at = 8 * (n_blocks + 1) + 8 * (self.n_docs + 1)
        nulls = np.frombuffer(index, "u1", self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = pa.array(np.frombuffer(index, "<i8", self.n_docs, at), mask=nulls.astype(bool))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start`` to ``stop`` - 1; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_tokens, (stop - 1) // self.block_tokens
        base = first * self.block_tokens
        data = self._in.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        return unpack(data, min(self.n_tokens, (last + 1) * self.block_tokens) - base, self.bits)[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self._in.close()


class LibraryEncoder:
    """Ids of a text as the tokenizers library gives them, packed as unsigned 32-bit integers.

    Byte-level BPE without a normalizer treats the chunks between spaces alone, so the library
    encodes each distinct chunk once and a bounded cache keeps it; other files encode whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        chunked = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        chunked = chunked and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self._added, self._cut = added, special_cutter([*added])
        self._model = self.tokenizer.model if spec["model"]["type"] == "BPE" else None
        self._letters = byte_letters()
        self._values = Chunked(self._encode_chunk) if chunked else None

    def _encode_chunk(self, chunk: str) -> bytes:
        """A space and letters are one piece, which the library's model takes as it is."""
        if self._model is None or chunk[0] != " " or not chunk[1:].isalpha():
            return self._encode(chunk)
        return array("I", [x.id for x in self._model.tokenize(chunk.encode().decode("latin-1").translate(self._letters))]).tobytes()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._values is None or (self._added and len(self._cut(text)) > 1):
            return self._encode(text)
        return b"".join(self._values(text))


def _encoder(path: str) -> LibraryEncoder:
    return held(("encoder", path), lambda: LibraryEncoder(path))


def write_tokens(docs: DataFrame, path: str, end_id: int | None = None, to: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode whole texts and write their ids to token files in ascending doc_id order.

    Returns the manifest, one row per file in order: part, path, n_docs, n_tokens, base (ids in
    the files before it). The files lie under ``to``, a folder that all executors see (by default
    one in ``spark.checkpoint.dir``). A null text is empty; a null doc_id comes first; documents
    of equal doc_id stand in the order of their texts' hashes, equal rows side by side. An
    empty table gives no file. Columns other than doc_id and text are not stored.

    One range shuffle. Each task writes a file of a new name and reports it, so a task that is
    run again leaves a stray file at most: only the manifest's files count.
    """
    spark = docs.sparkSession
    folder = to or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, name = _encoder(path), None, ""
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    vocabulary = encoder.vocabulary if end_id is None else max(encoder.vocabulary, end_id + 1)
                    writer = TokenWriter(name, bits_for(vocabulary), block_tokens)
                writer.add(doc_id, np.frombuffer(encoder(text) + end, "<u4"))
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    slim = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    written = slim.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).mapInArrow(write, "part int, path string, n_docs long, n_tokens long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return staged(written, "manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, with_ids: bool = False, at_once: int = 1 << 18) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, read from the token files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the checksum of the ids as
    little-endian unsigned 32-bit integers. A task reads a file ``at_once`` ids at a time; without
    ``with_ids`` a document of any length takes bounded memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                file = TokenFile(path)
                held, low = np.zeros(0, np.uint32), 0
                rows: list[list] = [[], []]
                first = 0
                for k in range(file.n_docs):
                    start, stop = int(file.starts[k]), int(file.starts[k + 1])
                    crc, parts = 0, []
                    while start < stop:
                        if not low <= start < low + len(held):
                            low, held = start, file.ids(start, min(file.n_tokens, start + at_once))
                        here = held[start - low : stop - low]
                        crc = zlib.crc32(here, crc)
                        if with_ids:
                            parts.append(here.astype(np.int32))
                        start += len(here)
                    rows[0].append(crc)
                    rows[1].append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                    if len(rows[0]) == 256 or k == file.n_docs - 1:
                        starts = file.starts[first : k + 1]
                        out = [file.doc_ids.slice(first, k + 1 - first), pa.array(starts + base), pa.array(file.starts[first + 1 : k + 2] - starts), pa.array(rows[0], pa.int64())]
                        if with_ids:
                            out.append(pa.array(rows[1], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
                        rows, first = [[], []], k + 1
                file.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    n = partitions(manifest)
    return manifest.select("path", "base").repartition(n).mapInArrow(read, schema)
