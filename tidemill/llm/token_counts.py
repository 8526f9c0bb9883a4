"""Token counts without token identifiers (heap-and-linked-list byte-pair merging)."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, column, held, slices
from .pieces import Chunked, special_cutter, splitter

#: Pieces of byte-level BPE, as the public tokenizer files define them (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    spare = 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return letters


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols stay when all mergeable neighbours are merged, lowest rank first.

    The symbols form a linked list; a heap holds the mergeable neighbours by (rank, place). A
    heap entry is stale if either neighbour has changed since. Each merge takes one symbol away.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols = [*symbols]
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    left_over = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        merged = symbols[i] = a + b
        symbols[j] = ""
        left_over -= 1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            rank = ranks.get((merged, symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, merged, symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], merged))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], merged))
    return left_over


class TokenCounter:
    """Counts a text's tokens as the library would for a byte-level BPE ``.json`` file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self._ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self._letters = byte_letters()
        self._split = splitter(pattern)
        self._cut = special_cutter([t["content"] for t in spec["added_tokens"]])
        self._piece = Recent(self._count_piece, 20_000)
        self._values = Chunked(self._count_chunk)

    def _count_piece(self, piece: str) -> int:
        return count_symbols([self._letters[b] for b in piece.encode()], self._ranks)

    def _count_chunk(self, chunk: str) -> int:
        return sum(map(self._piece.__getitem__, self._split(chunk)))

    def __call__(self, text: str) -> int:
        parts = self._cut(text)
        return len(parts) - 1 + sum(sum(self._values(part)) for part in parts)


def _counter(path: str) -> TokenCounter:
    return held(("counter", path), lambda: TokenCounter(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``n_tokens`` (long): tokens of each whole text.

    Equals the library's count for the vocabulary file at ``path`` without begin, end or padding
    tokens; special strings inside a text count as one token each. A null text counts as empty
    (0). Rows, repeats and other columns stay as they are; a column that is called ``n_tokens``
    already is replaced. An empty table gives an empty table.

    One pass without a shuffle; Python keeps a slice of rows and a bounded cache of chunks.
    """
    rest = [c for c in docs.columns if c != n_tokens]
    docs = docs.select(*rest)
    where = docs.columns.index(text)
    schema = docs.withColumn(n_tokens, F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            counts = [counter(t) if t else 0 for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, n_tokens])

    return docs.mapInArrow(count, schema)


def count_report(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of each whole text.

    Null and empty texts have no bytes and no tokens; repeated rows and rows without doc_id are
    counted each; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            texts = column(batch, "text").to_pylist()
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"),
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array([counter(t) if t else 0 for t in texts], pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens"])

    return slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
