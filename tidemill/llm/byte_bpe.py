"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds every token of a piece in
one scan. From the longest match at each place the encoder steps back only where two
neighbouring tokens could not both stand in the merged result; whether they can is memoised per
pair. This gives exactly the tokens of rank-ordered merging in time linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, column, held, slices
from .pieces import Chunked, splitter
from .token_counts import PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """The tokens of a rank file: how each is made up, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.shorter = {rank: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank in sorted(self.tokens):
            self.parts[rank] = self._parts(rank)
        self._beside: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()

    def _parts(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for one that no merge makes."""
        token, left = self.tokens[rank], self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[self.length[left]:])
            if right is not None and left < rank and right < rank and self._stay_apart(left, right):
                self.made[left, right] = rank
                return left, right
            left = self.shorter[left]
        return None

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes in rank order ends in just these two tokens.

        Goes back in time: of the two tokens at the border, the one made last is undone. If before
        that the border tokens could merge at a lower rank, the border would have been crossed.
        """
        parts, made = self.parts, self.made
        limit = float("inf")
        while True:
            rank = made.get((left, right))
            if rank is not None and rank < limit:
                return False
            left_made = left if parts[left] else -1
            right_made = right if parts[right] else -1
            if left_made > right_made:
                limit, left = left, parts[left][1]
            elif right_made >= 0:
                limit, right = right + 1, parts[right][0]
            else:
                return True

    def beside(self, left: int, right: int) -> bool:
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) > 250_000:
                self._beside.clear()
            known = self._beside[left, right] = self._stay_apart(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest, spans = [-1] * n, [0] * n
        for end, (rank, length) in self._automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > spans[start]:
                longest[start], spans[start] = rank, length
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + self.length[token]
                if not dead[end] and (not out or self.beside(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out


class ByteBpe:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.merges = Merges(read_ranks(path))
        size = max(self.merges.tokens) + 1
        self._bytes = [self.merges.tokens.get(k) for k in range(size)]
        self._split = splitter(pattern)
        self._piece = Recent(lambda p: array("I", self.merges.encode(p.encode())).tobytes(), 20_000)
        self._values = Chunked(lambda chunk: b"".join(map(self._piece.__getitem__, self._split(chunk))), 200_000)

    def encode(self, text: str) -> bytes:
        return b"".join(self._values(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _bpe(path: str, pattern: str) -> ByteBpe:
    return held(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): the tokens of each whole text.

    Each match of ``pattern`` is encoded by the ranks of the file at ``path``, without special
    tokens. A null text is read as empty (no ids). A column that is called ``ids`` already is
    replaced; rows, repeats and other columns stay. One pass without a shuffle.
    """
    docs = docs.select(*[c for c in docs.columns if c != ids])
    where = docs.columns.index(text)
    schema = docs.withColumn(ids, F.array().cast("array<int>")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in slices(batches, 128):
            packed = [bpe.encode(t) if t else b"" for t in batch.column(where).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, ids])

    return docs.mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", pattern: str = PATTERN) -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary): the bytes that the ids stand for.

    Null ids give null bytes. Other columns stay; ``decoded`` is replaced if it is there.
    """
    encoded = encoded.select(*[c for c in encoded.columns if c != decoded])
    where = encoded.columns.index(ids)
    schema = encoded.withColumn(decoded, F.lit(None).cast("binary")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in slices(batches, 128):
            rows = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, decoded])

    return encoded.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text (null: empty).

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that
    decoding these ids gives.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for text in column(batch, "text").to_pylist():
                packed = bpe.encode(text) if text else b""
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_decode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), ids_sha256, decoded_sha256 of each whole text.

    The digests are those of ``round_trip``; decoding is done from the ids that are returned.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in slices(batches, 128):
            packed = [bpe.encode(t) if t else b"" for t in column(batch, "text").to_pylist()]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            columns = [column(batch, "doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), ids]
            columns += [pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(both, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
