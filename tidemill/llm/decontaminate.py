"""Benchmark decontamination by Wu-Manber search over words.

The windows of the test items are the patterns. A table of hashed word pairs ("blocks") tells how
far the search may jump before any pattern can end; where the jump is 0, the pair picks the bucket
of patterns that end in it, their first pair narrows it, and direct comparison confirms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, column, fresh, held, slices, staged

#: ASCII capitals become small; other ASCII that is no letter or digit becomes a blank (fixed values).
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


#: Factors that mix the hashes of two words, and candidates that are compared at once.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COMPARED = 4_096


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (b >> np.uint64(29))) * _MIX[0] + b * _MIX[1]
    return out ^ (out >> np.uint64(32))


class WuManber:
    """Finds all occurrences of word sequences of one length in texts of hashed words.

    The patterns stay where they are: ``at`` says where in ``words`` (all words of the items, hashed)
    each begins. One byte for each slot of hashed pairs says how far the search may jump; patterns
    stand in the order of their bucket, which last and first pair give together. That is about 25
    bytes a word, whatever the patterns' length.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, length: int):
        self.words, self.length, self.block = words, length, min(2, length)
        self.skip = length - self.block + 1
        self.slots = np.uint64((1 << max(8, int(4 * len(at)).bit_length())) - 1)
        self.shift = np.full(int(self.slots) + 1, min(self.skip, 255), np.uint8)
        blocks = self._blocks(words)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, blocks[at + (end - self.block)] & self.slots, np.uint8(min(length - end, 255)))
        bucket = self._bucket(blocks, at)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.at = bucket[order], at[order].astype(np.uint32)

    def _blocks(self, words: np.ndarray) -> np.ndarray:
        return words if self.block == 1 else _pair(words[:-1], words[1:])

    def _bucket(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _pair(blocks[at + (self.length - self.block)], blocks[at])

    def find(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts in ``words`` and, beside them, starts of the patterns that occur there."""
        n, length, block = len(words), self.length, self.block
        if n < length or not len(self.at):
            return
        blocks = self._blocks(words)
        jumps = self.shift[blocks & self.slots].tobytes()
        ends, end = [], length
        while end <= n:
            jump = jumps[end - block]
            if not jump:
                ends.append(end)
            end += jump or 1
        if not ends:
            return
        starts = np.array(ends, np.int64) - length
        bucket = self._bucket(blocks, starts)
        first, last = np.searchsorted(self.bucket, bucket), np.searchsorted(self.bucket, bucket, "right")
        span = np.arange(length)
        for k in np.flatnonzero(last > first):
            here = words[starts[k] : starts[k] + length]
            for low in range(first[k], last[k], COMPARED):
                found = self.at[low : min(last[k], low + COMPARED)].astype(np.int64)
                found = found[(self.words[found[:, None] + span] == here).all(1)]
                if len(found):
                    yield np.full(len(found), starts[k]), found


class Searcher:
    """Searches texts for the windows of test items. Words are compared by 64 bits of hash each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.known = Recent(xxhash.xxh3_64_intdigest, 200_000)
        self.items = [item for item, _ in items]
        found = [self.hashed(words_of(text)) for _, text in items]
        sizes = np.array([len(w) for w in found], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        words = np.concatenate([np.zeros(0, np.uint64), *found])
        found.clear()
        self.tables = []
        lengths = np.minimum(sizes, window)
        for length in sorted({*lengths.tolist()} - {0}):
            chosen = np.flatnonzero(lengths == length)
            counts = sizes[chosen] - length + 1
            at = np.repeat(self.begins[chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            self.tables.append(WuManber(words, at, length))

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items, hashed = set(), set(), self.hashed(words)
        for table in self.tables:
            for starts, at in table.find(hashed):
                spans.add((int(starts[0]), int(starts[0]) + table.length))
                items.update(self.items[k] for k in (np.searchsorted(self.begins, at, "right") - 1).tolist())
        return merged(sorted(spans)), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = out[-1][0], stop
        else:
            out.append((start, stop))
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with what the benchmark's windows hit in each whole text.

    Adds n_words (long), n_hit (long: words inside any occurrence of a window), spans (array of
    word positions start, stop, start, stop ...; stops are exclusive) and items (array of string:
    sorted ids of the items with occurring windows; a null id counts as the empty string). A
    window is ``window`` consecutive words of an item, or all of a shorter item. Null and empty
    texts have no words, items without words no windows. Columns of ``docs`` with those names are
    replaced; rows, repeats and other columns stay (``keep`` names the columns to return instead).

    The benchmark is broadcast in blocks of about ``block_bytes``, whose tables take about five times
    that in a worker. Each block is a pass of its own over the texts, written before the next
    one, so neither the driver nor a task holds more than one. No shuffle of the documents.
    """
    sc = docs.sparkSession.sparkContext
    added = ["n_words", "n_hit", "spans", "items"]
    rest = [c for c in docs.columns if c not in added]
    carried, = fresh(docs.select(*rest), "searched_text")
    docs = docs.select(*(rest if keep is None else [c for c in keep if c in rest]), F.col(text).alias(carried))
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("words")).distinct()
    total = tests.agg(F.sum(F.octet_length("words") + 32)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    result = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("n_hit", F.lit(0).cast("long")).withColumn("spans", F.array().cast("array<int>")).withColumn("items", F.array().cast("array<string>"))
    for k in range(n_blocks):
        part = tests if n_blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == k)
        last = k + 1 == n_blocks
        result = _pass(result, sc.broadcast([tuple(r) for r in part.collect()]), window, carried, last)
        if not last:
            result = staged(result, "searched")
    return result


def _pass(docs: DataFrame, block, window: int, text: str, last: bool) -> DataFrame:
    """One block of the benchmark against all texts; the last pass doesn't return the text."""
    key = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = held(key, lambda: Searcher(block.value, window))
        for batch in slices(batches):
            counts, hits, all_spans, all_items = [], [], [], []
            for t, spans, items in zip(*(column(batch, c).to_pylist() for c in (text, "spans", "items")), strict=True):
                words = words_of(t)
                found, owners = find(words)
                if spans:
                    found = merged([*found, *zip(spans[::2], spans[1::2], strict=True)])
                counts.append(len(words))
                hits.append(sum(stop - start for start, stop in found))
                all_spans.append([x for span in found for x in span])
                all_items.append(sorted(owners.union(items)))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "spans": pa.array(all_spans, pa.list_(pa.int32())), "items": pa.array(all_items, pa.list_(pa.string()))}
            if last:
                del columns[text]
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(search, (docs.drop(text) if last else docs).schema)


def contaminated(share: int = 20):
    """Whether the hit words are at least one in ``share`` of the words (and any at all)."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = find_windows(docs, benchmark, window, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(share).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents of ``docs`` that are not contaminated, with their columns as they were.

    The rule is that of ``contamination_report``; documents without words stay. Columns of any
    name may stand beside the text.
    """
    renamed = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    found = find_windows(renamed, benchmark, window, text=f"c{at}")
    return found.where(~contaminated(share)).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
