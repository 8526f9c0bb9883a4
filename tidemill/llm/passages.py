"""Substring dedup: passages that repeat one of another document, up to small edits.

A paragraph here is a stretch of ``WINDOW`` words whose place the words themselves choose, so the
same words are cut the same way wherever lines and sentences end. Bands of MinHashes tell which
paragraphs collide, and each learns where the smallest doc_id has its like. Paragraphs that
collide with one document side by side mark two regions, whose words are held against each other:
what they share makes passages, verified by exact edit distance or Jaccard similarity. Regions that
are not settled by that are held against each other where they share words that the smallest doc_id
lacks (``_groups``). Verified passages are linked, and of each connected component the one of the smallest doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, near_rows, partitions, settled, slices, staged
from .components import components
from .ngram_join import hashes_of
from .units import GAP, WORDS, covered_spans, edits, shingles_of, unit_places, units_of
from .vertical import table_bytes

#: The least similarity of passages in percent.
PERCENT = 80
#: Words of a repeated passage, at least.
PASSAGE_WORDS = 40
#: Words of a paragraph. Of ``SPREAD`` places in a row one at least begins a paragraph, so that
#: 23 equal words in a row hold a whole one.
WINDOW = 16
SPREAD = 8
#: Bands and MinHashes of a band: at similarity 0.8 a pair of paragraphs collides with
#: probability 0.95, equal ones always.
BANDS = 3
ROWS = 2
#: Words around colliding paragraphs that are held against each other too; paragraphs that are
#: further apart mark regions of their own.
MARGIN = 48
#: Words of a region of what a document repeats of itself, about, at most: few of those meet others.
OWN = 128
#: Keys of a fragment, about, at most, and words and documents of a batch.
FRAGMENT_KEYS = 4_000_000
BATCH_WORDS = 500_000
BATCH_DOCS = 16_384
#: Words of passages that are compared at once.
PIECE = 2_000
#: What holding two regions against each other showed: no stretch that shared shingles cover, one
#: that is not alike, or only such as are.
SOFT, HARD, LINKED = 0, 2, 1
#: Soft regions of a key, at most, that are held against all others of it at once.
FEW = 8

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, 2 * (BANDS * ROWS + 1), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    y = (x ^ _SEEDS[2 * k]) * _SEEDS[2 * k + 1]
    return y ^ (y >> np.uint64(32))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` entries in a row."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def paragraph_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where paragraphs begin in texts of hashed words laid end to end, and a row of keys for each band.

    A paragraph begins where a shingle's hash is the least of ``SPREAD`` in a row around it. One
    word over and over makes none.
    """
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros((BANDS, 0), np.uint64)
    found, length = shingles_of(hashes), WINDOW - WORDS + 1
    whole = np.ones(n, bool)
    ends = np.cumsum(sizes)
    for k in range(1, WINDOW):
        whole[np.maximum(ends - k, ends - sizes)[sizes > 0]] = False
    whole[: n - length + 1] &= _least(found, length) != ~_least(~found, length)
    order = np.where(whole, _mixed(found, BANDS * ROWS), _MOST)
    edge = np.full(SPREAD - 1, _MOST)
    low = _least(np.concatenate([edge, order, edge]), SPREAD)
    at = np.flatnonzero(whole & (~_least(~low, SPREAD) == order))
    keys = []
    for band in range(BANDS):
        key = np.full(len(at), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = _mixed(key + _least(_mixed(found, k), length)[at], k)
        keys.append(key)
    return at, np.array(keys, np.uint64).reshape(BANDS, len(at))


def _regions(row: np.ndarray, at: np.ndarray, source: np.ndarray, there: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last paragraph, source, first and last paragraph there, of paragraphs of one row and
    source that lie side by side in both; those of its ``own`` document are cut at each ``OWN`` words."""
    order = np.lexsort((at, source, row))
    row, at, source, there, own = row[order], at[order], source[order], there[order], own[order]
    new = np.ones(len(row), bool)
    new[1:] = (own[1:] & (np.diff(at // OWN) != 0)) | (np.diff(row) > 0) | (np.diff(source) != 0) | (np.diff(at) > MARGIN) | (np.abs(np.diff(there - at)) > MARGIN)
    begins = np.flatnonzero(new)
    if not len(begins):
        return row, at, at, source, there, there
    ends = np.append(begins[1:], len(row)) - 1
    return row[begins], at[begins], at[ends], source[begins], np.minimum.reduceat(there, begins), np.maximum.reduceat(there, begins)


CANDIDATES = "doc_id long, text_hash long, low int, high int, source long, source_low int, source_high int, at int, to int, there int, there_to int"


def candidates(docs: DataFrame, fragments: int) -> DataFrame:
    """Regions of the rows of ``docs`` (doc_id, text, text_hash) with the regions of other documents that
    their paragraphs collide with, in words.

    A fragment of the keys' range gets each key once a batch, however many rows have it, with the
    smallest doc_id that has it there, and answers with the smallest of all where that is another.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, held, number, total = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            batch = (TaskContext.get().partitionId() << 32) | number
            turn = sorted(range(len(docs_)), key=docs_.__getitem__)
            ids = np.array([docs_[k] for k in turn], np.int64).reshape(-1, 2)
            sizes = np.array([len(held[k]) for k in turn], np.int64)
            begins = np.cumsum(sizes) - sizes
            at, keys = paragraph_keys(np.concatenate([held[k] for k in turn]), sizes)
            place, keys = np.tile(at, BANDS), keys.reshape(-1)
            order = np.argsort(keys, kind="stable")
            keys, place = keys[order], place[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            entry = np.cumsum(first) - 1
            several = np.bincount(entry, minlength=1)[entry] > 1
            meta = pa.RecordBatch.from_pydict({"x": pa.array([ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), entry[several].astype("<u4").tobytes(), place[several].astype("<u4").tobytes()], pa.binary())})
            rows = [(-1 - batch, batch, table_bytes(meta), b"", b"", b"", b"")]
            keys, place = keys[first], place[first]
            rank = np.searchsorted(begins, place, "right") - 1
            offset = place - begins[rank]
            to = ((keys >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            edges = np.searchsorted(to, np.arange(fragments + 1, dtype=np.uint64))
            for f in np.flatnonzero(np.diff(edges)):
                here = slice(edges[f], edges[f + 1])
                used = np.unique(rank[here])
                kind = "<u2" if offset[here].max() < 1 << 16 else "<u4"
                rows.append((int(f), batch, (keys[here] & _LOW).astype("<u4").tobytes(), rank[here].astype("<u2").tobytes(), offset[here].astype(kind).tobytes(), used.astype("<u2").tobytes(), ids[used, 0].astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 2 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=["fragment", "batch", "keys", "ranks", "offsets", "used", "ids"])

        for batch in slices(batches):
            for doc_id, text_hash, text in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                words = units_of(text)
                if len(words) < WINDOW:
                    continue
                if docs_ and (total + len(words) > BATCH_WORDS or len(docs_) == BATCH_DOCS):
                    yield flush()
                    docs_, held, number, total = [], [], number + 1, 0
                docs_.append((doc_id, text_hash))
                held.append(hashes_of(words))
                total += len(words)
        if docs_:
            yield flush()

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        batches, fragment = rows.column("batch"), rows.column("fragment")
        if key[0].as_py() < 0:
            none = pa.nulls(len(batches), pa.binary())
            return pa.table({"batch": batches, "fragment": fragment, "entries": pa.array([0] * len(batches), pa.int32()), "shared": rows.column("keys"), "ranks": none, "offsets": none, "sources": none, "places": none})
        keys, ranks, offsets, owners = [], [], [], []
        for k, r, o, used, ids in zip(*(rows.column(c).to_pylist() for c in ("keys", "ranks", "offsets", "used", "ids")), strict=True):
            keys.append(np.frombuffer(k, "<u4"))
            ranks.append(np.frombuffer(r, "<u2"))
            offsets.append(np.frombuffer(o, "<u2" if len(o) == len(r) else "<u4").astype(np.uint32))
            owners.append(np.frombuffer(ids, "<i8")[np.searchsorted(np.frombuffer(used, "<u2"), ranks[-1])])
        sizes = [len(k) for k in keys]
        keys, offsets, owners = np.concatenate(keys), np.concatenate(offsets), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(keys[order]) > 0))
        least = np.repeat(np.minimum.reduceat(owners[order], begins), np.diff(np.append(begins, len(keys))))
        mine = least == owners[order]
        spot = np.minimum.reduceat(np.where(mine, offsets[order], np.uint32(0xFFFFFFFF)), begins)
        repeated = np.zeros(len(keys), bool)
        heads = np.minimum.reduceat(np.where(mine & (offsets[order] == np.repeat(spot, np.diff(np.append(begins, len(keys))))), np.arange(len(keys)), len(keys)), begins)
        repeated[order] = mine
        repeated[order[heads]] = False
        source, place = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint32)
        source[order], place[order] = least, np.repeat(spot, np.diff(np.append(begins, len(keys))))
        out, begin = [], 0
        for size, r in zip(sizes, ranks, strict=True):
            here = slice(begin, begin + size)
            hit = (source[here] < owners[here]) | repeated[here]
            out.append((np.packbits(hit).tobytes(), r[hit].tobytes(), offsets[here][hit].astype("<u4").tobytes(), source[here][hit].astype("<i8").tobytes(), place[here][hit].astype("<u4").tobytes()))
            begin += size
        names = ["shared", "ranks", "offsets", "sources", "places"]
        return pa.table({"batch": batches, "fragment": fragment, "entries": pa.array(sizes, pa.int32()), **{n: pa.array(x, pa.binary()) for n, x in zip(names, zip(*out, strict=True), strict=True)}})

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        answers = sorted(zip(*(rows.column(c).to_pylist() for c in ("fragment", "entries", "shared", "ranks", "offsets", "sources", "places")), strict=True), key=lambda r: r[0])
        meta = pa.ipc.open_stream(answers[0][2]).read_all().column("x").to_pylist()
        ids, sizes, entry, at = (np.frombuffer(x, k).astype(np.int64) for x, k in zip(meta, ("<i8", "<i8", "<u4", "<u4"), strict=True))
        ids, begins = ids.reshape(-1, 2), np.cumsum(sizes) - sizes
        joined = lambda k, kind: np.frombuffer(b"".join(a[k] for a in answers[1:]), kind).astype(np.int64)
        rank, offset, source, place = joined(3, "<u2"), joined(4, "<u4"), joined(5, "<i8"), joined(6, "<u4")
        mask = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(a[2], "u1"), count=a[1]).astype(bool) for a in answers[1:])])
        # Keys that several rows of the batch have: all but the first follow the answer to it, or it.
        row = np.searchsorted(begins, at, "right") - 1
        first = np.append(True, np.diff(entry) > 0)[: len(entry)]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(entry)), 0)) if len(entry) else entry
        known = np.cumsum(mask) - 1
        answered = mask[entry]
        more_source, more_place = ids[row[lead], 0], at[lead] - begins[row[lead]]
        more_source[answered], more_place[answered] = source[known[entry[answered]]], place[known[entry[answered]]]
        rest = np.flatnonzero(~first & (more_source <= ids[row, 0]))
        held, source = np.append(rank, row[rest]), np.append(source, more_source[rest])
        cut = _regions(held, np.append(offset, (at - begins[row])[rest]), source, np.append(place, more_place[rest]), source == ids[held, 0])
        row, low, high, source, there_low, there_high = cut
        core = [pa.array(x.astype(np.int32)) for x in (low, high, there_low, there_high)]
        low, high = np.maximum(low - MARGIN, 0), np.minimum(high + WINDOW + MARGIN, sizes[row])
        # Borders on a grid: documents that repeat the same passage ask for the same region.
        there_low = np.maximum(there_low - MARGIN, 0) // WINDOW * WINDOW
        there_high = -(-(there_high + WINDOW + MARGIN) // WINDOW) * WINDOW
        numbers = [pa.array(x.astype(np.int32)) for x in (low, high, there_low, there_high)]
        return pa.table({"doc_id": ids[row, 0], "text_hash": ids[row, 1], "low": numbers[0], "high": numbers[1], "source": source, "source_low": numbers[2], "source_high": numbers[3], **dict(zip(("at", "to", "there", "there_to"), core, strict=True))})

    sent = docs.mapInArrow(send, "fragment long, batch long, keys binary, ranks binary, offsets binary, used binary, ids binary")
    answered = sent.groupBy("fragment").applyInArrow(answer, "batch long, fragment long, entries int, shared binary, ranks binary, offsets binary, sources binary, places binary")
    return answered.groupBy("batch").applyInArrow(gather, CANDIDATES)


def _region_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, low, high, words of each region in ``wanted`` of ``docs``, and on which sides of
    pairs it stands (``led``, ``own``); a word is 32 bits of hash."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for doc_id, text_hash, text, wanted in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text_hash", "text", "wanted")), strict=True):
                words = (hashes_of(units_of(text)) >> np.uint64(32)).astype("<u4")
                out += [(doc_id, text_hash, r["low"], r["high"], words[r["low"] : r["high"]].tobytes(), r["led"], r["own"]) for r in wanted]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text_hash", "low", "high", "words", "led", "own"])

    return docs.mapInArrow(make, "doc_id long, text_hash long, low int, high int, words binary, led boolean, own boolean")


def alike(a: np.ndarray, b: np.ndarray, percent: int, pairs: list[tuple[int, int]] = ()) -> bool:
    """Whether words ``a`` and ``b`` differ in few enough edits, or have enough shingles in common.

    At most (100 - ``percent``) % of the longer one may be inserted, deleted or replaced, or the
    Jaccard similarity of their shingles is ``percent`` or more. Long ones are compared in pieces
    that begin at ``pairs`` of places, which can only find more edits than there are.
    """
    if len(a) == len(b) and (a == b).all():
        return True
    most, done = max(len(a), len(b)) * (100 - percent) // 100, 0
    cuts = [(0, 0)]
    for i, j in pairs:
        if i - cuts[-1][0] >= PIECE and j > cuts[-1][1]:
            cuts.append((i, j))
    for (i, j), (k, m) in zip(cuts, [*cuts[1:], (len(a), len(b))], strict=True):
        done += edits(a[i:k].tolist(), b[j:m].tolist())
        if done > most:
            break
    if done <= most:
        return True
    if min(len(a), len(b)) < WORDS:
        return False
    mine, other = (np.unique(shingles_of(x.astype(np.uint64))[: len(x) - WORDS + 1]) for x in (a, b))
    common = len(np.intersect1d(mine, other, assume_unique=True))
    return 100 * common >= percent * (len(mine) + len(other) - common)


def shared_passages(mine: np.ndarray, other: np.ndarray, passage_words: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(first, last, first there, last there) of the passages of words ``mine`` that repeat one of ``other``.

    A passage whose words stand in ``other`` in another order is tried in parts that keep theirs.
    """
    return _passages(mine, other, _shared(mine, other), passage_words, percent)[0]


def _shared(mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of words ``mine``, which of them ``other`` has, and where it has those first."""
    a, b = (shingles_of(x.astype(np.uint64))[: max(len(x) - WORDS + 1, 0)] for x in (mine, other))
    if not len(a) or not len(b):
        return a, np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, where = np.unique(b, return_index=True)
    at = np.minimum(np.searchsorted(known, a), len(known) - 1)
    starts = np.flatnonzero(known[at] == a)
    return a, starts, where[at[starts]]


def _shared_of(mine: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """``_shared`` of each pair of words of a batch, laid end to end: where the words ``mine`` of each pair
    begin, the shingle from each word on, whether one begins there, the words at which shared ones begin,
    and where the other has those first, from its own begin on."""
    sizes, sizes_there = (np.array([len(x) for x in side], np.int64) for side in (mine, other))
    pair, pair_there = (np.repeat(np.arange(len(n)), n) for n in (sizes, sizes_there))
    begins, begins_there = np.cumsum(sizes) - sizes, np.cumsum(sizes_there) - sizes_there
    a, b = (shingles_of(np.concatenate(side).astype(np.uint64)) for side in (mine, other))
    whole = np.arange(len(a)) + WORDS <= (begins + sizes)[pair]
    at = np.flatnonzero(np.arange(len(b)) + WORDS <= (begins_there + sizes_there)[pair_there])
    apart = np.arange(len(mine), dtype=np.uint64) * _SEEDS[0]
    known = b[at] ^ apart[pair_there[at]]
    order = np.argsort(known, kind="stable")
    known, at = known[order], at[order]
    found = np.searchsorted(known, a ^ apart[pair])
    hit = np.flatnonzero(whole & (found < len(known)))
    hit = hit[known[found[hit]] == (a ^ apart[pair])[hit]]
    return begins, a, whole, hit, at[found[hit]] - begins_there[pair[hit]]


def _beyond(begins: np.ndarray, a: np.ndarray, whole: np.ndarray, starts: np.ndarray, there: np.ndarray, least: np.ndarray, most: np.ndarray) -> pa.ListArray:
    """For each pair of a batch (``_shared_of``) the shingles (32 bits) that another text may have in common beside
    shared ones: all that begin no more than ``GAP`` words off them and are not shared at about the same place,
    of shifts from ``least`` to ``most``."""
    sizes = np.diff(np.append(begins, len(a)))
    pair = np.repeat(np.arange(len(begins)), sizes)
    mine = pair[starts]
    reach = np.bincount(np.maximum(starts - GAP - WORDS, begins[mine]), minlength=len(a) + 1)
    reach -= np.bincount(np.minimum(starts + GAP + WORDS + 1, (begins + sizes)[mine]), minlength=len(a) + 1)
    fresh_ = whole & (np.cumsum(reach[:-1]) > 0)
    shift = there - starts + begins[mine]
    fresh_[starts[(shift >= least[mine] - GAP) & (shift <= most[mine] + GAP)]] = False
    known = np.unique(pair[fresh_].astype(np.uint64) << np.uint64(32) | a[fresh_] >> np.uint64(32))
    edges = np.searchsorted(known, np.arange(len(begins) + 1, dtype=np.uint64) << np.uint64(32))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((known & _LOW).astype("<u4").view("<i4")))


def _passages(mine: np.ndarray, other: np.ndarray, shared: tuple[np.ndarray, np.ndarray, np.ndarray], passage_words: int, percent: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """The passages, and how far that settles the pair: ``SOFT``, ``HARD`` or ``LINKED``."""
    a, starts, there = shared
    if min(len(mine), len(other)) < max(WORDS, passage_words * percent // 100):
        return [], SOFT
    places = np.zeros(len(a), np.int64)
    places[starts] = there

    def aligned(first: int, last: int, i: np.ndarray) -> list[tuple[int, int, int, int]]:
        if len(np.unique(a[i])) <= WORDS:
            return []
        j = places[i]
        near = np.abs(j - i - np.sort(j - i)[len(i) // 2]) <= GAP + (last - first) * (100 - percent) // 100
        i, j = i[near], j[near]
        begin, end = int(j.min()), int(j.max()) + WORDS
        pairs = [(int(x) - first, int(y) - begin) for x, y in zip(i[:: PIECE // 4], j[:: PIECE // 4], strict=True)] if last - first > 2 * PIECE else []
        return [(first, last, begin, end)] if alike(mine[first:last], other[begin:end], percent, pairs) else []

    def inside(first: int, last: int, i: np.ndarray) -> np.ndarray:
        return i[np.searchsorted(i, first) : np.searchsorted(i, last - WORDS, "right")]

    out, state = [], SOFT
    for first, last in covered_spans(starts, passage_words, percent):
        i = inside(first, last, starts)
        if len(np.unique(a[i])) <= WORDS:
            continue
        whole = aligned(first, last, i)
        state = max(state, LINKED if whole else HARD)
        if not whole:
            shift = places[i] - i
            order = np.argsort(shift, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shift[order]) > GAP) + 1):
                mine_only = np.sort(i[part])
                for x, y in covered_spans(mine_only, passage_words, percent):
                    whole += aligned(x, y, inside(x, y, mine_only))
        out += whole
    return out, state


def _verified(pairs: DataFrame, passage_words: int, percent: int) -> DataFrame:
    """Each pair of regions (of ``row`` and ``leader``) with the passages that are alike, the state of the
    pair, and the shingles by which the row may be like others that were held against the same leader."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sources, low, source_low, at, to, begin, end = (column(batch, c).to_pylist() for c in ("doc_id", "source", "low", "source_low", "at", "to", "there", "there_to"))
            words, there = ([np.frombuffer(x, "<u4") for x in column(batch, c).to_pylist()] for c in ("words", "source_words"))
            begins, a, whole, starts, places = _shared_of(words, there)
            shifts = np.array([(-np.inf, np.inf) if at[k] is None else sorted((begin[k] - at[k] + low[k] - source_low[k], end[k] - to[k] + low[k] - source_low[k])) for k in range(len(ids))])
            beyond = _beyond(begins, a, whole, starts, places, shifts[:, 0], shifts[:, 1])
            # A passage is covered to ``percent``: pairs of fewer shared words, most of them, have none.
            cover = np.bincount(starts, minlength=len(a) + 1) - np.bincount(np.minimum(starts + WORDS, len(a)), minlength=len(a) + 1)
            covered = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
            edges = np.append(begins, len(a))
            firsts = np.searchsorted(starts, edges)
            links, states = [[]] * len(ids), [SOFT] * len(ids)
            for k in np.flatnonzero(100 * np.diff(covered[edges]) >= percent * passage_words):
                if ids[k] != sources[k]:
                    here, low_, source = slice(firsts[k], firsts[k + 1]), low[k], source_low[k]
                    found, states[k] = _passages(words[k], there[k], (a[edges[k] : edges[k + 1]], starts[here] - edges[k], places[here]), passage_words, percent)
                    links[k] = [{"first": low_ + f[0], "last": low_ + f[1], "source_first": source + f[2], "source_last": source + f[3]} for f in found]
            kinds = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "source_first", "source_last")]))
            kept = ["doc_id", "text_hash", "source", "source_hash", "row", "leader", "there", "there_to"]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(states, pa.int32()), pa.array(links, kinds), beyond], names=[*kept, "state", "links", "beyond"])

    return pairs.mapInArrow(make, "doc_id long, text_hash long, source long, source_hash long, row long, leader long, there int, there_to int, state int, links array<struct<first:int,last:int,source_first:int,source_last:int>>, beyond array<int>")


def _groups(held: DataFrame) -> DataFrame:
    """key, doc_id, row, state, n_soft, head of the regions that may still be alike after each was ``held`` against
    its leader: all of a key are, as far as one of a pair is ``SOFT``.

    If a passage of two regions were made of shingles that the leader shares, it would have been seen
    there; so regions that were not like it (``SOFT``) can only be like those that also share one of
    the others, the nearest of which to what the leader shares is no more than ``GAP`` words off. Shingles
    in a row mostly have the same regions: such groups are one.
    """
    group = Window.partitionBy("key")
    posts = held.select(F.explode("beyond").alias("shingle"), "leader", "doc_id", "row", "state").select(F.xxhash64("leader", "shingle").alias("key"), "doc_id", "row", "state")
    of = {"n": F.count("*"), "n_soft": F.count(F.when(F.col("state") == SOFT, 1)), "head": F.min(F.struct("doc_id", "row")), "sum": F.sum(F.shiftrightunsigned(F.xxhash64("row", "state"), 32))}
    posts = posts.withColumns({name: c.over(group) for name, c in of.items()}).where((F.col("n") > 1) & (F.col("n_soft") > 0))
    return posts.select(F.xxhash64("n", "n_soft", "head", "sum").alias("key"), "doc_id", "row", "state", "n_soft", F.col("head.row").alias("head")).distinct()


def _pairs(groups: DataFrame) -> DataFrame:
    """row, head of all pairs of regions of one key of which one is soft."""
    soft = groups.where(F.col("state") == SOFT).select("key", F.col("doc_id").alias("soft_id"), F.col("row").alias("soft"))
    both = groups.join(soft, "key").where((F.col("doc_id") != F.col("soft_id")) & ((F.col("state") != SOFT) | (F.col("doc_id") > F.col("soft_id"))))
    mine = F.col("doc_id") > F.col("soft_id")
    return both.select(F.when(mine, F.col("row")).otherwise(F.col("soft")).alias("row"), F.when(mine, F.col("soft")).otherwise(F.col("row")).alias("head")).distinct()


def _hard(held: DataFrame) -> DataFrame:
    """row, head of the pairs of regions of one leader of which one shares a passage's shingles with it in another order."""
    hard = held.where(F.col("state") == HARD).select("leader", "doc_id", "row", "there", "there_to")
    other = held.where(F.col("state") != SOFT).select("leader", F.col("doc_id").alias("other_id"), F.col("row").alias("other"), "state", F.col("there").alias("from"), F.col("there_to").alias("up_to"))
    meet = F.coalesce((F.col("there") <= F.col("up_to")) & (F.col("from") <= F.col("there_to")), F.lit(True))
    both = hard.join(other, "leader").where(meet & (F.col("doc_id") != F.col("other_id")) & ((F.col("state") != HARD) | (F.col("doc_id") > F.col("other_id"))))
    mine = F.col("doc_id") > F.col("other_id")
    return both.select(F.when(mine, F.col("row")).otherwise(F.col("other")).alias("row"), F.when(mine, F.col("other")).otherwise(F.col("row")).alias("head")).distinct()


def _all_links(first: DataFrame, words: DataFrame, passage_words: int, percent: int) -> DataFrame:
    """The links of the pairs ``first`` and of all others of their regions ``words`` that may be alike.

    Of a key's regions all pairs are taken, unless more than ``FEW`` are soft: then each is held against
    the first of them, which leads those that go on. Once that leaves no more pairs in all than ``first``
    has, all of them are taken.
    """

    def held_against(pairs: DataFrame) -> DataFrame:
        mine = near_rows(words, pairs, "row").select("doc_id", "text_hash", "low", "words", "row")
        heads = pairs.select(F.col("head").alias("row"))
        there = near_rows(words, heads, "row").select(F.col("doc_id").alias("source"), F.col("text_hash").alias("source_hash"), F.col("low").alias("source_low"), F.col("words").alias("source_words"), F.col("row").alias("head"))
        both = pairs.join(mine, "row").join(there, "head").withColumn("leader", F.col("head"))
        return _verified(both.withColumns({c: F.lit(None).cast("int") for c in ("at", "to", "there", "there_to")}), passage_words, percent)

    held = staged(_verified(first, passage_words, percent), "held")
    tried, last, most = [held], [], held.count()
    while True:
        groups = staged(_groups(held), "groups")
        large = F.col("n_soft") > FEW
        made = groups.agg(F.coalesce(F.sum(F.when(large, F.col("n_soft"))), F.lit(0))).first()[0]
        last += [_hard(held), _pairs(groups if made <= most else groups.where(~large))]
        if made <= most:
            break
        many = staged(groups.where(large & (F.col("row") != F.col("head"))).select("row", "head").distinct(), "many")
        held = staged(held_against(many), "held")
        tried.append(held)
    rest = staged(reduce(DataFrame.unionAll, last).distinct(), "rest")
    tried.append(staged(held_against(rest).drop("beyond"), "last"))
    links = [t.select("doc_id", "text_hash", "source", "source_hash", F.inline("links")) for t in tried]
    return reduce(DataFrame.unionAll, links).distinct()


def _copied(docs: DataFrame, passage_words: int) -> DataFrame:
    """doc_id, text_hash, first, last, stop of the texts that are a passage as a whole."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for doc_id, text_hash, text in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                words = hashes_of(units_of(text))
                if len(words) >= passage_words and len(np.unique(shingles_of(words)[: len(words) - WORDS + 1])) > WORDS:
                    out.append((doc_id, text_hash, 0, len(words), len(text)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text_hash", "first", "last", "stop"])

    return docs.mapInArrow(make, "doc_id long, text_hash long, first int, last int, stop int")


FOUND = "doc_id long, text_hash long, start int, stop int, first_word int, n_words int, sources array<long>"


def _placed(docs: DataFrame) -> DataFrame:
    """The passages of ``docs`` (doc_id, text_hash, text, spans) with their characters; spans that
    touch are one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for doc_id, text_hash, text, spans in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text_hash", "text", "spans")), strict=True):
                places = np.append(unit_places(text), len(text)).tolist()
                joined: list = []
                for first, last, keeper in sorted((s["first"], s["last"], s["keeper"]) for s in spans):
                    if joined and first <= joined[-1][1]:
                        joined[-1] = (joined[-1][0], max(last, joined[-1][1]), joined[-1][2] | {keeper})
                    else:
                        joined.append((first, last, {keeper}))
                out += [(doc_id, text_hash, places[first] if first else 0, places[last], first, last - first, sorted(sources)) for first, last, sources in joined]
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text_hash", "start", "stop", "first_word", "n_words", "sources"])

    return docs.mapInArrow(make, FOUND)


def _kept(links: DataFrame, whole: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, first, last, keeper of the passages that go and of the copied texts ``whole``.

    Passages of one text that are nearly the same stretch (by ``percent``, one to the next in text
    order) are one node; links join nodes, and the smallest doc_id of a component keeps its
    passage. Only stretches that were held against an earlier document go.
    """
    ends = ["doc_id", "text_hash", "first", "last"]
    mine = links.select(*ends)
    there = links.select(*[F.col(f"source{c}").alias(n) for c, n in zip(("", "_hash", "_first", "_last"), ends, strict=True)])
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    nodes = mine.unionByName(there).unionByName(whole.select(*ends)).distinct()
    nodes = nodes.withColumn("before", F.lag(F.struct("first", "last")).over(order))
    common = F.least("last", "before.last") - F.greatest("first", "before.first")
    apart = F.col("before").isNull() | (100 * common < percent * (F.greatest("last", "before.last") - F.least("first", "before.first")))
    nodes = nodes.withColumn("head", F.when(apart, F.xxhash64(*ends)))
    nodes = staged(nodes.select(*ends, F.last("head", ignorenulls=True).over(order).alias("node")), "nodes")
    there = nodes.select(*[F.col(n).alias(f"source{c}") for c, n in zip(("", "_hash", "_first", "_last"), ends, strict=True)], F.col("node").alias("b"))
    found = staged(components(links.join(nodes.withColumnRenamed("node", "a"), ends).join(there, ["source", "source_hash", "source_first", "source_last"])), "components")
    owned = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keepers = owned.groupBy("component").agg(F.min("doc_id").alias("keeper"))
    kept = staged(owned.join(keepers, "component").select(*ends, "keeper"), "kept")
    return kept.join(mine.distinct(), ends, "left_semi"), kept.join(whole, ends)


def repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The passages of ``docs`` (doc_id, text) that repeat one of another document.

    Returns doc_id, text_hash, start, stop (characters), first_word, n_words and sources (sorted
    doc_ids that keep what is in it) for each. Words are runs of letters and digits with A-Z in
    lower case; a character of a script without spaces is a word.

    A passage is ``passage_words`` or more words in a row that are covered, to ``percent``, by runs
    of five words of the other document, with ten other words in a row at most. It is verified
    against that document's stretch by exact edit distance over words, or Jaccard similarity of the
    runs (``percent``). Pairs are found if they share a paragraph: 16 words whose MinHashes agree
    in a band, which any 23 equal words in a row have. Of linked passages that of the smallest
    doc_id is kept, also where others link to it through third ones; passages that touch are one.

    Null and empty texts have no passages, nor have shorter texts; rows without doc_id are left
    out; rows of one doc_id don't repeat each other, nor does a text repeat itself; passages of
    five different runs or fewer, such as one word over and over, are left alone. Equal rows give
    their passages once. An empty table gives no rows.
    """
    slim = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull()))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(partitions(docs), -(-int(size) // (15 * FRAGMENT_KEYS)))
    slim = slim.withColumn("text_hash", F.xxhash64("text"))
    marked = slim.where(F.octet_length("text") >= WINDOW).select("doc_id", "text_hash")
    firsts = staged(marked.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("last_id > first_id").drop("last_id"), "firsts")
    copies = staged(marked.join(firsts, "text_hash").where("doc_id > first_id").distinct(), "copies")

    wide = candidates(slim, fragments).join(copies, ["doc_id", "text_hash"], "left_anti").distinct()
    wide = staged(wide.where(F.col("high") - F.col("low") >= passage_words), "candidates")
    # What a document repeats of itself counts where others have it too.
    own, foreign = wide.where("doc_id = source"), wide.where("doc_id != source")
    met = foreign.select(F.col("source").alias("doc_id"), F.col("there").alias("from"), F.col("there_to").alias("up_to")).distinct()
    shared = own.join(met, (own["doc_id"] == met["doc_id"]) & (F.col("there") <= F.col("up_to")) & (F.col("from") <= F.col("there_to")), "left_semi")
    wide = foreign.unionByName(staged(shared, "own"))
    wanted = wide.select("doc_id", "low", "high", F.lit(False).alias("led")).unionByName(wide.select(F.col("source").alias("doc_id"), F.col("source_low").alias("low"), F.col("source_high").alias("high"), F.lit(True).alias("led")))
    wanted = wanted.groupBy("doc_id", "low", "high").agg(F.max("led").alias("led"), F.max(~F.col("led")).alias("own"))
    wanted = staged(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high", "led", "own")).alias("wanted")), "wanted")
    words = _region_words(near_rows(slim, wanted, "doc_id").join(wanted, "doc_id"))
    if marked.groupBy("doc_id", "text_hash").count().where("count > 1").take(1):
        words = words.distinct()
    words = staged(words.withColumn("row", F.xxhash64("doc_id", "text_hash", "low", "high")), "regions")
    there = words.where("led").select(*[F.col(c).alias(n) for c, n in (("doc_id", "source"), ("text_hash", "source_hash"), ("low", "source_low"), ("high", "source_high"), ("words", "source_words"))])
    pairs = wide.join(words.where("own").drop("led", "own"), ["doc_id", "text_hash", "low", "high"]).join(there, ["source", "source_low", "source_high"])
    links = staged(_all_links(pairs.withColumn("leader", F.col("source")), words, passage_words, percent), "links")

    first_ids = firsts.select(F.col("first_id").alias("doc_id"), "text_hash")
    whole = staged(_copied(near_rows(slim, first_ids, "doc_id").join(first_ids, ["doc_id", "text_hash"], "left_semi"), passage_words).dropDuplicates(["doc_id", "text_hash"]), "whole")
    gone, again = _kept(links, whole, percent)
    spans = gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "keeper")).alias("spans"))
    spans = staged(spans, "spans")
    placed = near_rows(slim, spans, "doc_id").join(spans, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    again = copies.join(again.drop("doc_id"), "text_hash").select("doc_id", "text_hash", F.lit(0).alias("start"), "stop", F.lit(0).alias("first_word"), F.col("last").alias("n_words"), F.array("keeper").alias("sources"))
    return _placed(placed.select("doc_id", "text_hash", "text", "spans")).unionByName(again)


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop, first_word, n_words, sources of each passage of ``repeated_passages``.

    Null, empty and short texts, rows without doc_id, ties and repeated rows are taken as there.
    """
    return repeated_passages(docs.select("doc_id", "text")).drop("text_hash")


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the characters of the sorted spans (start, stop)."""
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.transform(F.arrays_zip(begins.alias("at"), ends.alias("to")), lambda r: F.substr(text, r["at"] + 1, r["to"] - r["at"])), "")


def remove_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the passages of ``repeated_passages`` cut out of the text; all rows and columns stay.

    Null and empty texts, rows without doc_id and kept passages stay as they are; equal rows are
    cut alike. A column of any name may stand beside doc_id and text. An empty table stays empty.
    """
    key, hashed, spans = fresh(docs, "span_id", "span_text", "spans")
    found = repeated_passages(docs.select("doc_id", "text"), passage_words, percent)
    cut = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(spans))
    joined = docs.join(staged(cut, "spans"), (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(hashed)), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(spans)))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
