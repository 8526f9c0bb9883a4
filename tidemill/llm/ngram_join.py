"""N-gram Jaccard join: links between documents of nearly equal shingle sets, exactly.

Shingles stand in one global order that is cut into fragments (vertical partitioning). Fragments
are first counted on their own to find the shingles that any other document has: a document that
shares too few of them can link with nothing. For the rest the rarest shingles of each set give
candidate pairs, whose overlaps are counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, column, fresh, held, partitions, rows_beside, rows_of, settled, slices, staged
from .components import components
from .vertical import SENT, answer_batches, fragment_rows

#: Words of a shingle, and the least Jaccard similarity of a link in percent.
WORDS = 3
PERCENT = 90
#: Shingles that a fragment holds, about, at most, and a batch of documents when they are counted.
FRAGMENT_TOKENS = 2_000_000
BATCH_TOKENS = 500_000
BATCH_DOCS = 16_384
#: Fragments in which the overlaps of candidate pairs are counted.
PAIR_FRAGMENTS = 8

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = held("words", lambda: Recent(xxhash.xxh3_64_intdigest, 200_000))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    return hashes_of(text.encode("utf-8", "surrogatepass").lower().split() if text else [])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words in turn; of fewer words, for all together."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        part = words[k : len(words) - size + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * _MIX[k % 6] + part * _MIX[(k + 3) % 6]
    out ^= out >> np.uint64(32)
    out *= _MIX[3]
    return out ^ (out >> np.uint64(29))


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes (64 bits) of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text), n))


def _count_shared(docs: DataFrame, n: int, fragments: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, unshared of each row of ``docs``.

    ``unshared`` counts the shingles that no other row has (or a few less, by chance).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list = []
        number = total = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held], np.int64)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in held]
            meta = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes), "digest": pa.array(digests, pa.binary(16))})
            return fragment_rows(number, meta, np.concatenate(held), np.repeat(np.arange(len(held)), sizes), fragments, "<u2")

        for batch in slices(batches):
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                found = shingle_set(text, n)
                if ids and (total + len(found) > BATCH_TOKENS or len(ids) == BATCH_DOCS):
                    yield flush()
                    held, ids, total, number = [], [], 0, number + 1
                held.append(found)
                ids.append(doc_id)
                total += len(found)
        if ids:
            yield flush()

    def finish(meta: pa.Table, owners: np.ndarray) -> pa.Table:
        digests = np.frombuffer(b"".join(meta.column("digest").to_pylist()), "<i8").reshape(-1, 2)
        return pa.table({
            "doc_id": meta.column("doc_id"), "n_shingles": meta.column("n"),
            "set_a": pa.array(digests[:, 0].copy()), "set_b": pa.array(digests[:, 1].copy()),
            "unshared": pa.array(np.bincount(owners, minlength=len(meta)).astype(np.int64)),
        })

    return answer_batches(docs.mapInArrow(send, SENT), "<u2", finish, "doc_id long, n_shingles long, set_a long, set_b long, unshared long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [shingle_set(t, n) for t in column(batch, "text").to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
            ], names=["doc", "set_a", "set_b", "tokens"])

    return docs.mapInArrow(make, "doc long, set_a long, set_b long, tokens array<long>")


def _near_enough(percent: int, n: str, p: str, m: str, q: str):
    """Whether sets of n and m shingles may still link if p and q of them come before the first
    common one in the global order: neither those nor a size too different can be made up for."""
    n, p, m, q = map(F.col, (n, p, m, q))
    fits = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return fits & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common: the size of the intersection of the sets of each pair (a, b) of ``pairs``.

    The order of the shingles is cut into ``PAIR_FRAGMENTS``; each fragment of a pair is counted
    on its own, and the counts are summed per pair.
    """
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PAIR_FRAGMENTS - 1)), lambda f: F.filter("tokens", lambda h: F.pmod(F.shiftright(h, 40), F.lit(PAIR_FRAGMENTS)) == f)))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    fragments = staged(sets.join(wanted, "doc", "left_semi").select("doc", cut.alias("fragment", "part")), "fragments")
    left = fragments.select(F.col("doc").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = fragments.select(F.col("doc").alias("b"), F.col("fragment"), F.col("part").alias("part_b"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
    return counted.groupBy("a", "b").agg(F.sum("common").alias("common"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sizes = sets.select("doc", "n")
    found = overlaps(pairs.select("a", "b"), sets)
    joined = found.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("n_b")), "b")
    return joined.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def link_components(sets: DataFrame, percent: int) -> DataFrame:
    """node, component of the sets (doc, n, tokens; all different) that have a link.

    Candidates share one of each other's rarest shingles, few enough to miss none. First each
    such shingle's sets are held against one of them, that with the fewest rarer shingles; then
    against every one that isn't in the same component yet and not too far in size or order,
    which is first seen from the few distinct sizes and places that a shingle has.
    So a large group of near copies costs as many pairs as it has members, and no link between
    components is lost.
    """
    tokens = sets.select("doc", "n", F.explode("tokens").alias("h"))
    shared = staged(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    known = tokens.join(shared, "h").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    known = known.withColumn("lone", F.col("n") - F.size("order"))
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("lone")
    first = known.where(prefix > 0).select("doc", "n", "lone", F.posexplode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("at", "token"))
    postings = staged(first.select(F.col("token.h").alias("h"), "doc", "n", (F.col("lone") + F.col("at")).alias("p")), "postings")

    heads = postings.groupBy("h").agg(F.min(F.struct("p", "n", "doc")).alias("head"), F.count("*").alias("k")).where("k > 1")
    heads = staged(heads.select("h", F.col("head.doc").alias("a"), F.col("head.n").alias("m"), F.col("head.p").alias("q")), "heads")
    stars = postings.join(heads, "h").where((F.col("doc") != F.col("a")) & _near_enough(percent, "n", "p", "m", "q"))
    stars = staged(stars.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct(), "stars")
    links = staged(_links(stars, sets, percent), "star-links")
    reached = staged(components(links), "reached")

    placed = postings.join(reached.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = staged(placed, "placed")
    several = placed.groupBy("h", "component").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    several = staged(several.select("h", F.col("main.component").alias("main")), "several")
    open_ = staged(placed.join(several, "h"), "open")
    # Sets of one size and place are one profile; those whose profile fits none can't link by this shingle.
    profiles = staged(open_.select("h", "n", "p").distinct(), "profiles")
    others = profiles.select("h", F.col("n").alias("m"), F.col("p").alias("q"))
    fitting = profiles.join(others, "h").where(_near_enough(percent, "n", "p", "m", "q")).select("h", "n", "p").distinct()
    open_ = staged(open_.join(fitting, ["h", "n", "p"], "left_semi"), "fitting")
    left = open_.where(F.col("component") != F.col("main")).select("h", "doc", "n", "p", "component")
    right = open_.select("h", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("component").alias("other"))
    rest = left.join(right, "h").where((F.col("component") != F.col("other")) & _near_enough(percent, "n", "p", "m", "q"))
    rest = staged(rest.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct(), "rest")
    more = _links(rest.join(stars, ["a", "b"], "left_anti"), sets, percent)
    return components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def similar_documents(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    A row's set holds its distinct runs of ``n`` words (fewer words: all as one; none: the empty
    set, also for null). Rows link when 100 * intersection >= ``percent`` * union, never by empty
    sets; component_id is the smallest doc_id that links reach, the row's own included. Rows of
    null doc_id link with nothing and get a null component_id. Rows of equal doc_id stand for
    themselves. Every row returns once; an empty table returns none.

    Shingles are compared by 64 bits of hash, whole sets of equal rows by 128 bits: rows of equal
    sets are one class, which takes part as one.
    """
    slim = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(2 * partitions(docs), -(-int(size) // (6 * FRAGMENT_TOKENS)))
    rows = staged(_count_shared(slim, n, fragments), "rows")
    there = rows.where(F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull())
    classes = there.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"), F.max("n_shingles").alias("n"), F.max("unshared").alias("unshared"))
    classes = staged(classes.withColumn("doc", F.xxhash64("set_a", "set_b")), "classes")
    able = classes.where(100 * (F.col("n") - F.col("unshared")) >= percent * F.col("n")).select("doc", "least", "set_a", "set_b", "n")
    able = staged(able, "able")
    chosen = rows_of(slim, able.select(F.col("least").alias("doc_id")), "doc_id")
    sets = staged(_sets(chosen, n).drop("doc").join(able, ["set_a", "set_b"]).dropDuplicates(["doc"]).select("doc", "n", "tokens"), "sets")
    found = staged(link_components(sets, percent), "components")
    heads = found.join(classes.select(F.col("doc").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("head"))
    reached = staged(found.join(heads, "component").select(F.col("node").alias("doc"), "head"), "heads")
    copies = classes.join(reached, "doc", "left").select("set_a", "set_b", F.coalesce("head", "least").alias("component"), "k", "least")
    copies = staged(copies.where((F.col("k") > 1) | (F.col("component") != F.col("least"))), "copies")
    joined = rows.join(copies.select("set_a", "set_b", "component"), ["set_a", "set_b"], "left")
    linked = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", linked.alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that link to one of a smaller doc_id, directly or by others.

    Of each group the document of the smallest doc_id stays, with all columns; documents without
    words or doc_id stay. Rows of one doc_id stay or go together.
    """
    found = similar_documents(docs.select("doc_id", "text"), n, percent)
    key, = fresh(docs, "key")
    gone = staged(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)), "gone")
    return rows_beside(docs.withColumn(key, F.col("doc_id").cast("long")), gone, key).select(*docs.columns)
