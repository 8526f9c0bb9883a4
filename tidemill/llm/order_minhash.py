"""Document fingerprints by order MinHash, with DataFrame functions only.

A text's k-mers (runs of ``K`` words), each numbered by its occurrence in the text, are hashed;
the hashes' range is cut into ``SLOTS`` parts. In each part the ``TUPLE`` smallest are selected
and put back into text order, and the hash of that tuple is the slot's signature. Two texts share
a signature where they share the selected k-mers in the same order, which edits and moves break.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Words of a k-mer.
K = 2
#: Characters of a word on average, beyond which a text is read character by character.
LONG_WORD = 24
#: Signatures of a fingerprint; a power of two.
SLOTS = 64
#: k-mers of a signature.
TUPLE = 2
_POSITION = (1 << 31) - 1
_LEAST = -(1 << 63)
_MOST = (1 << 63) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i)


def fingerprint(text: Column, slots: int = SLOTS, k: int = K, size: int = TUPLE) -> Column:
    """The signatures of a text (array of ``slots`` ints; null where no k-mer falls).

    Words stand between white space; where they are longer than ``LONG_WORD`` characters on average,
    as in scripts without spaces, each character is one. A text of fewer than ``k`` words has one k-mer, all its
    words; an empty one has none. Everything happens inside the row: no shuffle, and memory in
    proportion to the text. k-mers are told apart by 33 bits of hash; 31 bits hold the position.
    """
    top = 64 - (slots.bit_length() - 1)

    def numbered(kmers: Column) -> Column:
        """For each k-mer 33 bits of hash of itself and its occurrence number, and its position."""
        packed = lambda h, p: F.shiftleft(F.shiftright(h, 31), 31).bitwiseOR(p.cast("long"))

        def by_runs(order: Column) -> Column:
            n = F.size(order)
            first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.shiftright(_at(order, i), 31) != F.shiftright(_at(order, i - 1), 31)))
            numbers = _let(first, lambda f: F.flatten(F.transform(f, lambda s, r: F.sequence(F.lit(0), F.coalesce(_at(f, r + 1), n) - s - 1))))
            return _let(numbers, lambda o: F.transform(order, lambda x, i: packed(F.xxhash64(F.shiftright(x, 31), _at(o, i)), x.bitwiseAND(F.lit(_POSITION)))))

        once = F.transform(kmers, lambda h, i: packed(F.xxhash64(h, F.lit(0)), i))
        order = F.sort_array(F.transform(kmers, lambda h, i: F.shiftleft(h, 31).bitwiseOR(i.cast("long"))))
        return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), once).otherwise(_let(order, by_runs))

    def signatures(chosen: Column) -> Column:
        """From all k-mers in the order of their hashes."""
        n = F.size(chosen)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.shiftright(_at(chosen, i), top) != F.shiftright(_at(chosen, i - 1), top)))

        def signed(begin: Column) -> Column:
            slot = F.shiftright(_at(chosen, begin), top)
            least = F.filter(F.slice(chosen, begin + 1, F.lit(size)), lambda x: F.shiftright(x, top) == slot)
            turned = F.sort_array(F.transform(least, lambda x: F.shiftleft(x, 33).bitwiseOR(F.shiftrightunsigned(x, 31))))
            return F.struct(slot.cast("int").alias("slot"), F.shiftright(F.xxhash64(turned_ids(turned)), 32).cast("int").alias("sig"))

        def turned_ids(turned: Column) -> Column:
            return F.transform(turned, lambda x: x.bitwiseAND(F.lit((1 << 33) - 1)))

        by_slot = lambda m: F.transform(F.sequence(F.lit(-slots // 2), F.lit(slots // 2 - 1)), lambda s: F.try_element_at(m, s))
        return _let(F.map_from_entries(F.transform(begins, signed)), by_slot)

    def of_words(hashes: Column) -> Column:
        n = F.size(hashes)
        kmers = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.shiftright(F.xxhash64(*[_at(hashes, i + j) for j in range(k)]), 31))
        full = _let(kmers, lambda h: _let(F.sort_array(numbered(h)), signatures))
        return F.when(n > 0, full).otherwise(F.array_repeat(F.lit(None).cast("int"), slots))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    characters = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")
    units = _let(words, lambda w: F.when(F.char_length(text) > LONG_WORD * F.size(w), characters).otherwise(w))
    return _let(F.transform(units, lambda w: F.xxhash64(w)), of_words)


def likeness(a: Column, b: Column) -> Column:
    """The share of the used slots whose signatures agree (0 to 1; 1 if neither uses any)."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    return _let(F.filter(pairs, lambda x: x.isNotNull()), lambda used: F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.aggregate(used, F.lit(0), lambda s, x: s + x) / F.size(used)))


def as_text(signatures: Column) -> Column:
    """Eight hexadecimal digits a slot; minus signs for a slot that isn't used."""
    return F.array_join(F.transform(signatures, lambda x: F.when(x.isNull(), F.lit("-" * 8)).otherwise(F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))), "")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by binary search."""
    steps = max(1, len(bounds).bit_length())
    padded = F.array(*[F.lit(b) for b in bounds + [_MOST] * ((1 << steps) - 1 - len(bounds))])
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(padded, low + step - 1) <= value), low + step).otherwise(low))


def with_next(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text, text_hash, signatures) with ``bucket`` and ``next``, the text and signatures of
    the next row in its bucket, and the first row of each bucket by the bucket before it.

    The next row is that in ascending doc_id (null first), then text hash; after the last comes the
    first. Rows are dealt to buckets of consecutive ids, with bounds from a one-pass sketch of all
    ids; a doc_id that fills several buckets is cut by its text hashes. The last row of a bucket
    takes the first row of the next one from a table of as many rows as there are buckets. Texts
    are shuffled once.
    """
    slim = rows.select("doc_id", "text_hash")
    known = F.coalesce("doc_id", F.lit(_LEAST))
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    found = slim.agg(F.percentile_approx(known, shares, F.lit(max(10_000, 20 * buckets)))).first()[0] if shares else []
    times = Counter(found or [])
    bounds = sorted(times)
    # Rows of the k-th bound and up to the next one have times[k] buckets, those of the bound itself by hash.
    starts, widths = [0], [1]
    for value in bounds:
        starts.append(starts[-1] + widths[-1])
        widths.append(times[value])
    lists = lambda x: F.array(*[F.lit(v) for v in x])
    place = _bucket(known, bounds)
    part = F.floor((F.col("text_hash").cast("double") / 2.0**64 + 0.5) * F.get(lists(widths), place)).cast("int")
    part = F.when(known == F.get(lists([_LEAST, *bounds]), place), F.least(part, F.get(lists(widths), place) - 1)).otherwise(F.get(lists(widths), place) - 1)
    bucket = (F.get(lists(starts), place) + F.greatest(part, F.lit(0))).alias("bucket")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    window = Window.partitionBy("bucket").orderBy(*order)
    after = rows.withColumn("bucket", bucket)
    after = after.withColumns({"next": F.lead(F.struct("text", "signatures")).over(window)})
    heads = slim.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(known.alias("known"), "text_hash", "doc_id")).alias("k"))
    every = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("bucket").over(every), last).alias("before"), F.col("k.doc_id").alias("head_id"), F.col("k.text_hash").alias("head_hash"))
    return after, heads


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has the last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document's text. A null text is read as empty; equal rows are
    neighbours of each other.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = base.withColumn("signatures", fingerprint(F.col("text")))
    after, heads = with_next(rows, 4 * partitions(docs))
    first = F.broadcast(heads).join(base, F.col("head_id").eqNullSafe(F.col("doc_id")) & (F.col("head_hash") == F.col("text_hash"))).dropDuplicates(["before"])
    first = first.select("before", F.struct("text", fingerprint(F.col("text")).alias("signatures")).alias("head"))
    joined = after.join(first, F.col("next").isNull() & (F.col("bucket") == F.col("before")), "left").select("doc_id", "text", "signatures", F.coalesce("next", "head").alias("next"))
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    edited = joined.select("doc_id", "signatures", F.col("next.signatures").alias("beside"), n.cast("long").alias("n_chars"), F.concat(F.left("text", n - cut), F.left("next.text", cut)).alias("edited"))
    edited = edited.select("doc_id", "n_chars", "signatures", "beside", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("changed"))
    return edited.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("signatures")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("changed")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("beside")).alias("near_next"),
    )
