"""Sharding into parts of nearly equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged, utf8_bytes

#: Groups above this share of all bytes are differenced first, by the driver; there are as many at most.
HEAVY = 16_384
#: Other groups that are differenced together, about.
CELL_ITEMS = 8_192
#: Rows of a shard that one task numbers.
NUMBERED_ROWS = 10_000


def differenced(items: list[list[int]], parts: int) -> list[list[int]]:
    """For each item (a list of ``parts`` sums or fewer) the part that each of its sums goes to.

    Each item begins as a partial partition of its own. Again and again the two with the largest
    spread are combined, the largest part of one with the smallest of the other. Parts are kept
    as trees of pairs, so combining costs ``parts`` steps whatever they hold.
    """
    heap = []
    for i, sums in enumerate(items):
        both = sorted(((x, k) for k, x in enumerate(sums)), key=lambda p: (-p[0], p[1]))
        least = both[-1][0] if len(both) == parts else 0
        free = parts - len(both)
        heap.append((least - both[0][0], i, [x - least for x, _ in both] + [0] * free, [[i, k] for _, k in both] + [None] * free))
    heapq.heapify(heap)
    made = len(items)
    while len(heap) > 1:
        _, _, sums_a, held_a = heapq.heappop(heap)
        _, _, sums_b, held_b = heapq.heappop(heap)
        both = sorted(((sums_a[k] + sums_b[-1 - k], k) for k in range(parts)), reverse=True)
        held = []
        for _, k in both:
            a, b = held_a[k], held_b[-1 - k]
            held.append(a if b is None else b if a is None else (a, b))
        least = both[-1][0]
        sums = [x - least for x, _ in both]
        heapq.heappush(heap, (-sums[0], made, sums, held))
        made += 1
    out = [[0] * len(sums) for sums in items]
    for part, tree in enumerate(heap[0][3] if heap else []):
        stack = [] if tree is None else [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                out[node[0]][node[1]] = part
    return out


def karmarkar_karp(sizes: list[int], parts: int) -> list[int]:
    """The part (0 to ``parts`` - 1) of each size, by largest differencing."""
    return [p for p, in differenced([[s] for s in sizes], parts)]


def placed_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """item, shard of the groups (item, size), by differencing alone.

    The groups above 1/``HEAVY`` of all bytes are differenced first: they make one partial partition.
    The others are dealt to cells of about ``CELL_ITEMS`` by hash, and each cell is differenced in a
    task together with its share of that partial partition, scaled to the cell's bytes. So each cell
    levels its part of what the heavy groups leave unequal, and the shards are level together.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy = sorted(tuple(r) for r in groups.where(F.col("size") * HEAVY > F.lit(total)).select("item", "size").collect())
    shards = karmarkar_karp([size for _, size in heavy], n_shards)
    sums = [0] * n_shards
    for (_, size), shard in zip(heavy, shards, strict=True):
        sums[shard] += size
    placed = spark.createDataFrame([(item, shard) for (item, _), shard in zip(heavy, shards, strict=True)], "item long, shard int")
    light = groups.where(F.col("size") * HEAVY <= F.lit(total))
    n_light, rest = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    level = max(sums) == min(sums)

    def place(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell")[0].as_py()
        order = sorted(zip(rows.column("size").to_pylist(), rows.column("item").to_pylist(), strict=True), reverse=True)
        share = sum(size for size, _ in order)
        first, *others = differenced([[x * share // rest for x in sums]] + [[size] for size, _ in order], n_shards)
        # The heavy groups' shards give the parts their numbers; where these are level, cells begin in turn.
        number = {part: (k + cell * level) % n_shards for k, part in enumerate(first)}
        return pa.table({"item": pa.array([item for _, item in order], pa.int64()), "shard": pa.array([number[part] for part, in others], pa.int32())})

    cell = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_light // CELL_ITEMS)))).alias("cell")
    return placed.unionByName(light.select("item", "size", cell).groupBy("cell").applyInArrow(place, "item long, shard int"))


def _keyed(docs: DataFrame, text: str, item: str, other: str, size: str) -> DataFrame:
    known = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({item: F.xxhash64(known), other: F.xxhash64(F.lit(1), known), size: utf8_bytes(F.col(text).cast("string")) + 1})


def _sharded(keyed: DataFrame, item: str, other: str, size: str, n_shards: int, shard: str) -> DataFrame:
    groups = keyed.groupBy(item, other).agg(F.sum(size).alias("size"))
    groups = staged(groups.select(F.xxhash64(item, other).alias("item"), F.col(item).alias("a"), F.col(other).alias("b"), "size"), "groups")
    # Groups whose numbers agree by chance are one item, so that none is placed twice.
    placed = staged(placed_groups(groups.groupBy("item").agg(F.sum("size").alias("size")), n_shards), "placed")
    shards = groups.join(placed, "item").select(F.col("a").alias(item), F.col("b").alias(other), F.col("shard").alias(shard))
    return keyed.join(staged(shards, "shards"), [item, other])


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, text: str = "text", shard: str = "shard") -> DataFrame:
    """``docs`` with the column ``shard`` (int), so that the shards hold nearly equal bytes.

    A row weighs the UTF-8 bytes of its text plus 1 (null: 1). Rows of equal text (null counts
    as empty) are one group and stay together; a group above a shard's fair share makes its shard
    larger. A column ``shard`` that is there is replaced; rows and other columns stay. An empty
    table stays empty. Ties between groups fall by their hashes, so equal input gives equal shards.

    Groups are summed before any shuffle, and all placed by ``placed_groups``.
    """
    docs = docs.select(*[c for c in docs.columns if c != shard])
    item, other, size = fresh(docs.withColumn(shard, F.lit(0)), "group_a", "group_b", "group_bytes")
    return _sharded(_keyed(docs, text, item, other, size), item, other, size, n_shards, shard).select(*docs.columns, shard)


def numbered(rows: DataFrame, shard: str, *order: str, slot: str = "slot", n_shards: int = 8) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within each shard, without gaps.

    Each shard is cut by hash of its rows into buckets that single tasks number; a bucket's
    numbers follow those of the buckets before it. Equal rows get numbers of their own.
    """
    bucket, begin, place, count = fresh(rows, "bucket", "begin", "place", "n_rows")
    n_buckets = max(1, -(-rows.count() // (n_shards * NUMBERED_ROWS)))
    placed = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    ordered = Window.partitionBy(shard, bucket).orderBy(*order)
    placed = placed.withColumn(place, F.row_number().over(ordered) - 1)
    counts = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets))).groupBy(shard, bucket).agg(F.count("*").alias(count))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(begin))
    return placed.join(starts, [shard, bucket]).select(*rows.columns, (F.col(begin) + F.col(place)).cast("long").alias(slot))


def shard_report(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document.

    Null texts weigh 1 byte and count as empty; equal texts share a shard; repeated rows and rows
    without doc_id have slots of their own. An empty table gives no rows. Texts aren't shuffled.
    """
    slim = _keyed(docs.select("doc_id", "text"), "text", "a", "b", "size").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))).drop("text")
    sharded = _sharded(slim, "a", "b", "size", n_shards, "shard").select("doc_id", "size", "text_crc32", "shard")
    rows = numbered(staged(sharded, "sharded"), "shard", "doc_id", "size", "text_crc32", n_shards=n_shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write ``docs`` as Parquet under ``path``/shard=0 ... by ``shard_by_bytes``.

    Nulls, empty texts, ties and repeated rows are taken as there; an empty table writes no shard.
    """
    shard_by_bytes(docs, n_shards).write.partitionBy("shard").parquet(path)
