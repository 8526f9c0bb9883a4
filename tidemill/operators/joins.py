"""Joins that Spark SQL has no form for: as-of, positional, interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh, staged


#: Cells of one grid that a span may meet, about, before a coarser one takes it.
CELLS = 64


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, str], by: list[str], width: float | None = None, strict: bool = False) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``by`` whose time is not later.

    ``on`` names the time columns of both sides; with ``strict`` the time must be earlier. Rows of
    ``left`` without a match keep nulls; null times and nulls in ``by`` match nothing. Of right rows of one time the
    greatest by its other columns counts. The right side's columns other than ``by`` are
    added; they must not clash with the left side's.

    The sides are laid on one time line, so no pair of rows is ever built. With ``width`` (in
    units of the time column; seconds for timestamps) the line of a key is cut into slices that
    are worked on apart, and each slice is handed the last right row before it: a key with a
    third of all rows is then spread over its slices.
    """
    l_time, r_time = on
    side, at, payload, kept, row, slot, last = fresh(left, "side", "at", "payload", "kept", "row", "slot", "last")
    extra = [c for c in right.columns if c not in by]
    l_rows = left.select(*by, F.col(l_time).alias(at), F.struct(*left.columns).alias(row), F.lit(None).cast(right.select(F.struct(*extra)).schema[0].dataType).alias(payload), F.lit(0 if strict else 1).alias(side))
    r_rows = right.dropna(subset=[*by, r_time]).select(*by, F.col(r_time).alias(at), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias(row), F.struct(*extra).alias(payload), F.lit(1 if strict else 0).alias(side))
    line = l_rows.unionByName(r_rows)
    order = [F.col(at).asc_nulls_first(), F.col(side), F.col(payload)]
    if width is None:
        seen = F.last(payload, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return line.withColumn(kept, seen).where(F.col(row).isNotNull()).select(f"{row}.*", *[F.col(f"{kept}.{c}").alias(c) for c in extra])
    seconds = F.col(at).cast("timestamp").cast("double") if "timestamp" in dict(line.dtypes)[at] else F.col(at).cast("double")
    line = line.withColumn(slot, F.floor(seconds / width))
    known = line.groupBy(*by, slot).agg(F.max(F.when(F.col(payload).isNotNull(), F.struct(at, payload))).alias(last))
    before = Window.partitionBy(*by).orderBy(F.col(slot).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    known = known.select(*by, slot, F.last(last, ignorenulls=True).over(before)[payload].alias(kept))
    here = Window.partitionBy(*by, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn(last, F.last(payload, ignorenulls=True).over(here)).where(F.col(row).isNotNull())
    keys = F.lit(True)
    for c in [*by, slot]:
        keys = keys & line[c].eqNullSafe(known[c])
    both = line.join(known, keys, "left").select(row, F.when(line[slot].isNotNull(), F.coalesce(last, kept)).alias(kept))
    return both.select(f"{row}.*", *[F.col(f"{kept}.{c}").alias(c) for c in extra])


def numbered(df: DataFrame, order: list[str | Column], number: str = "row_number") -> DataFrame:
    """``df`` with 1, 2, 3 ... in the order of ``order``, without bringing the rows together.

    Rows are sorted by ranges and written once; each range's numbers follow the count of rows in
    the ranges before it. A window without partitions would sort everything in one task.
    """
    part, place, count = fresh(df, "part", "place", "n_rows")
    mark = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumn(place, mark).withColumns({part: F.shiftright(place, 33), place: F.col(place).bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = ranged.groupBy(part).agg(F.count("*").alias(count))
    starts = counts.select(part, F.coalesce(F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(count))
    return ranged.join(starts, part).select(*df.columns, (F.col(place) + F.col(count) + 1).alias(number))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Row k of ``left`` beside row k of ``right``; the shorter side ends in nulls.

    Tables have no order of their own in Spark, so both orders are named. Columns must not clash.
    """
    number, = fresh(left.join(right, F.lit(False)), "row_number")
    joined = numbered(left, left_order, number).join(numbered(right, right_order, number), number, "full")
    return joined.select(*left.columns, *right.columns)


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a span with ``start`` <= ``at`` < ``stop``, by an equi-join on cells.

    The line is cut into cells of ``width``; a span is repeated for each cell that it meets. A span
    of more than ``CELLS`` cells goes to the next coarser grid, of cells ``CELLS`` times as wide, and so
    on; a point has one cell in each grid that is used. So Spark can hash and split the join,
    where a range condition alone would be a nested loop. Nulls match nothing. Pairs grow with the
    product of the sides where both become denser; ``interval_counts`` counts them without.
    """
    cell, grid = fresh(points.join(spans, F.lit(False)), "cell", "grid")

    def cell_of(c: Column) -> Column:
        return F.floor(c.cast("double") / (F.lit(float(width)) * F.pow(F.lit(float(CELLS)), F.col(grid))))

    s = spans.where(F.col(start) < F.col(stop))
    cells = F.greatest((F.col(stop).cast("double") - F.col(start).cast("double")) / width, F.lit(1.0))
    s = s.withColumn(grid, F.ceil(F.round(F.log(float(CELLS), cells), 9)).cast("int")).withColumn(grid, F.greatest(F.col(grid) - 1, F.lit(0)))
    most = s.agg(F.max(grid)).first()[0] or 0
    s = s.withColumn(cell, F.explode(F.sequence(cell_of(F.col(start)), cell_of(F.col(stop)))))
    p = points.where(F.col(at).isNotNull()).withColumn(grid, F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn(cell, cell_of(F.col(at)))
    return p.join(s, [*(by or []), grid, cell]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))).drop(cell, grid)


def interval_counts(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, number: str, by: list[str] | None = None) -> DataFrame:
    """``points`` with the number of their pairs in ``interval_join`` as ``number`` (0 without any); no pair is built.

    A point meets the spans that began up to it, less those that ended: a running sum over the places
    of one line, each once. A key of ``by`` ends all its spans, so the sum is 0 again where the next begins.
    The line is sorted by ranges and written once; each range's sums follow the total of the ranges before it.
    """
    keys, place, step, asked, part = by or [], *fresh(points.join(spans, F.lit(False)).withColumn(number, F.lit(0)), "place", "step", "asked", "part")
    s = spans.where(F.col(start) < F.col(stop)).dropna(subset=keys)
    line = s.select(*keys, F.col(start).alias(place), F.lit(1).alias(step), F.lit(0).alias(asked))
    line = line.unionByName(s.select(*keys, F.col(stop).alias(place), F.lit(-1).alias(step), F.lit(0).alias(asked)))
    line = line.unionByName(points.dropna(subset=keys).where(F.col(at).isNotNull()).select(*keys, F.col(at).alias(place), F.lit(0).alias(step), F.lit(1).alias(asked)))
    order = [*keys, place]
    line = line.groupBy(*order).agg(F.sum(step).alias(step), F.max(asked).alias(asked)).where((F.col(step) != 0) | (F.col(asked) > 0))
    line = staged(line.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "line")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = line.groupBy(part).agg(F.sum(step).alias(number)).select(part, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(number))
    here = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = line.withColumn(step, F.sum(step).over(here)).where(F.col(asked) > 0).join(starts, part)
    sums = staged(sums.select(*keys, F.col(place), (F.col(step) + F.col(number)).alias(number)).where(F.col(number) > 0), "sums")
    both = points.withColumn(place, F.col(at)).join(sums, order, "left")
    return both.select(*points.columns, F.coalesce(number, F.lit(0)).alias(number))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each of ``keys``: the first in ``order`` (the qualify and distinct-on idiom)."""
    number, = fresh(df, "row_number")
    return df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(number) == 1).drop(number)
