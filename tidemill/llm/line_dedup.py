"""Line dedup by overlapping three-line windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: Lines of a window (a fixed value of the method).
WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def repeated_windows(docs: DataFrame, doc_id: str, text_hash: str, text: str) -> DataFrame:
    """One row per document with a later occurrence of a window: its sorted starts.

    A window is known by two 64-bit hashes. Windows of one hash are counted with a partial
    aggregate before the shuffle; only those that occur again are joined back, in a join whose
    large partitions Spark can split.
    """
    hashed = docs.select(
        doc_id, text_hash,
        F.transform(_lines(text), lambda x: F.xxhash64(x)).alias("a"),
        F.transform(_lines(text), lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
    ).where(F.size("a") >= WINDOW)
    three = lambda c, i: [F.element_at(c, i + k) for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(1), F.size("a") - (WINDOW - 1)), lambda i: F.struct(F.xxhash64(*three("a", i)).alias("a"), F.xxhash64(*three("b", i)).alias("b")))
    windows = hashed.select(doc_id, text_hash, F.posexplode(hashes).alias("pos", "h")).select(doc_id, text_hash, "pos", "h.a", "h.b")
    place = F.struct(doc_id, text_hash, "pos")
    again = staged(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first"), "again")
    later = windows.join(again, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy(doc_id, text_hash).agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines, n_removed (long).

    Lines are what stands between line feeds. Of each three consecutive lines that occur more
    than once in the table, the first occurrence in the order of doc_id (null first), text hash
    and position counts as the original; the lines of all later ones are removed, overlapping
    ones together. What is left is joined by line feeds; it may be empty. Texts of fewer than
    three lines, empty texts and null (no lines) stay as they are. Rows of equal doc_id and text
    are one document: they get the same result. Columns named n_lines and n_removed are replaced;
    other columns and all rows stay. An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in (n_lines, n_removed)]
    docs = docs.select(*names)
    key, hashed, starts = fresh(docs.withColumns({n_lines: F.lit(0), n_removed: F.lit(0)}), "row_id", "row_text", "starts")
    keyed = docs.withColumns({key: F.col(doc_id), hashed: F.xxhash64(text)})
    found = repeated_windows(keyed.select(key, hashed, F.col(text).alias("text")), key, hashed, "text").select(F.col(key).alias(key + "_"), F.col(hashed).alias(hashed + "_"), F.col("starts").alias(starts))
    joined = keyed.join(found, F.col(key).eqNullSafe(F.col(key + "_")) & (F.col(hashed) == F.col(hashed + "_")), "left")
    lines, runs, = fresh(joined, "all_lines", "runs")
    n = F.size(lines)
    begins = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + WINDOW))
    ends = F.concat(F.col(starts), F.array(n))
    joined = joined.withColumn(lines, F.when(F.col(text).isNotNull(), _lines(text)))
    joined = joined.withColumn(runs, F.when(F.col(starts).isNotNull(), F.filter(F.arrays_zip(begins.alias("at"), ends.alias("to")), lambda r: r["to"] > r["at"])))
    kept = F.get(F.transform(F.array(F.col(lines)), lambda all_: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(all_, r["at"] + 1, r["to"] - r["at"]))), "\n")), F.lit(0))
    left = F.aggregate(runs, F.lit(0), lambda total, r: total + r["to"] - r["at"])
    out = {
        text: F.when(F.col(runs).isNull(), F.col(text)).otherwise(kept),
        n_lines: F.when(F.col(text).isNull(), 0).otherwise(n).cast("long"),
        n_removed: F.when(F.col(runs).isNull(), 0).otherwise(n - left).cast("long"),
    }
    return joined.select(*[out[c].alias(c) if c == text else F.col(c) for c in names], *[out[c].alias(c) for c in (n_lines, n_removed)])


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of what is left) of each document."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: The same in DuckDB SQL, for tables without repeated rows.
LINE_SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents
), windows as (
  select doc_id, pos, line as a,
    lead(line, 1) over (partition by doc_id order by pos) as b,
    lead(line, 2) over (partition by doc_id order by pos) as c
  from lines
), later as (
  select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as k from windows where c is not null
), covered as (
  select distinct doc_id, pos + d as pos from later, (values (0), (1), (2)) as t(d) where k > 1
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text, count(*) as n
  from lines l anti join covered c on l.doc_id = c.doc_id and l.pos = c.pos group by l.doc_id
), counted as (select doc_id, count(*) as n from lines group by doc_id)
select d.doc_id, coalesce(counted.n, 0)::bigint as n_lines,
  (coalesce(counted.n, 0) - coalesce(kept.n, 0))::bigint as n_removed,
  case when d.text is not null then sha256(coalesce(kept.text, '')) end as text_sha256
from documents d left join counted on d.doc_id = counted.doc_id left join kept on d.doc_id = kept.doc_id
"""
