from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions.dialect import MisreadSql, check_sql, int_cast, isfinite, string_agg
from tidemill.operators import changes, checks, joins, schema
from tidemill.operators.incremental import Slice, capture, fold, read_slice, trim
from tidemill.sources.ranges import equal_width, predicates, split


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [None, 3.0])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_brute_force(spark, width, strict):
    left = [(k, t) for k in ("a", "b", None) for t in (0.0, 1.0, 5.0, 9.0, 20.0, None)]
    right = [(k, t, f"{k}{t}") for k in ("a", None) for t in (1.0, 4.0, 9.0, 12.0)] + [("a", None, "none"), ("a", 9.0, "zz")]
    got = rows(joins.asof_join(spark.createDataFrame(left, "k string, t double"), spark.createDataFrame(right, "k string, u double, v string"), ("t", "u"), ["k"], width, strict))
    want = []
    for k, t in left:
        found = [r for r in right if k is not None and r[0] == k and t is not None and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(found, key=lambda r: (r[1], r[2])) if found else (None, None, None)
        want.append((k, t, best[1], best[2]))
    assert got == sorted(want, key=str)


def test_positional_and_numbered(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "i long, x string").repartition(5)
    b = spark.createDataFrame([(i, f"b{i}") for i in range(60)], "j long, y string").repartition(3)
    got = joins.positional_join(a, b, ["i"], ["j"]).collect()
    assert len(got) == 60
    assert all(r.i == r.j or (r.i is None and r.j >= 50) for r in got)


def test_interval_join(spark):
    p = spark.createDataFrame([(x / 2,) for x in range(40)] + [(None,)], "at double")
    s = spark.createDataFrame([(1.0, 4.5), (3.0, 19.0), (5.0, 5.0), (None, 3.0)], "a double, b double")
    got = rows(joins.interval_join(p, s, "at", "a", "b", 2.0))
    assert got == sorted(((x / 2, a, b) for x in range(40) for a, b in ((1.0, 4.5), (3.0, 19.0)) if a <= x / 2 < b), key=str)


def test_collapse_and_apply(spark):
    ch = spark.createDataFrame([(1, "a", "001", "insert"), (1, "b", "003", "update"), (2, "c", "002", "insert"), (2, None, "004", "delete"), (3, "d", "005", "delete"), (3, "e", "006", "insert")], "k int, v string, lsn string, op string")
    up, gone = changes.collapse(ch, ["k"], "lsn", "op")
    assert rows(up) == [(1, "b"), (3, "e")] and rows(gone) == [(2,)]
    target = spark.createDataFrame([(2, "old"), (9, "stay")], "k int, v string")
    assert rows(changes.apply_changes(target, up, gone, ["k"], "hard")) == [(1, "b"), (3, "e"), (9, "stay")]
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    soft = changes.apply_changes(target, up, gone, ["k"], "soft", at=at)
    assert rows(soft) == [(1, "b", None), (2, "old", datetime(2024, 1, 1)), (3, "e", None), (9, "stay", None)]
    again = changes.apply_changes(soft, spark.createDataFrame([(2, "new")], "k int, v string"), gone.limit(0), ["k"], "soft", at=at)
    assert (2, "new", None) in rows(again)
    with pytest.raises(ValueError):
        changes.apply_changes(target, up, gone, ["k"], "maybe")


def test_merge_by_name_and_guard(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([("x", 2, 5), ("y", 2, 7), ("z", 3, 1)], "v string, k int, n int")
    assert rows(changes.merge(old, new.drop("n"), ["k"])) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(changes.merge(old, new, ["k"], ["n"])) == [(1, "a", None), (2, "y", 7), (3, "z", 1)]
    guard = changes.merge_guard(spark.createDataFrame([(None,), (None,), (1,), (1,), (1,), (2,)], "k int"), ["k"]).first()
    assert tuple(guard) == (2, 1, 2)
    assert tuple(changes.merge_guard(old.limit(0), ["k"]).first()) == (0, 0, 0)


def test_slices(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "c int")
    part = Slice(1, 9, high_inclusive=False)
    assert rows(read_slice(df, "c", part)) == [(5,)] and rows(trim(df, "c", part)) == [(5,), (None,)]
    assert rows(read_slice(df, "c", Slice())) == rows(df)
    assert tuple(capture(df, "c", Slice(1, 9)).first()) == (9, 2, False)
    assert tuple(capture(df, "c", Slice(20, 30)).first()) == (30, 0, False)
    assert tuple(capture(df, "c", Slice(20, 30, high_inclusive=False)).first()) == (None, 0, True)


def test_fold():
    assert fold([(3, False), (1, False), (1, True)], floor=True) == (1, True)
    assert fold([(3, True), (1, False), (1, True)], floor=False) == (1, False)
    assert fold([(3, True), (None, False)], floor=True) is None
    assert fold([(3, True), (None, False)], floor=False) == (3, True)


def test_ranges(spark):
    assert equal_width(5, 5, 4) == [(5, 5, True)] and equal_width(None, None, 4) == [(None, None, True)]
    assert [p for p in equal_width(0, 10, 3)] == [(0, 3, False), (3, 6, False), (6, 10, True)]
    df = spark.createDataFrame([(x,) for x in [*range(11), None]], "c int")
    assert sum(p.count() for p in split(df, "c", 0, 10, 3)) == 12
    assert "is null" in predicates("c", 0, 10, 3)[0] and predicates("c", None, None, 3) == ["1 = 1"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (None, "z")], "k int, v string")
    count = lambda d: d.first().violations
    assert count(checks.not_null(df, ["k", "v"])) == 3
    assert count(checks.unique(df, ["k"])) == 2
    assert count(checks.row_count(df, 5)) == 1 and count(checks.row_count(df, 1, 4)) == 0
    assert count(checks.accepted_values(df, "v", ["a", "b"])) == 1
    assert count(checks.custom_sql(df.where("v = 'z'"))) == 1
    assert all(count(c) == 0 for c in (checks.not_null(df.limit(0), ["k"]), checks.unique(df.limit(0), ["k"]), checks.accepted_values(df.limit(0), "v", [])))
    times = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert count(checks.freshness(times, "t", timedelta(days=1), datetime(2024, 1, 3))) == 1
    assert count(checks.freshness(times, "t", timedelta(days=9), datetime(2024, 1, 3))) == 0
    assert count(checks.freshness(times.limit(0), "t", timedelta(days=9), datetime(2024, 1, 3))) == 1


def test_schema(spark):
    df = spark.createDataFrame([(2.0**60, 1.5, "ab"), (3.0, None, None)], "big double, x double, t string")
    assert rows(schema.integer_lint(df)) == [("big", 2.0**60)]
    assert rows(schema.text_lengths(df)) == [("t", 2)]
    assert schema.drift_gate(df, None, "fail") is None
    with pytest.raises(schema.SchemaDrift):
        schema.drift_gate(df, {"big": "double"}, "fail")
    assert schema.drift_gate(df, {"BIG": "double", "x": "int"}, "warn").retyped == {"x": ("int", "double")}
    assert schema.check_policy({"a": "int"}, {"a": "int", "b": "int"}, "additive") == ["b"]
    a, b = (schema.fingerprint(d).first() for d in (df, df.repartition(3).orderBy("x")))
    assert a == b != schema.fingerprint(df.limit(1)).first()
    assert schema.preview(df, 1, ["t"]).first().t == "•••"


def test_dialect(spark):
    df = spark.createDataFrame([("12.5", 1.0), ("x", float("inf")), (None, float("nan"))], "s string, d double")
    assert [tuple(r) for r in df.select(int_cast(F.col("s")), isfinite(F.col("d"))).collect()] == [(13, True), (None, False), (None, False)]
    assert df.agg(string_agg(F.col("s"), "|")).first()[0] == "12.5|x"
    assert df.limit(0).agg(string_agg(F.col("s"), "|")).first()[0] is None
    for sql in ("select * from a asof join b", "select * from a positional join b", "select 1 qualify 1", "select * exclude (a) from t"):
        with pytest.raises(MisreadSql):
            check_sql(sql)
    assert check_sql("select 'qualify', `asof join` from t -- union by name")


def test_interval_join_of_long_spans_has_few_cells(spark):
    p = spark.createDataFrame([(k, float(k * 997 % 100_000)) for k in range(300)] + [(999, None)], "i long, at double")
    s = spark.createDataFrame([(1, 0.0, 100_000.0), (2, 5.0, 6.0), (3, -1e6, 64_000.0), (4, 9.0, 9.0), (5, 99_000.0, 99_064.0), (6, None, 3.0)], "j long, a double, b double")
    got = {(r.i, r.j) for r in joins.interval_join(p, s, "at", "a", "b", 1.0).collect()}
    points, spans = p.collect(), s.collect()
    assert got == {(x.i, y.j) for x in points for y in spans if x.at is not None and y.a is not None and y.a <= x.at < y.b}


@pytest.mark.parametrize("by", [None, ["k"]])
def test_interval_counts_are_those_of_the_pairs(spark, by):
    p = spark.createDataFrame([("ab"[k % 2], k, float(k * 37 % 50 - 5)) for k in range(120)] + [("a", 200, None), (None, 201, 3.0), ("c", 202, 3.0), ("a", 203, 7.0), ("a", 204, -0.0), ("b", 205, float("nan"))], "k string, i long, at double")
    s = spark.createDataFrame([("ab"[k % 2], float(k * 7 % 40), float(k * 7 % 40 + k % 9)) for k in range(80)] + [("a", None, 3.0), (None, 0.0, 9.0), ("b", 2.0, None), ("a", 0.0, 1.0), ("d", 1.0, 90.0), ("a", 9.0, 1.0)], "k string, a double, b double")
    got = joins.interval_counts(p, s, "at", "a", "b", "n", by)
    points, spans = p.collect(), s.collect()
    known = lambda *x: all(v is not None for v in x)
    want = [(x.k, x.i, x.at, sum(known(x.at, y.a, y.b) and y.a <= x.at < y.b and (by is None or (known(x.k) and x.k == y.k)) for y in spans)) for x in points]
    assert got.columns == ["k", "i", "at", "n"] and [*map(str, rows(got))] == sorted(str(x) for x in want)


def test_interval_counts_build_no_pair(spark, sf_dir, monkeypatch):
    from tidemill.plans.queries import QUERIES

    monkeypatch.setattr(joins, "interval_join", None)
    p, s = (spark.range(20_000).selectExpr(*x) for x in (["id as i", "5.0d as at"], ["id as j", "0.0d as a", "9.0d as b"]))
    assert rows(joins.interval_counts(p, s, "at", "a", "b", "n").groupBy("n").count()) == [(20_000, 20_000)]
    assert QUERIES["join_interval"](spark, sf_dir).columns == ["p_partkey", "n"]


def test_integers_beyond_a_long_are_integers(spark):
    df = spark.createDataFrame([(9.5e18, -1e20, 2.0**127, 1.5), (3.0, None, 1.0, 1e20)], "a double, b double, c double, d double")
    assert rows(schema.integer_lint(df)) == [("a", 9.5e18), ("b", 1e20)]


def test_fingerprint_tells_where_nulls_are(spark):
    a, b = (schema.fingerprint(spark.createDataFrame([r], "x long, y long")).first() for r in ((None, 1), (1, None)))
    assert a.n_rows == b.n_rows and a.hash_sum != b.hash_sum


def test_drain_in_order_numbers_by_ranges(spark):
    df = spark.range(1000).selectExpr("nullif(id * 7919 % 1000, 5) as x").repartition(5)
    drained = schema.in_order(df, 990)
    assert [r.x for r in drained.collect()] == [*range(991, 1000), None]
    assert "CollectLimit" not in drained._jdf.queryExecution().toString()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemill import storage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_small_files_are_written_by_paths_of_spark(spark, tmp_path):
    from tidemill import storage

    path = f"file://{tmp_path}/a/b.json"
    storage.write_text(spark, path, "x\u00e9")
    assert storage.read_text(spark, path) == "x\u00e9" == (tmp_path / "a" / "b.json").read_text()


def test_ranges_have_literals_that_sql_takes(spark):
    from datetime import date, datetime
    from decimal import Decimal

    from tidemill.sources import ranges

    for kind, low, high in (("decimal(9,2)", Decimal("1.50"), Decimal("9.00")), ("date", date(2024, 1, 1), date(2024, 3, 1)), ("timestamp_ntz", datetime(2024, 1, 1, 5), datetime(2024, 1, 2))):
        df = spark.createDataFrame([(low,), (high,), (None,)], f"c {kind}")
        parts = ranges.split(df, "c", low, high, 4)
        assert [p.count() for p in parts] == [2, 0, 0, 1]
    assert len(ranges.equal_width(0, 100, 40, most=64)) == 40
