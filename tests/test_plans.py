import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from tidemill.plans import cursors
from tidemill.plans.graph import flows, ordered, select
from tidemill.plans.project import ProjectError, from_dict, load, render, validate
from tidemill.plans.runner import Run, Transient, until_caught_up, with_retry
from tidemill.plans.state import State


def test_cursor_arithmetic():
    assert cursors.add(5, "10", "bigint") == 15
    assert cursors.add(datetime(2024, 1, 1), "90m", "timestamp") == datetime(2024, 1, 1, 1, 30)
    assert cursors.add(date(2024, 1, 1), "1w", "date") == date(2024, 1, 8)
    assert cursors.canonical(cursors.parse("1.50", "decimal"), "decimal") == "1.50"
    assert cursors.parse("2024-01-01T00:00:00Z", "timestamp") == datetime(2024, 1, 1)
    assert cursors.canonical(datetime(2024, 1, 1), "timestamp") == "2024-01-01T00:00:00.000000"
    for value, kind in (("2024-01-01T00:00:00+02:00", "timestamp"), ("x", "int"), ("1", "varchar")):
        with pytest.raises(cursors.CursorError):
            cursors.parse(value, kind)
    for step, kind in (("1h", "date"), ("5d", "int"), ("x", "int"), ("5", "timestamp")):
        with pytest.raises(cursors.CursorError):
            cursors.add(date(2024, 1, 1) if kind == "date" else 1, step, kind)
    assert cursors.same_kind("int", "bigint") and not cursors.same_kind("int", "date")


def test_windows():
    w = cursors.bounded(0, "2", 6, "bigint")
    assert (w.high, w.inclusive, w.empty) == (2, True, False)
    w = cursors.bounded(5, "2", 6, "bigint")
    assert (w.high, w.empty) == (6, False)
    assert cursors.bounded(6, "2", 6, "bigint").empty
    now = cursors.bounded(Decimal(5), "2", Decimal(6), "decimal", until_is_now=True)
    assert now.high == 6 and not now.inclusive


def project(path, out, **source):
    return {
        "name": "p", "vars": {"least": 0},
        "sources": [{"connection": "c", "entity": "events", "path": path, **source}],
        "pipelines": [
            {"name": "a", "sql": "select * from {{ source('c', 'events') }} where v >= {{ var('least') }}", "tags": ["x"]},
            {"name": "b", "sql": "select id, v from {{ ref('a') }}", "outputs": [{"name": "o", "path": out, "mode": "merge", "keys": ["id"]}], "checks": [{"type": "not_null", "columns": ["id"]}]},
        ],
    }


def test_windowed_backfill_over_a_gap(spark, tmp_path):
    ids = [*range(1, 21), *range(31, 51)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, float(i)) for i in ids], "id long, v double").write.parquet(path)
    made = from_dict(project(path, out, mode="incremental", cursor="id", cursor_type="bigint", initial="0", max_window="10", until="50"))
    store = str(tmp_path / "state.json")
    seen = []

    def make():
        run = Run(spark, made, State(store))
        seen.append(run.mark(made.sources[0]))
        return run

    passes = until_caught_up(make)
    assert seen[:6] == [None, "10", "20", "30", "40", "50"] and passes == 6
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ids


def test_a_backlog_beyond_the_passes_is_told(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, float(i)) for i in range(1, 51)], "id long, v double").write.parquet(path)
    made = from_dict(project(path, out, mode="incremental", cursor="id", cursor_type="bigint", initial="0", max_window="10", until="50"))
    make = lambda: Run(spark, made, State(str(tmp_path / "state.json")))
    with pytest.raises(RuntimeError, match="not caught up after 2 runs"):
        until_caught_up(make, passes=2)
    until_caught_up(make)
    assert spark.read.parquet(out).count() == 50


def test_watermark_is_held_when_an_output_fails(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0), (None, 2.0)], "id long, v double").write.parquet(path)
    d = project(path, str(tmp_path / "out"), mode="incremental", cursor="v", cursor_type="bigint", initial="0")
    d["pipelines"][1]["checks"] = []
    run = Run(spark, from_dict(d), State(str(tmp_path / "s.json")), events=str(tmp_path / "e.ndjson"))
    results = run.execute()
    assert results["b"].status == "failed" and "no key" in results["b"].message
    assert run.mark(run.project.sources[0]) is None
    assert "watermark_held" in [json.loads(x)["event"] for x in (tmp_path / "e.ndjson").read_text().splitlines()]


def test_lookback_and_changes(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "a", "01", "insert", "t"), (2, "b", "02", "insert", "t"), (1, "c", "03", "update", "t")]
    spark.createDataFrame(rows, "id long, v string, _lsn string, _op string, _changed_at string").write.parquet(path)
    d = {"name": "p", "sources": [{"connection": "c", "entity": "e", "path": path, "mode": "cdc", "keys": ["id"]}], "pipelines": [{"name": "q", "sql": "select * from {{ source('c', 'e') }}", "outputs": [{"name": "o", "path": out, "mode": "merge", "keys": ["id"], "on_delete": "hard"}]}]}
    Run(spark, from_dict(d), State(str(tmp_path / "s.json"))).execute()
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "c"), (2, "b")]
    spark.createDataFrame([(2, None, "04", "delete", "t")], "id long, v string, _lsn string, _op string, _changed_at string").write.mode("append").parquet(path)
    Run(spark, from_dict(d), State(str(tmp_path / "s.json"))).execute()
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "c")]


def test_delivery_matrix():
    def errors(load, **output):
        d = project("p", "o", mode=load, **({"cursor": "id", "cursor_type": "bigint"} if load == "incremental" else {"keys": ["id"]}))
        d["pipelines"][1]["outputs"] = [{"name": "o", "path": "o", **output}]
        try:
            validate(from_dict(d))
        except ProjectError as e:
            return str(e)
        return ""

    assert "repeat rows" in errors("incremental", mode="append")
    assert not errors("incremental", mode="append", accept_duplicates=True)
    assert "drop all earlier" in errors("incremental", mode="replace")
    assert not errors("incremental", mode="merge", keys=["id"])
    assert "merged, not" in errors("cdc", mode="append")
    assert "on_delete" in errors("cdc", mode="merge", keys=["id"])
    assert not errors("cdc", mode="merge", keys=["id"], on_delete="soft")
    assert "needs keys" in errors("full", mode="merge")
    assert "changes only" in errors("full", mode="replace", on_delete="hard")


def test_render_and_selectors(tmp_path):
    made = from_dict(project("p", "o"))
    rendered = validate(made)
    assert ordered(rendered) == ["a", "b"] and flows(rendered) == [["a", "b"]]
    assert select(made, rendered, "+b") == ["a", "b"] and select(made, rendered, "tag:x+,b") == ["b"]
    assert select(made, rendered, "source:c.events") == ["a"] and select(made, rendered, "a b") == ["a", "b"]
    with pytest.raises(ProjectError):
        select(made, rendered, "nothing")
    bad = from_dict({"name": "x", "sources": [], "pipelines": [{"name": "a", "sql": "{{ ref('b') }} {{ source('q','r') }} {{ open('f') }}"}]})
    with pytest.raises(ProjectError) as e:
        validate(bad)
    assert all(x in str(e.value) for x in ("no pipeline b", "no source q.r", "no call open"))
    circle = from_dict({"name": "x", "pipelines": [{"name": n, "sql": "select * from {{ ref('%s') }}" % m} for n, m in (("a", "b"), ("b", "a"))]})
    with pytest.raises(ProjectError):
        ordered(validate(circle))
    (tmp_path / "pipelines").mkdir()
    (tmp_path / "pipelines" / "q.sql").write_text("select 1 as x")
    (tmp_path / "project.json").write_text(json.dumps({"name": "n", "pipelines": [{"name": "q"}]}))
    assert load(str(tmp_path)).pipelines[0].sql == "select 1 as x"
    s = {"connection": "c", "entity": "e", "path": "p", "mode": "incremental", "cursor": "t", "cursor_type": "timestamp"}
    w = from_dict({"name": "x", "sources": [s], "pipelines": [{"name": "a", "sql": "select * from {{ source('c','e') }} where t > {{ watermark('c','e') }}"}]})
    assert "cast(null as timestamp_ntz)" in render(w, w.pipelines[0]).sql
    assert "cast('2024' as timestamp_ntz)" in render(w, w.pipelines[0], {("c", "e"): "2024"}).sql


def test_state_and_retry(tmp_path):
    s = State(str(tmp_path / "d" / "s.json"))
    s.set("k", {"value": 1}, "r1")
    s.set("k", {"value": 2}, "r2")
    assert State(str(tmp_path / "d" / "s.json")).get("k") == {"value": 2}
    assert s.rollback("k", "r3") == {"value": 1} and s.get("k") == {"value": 1} and len(s.history("k")) == 3
    pauses, tries = [], []

    def step():
        tries.append(1)
        if len(tries) < 3:
            raise Transient
        return "ok"

    assert with_retry(step, sleep=pauses.append) == "ok" and 0.75 <= pauses[0] <= 1.25 and 1.5 <= pauses[1] <= 2.5
    with pytest.raises(ValueError):
        with_retry(lambda: int("x"), sleep=pauses.append)


def test_retry_takes_over_what_was_done(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, v double").write.parquet(path)
    d = {
        "name": "p", "sources": [{"connection": "c", "entity": "e", "path": path}],
        "pipelines": [
            {"name": "a", "sql": "select * from {{ source('c', 'e') }}", "materialization": "table", "outputs": [{"name": "o", "path": out, "mode": "append"}]},
            {"name": "b", "sql": "select id, raise_error('no') as v from {{ ref('a') }}", "outputs": [{"name": "q", "path": out + "2", "mode": "replace"}]},
        ],
    }
    first = Run(spark, from_dict(d), State(str(tmp_path / "s.json")), folder=str(tmp_path / "runs"))
    assert {n: r.status for n, r in first.execute().items()} == {"a": "done", "b": "failed"}
    spark.createDataFrame([(3, 3.0)], "id long, v double").write.mode("append").parquet(path)
    d["pipelines"][1]["sql"] = "select id, v from {{ ref('a') }}"
    second = Run(spark, from_dict(d), State(str(tmp_path / "s.json")), folder=str(tmp_path / "runs"), retry_of=first.save())
    assert {n: r.status for n, r in second.execute().items()} == {"a": "reused", "b": "done"}
    assert spark.read.parquet(out).count() == 2 and spark.read.parquet(out + "2").count() == 2
    d["pipelines"][0]["sql"] += " where id > 0"
    third = Run(spark, from_dict(d), State(str(tmp_path / "s.json")), folder=str(tmp_path / "runs"), retry_of=second.save())
    assert third.execute()["a"].status == "done" and spark.read.parquet(out + "2").count() == 3


def test_watermarks_in_sql_guard_nulls(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    d = project(path, out, cursor="id", cursor_type="bigint")
    d["pipelines"][0]["sql"] = "select * from {{ source('c', 'events') }} e where {{ watermark('c', 'events') }} < e.id and v >= 0"
    d["pipelines"][1]["outputs"] = [{"name": "o", "path": out, "mode": "append"}]
    with pytest.raises(ProjectError, match="repeat rows"):
        validate(from_dict(d))
    d["pipelines"][1]["outputs"][0]["accept_duplicates"] = True
    for ids in ([1, 2, 3], [4], []):
        spark.createDataFrame([(i, float(i)) for i in ids], "id long, v double").write.mode("append").parquet(path)
        run = Run(spark, from_dict(d), State(str(tmp_path / "s.json")))
        assert {r.status for r in run.execute().values()} == {"done"}
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4] and run.mark(run.project.sources[0]) == "4"
    del d["sources"][0]["cursor"]
    with pytest.raises(ProjectError, match="needs a cursor"):
        validate(from_dict(d))


def test_a_retry_never_passes_rows_that_a_reader_did_not_get(spark, tmp_path):
    path, outs, switch = str(tmp_path / "in"), [str(tmp_path / n) for n in "ab"], tmp_path / "late"
    d = project(path, outs[0], mode="incremental", cursor="id", cursor_type="bigint", initial="0")
    sql = ["select id, v from {{ source('c', 'events') }}", "select id, v from {{ source('c', 'events') }} where id not in (select id from parquet.`%s`)" % switch]
    d["pipelines"] = [{"name": n, "sql": q, "outputs": [{"name": n, "path": o, "mode": "append", "accept_duplicates": True}]} for n, q, o in zip("ab", sql, outs, strict=True)]
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, v double").write.parquet(path)
    make = lambda **more: Run(spark, from_dict(d), State(str(tmp_path / "s.json")), folder=str(tmp_path / "runs"), **more)
    first = make()
    assert {n: r.status for n, r in first.execute().items()} == {"a": "done", "b": "failed"}
    spark.createDataFrame([(3, 3.0)], "id long, v double").write.mode("append").parquet(path)
    spark.createDataFrame([(-1,)], "id long").write.parquet(str(switch))
    saved = first.save()
    second = make(retry_of=saved)
    assert {n: r.status for n, r in second.execute().items()} == {"a": "reused", "b": "done"} and second.mark(second.project.sources[0]) == "2"
    make().execute()
    assert all(sorted(r.id for r in spark.read.parquet(o).collect()) == [1, 2, 3] for o in outs)
    kept = json.loads((tmp_path / "runs" / first.id / "results.json").read_text())
    kept["sources"] = {}
    (tmp_path / "lost.json").write_text(json.dumps(kept))
    spark.createDataFrame([(4, 4.0)], "id long, v double").write.mode("append").parquet(path)
    third = make(retry_of=str(tmp_path / "lost.json"))
    assert third.execute()["a"].status == "reused" and third.mark(third.project.sources[0]) == "3"


def test_broken_checks_fail_unless_they_warn(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1.0), (1, 2.0)], "id long, v double").write.parquet(path)
    d = project(path, out)
    d["pipelines"][1] = {"name": "b", "sql": "select id, v from {{ ref('a') }}", "outputs": [{"name": "o", "path": out}], "checks": [{"type": "unique", "columns": ["id"]}, {"type": "row_count", "min": 100}]}
    events = tmp_path / "e.ndjson"
    got = Run(spark, from_dict(d), State(str(tmp_path / "s.json")), events=str(events)).execute()["b"]
    assert got.status == "failed" and got.violations == {"0:unique": 1, "1:row_count": 1}
    told = [json.loads(x) for x in events.read_text().splitlines()]
    assert [e["samples"] for e in told if e["event"] == "check_failed"] == [{"0:unique": [{"id": 1, "n_rows": 2}]}]
    for c in d["pipelines"][1]["checks"]:
        c["severity"] = "warn"
    got = Run(spark, from_dict(d), State(str(tmp_path / "s.json"))).execute()["b"]
    assert got.status == "done" and got.violations == {"0:unique": 1, "1:row_count": 1} and spark.read.parquet(out).count() == 2


def test_a_changed_output_is_another_node(spark):
    a, b = (Run(spark, from_dict(project("p", out)), State("/nowhere")).nodes for out in ("o", "q"))
    assert a["a"] == b["a"] and a["b"] != b["b"]


def test_text_outputs_are_read_back_with_their_types(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.5)], "id long, v double").write.parquet(path)
    for kind, options in (("csv", {"delimiter": ";"}), ("tsv", {}), ("json", {}), ("xml", {"row": "r"})):
        out = str(tmp_path / kind)
        d = project(path, out)
        d["pipelines"][1]["outputs"] = [{"name": "o", "path": out, "format": kind, "mode": "merge", "keys": ["id"], "options": options}]
        for _ in range(2):
            got = Run(spark, from_dict(d), State(str(tmp_path / "s.json"))).execute()["b"]
            assert got.status == "done", got.message
        from tidemill.sources.files import read_files

        assert [(r.id, r.v) for r in read_files(spark, kind, out, {"id": "bigint", "v": "double"}, **options).collect()] == [(1, 1.5)]
