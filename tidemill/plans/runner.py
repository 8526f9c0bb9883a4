"""Running a project: sources become views, pipelines Spark SQL, outputs writes.

Everything between the sources and the outputs is one lazy plan, so Spark prunes columns and
pushes filters through all pipelines. A pipeline that is a table, or that feeds several outputs
or checks, is written once to the shared folder and read from there: all see the same rows, and
a later run with the same node can use it again.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, checks, schema
from ..operators.incremental import Slice, capture, read_slice
from ..sources.files import read_back, read_files, with_policy, write_files
from ..storage import read_text, staged, write_text
from . import cursors
from .graph import downstream, ordered, select
from .project import Output, Pipeline, Project, Rendered, Source, node_id, render, sources_of, validate
from .state import State


@dataclass
class Result:
    node: str
    status: str  # done, failed, skipped or reused
    rows: int | None = None
    message: str = ""
    violations: dict[str, int] = field(default_factory=dict)


class Transient(RuntimeError):
    """A failure that may pass: the step is tried again."""


class ChecksFailed(RuntimeError):
    """Rows break a check: the pipeline's outputs are not written."""

    def __init__(self, violations: dict[str, int], samples: dict[str, list]):
        super().__init__("; ".join(f"{k}: {n}" for k, n in violations.items()))
        self.violations, self.samples = violations, samples


def with_retry(step: Callable, attempts: int = 3, base: float = 1.0, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """``step()``, again after a failure that may pass, with pauses that double, give or take 25 %."""
    for attempt in range(attempts):
        try:
            return step()
        except (Transient, ConnectionError, TimeoutError):
            if attempt + 1 == attempts:
                raise
            sleep(min(cap, base * 2**attempt) * random.uniform(0.75, 1.25))


class Run:
    """One run of a project over a session, with its state and events.

    With a ``folder`` (one that all executors see), what is written once stays there under the run's
    id, beside ``results.json``: tables of pipelines, and the slices of incremental sources. A run that
    gets the results of a failed one as ``retry_of`` takes over what that had done: nodes of the same
    content aren't delivered again, and their tables and slices are read if their rows are still
    all there. So all readers of a source get the same rows, and its watermark never passes rows
    that one of them didn't get.
    """

    def __init__(self, spark: SparkSession, project: Project, state: State, now: datetime | None = None, events: str | None = None, folder: str | None = None, retry_of: str | None = None):
        self.spark, self.project, self.state = spark, project, state
        self.now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        self.id = uuid.uuid4().hex
        self.rendered: dict[str, Rendered] = validate(project)
        self.results: dict[str, Result] = {}
        self.deletes: dict[str, DataFrame] = {}
        self.kept: dict[str, dict] = {}
        self.folder = folder
        earlier = json.loads(read_text(spark, retry_of)) if retry_of else {}
        self.before: dict[str, dict] = earlier.get("nodes", {})
        self.sliced: dict[str, dict] = earlier.get("sources", {})
        self.captured: dict[str, dict] = {}
        self.named = {s.view for r in self.rendered.values() for s in r.watermarks}
        self.nodes = self.manifest()
        self._events = Path(events) if events else None

    def _took_over(self, name: str) -> DataFrame | None:
        """What an earlier run wrote for a node of the same content, if it is whole."""
        old = self.before.get(name)
        if not old or old["node"] != self.nodes[name] or old["status"] not in ("done", "reused"):
            return None
        df = self._whole(old)
        if df is not None:
            self.kept[name] = {"path": old["path"], "rows": old["rows"]}
        return df

    def _whole(self, old: dict) -> DataFrame | None:
        """What was written to a path, if all its rows are still there."""
        if not old.get("path"):
            return None
        try:
            df = self.spark.read.parquet(old["path"])
            return df if df.count() == old["rows"] else None
        except AnalysisException:
            return None

    def _written(self, df: DataFrame, name: str) -> tuple[DataFrame, dict]:
        path = f"{self.folder.rstrip('/')}/{self.id}/{name}"
        df.write.parquet(path)
        df = self.spark.read.parquet(path)
        return df, {"path": path, "rows": df.count()}

    def save(self) -> str:
        """Write results.json into the run's folder; returns its path."""
        path = f"{self.folder.rstrip('/')}/{self.id}/results.json"
        nodes = {n: asdict(r) | {"node": self.nodes[n]} | self.kept.get(n, {}) for n, r in self.results.items()}
        write_text(self.spark, path, json.dumps({"run": self.id, "nodes": nodes, "sources": self.captured}, indent=1))
        return path

    def event(self, kind: str, **what) -> None:
        if self._events:
            with self._events.open("a") as f:
                f.write(json.dumps({"event": kind, "run": self.id, "at": datetime.now(timezone.utc).isoformat()} | what) + "\n")

    def mark(self, source: Source) -> str | None:
        kept = self.state.get(f"watermark/{source.view}")
        return kept["value"] if kept else None

    def slice(self, source: Source) -> Slice:
        """What this run takes of a source."""
        if source.mode != "incremental":
            return Slice()
        kind = source.cursor_type
        text = self.mark(source) or source.initial
        low = cursors.parse(text, kind) if text is not None else None
        until = self.now if source.until == "now" else cursors.parse(source.until, kind) if source.until else None
        if source.max_window and low is not None:
            window = cursors.bounded(low, source.max_window, until, kind, source.until == "now")
            return Slice(low, low if window.empty else window.high, high_inclusive=window.inclusive or window.empty)
        return Slice(low, until, high_inclusive=source.until != "now")

    def load(self, source: Source) -> None:
        df = read_files(self.spark, source.format, source.path, source.columns, **source.options)
        accepted = self.state.get(f"schema/{source.view}")
        drift = schema.drift_gate(df, accepted, source.drift, has_contract=source.columns is not None)
        if drift:
            self.event("schema_drift", source=source.view, drift=str(drift))
        if accepted is None and source.columns is None:
            self.state.set(f"schema/{source.view}", schema.columns_of(df), self.id)
        if source.mode == "cdc":
            df, self.deletes[source.view] = changes.collapse(df, [*source.keys], "_lsn", "_op", ["_changed_at"])
        elif source.mode == "incremental":
            df = self._part(source, df)
        elif source.view in self.named:
            df = self._captured(source, df, Slice())
            low = self.captured[source.view]["watermark"]
            if low is not None:
                df = read_slice(df, source.cursor, Slice(None, cursors.parse(low, source.cursor_type)), keep_null=True)
        df.createOrReplaceTempView(source.view)

    def _part(self, source: Source, df: DataFrame) -> DataFrame:
        """The slice of an incremental source, or the one that an earlier run had taken."""
        old = self.sliced.get(source.view, {})
        taken = self._whole(old)
        if taken is not None:
            self.captured[source.view] = old
            return taken
        part = self.slice(source)
        df, kept = read_slice(df, source.cursor, part), {}
        if self.folder:
            df, kept = self._written(df, source.view)
        df = self._captured(source, df, part)
        self.captured[source.view] |= kept
        return df

    def _captured(self, source: Source, df: DataFrame, part: Slice) -> DataFrame:
        got = capture(df, source.cursor, part).first().watermark
        self.captured[source.view] = {"watermark": None if got is None else cursors.canonical(got, source.cursor_type), "fresh": bool(self.before)}
        return df

    def build(self, pipeline: Pipeline) -> DataFrame:
        old = self._took_over(pipeline.name)
        if old is not None:
            old.createOrReplaceTempView(pipeline.name)
            return old
        marks = {(s.connection, s.entity): self.mark(s) for s in self.rendered[pipeline.name].watermarks}
        sql = render(self.project, pipeline, marks, {"run_id": self.id, "run_started_at": self.now.isoformat()}).sql
        df = self.spark.sql(sql)
        readers = len(pipeline.outputs) + len(pipeline.checks)
        if pipeline.materialization == "table" or (readers > 1 and pipeline.materialization != "ephemeral"):
            if self.folder:
                df, self.kept[pipeline.name] = self._written(df, pipeline.name)
            else:
                df = staged(df, pipeline.name)
        df.createOrReplaceTempView(pipeline.name)
        return df

    def check(self, pipeline: Pipeline, df: DataFrame) -> dict[str, int]:
        made = []
        for c in pipeline.checks:
            o, columns = c.options, [*c.columns]
            if c.type == "not_null":
                made.append(checks.not_null(df, columns))
            elif c.type == "unique":
                made.append(checks.unique(df, columns))
            elif c.type == "row_count":
                made.append(checks.row_count(df, o.get("min"), o.get("max")))
            elif c.type == "freshness":
                made.append(checks.freshness(df, columns[0], timedelta(seconds=o["max_age_seconds"]), self.now))
            elif c.type == "accepted_values":
                made.append(checks.accepted_values(df, columns[0], o["values"]))
            elif c.type == "custom_sql":
                made.append(checks.custom_sql(self.spark.sql(o["sql"])))
            else:
                raise ValueError(f"there is no check {c.type}")
        if not made:
            return {}
        found = [r.violations for r in checks.all_checks([m.withColumn("k", F.lit(k)) for k, m in enumerate(made)]).orderBy("k").collect()]
        out = {f"{k}:{c.type}": n for k, (c, n) in enumerate(zip(pipeline.checks, found, strict=True))}
        broken = {k: c for k, c in zip(out, pipeline.checks, strict=True) if out[k] and c.options.get("severity", "error") == "error"}
        if broken:
            samples = {k: [r.asDict() for r in checks.violating_rows(df, c.type, [*c.columns], c.options.get("values")).collect()] for k, c in broken.items() if c.type in ("not_null", "unique", "accepted_values")}
            raise ChecksFailed(out, samples)
        return out

    def deliver(self, output: Output, df: DataFrame, sources: list[Source]) -> None:
        there = read_back(self.spark, output.format, output.path, df, **output.options) if output.mode != "replace" else None
        if there is not None and output.mode != "merge":
            df = with_policy(schema.columns_of(there), df, output.schema_policy)
        if output.mode == "merge":
            keys = [*output.keys]
            guard = changes.merge_guard(df, keys).first()
            if guard.null_key_rows:
                raise ValueError(f"{output.name}: {guard.null_key_rows} rows have no key")
            if guard.extra_rows:
                self.event("merge_duplicates", output=output.name, extra=guard.extra_rows)
            target = there if there is not None else df.limit(0)
            if output.on_delete:
                gone = self.deletes.get(sources[0].view, df.limit(0).select(*keys))
                df = changes.apply_changes(target, df, gone, keys, output.on_delete, at=F.lit(self.now).cast("timestamp_ntz"))
            else:
                df = changes.merge(target, df, keys)
        mode = "append" if output.mode == "append" else "replace"
        with_retry(lambda: write_files(df, output.format, output.path, mode, [*output.partition_by] or None, **output.options))

    def advance(self) -> None:
        """Move on the watermarks of sources whose rows all readers have delivered, to the last of
        these rows. A source that a retry had to load again stays where it is if a reader was not
        run again: that one has not got the new rows."""
        for source in self.project.sources:
            got = self.captured.get(source.view)
            if not got:
                continue
            reading = {n for n, r in self.rendered.items() if source.view in {s.view for s in r.sources}}
            below = [self.results.get(n) for n in downstream(self.rendered, reading)]
            if any(r is None or r.status not in ("done", "reused") for r in below) or (got["fresh"] and any(r.status == "reused" for r in below)):
                self.event("watermark_held", source=source.view)
                continue
            last, mark = got["watermark"], self.mark(source)
            if last is None or (mark is not None and cursors.parse(mark, source.cursor_type) >= cursors.parse(last, source.cursor_type)):
                continue
            self.state.set(f"watermark/{source.view}", {"value": last, "type": source.cursor_type, "run": self.id}, self.id)

    def execute(self, selector: str = "*") -> dict[str, Result]:
        chosen = select(self.project, self.rendered, selector)
        wanted = {n for n in ordered(self.rendered) if n in chosen or any(n in _above(self.rendered, c) for c in chosen)}
        self.event("run_started", nodes=sorted(wanted))
        for source in {s.view: s for n in wanted for s in sources_of(self.rendered, n)}.values():
            with_retry(lambda source=source: self.load(source))
        for name in (n for n in ordered(self.rendered) if n in wanted):
            pipeline = self.project.pipeline(name)
            failed = [r for r in self.rendered[name].refs if self.results[r].status in ("failed", "skipped")]
            if failed:
                self.results[name] = Result(name, "skipped", message=f"{', '.join(failed)} failed")
                continue
            try:
                df = self.build(pipeline)
                old = self.before.get(name, {})
                again = old.get("node") == self.nodes[name] and old.get("status") in ("done", "reused")
                if again:
                    self.results[name] = Result(name, "reused", violations=old.get("violations", {}))
                    continue
                if name in chosen:
                    violations = self.check(pipeline, df)
                    for output in pipeline.outputs:
                        self.deliver(output, df, sources_of(self.rendered, name))
                else:
                    violations = {}
                self.results[name] = Result(name, "done", violations=violations)
            except ChecksFailed as e:
                self.event("check_failed", node=name, samples=json.loads(json.dumps(e.samples, default=str)))
                self.results[name] = Result(name, "failed", message=f"checks: {e}", violations=e.violations)
            except Exception as e:
                self.results[name] = Result(name, "failed", message=f"{type(e).__name__}: {str(e)[:500]}")
            self.event("node_finished", **asdict(self.results[name]))
        self.advance()
        if self.folder:
            self.save()
        self.event("run_finished", failed=[n for n, r in self.results.items() if r.status == "failed"])
        return self.results

    def manifest(self) -> dict[str, str]:
        """The node id of each pipeline: what it reads, computes, checks and writes, by content."""
        out: dict[str, str] = {}
        for name in ordered(self.rendered):
            r = self.rendered[name]
            out[name] = node_id(self.project.pipeline(name), r, [out[x] for x in r.refs] + [json.dumps(asdict(s), sort_keys=True) for s in r.sources])
        return out


def _above(rendered: dict[str, Rendered], name: str) -> set[str]:
    out, todo = set(), [*rendered[name].refs]
    while todo:
        at = todo.pop()
        if at not in out:
            out.add(at)
            todo += rendered[at].refs
    return out


def until_caught_up(make: Callable[[], Run], passes: int = 100) -> int:
    """Run again and again until no watermark moves; returns the number of runs.

    Raises RuntimeError if the watermarks still move after ``passes`` runs; what they loaded stays.
    """
    before = None
    for k in range(passes):
        run = make()
        results = run.execute()
        if any(r.status == "failed" for r in results.values()):
            raise RuntimeError(str({n: r.message for n, r in results.items() if r.status == "failed"}))
        after = {s.view: run.mark(s) for s in run.project.sources}
        if after == before:
            return k + 1
        before = after
    raise RuntimeError(f"not caught up after {passes} runs; watermarks: {before}")
