"""A project: connections, sources, SQL pipelines, checks and outputs, as plain declarations.

Pipelines are Spark SQL with a few marked calls: ``{{ source('conn', 'entity') }}``, ``{{
ref('pipeline') }}``, ``{{ watermark('conn', 'entity') }}``, ``{{ var('name') }}``, ``{{ env('NAME')
}}``, ``{{ run_id }}``, ``{{ run_started_at }}``. Spark parses, plans and runs the SQL.
"""

from __future__ import annotations

import ast
import hashlib
import json
import os
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from ..functions.dialect import check_sql
from ..sources.contracts import CURSORS


class ProjectError(ValueError):
    """What is declared doesn't hold together; all findings are in the message."""


@dataclass(frozen=True)
class Source:
    """What is read. A source of changes (``cdc``) has the columns _lsn (text whose order is the
    log's), _op (``delete`` or another) and perhaps _changed_at beside its own."""

    connection: str
    entity: str
    format: str = "parquet"
    path: str = ""
    columns: dict[str, str] | None = None
    options: dict[str, str] = field(default_factory=dict)
    mode: str = "full"  # full, incremental or cdc
    cursor: str | None = None
    cursor_type: str | None = None
    initial: str | None = None
    max_window: str | None = None
    until: str | None = None
    keys: tuple[str, ...] = ()
    drift: str = "warn"

    @property
    def view(self) -> str:
        return "src_" + re.sub(r"\W", "_", f"{self.connection}__{self.entity}")


@dataclass(frozen=True)
class Check:
    """A check; with ``severity: warn`` among its options violations are told and don't fail the node."""

    type: str
    columns: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Output:
    name: str
    path: str
    format: str = "parquet"
    mode: str = "append"  # append, replace or merge
    keys: tuple[str, ...] = ()
    on_delete: str | None = None  # hard or soft
    accept_duplicates: bool = False
    schema_policy: str = "fail_on_change"
    partition_by: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    name: str
    sql: str
    materialization: str = "view"  # view, table or ephemeral
    tags: tuple[str, ...] = ()
    checks: tuple[Check, ...] = ()
    outputs: tuple[Output, ...] = ()


@dataclass(frozen=True)
class Project:
    name: str
    sources: tuple[Source, ...]
    pipelines: tuple[Pipeline, ...]
    vars: dict[str, str] = field(default_factory=dict)

    def source(self, connection: str, entity: str) -> Source:
        for s in self.sources:
            if (s.connection, s.entity) == (connection, entity):
                return s
        raise ProjectError(f"there is no source {connection}.{entity}")

    def pipeline(self, name: str) -> Pipeline:
        for p in self.pipelines:
            if p.name == name:
                return p
        raise ProjectError(f"there is no pipeline {name}")


def from_dict(d: dict) -> Project:
    """A project from nested dicts and lists, as JSON or YAML give them."""

    def output(o: dict) -> Output:
        return Output(**o | {k: tuple(o[k]) for k in ("keys", "partition_by") if k in o})

    def pipeline(p: dict) -> Pipeline:
        checks = tuple(Check(c["type"], tuple(c.get("columns", ())), {k: v for k, v in c.items() if k not in ("type", "columns")}) for c in p.get("checks", ()))
        return Pipeline(**p | {"tags": tuple(p.get("tags", ())), "checks": checks, "outputs": tuple(map(output, p.get("outputs", ())))})

    sources = tuple(Source(**s | ({"keys": tuple(s["keys"])} if "keys" in s else {})) for s in d.get("sources", ()))
    return Project(d["name"], sources, tuple(map(pipeline, d.get("pipelines", ()))), d.get("vars", {}))


def load(folder: str) -> Project:
    """The project in a folder: project.json or project.yml, and pipelines/NAME.sql for SQL that
    isn't given in place."""
    root = Path(folder)
    if (root / "project.json").exists():
        d = json.loads((root / "project.json").read_text())
    else:
        import yaml

        d = yaml.safe_load((root / "project.yml").read_text())
    for p in d.get("pipelines", ()):
        if "sql" not in p:
            p["sql"] = (root / "pipelines" / f"{p['name']}.sql").read_text()
    return from_dict(d)


_CALL = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.S)
_MARK = r"\{\{\s*watermark\([^{}]*\)\s*\}\}"
_ABOVE = re.compile(rf"((?:[\w.]|`[^`]*`)+(?:\([^()]*\))?)\s*(>=?)\s*({_MARK})", re.S)
_BELOW = re.compile(rf"({_MARK})\s*(<=?)\s*((?:[\w.]|`[^`]*`)+(?:\([^()]*\))?)", re.S)


@dataclass
class Rendered:
    sql: str
    sources: list[Source] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    watermarks: list[Source] = field(default_factory=list)


def render(project: Project, pipeline: Pipeline, marks: dict[tuple[str, str], str] | None = None, run: dict[str, str] | None = None) -> Rendered:
    """The pipeline's SQL with its calls replaced by views and literals, and what it depends on.

    A watermark that isn't known yet is a typed null; what is compared to lie above it then holds
    for every row, so the first load takes all. Wrong calls are gathered into one error.
    """
    out, errors = Rendered(""), []

    def call(match: re.Match) -> str:
        try:
            node = ast.parse(match[1], mode="eval").body
            if isinstance(node, ast.Name) and node.id in ("run_id", "run_started_at"):
                return "'" + (run or {}).get(node.id, "") + "'"
            if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
                raise ProjectError(f"{match[1]!r} is no call")
            args = [ast.literal_eval(a) for a in node.args]
            if node.func.id == "source":
                found = project.source(*args)
                out.sources.append(found)
                return f"`{found.view}`"
            if node.func.id == "ref":
                out.refs.append(project.pipeline(*args).name)
                return f"`{args[0]}`"
            if node.func.id == "watermark":
                found = project.source(*args)
                if not found.cursor:
                    raise ProjectError(f"{found.view}: a watermark needs a cursor")
                if found not in out.watermarks:
                    out.watermarks.append(found)
                kind = {"timestamp": "timestamp_ntz", "decimal": "decimal(38,9)"}.get(found.cursor_type, found.cursor_type)
                value = (marks or {}).get((found.connection, found.entity))
                return f"cast(null as {kind})" if value is None else f"cast('{value}' as {kind})"
            if node.func.id == "var":
                return str(project.vars[args[0]] if args[0] in project.vars else args[1])
            if node.func.id == "env":
                return os.environ[args[0]] if args[0] in os.environ else args[1]
            raise ProjectError(f"there is no call {node.func.id}")
        except ProjectError as e:
            errors.append(str(e))
        except (SyntaxError, ValueError, TypeError, IndexError, KeyError) as e:
            errors.append(f"{match[1]!r}: {e}")
        return "null"

    guarded = _ABOVE.sub(r"(\3 is null or \1 \2 \3)", pipeline.sql)
    guarded = _BELOW.sub(r"(\1 is null or \1 \2 \3)", guarded)
    out.sql = _CALL.sub(call, guarded)
    if errors:
        raise ProjectError(f"{pipeline.name}: " + "; ".join(errors))
    check_sql(out.sql)
    return out


def delivery_errors(source: Source, output: Output) -> list[str]:
    """Ways of loading and delivering that together would lose or repeat rows."""
    out = []
    if source.mode == "incremental" and output.mode == "append" and not output.accept_duplicates:
        out.append("an incremental load that is appended may repeat rows after a retry: accept_duplicates, or merge")
    if source.mode == "incremental" and output.mode == "replace":
        out.append("an incremental load that replaces would drop all earlier rows")
    if source.mode == "cdc" and output.mode != "merge":
        out.append("changes are merged, not appended or replaced")
    if source.mode == "cdc" and output.mode == "merge" and output.on_delete not in ("hard", "soft"):
        out.append("merged changes need on_delete: hard or soft")
    if source.mode != "cdc" and output.on_delete:
        out.append("on_delete is for changes only")
    if output.mode == "merge" and not output.keys:
        out.append("a merge needs keys")
    return [f"{source.view} to {output.name}: {e}" for e in out]


def validate(project: Project) -> dict[str, Rendered]:
    """Everything that can be known before a run; all errors at once."""
    errors, rendered = [], {}
    names = [p.name for p in project.pipelines]
    errors += [f"two pipelines are called {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    for s in project.sources:
        if s.mode == "incremental" and not s.cursor:
            errors.append(f"{s.view}: an incremental source needs a cursor")
        if s.cursor and s.cursor_type not in CURSORS:
            errors.append(f"{s.view}: the cursor's type is one of {', '.join(CURSORS)}")
        if s.mode == "cdc" and not s.keys:
            errors.append(f"{s.view}: changes need keys")
    for p in project.pipelines:
        try:
            rendered[p.name] = render(project, p)
        except ValueError as e:
            errors.append(str(e))
    for p in project.pipelines:
        for upstream in rendered[p.name].refs if p.name in rendered else ():
            if p.materialization == "ephemeral" and project.pipeline(upstream).materialization == "ephemeral":
                errors.append(f"{p.name}: an ephemeral pipeline may not read another, {upstream}")
        if p.materialization == "ephemeral" and p.outputs:
            errors.append(f"{p.name}: an ephemeral pipeline has no outputs")
        if p.name in rendered:
            reached = sources_of(rendered, p.name)
            marked = {s.view for r in rendered.values() for s in r.watermarks}
            for o in p.outputs:
                for s in reached:
                    errors += delivery_errors(replace(s, mode="incremental") if s.view in marked and s.mode == "full" else s, o)
                if o.on_delete and len(reached) > 1:
                    errors.append(f"{o.name}: deletes can be routed from a single source only")
    if errors:
        raise ProjectError("\n".join(errors))
    return rendered


def sources_of(rendered: dict[str, Rendered], name: str) -> list[Source]:
    """All sources that a pipeline reads, itself or through others."""
    seen, out, todo = set(), {}, [name]
    while todo:
        at = todo.pop()
        if at in seen or at not in rendered:
            continue
        seen.add(at)
        out |= {s.view: s for s in rendered[at].sources}
        todo += rendered[at].refs
    return [*out.values()]


def node_id(pipeline: Pipeline, rendered: Rendered, upstream: list[str]) -> str:
    """A name for what a pipeline does: the same SQL, checks and outputs over the same inputs have the same."""
    parts = asdict(pipeline) | {"sql": " ".join(rendered.sql.split()), "tags": [], "on": sorted(upstream)}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]
