"""The order of pipelines, and picking some of them by name, tag or source."""

from __future__ import annotations

from fnmatch import fnmatchcase
from graphlib import CycleError, TopologicalSorter

from .project import Project, ProjectError, Rendered


def ordered(rendered: dict[str, Rendered]) -> list[str]:
    """Pipelines so that each comes after what it reads, by name where that leaves a choice."""
    sorter = TopologicalSorter({n: sorted(set(r.refs)) for n, r in sorted(rendered.items())})
    try:
        sorter.prepare()
    except CycleError as e:
        raise ProjectError("pipelines read each other in a circle: " + " -> ".join(e.args[1])) from e
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def upstream(rendered: dict[str, Rendered], names: set[str]) -> set[str]:
    out, todo = set(), [*names]
    while todo:
        at = todo.pop()
        if at not in out:
            out.add(at)
            todo += rendered[at].refs
    return out


def downstream(rendered: dict[str, Rendered], names: set[str]) -> set[str]:
    out = set(names)
    for name in ordered(rendered):
        if out & set(rendered[name].refs):
            out.add(name)
    return out


def select(project: Project, rendered: dict[str, Rendered], selector: str) -> list[str]:
    """Pipelines that a selector names: blanks join sets, commas intersect them.

    A term is a name with wildcards, ``tag:T`` or ``source:CONNECTION.ENTITY``; a plus before it adds
    all that it reads, one after it all that reads it.
    """

    def term(text: str) -> set[str]:
        name = text.strip("+")
        if name.startswith("tag:"):
            found = {p.name for p in project.pipelines if any(fnmatchcase(t, name[4:]) for t in p.tags)}
        elif name.startswith("source:"):
            found = {n for n, r in rendered.items() if any(fnmatchcase(f"{s.connection}.{s.entity}", name[7:]) for s in r.sources)}
        else:
            found = {n for n in rendered if fnmatchcase(n, name)}
        if not found:
            raise ProjectError(f"nothing is selected by {text!r}")
        return found | (upstream(rendered, found) if text.startswith("+") else set()) | (downstream(rendered, found) if text.endswith("+") else set())

    chosen: set[str] = set()
    for group in selector.split():
        chosen |= set.intersection(*map(term, group.split(",")))
    return [n for n in ordered(rendered) if n in chosen]


def flows(rendered: dict[str, Rendered]) -> list[list[str]]:
    """Pipelines that hang together by what they read, as groups in order."""
    group = {n: {n} for n in rendered}
    readers: dict[str, str] = {}
    for name in ordered(rendered):
        for other in [*rendered[name].refs, *(readers[s.view] for s in rendered[name].sources if s.view in readers)]:
            if group[other] is not group[name]:
                both = group[name] | group[other]
                for n in both:
                    group[n] = both
        for s in rendered[name].sources:
            readers.setdefault(s.view, name)
    return [sorted(g) for g in sorted({tuple(sorted(g)) for g in group.values()})]
