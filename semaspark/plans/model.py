"""Effective semantic models: projects, imports, refinements and extensions."""

from __future__ import annotations

import fnmatch
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import Path

from semaspark.plans.modelfile import Entry, read_model

FIELD_KINDS = ("dimension", "dimension_group", "measure", "filter", "parameter")
TIMEFRAMES = ("raw", "time", "date", "week", "month", "quarter", "year")
#: Parameters to which refinements add instead of replacing.
ADDITIVE = frozenset({"link", "filters", "action", "extends"})


class ModelError(ValueError):
    """A model that can't be resolved."""


@dataclass(frozen=True)
class Place:
    project: str
    file: str
    line: int

    def __str__(self) -> str:
        return f"{self.project}/{self.file}:{self.line}"


@dataclass
class Part:
    """A view, explore, field or join: parameters with the place of the last
    write of each, and parts of its own by name."""

    kind: str
    name: str
    params: dict[str, object] = field(default_factory=dict)
    places: dict[str, Place] = field(default_factory=dict)
    history: list[tuple[str, Place]] = field(default_factory=list)
    parts: dict[str, Part] = field(default_factory=dict)
    exempt: set[str] = field(default_factory=set)

    def get(self, key: str, default: object = None) -> object:
        return self.params.get(key, default)

    def yes(self, key: str) -> bool:
        return self.params.get(key) in ("yes", True)

    @property
    def first(self) -> Place:
        return self.history[0][1]

    @property
    def last(self) -> Place:
        return self.history[-1][1]

    @property
    def type(self) -> str:
        default = {"dimension": "string", "dimension_group": "time", "measure": "string"}.get(self.kind, "string")
        return str(self.params.get("type", default))

    @property
    def tags(self) -> list[str]:
        return list(self.params.get("tags", []))  # type: ignore[arg-type]

    @property
    def filters(self) -> list[tuple[str, str]]:
        return [(k, v) for k, v in self.params.get("filters", [])]  # type: ignore[union-attr]


def as_part(e: Entry, project: str, file: str) -> Part:
    """A part with all that is written in one block."""
    here = Place(project, file, e.line)
    out = Part(e.key, e.name.lstrip("+"), history=[("define", here)], exempt=set(e.exempt))
    for x in e.body or ():
        place = Place(project, file, x.line)
        if e.key == "view" and x.key in FIELD_KINDS or e.key == "explore" and x.key == "join":
            new = as_part(x, project, file)
            out.parts[x.name] = overlay(out.parts[x.name], new, "override") if x.name in out.parts else new
            continue
        value = x.value
        if x.body is not None:
            if x.key == "always_filter":
                value = [y for f in x.all("filters") for y in f.value]  # type: ignore[union-attr]
            elif x.key == "derived_table":
                out.params["derived_sql"], out.places["derived_sql"] = x.get("sql"), place
                continue
            else:
                value = {y.key: y.value for y in x.body}
        if x.key in ADDITIVE and x.key in out.params:
            value = [*out.params[x.key], *(value if isinstance(value, list) else [value])]  # type: ignore[misc]
        elif x.key in ADDITIVE and not isinstance(value, list):
            value = [value]
        out.params[x.key], out.places[x.key] = value, place
    return out


def overlay(base: Part, top: Part, op: str) -> Part:
    """``base`` with what ``top`` writes on it."""
    out = deepcopy(base)
    for k, v in top.params.items():
        if k in ADDITIVE and k in out.params and op == "refine":
            v = [*out.params[k], *[x for x in v if x not in out.params[k]]]  # type: ignore[misc,union-attr]
        out.params[k], out.places[k] = v, top.places.get(k, top.last)
    out.history += [(op, place) for _, place in top.history]
    out.exempt |= top.exempt
    for name, part in top.parts.items():
        out.parts[name] = overlay(out.parts[name], part, op) if name in out.parts else deepcopy(part)
    return out


@dataclass
class Project:
    name: str
    root: Path
    depends: dict[str, str] = field(default_factory=dict)  # name -> kind of dependency
    files: dict[str, list[Entry]] = field(default_factory=dict)

    @classmethod
    def load(cls, root: str | Path) -> Project:
        root = Path(root)
        out = cls(root.name, root)
        for p in sorted(root.rglob("*.lkml")):
            out.files[p.relative_to(root).as_posix()] = read_model(p.read_text(encoding="utf-8"), str(p))
        for e in out.files.get("manifest.lkml", []):
            if e.key == "project_name":
                out.name = str(e.value)
            elif e.key == "local_dependency":
                out.depends[str(e.get("project"))] = e.key
            elif e.key == "remote_dependency":
                out.depends[e.name] = e.key
        return out


class Workspace:
    """Projects that may import each other, without cycles."""

    def __init__(self, roots: list[str | Path]):
        self.projects = {p.name: p for p in map(Project.load, roots)}
        for name in self.projects:
            self._walk(name, [])

    def _walk(self, name: str, path: list[str]) -> None:
        if name in path:
            raise ModelError("import cycle between projects: " + " -> ".join([*path[path.index(name) :], name]))
        for other in self.projects[name].depends if name in self.projects else ():
            self._walk(other, [*path, name])

    def imports(self, name: str) -> list[str]:
        """All projects that one imports, also through others, by name."""
        out: set[str] = set()
        todo = list(self.projects[name].depends)
        while todo:
            if (x := todo.pop()) not in out:
                out.add(x)
                todo += list(self.projects[x].depends) if x in self.projects else []
        return sorted(out)

    def tree(self) -> str:
        """A line for each project in order of names: what it imports and how."""
        say = lambda p: "; ".join(f"{d} as {kind}" for d, kind in sorted(p.depends.items())) or "nothing"
        return "".join(f"{name} <= {say(p)}\n" for name, p in sorted(self.projects.items()))

    def mermaid(self) -> str:
        """The import graph as a Mermaid flowchart, importers below."""
        edges = sorted((d, name, kind) for name, p in self.projects.items() for d, kind in p.depends.items())
        lone = sorted(set(self.projects) - {x for e in edges for x in e[:2]})
        return "".join(["flowchart TB\n", *[f"    {a} -. {kind} .-> {b}\n" for a, b, kind in edges], *[f"    {x}\n" for x in lone]])


@dataclass
class SemanticModel:
    """What a project sees once all is resolved."""

    project: str
    views: dict[str, Part]
    explores: dict[str, Part]
    grants: dict[str, list] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)
    included: list[tuple[str, str]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)

    def field(self, view: str, name: str) -> Part | None:
        return self.views[view].parts.get(name) if view in self.views else None

    def queryable(self) -> list[str]:
        return sorted(n for n, e in self.explores.items() if e.get("extension") != "required")

    @staticmethod
    def base_view(explore: Part) -> str:
        return str(explore.get("from") or explore.get("view_name") or explore.name)

    @staticmethod
    def base_alias(explore: Part) -> str:
        return str(explore.get("view_name") or explore.name)

    def aliases(self, explore: Part) -> dict[str, str]:
        """View of every alias of an explore, the base first."""
        return {self.base_alias(explore): self.base_view(explore), **{n: str(j.get("from", n)) for n, j in explore.parts.items()}}


def _matches(path: str, pattern: str) -> bool:
    """``*`` stays within a directory, ``**`` does not; the suffix is optional."""
    for p in (pattern, pattern + ".lkml"):
        want, have = p.strip("/").split("/"), path.split("/")
        if "**" not in want:
            if len(want) == len(have) and all(fnmatch.fnmatchcase(h, w) for h, w in zip(have, want, strict=True)):
                return True
        elif fnmatch.fnmatchcase(path, p.strip("/").replace("**/", "*")):
            return True
    return False


def resolve(space: Workspace, name: str) -> SemanticModel:
    """The effective model of one project: files in include order, refinements
    applied as met, then extensions."""
    project = space.projects[name]
    model = SemanticModel(name, {}, {}, imports=space.imports(name))
    blocks: list[tuple[Entry, str, str]] = []
    seen: set[tuple[str, str]] = set()

    def include(owner: Project, file: str) -> None:
        if (owner.name, file) in seen:
            return
        seen.add((owner.name, file))
        model.included.append((owner.name, file))
        for e in owner.files[file]:
            if e.key != "include":
                blocks.append((e, owner.name, file))
                continue
            target, pattern = owner, str(e.value)
            if pattern.startswith("//"):
                other, _, pattern = pattern[2:].partition("/")
                if other not in owner.depends:
                    model.problems.append(f"{owner.name}/{file}:{e.line}: project '{other}' is not declared in manifest")
                    continue
                if other not in space.projects:
                    model.problems.append(f"{owner.name}/{file}:{e.line}: project '{other}' is unknown")
                    continue
                target = space.projects[other]
            elif not pattern.startswith("/"):
                pattern = f"{Path(file).parent.as_posix()}/{pattern}".removeprefix("./")
            found = [f for f in sorted(target.files) if _matches(f, pattern)]
            if not found:
                model.problems.append(f"{owner.name}/{file}:{e.line}: include '{e.value}' matched no files")
            for f in found:
                include(target, f)

    for f in sorted(f for f in project.files if f.endswith(".model.lkml")):
        include(project, f)
    for e, owner, file in blocks:
        if e.key == "access_grant":
            model.grants[e.name] = list(e.get("allowed_values", []))  # type: ignore[arg-type]
        if e.key not in ("view", "explore"):
            continue
        into = model.views if e.key == "view" else model.explores
        part = as_part(e, owner, file)
        if e.name.startswith("+"):
            if part.name not in into:
                model.problems.append(f"{owner}/{file}:{e.line}: refinement of unknown {e.key} '{part.name}'")
            else:
                into[part.name] = overlay(into[part.name], part, "refine")
        elif part.name in into:
            model.problems.append(f"{owner}/{file}:{e.line}: {e.key} '{part.name}' is defined twice")
        else:
            into[part.name] = part
    for into in (model.views, model.explores):
        done: dict[str, Part] = {}
        for n in list(into):
            done[n] = _extend(n, into, done, [], model.problems)
        into.update(done)
    return model


def _extend(name: str, into: dict[str, Part], done: dict[str, Part], path: list[str], problems: list[str]) -> Part:
    if name in done:
        return done[name]
    if name in path:
        raise ModelError("extends cycle: " + " -> ".join([*path, name]))
    own = into[name]
    parents = [str(p) for p in own.params.get("extends", [])]  # type: ignore[union-attr]
    base: Part | None = None
    for p in parents:
        if p not in into:
            problems.append(f"{own.last}: {own.kind} '{name}' extends unknown '{p}'")
            continue
        parent = deepcopy(_extend(p, into, done, [*path, name], problems))
        base = parent if base is None else overlay(base, parent, "extend")
    if base is None:
        return own
    base.params.pop("extension", None)
    base.params.pop("extends", None)
    for part in base.parts.values():
        part.history.append(("extend", own.last))
    if own.kind == "explore" and "view_name" not in base.params and "from" not in base.params:
        base.params["view_name"] = base.name
    base.name = name
    out = overlay(base, own, "override")
    done[name] = out
    return out
