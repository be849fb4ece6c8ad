"""Configuration: roots, projects, bindings, enrichment settings; read, checked, and saved atomically."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field

from .files import inside

VERSION = 2
#: Ids that mean something else, and the limits and defaults of enrichment.
RESERVED = ("auto", "shared", "current", "all")
ENRICH = {"maxOutputTokens": (16, 8192, 2048), "timeoutMs": (1000, 300_000, 60_000), "concurrency": (1, 32, 8), "retries": (0, 8, 2)}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Scope:
    kind: str
    projects: tuple[str, ...] = ()

    def same(self, other: Scope) -> bool:
        return self.kind == other.kind and set(self.projects) == set(other.projects)

    def to_json(self):
        return {"projects": list(self.projects)} if self.kind == "projects" else self.kind


@dataclass
class Root:
    name: str
    configured_path: str
    writable: bool = False
    exclude: list[str] = field(default_factory=list)

    @property
    def path(self) -> str:
        return os.path.realpath(os.path.expanduser(self.configured_path))

    @property
    def exists(self) -> bool:
        return os.path.isdir(self.path)


@dataclass
class Project:
    id: str
    name: str
    workspaces: list[str]


@dataclass
class Binding:
    root: str
    path: str
    scope: Scope


@dataclass
class Config:
    roots: list[Root]
    projects: list[Project] = field(default_factory=list)
    bindings: list[Binding] = field(default_factory=list)
    isolation: bool = False
    enabled: bool = True
    enrich: dict | None = None
    rest: dict = field(default_factory=dict)

    @property
    def writable(self) -> Root | None:
        return next((r for r in self.roots if r.writable), None)

    def root(self, name: str) -> Root:
        for r in self.roots:
            if r.name == name:
                return r
        raise ConfigError(f"unknown root: {name}")


def _need(ok: object, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def project_id(raw: object) -> str:
    _need(isinstance(raw, str) and raw.strip(), "a project id must not be empty")
    out = raw.strip()  # type: ignore[union-attr]
    _need(not re.search(r"\s", out), f"a project id must not hold white space: {out}")
    _need(out.lower() not in RESERVED, f"a project id is reserved: {out}")
    return out


def bind_path(raw: object) -> str | None:
    """A relative path in normal form, ``.`` for the root, null if it is absolute or leaves it."""
    if not isinstance(raw, str):
        return None
    path = raw.strip().replace("\\", "/")
    if path in ("", "."):
        return "."
    if path.startswith("/") or re.match("[a-zA-Z]:", path):
        return None
    parts = path.strip("/").split("/")
    return None if any(p in ("", ".", "..") for p in parts) else "/".join(parts)


def scope(raw: object) -> Scope:
    if raw in ("shared", "unassigned"):
        return Scope(raw)  # type: ignore[arg-type]
    _need(isinstance(raw, dict) and isinstance(raw.get("projects"), list) and raw["projects"], "a scope is shared, unassigned, or a list of projects")
    return Scope("projects", tuple(dict.fromkeys(project_id(x) for x in raw["projects"])))  # type: ignore[index]


def new_project_id(name: str, taken: set[str]) -> str:
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
    return slug if slug and slug not in RESERVED and slug not in taken else f"p-{uuid.uuid4().hex[:8]}"


def _absolute(path: object) -> bool:
    return isinstance(path, str) and path.strip() != "" and (path.strip().startswith("~") or os.path.isabs(path.strip()))


def enrich_settings(raw: object) -> dict | None:
    if raw is None:
        return None
    _need(isinstance(raw, dict) and all(isinstance(raw.get(k), str) and raw[k].strip() for k in ("provider", "model")), "enrich needs a provider and a model")
    out = {k: raw[k].strip() for k in ("provider", "model")}  # type: ignore[index]
    for k, (low, high, default) in ENRICH.items():
        value = raw.get(k, default)  # type: ignore[union-attr]
        _need(isinstance(value, int) and not isinstance(value, bool) and low <= value <= high, f"enrich.{k} must be a whole number from {low} to {high}")
        out[k] = value
    return out


def parse(raw: object) -> Config:
    _need(isinstance(raw, dict) and isinstance(raw.get("roots"), list), "the configuration needs a list of roots")
    roots: list[Root] = []
    for r in raw["roots"]:  # type: ignore[index]
        _need(isinstance(r, dict) and isinstance(r.get("name"), str) and r["name"].strip(), "a root needs a name")
        name = r["name"].strip()
        _need(name not in {x.name for x in roots}, f"two roots have the name {name}")
        _need(_absolute(r.get("path")), f"the path of root {name} must be absolute or begin with ~")
        rules = r.get("exclude", [])
        _need(isinstance(rules, list) and all(isinstance(x, str) for x in rules), f"exclude of root {name} must be a list of strings")
        roots.append(Root(name, r["path"].strip(), bool(r.get("writable", False)), rules))
    _need(sum(r.writable for r in roots) <= 1, "only one root may be writable")
    out = Config(roots, isolation=bool(raw.get("isolation", False)), enabled=bool(raw.get("enabled", True)), enrich=enrich_settings(raw.get("enrich")))  # type: ignore[union-attr]
    if "projects" in raw or "bindings" in raw:  # type: ignore[operator]
        _need(raw.get("version") == VERSION, f"projects and bindings need version {VERSION}")  # type: ignore[union-attr]
        for p in raw.get("projects") or []:  # type: ignore[union-attr]
            _need(isinstance(p, dict), "a project must be an object")
            pid = project_id(p.get("id"))
            _need(pid not in {x.id for x in out.projects}, f"two projects have the id {pid}")
            _need(isinstance(p.get("name"), str) and p["name"].strip(), f"project {pid} needs a name")
            _need(isinstance(p.get("workspaces"), list) and all(map(_absolute, p["workspaces"])), f"workspaces of project {pid} must be absolute or begin with ~")
            out.projects.append(Project(pid, p["name"].strip(), list(dict.fromkeys(w.strip() for w in p["workspaces"]))))
        for b in raw.get("bindings") or []:  # type: ignore[union-attr]
            _need(isinstance(b, dict) and isinstance(b.get("root"), str), "a binding must name a root")
            _need(b["root"].strip() in {r.name for r in roots}, f"a binding names an unknown root: {b['root']}")
            path = bind_path(b.get("path"))
            _need(path, f"a binding's path isn't valid: {b.get('path')}")
            s = scope(b.get("scope"))
            unknown = set(s.projects) - {p.id for p in out.projects}
            _need(not unknown, f"a binding names unknown projects: {', '.join(sorted(unknown))}")
            out.bindings.append(Binding(b["root"].strip(), path, s))  # type: ignore[arg-type]
        _need(not (found := conflicts(out)), "; ".join(found))
    out.rest = {k: v for k, v in raw.items() if k not in ("version", "roots", "projects", "bindings", "isolation", "enabled", "enrich")}  # type: ignore[union-attr]
    return out


def conflicts(config: Config) -> list[str]:
    """Workspaces of two projects, and bindings of one target with different scopes."""
    out, owner, targets = [], {}, {}
    for p in config.projects:
        for w in p.workspaces:
            key = os.path.realpath(os.path.expanduser(w))
            if owner.setdefault(key, p.id) != p.id:
                out.append(f"workspace {w} belongs to {owner[key]} and {p.id}")
    for b in config.bindings:
        target = os.path.normpath(os.path.join(config.root(b.root).path, b.path))
        if not targets.setdefault(target, b).scope.same(b.scope):
            out.append(f"bindings of {target} don't agree")
    return out


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(json.load(f))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"the configuration can't be read: {e}") from e


def to_json(config: Config) -> dict:
    out = {**config.rest, "version": VERSION, "enabled": config.enabled, "isolation": config.isolation}
    out["roots"] = [{"name": r.name, "path": r.configured_path, "writable": r.writable, "exclude": r.exclude} for r in config.roots]
    out["projects"] = [{"id": p.id, "name": p.name, "workspaces": p.workspaces} for p in config.projects]
    out["bindings"] = [{"root": b.root, "path": b.path, "scope": b.scope.to_json()} for b in config.bindings]
    return out | ({"enrich": config.enrich} if config.enrich else {})


def save(config: Config, path: str) -> None:
    """Check again, keep one backup of what was there, and swap in the new file."""
    value = to_json(config)
    parse(value)
    try:
        with open(path, "rb") as old, open(f"{path}.bak", "xb") as new:
            new.write(old.read())
    except (FileNotFoundError, FileExistsError):
        pass
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(temp, path)


def change_root(config: Config, action: str, name: str, path: str = "", exclude: list[str] | None = None) -> None:
    """add, remove, or set_writable (which takes it from any other)."""
    if action == "add":
        _need(name.strip() and name not in {r.name for r in config.roots}, f"the name {name} is taken or empty")
        _need(_absolute(path), "the path must be absolute or begin with ~")
        config.roots.append(Root(name.strip(), path, False, exclude or []))
        return
    root = config.root(name)
    if action == "remove":
        config.roots.remove(root)
        config.bindings[:] = [b for b in config.bindings if b.root != name]
    elif action == "set_writable":
        for r in config.roots:
            r.writable = r is root
    else:
        raise ConfigError(f"unknown action: {action}")


def workspace_project(config: Config, cwd: str) -> str | None:
    """The project with the longest workspace around ``cwd``; raises if two have it."""
    spaces = [(os.path.realpath(os.path.expanduser(x)), p.id) for p in config.projects for x in p.workspaces]
    around = [(len(w), i) for w, i in spaces if inside(os.path.realpath(cwd), w)]
    best = {i for n, i in around if n == max(around)[0]}
    _need(len(best) < 2, "the folder belongs to several projects")
    return best.pop() if best else None


def visible_roots(config: Config, project_ids: list[str] = (), include_shared: bool = False) -> int:
    """How many roots a search can reach: with isolation those with a binding of the projects, or a shared one if asked for."""
    if not config.enabled:
        return 0
    usable = {r.name for r in config.roots if r.exists or r.writable}
    if not config.isolation:
        return len(usable)
    wanted = set(project_ids)
    seen = lambda s: include_shared if s.kind == "shared" else s.kind == "projects" and not wanted.isdisjoint(s.projects)
    return len({b.root for b in config.bindings if b.root in usable and seen(b.scope)})


def project_argument(config: Config, raw: str) -> str:
    """``auto``, ``shared`` or the id of a project, as given to a command."""
    token = raw.strip()
    _need(token, "a project is needed")
    _need(config.isolation, "projects aren't kept apart")
    _need(token in ("auto", "shared") or token in {p.id for p in config.projects}, f"there is no project {token}")
    return token


def scope_argument(config: Config, raw: str) -> list[str]:
    """Further projects to search in: none for ``current``, ``*`` for ``all``, else a list of ids."""
    token = raw.strip()
    _need(token, "a scope is needed")
    _need(config.isolation, "projects aren't kept apart")
    if token in ("current", "all"):
        return ["*"] if token == "all" else []
    ids = [x for x in re.split(r"[,\s]+", token) if x]
    for x in ids:
        _need(x in {p.id for p in config.projects}, f"there is no project {x}")
    return ids


def search_ids(config: Config, project: str | None, extra: list[str] = ()) -> list[str]:
    """The projects that a search sees: the current one and those asked for."""
    if "*" in extra:
        return [p.id for p in config.projects]
    return list(dict.fromkeys([*([project] if project and project != "shared" else []), *extra]))
