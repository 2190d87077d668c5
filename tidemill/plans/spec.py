"""Pipeline documents: loading, variables, profiles, includes, and checks."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from tidemill.errors import ConfigurationError

MOST_BYTES = 1 << 20
DEEPEST_INCLUDE = 5


class _Loader(yaml.SafeLoader):
    """YAML in which only ``true`` and ``false`` are booleans."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def merged(base, over):
    """Mappings merged in depth; anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merged(base.get(k), v) for k, v in over.items()}
    return over


def _filled(value, variables: dict):
    if isinstance(value, dict):
        return {k: _filled(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        name, default = m[1], m[2]
        if name.startswith("var."):
            if name[4:] in variables:
                return str(variables[name[4:]])
        elif name in os.environ:
            return os.environ[name]
        elif not re.fullmatch(r"[A-Z_][A-Z0-9_]*", name):
            return m[0]  # filled in when steps run
        if default is None:
            raise ConfigurationError(f"${{{name}}} has no value")
        return default

    return re.sub(r"\$\{([\w.]+)(?::-([^}]*))?\}", one, value)


def load_document(path: str | Path, profile: str | None = None, settings: dict | None = None, _depth: int = 0) -> dict:
    """A YAML or JSON document with its includes, profile, ``a.b=c`` settings and variables filled in."""
    path = Path(path)
    if _depth > DEEPEST_INCLUDE:
        raise ConfigurationError(f"includes are at most {DEEPEST_INCLUDE} deep")
    if path.stat().st_size > MOST_BYTES:
        raise ConfigurationError(f"{path} is larger than {MOST_BYTES} bytes")
    text = path.read_text(encoding="utf-8")
    document = json.loads(text) if path.suffix == ".json" else yaml.load(text, _Loader)  # noqa: S506
    if not isinstance(document, dict):
        raise ConfigurationError(f"{path} holds no mapping")
    base: dict = {}
    for name in document.pop("include", []):
        base = merged(base, load_document(path.parent / name, _depth=_depth + 1))
    document = merged(base, document)
    if _depth:
        return document
    profiles = document.pop("profiles", {})
    if profile is not None:
        if profile not in profiles:
            raise ConfigurationError(f"no profile {profile!r}")
        document = merged(document, profiles[profile])
    for key, value in (settings or {}).items():
        at = document
        *parents, last = key.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = yaml.load(value, _Loader) if isinstance(value, str) else value  # noqa: S506
    return _filled(document, document.get("variables", {}))


_TASK_KEYS = {"id", "type", "depends_on", "source", "transformations", "validation", "destination", "rejects", "extraction", "condition", "on_failure", "retry", "timeout", "statement", "mode", "description", "enabled"}


@dataclass
class TaskSpec:
    """One task: source, chain, validation and destination."""

    id: str
    type: str = "etl"
    depends_on: list = field(default_factory=list)
    source: dict | None = None
    transformations: list = field(default_factory=list)
    validation: dict = field(default_factory=dict)
    destination: dict | None = None
    rejects: dict | None = None
    extraction: dict = field(default_factory=dict)
    condition: str | None = None
    on_failure: str = "fail"
    retry: dict | None = None
    timeout: float | None = None
    statement: str | None = None


@dataclass
class PipelineSpec:
    """A named graph of tasks."""

    name: str
    tasks: list[TaskSpec]
    params: dict = field(default_factory=dict)
    parallelism: int = 4


def parse_pipeline(document: dict) -> PipelineSpec:
    """A checked pipeline of a document."""
    body = document.get("pipeline", document)
    if not body.get("name") or not body.get("tasks"):
        raise ConfigurationError("a pipeline has a name and tasks")
    tasks, seen = [], set()
    for t in body["tasks"]:
        extra = set(t) - _TASK_KEYS
        if extra:
            raise ConfigurationError(f"task {t.get('id')!r} has unknown keys {sorted(extra)}")
        if not t.get("id") or t["id"] in seen:
            raise ConfigurationError(f"task ids are given and unique: {t.get('id')!r}")
        seen.add(t["id"])
        known = {k: v for k, v in t.items() if k in TaskSpec.__dataclass_fields__}
        task = TaskSpec(**known)
        if task.type not in ("etl", "sql", "noop"):
            raise ConfigurationError(f"task {task.id!r}: type is etl, sql or noop")
        if task.type == "etl" and (not task.source or not task.destination):
            raise ConfigurationError(f"task {task.id!r} needs a source and a destination")
        if task.on_failure not in ("fail", "continue"):
            raise ConfigurationError("on_failure is fail or continue")
        tasks.append(task)
    for t in tasks:
        missing = set(t.depends_on) - seen
        if missing:
            raise ConfigurationError(f"task {t.id!r} depends on unknown {sorted(missing)}")
    return PipelineSpec(body["name"], tasks, body.get("params", {}), body.get("parallelism", 4))


def levels(tasks: list[TaskSpec]) -> list[list[TaskSpec]]:
    """Tasks in levels: each depends only on earlier levels."""
    left, done, out = {t.id: t for t in tasks}, set(), []
    while left:
        ready = [t for t in left.values() if set(t.depends_on) <= done]
        if not ready:
            raise ConfigurationError(f"tasks depend on each other in a circle: {sorted(left)}")
        out.append(sorted(ready, key=lambda t: t.id))
        done |= {t.id for t in ready}
        for t in ready:
            del left[t.id]
    return out
