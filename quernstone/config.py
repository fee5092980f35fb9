"""Configuration: overlays, interpolation, overrides, redaction, checks, and a registry of implementations. Driver-side only."""

from __future__ import annotations

import copy
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import fields, is_dataclass
from typing import Any

STAGES = ("corpus", "parse", "segment", "enrich", "index", "route", "retrieve", "fuse", "rerank", "judge", "bootstrap", "embed", "cache")
SECRET = re.compile(r"(^|_)(api_?key|access_?key|secret|password|credential|credentials|auth_?token|access_?token|bearer_?token|token)$", re.I)
#: What kind of index an implementation is.
KINDS = {"bm25": "lexical", "bm25_memory": "lexical", "hash_embedding": "dense", "svd_embedding": "dense", "sentence_transformer": "dense", "structured": "structured", "sqlite": "structured"}
_REGISTRY: dict[tuple[str, str], tuple[str, Callable[..., Any], type | None]] = {}


class ConfigError(ValueError):
    pass


def register(stage: str, name: str, make: Callable[..., Any], version: str = "1", params: type | None = None) -> None:
    """Name an implementation; a name can be taken once."""
    if stage not in STAGES:
        raise ConfigError(f"no stage {stage!r}")
    if (stage, name) in _REGISTRY:
        raise ConfigError(f"{stage}/{name} is registered already")
    _REGISTRY[stage, name] = (version, make, params)


def registered(stage: str) -> list[str]:
    """The names of a stage's implementations."""
    return sorted(n for s, n in _REGISTRY if s == stage)


def discover(group: str = "quernstone.plugins") -> list[str]:
    """Call what installed packages offer in an entry-point group, which is to register() implementations; returns their names."""
    from importlib.metadata import entry_points

    found = list(entry_points(group=group))
    for e in found:
        e.load()()
    return [e.name for e in found]


def create(stage: str, name: str, given: Mapping[str, Any] | None = None) -> Any:
    """An implementation with checked parameters; an unknown one is refused."""
    if (stage, name) not in _REGISTRY:
        raise ConfigError(f"no {stage}/{name}; there are: {', '.join(registered(stage))}")
    _, make, params = _REGISTRY[stage, name]
    given = dict(given or {})
    if params is not None and is_dataclass(params):
        if extra := set(given) - {f.name for f in fields(params)}:
            raise ConfigError(f"{stage}/{name}: unknown {', '.join(sorted(extra))}")
        return make(**vars(params(**given)))
    return make(**given)


def merged(base: Any, over: Any) -> Any:
    """OVER laid over BASE: mappings merge, all else, lists too, replaces."""
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return {k: merged(base[k], over[k]) if k in base and k in over else copy.deepcopy(over.get(k, base.get(k))) for k in [*base, *(k for k in over if k not in base)]}
    return copy.deepcopy(over)


def load(path: str, read: Callable[[str], Mapping[str, Any]] | None = None, _seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A YAML (or JSON) file over what it extends; a cycle is refused."""
    full = os.path.abspath(path)
    if full in _seen:
        raise ConfigError("extends in a circle: " + " > ".join([*_seen, full]))
    own = dict((read or _read)(full))
    base = own.pop("extends", None)
    return merged(load(os.path.join(os.path.dirname(full), base), read, (*_seen, full)), own) if base else own


def _read(path: str) -> Mapping[str, Any]:
    with open(path) as f:
        try:
            import yaml
        except ImportError:
            import json

            return json.load(f)
        return yaml.safe_load(f) or {}


def at(config: Mapping[str, Any], path: str) -> Any:
    """The value at a dotted path; name[key] takes from a mapping, or the entry of a list whose name is key."""
    here: Any = config
    for part in re.findall(r"[^.\[\]]+|\[[^\]]*\]", path):
        key = part.strip("[]")
        here = here[_entry(here, key, path)] if isinstance(here, list) else here[key]
    return here


def interpolated(config: Mapping[str, Any], env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """${env:NAME}, ${env:NAME:default} and ${dotted.path} replaced; a name that isn't there is refused."""
    env = os.environ if env is None else env

    def one(m: re.Match, seen: tuple[str, ...]) -> str:
        name = m[1]
        if name.startswith("env:"):
            key, _, default = name[4:].partition(":")
            if key not in env and ":" not in name[4:]:
                raise ConfigError(f"{key} is not set")
            return env.get(key, default)
        if name in seen:
            raise ConfigError(f"{name} refers to itself")
        try:
            return str(walk(at(config, name), (*seen, name)))
        except (KeyError, TypeError, ConfigError) as e:
            raise ConfigError(f"no {name}") from e

    def walk(x: Any, seen: tuple[str, ...] = ()) -> Any:
        if isinstance(x, Mapping):
            return {k: walk(v, seen) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, seen) for v in x]
        return re.sub(r"\$\{([^}]+)\}", lambda m: one(m, seen), x) if isinstance(x, str) else x

    return walk(config)


def _entry(entries: list, key: str, path: str) -> int:
    """The place of a list's entry given by its number or its name."""
    if re.fullmatch(r"-?\d+", key):
        if not -len(entries) <= int(key) < len(entries):
            raise ConfigError(f"{path}: no entry {key}")
        return int(key)
    found = [k for k, x in enumerate(entries) if isinstance(x, Mapping) and x.get("name") == key]
    if not found:
        raise ConfigError(f"{path}: no {key}")
    return found[0]


def overridden(config: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """A copy with values set at dotted paths; a list's entry is named by [name] or numbered by [0], also as the last of the path. The original
    stays as it is."""
    out = copy.deepcopy(dict(config))
    for path, value in changes.items():
        *way, last = (p.strip("[]") for p in re.findall(r"[^.\[\]]+|\[[^\]]*\]", path))
        here: Any = out
        for key in way:
            here = here[_entry(here, key, path)] if isinstance(here, list) else here.setdefault(key, {})
        here[_entry(here, last, path) if isinstance(here, list) else last] = copy.deepcopy(value)
    return out


def redacted(config: Any) -> Any:
    """Config with secrets masked. max_tokens and the like are no secrets."""
    if isinstance(config, Mapping):
        return {k: "***" if SECRET.search(str(k)) and not isinstance(v, (Mapping, list)) else redacted(v) for k, v in config.items()}
    return [redacted(v) for v in config] if isinstance(config, list) else config


def problems(config: Mapping[str, Any]) -> list[str]:
    """What makes a configuration unusable: repeated index names, missing paths, targets or weights that name no index, a lookup path of
    several steps, a structured path without a structured index."""
    out = []
    indexes = config.get("ingestion", {}).get("index", {}).get("indexes", [])
    names = [i.get("name") for i in indexes]
    out += [f"index {n} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    paths = config.get("query", {}).get("route", {}).get("paths", {})
    out += [f"path {p} is missing" for p in ("structured", "lookup", "iterative") if p not in paths]
    for p, spec in paths.items():
        out += [f"path {p}: no index {t}" for t in spec.get("targets", []) if t not in names]
    if paths.get("lookup", {}).get("step_budget", 1) != 1:
        out.append("lookup takes one step")
    kinds = {i.get("name"): i.get("impl") for i in indexes}
    if "structured" in paths and not any(KINDS.get(kinds.get(t)) == "structured" for t in paths["structured"].get("targets", [])):
        out.append("the structured path has no structured index")
    fuse = config.get("query", {}).get("fuse", {})
    out += [f"weight for {n}, which is no index" for n in {**fuse.get("weights", {}), **fuse.get("params", {}).get("weights", {})} if n not in names]
    return out


def warnings(config: Mapping[str, Any]) -> list[str]:
    """What is allowed but seldom meant: enrichment off, half of hybrid search, no reranking, a structured path whose fields nothing extracts,
    weights of indexes that are off, metrics without the fifth rank."""
    ingestion, query = config.get("ingestion", {}), config.get("query", {})
    enrich, out = ingestion.get("enrich", {}), []
    on = lambda part: part.get("enabled", True)
    enrichers = [e for e in enrich.get("enrichers", []) if on(e)] if on(enrich) else []
    if not enrichers:
        out.append("enrich is off: units are indexed without context")
    indexes = [i for i in ingestion.get("index", {}).get("indexes", []) if on(i)]
    kinds = {i.get("kind") or KINDS.get(i.get("impl"), i.get("impl")) for i in indexes}
    if not {"dense", "lexical"} <= kinds:
        out.append(f"indexes cover {sorted(map(str, kinds))}: hybrid search needs a dense and a lexical one")
    rerank = query.get("rerank", {})
    if not on(rerank) or rerank.get("impl", "noop") == "noop":
        out.append("rerank is off")
    if on(query.get("route", {})) and "structured" in query.get("route", {}).get("paths", {}) and "structured" in kinds and not any(e.get("params", {}).get("fields") for e in enrichers):
        out.append("no enricher extracts fields: the structured path has nothing to answer from")
    idle = set(query.get("fuse", {}).get("weights", {})) - {i.get("name") for i in indexes}
    if idle:
        out.append(f"weights of indexes that are off have no effect: {', '.join(sorted(idle))}")
    if 5 not in config.get("eval", {}).get("k_values", [5]):
        out.append("eval.k_values lacks 5")
    return out


def needs_rebuild(changes: Mapping[str, Any]) -> bool:
    """Whether changed settings touch what is built, not only how it is asked."""
    return any(c.split(".")[0].split("[")[0] in ("corpus", "ingestion", "cache") for c in changes)
