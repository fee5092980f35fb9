"""From a configuration to documents and an engine. Every stage is looked up in the registry, where further ones can be named."""

from __future__ import annotations

import sys
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import config as C
from quernstone.operators import enrich
from quernstone.plans.engine import Engine, EngineConfig, VectorIndex
from quernstone.session import table
from quernstone.sources import scan


def _register() -> None:
    stage = lambda name, *impls: [C.register(name, i, lambda i=i, **params: (i, params)) for i in impls if i not in C.registered(name)]
    stage("corpus", "filesystem", "table")
    stage("parse", "text", "markdown", "rst", "passthrough")
    stage("segment", "structural", "fixed_window", "whole_document")
    stage("enrich", "section_prefix", "extractive_context", "regex_fields")
    stage("index", *C.KINDS)
    stage("route", "rules", "passthrough")
    stage("retrieve", "parallel")
    stage("fuse", "rrf", "concat")
    stage("rerank", "lexical_overlap", "cross_encoder", "noop")


_register()


@dataclass
class Assembled:
    """What a configuration stands for."""

    config: dict[str, Any]
    engine: Engine
    lexicon: list[str]
    types: dict[str, str]
    warnings: list[str] = field(default_factory=list)

    def documents(self) -> DataFrame:
        return corpus(self.engine.spark, self.config)

    def build(self, build_id: str = "") -> dict[str, int]:
        return self.engine.build(self.documents(), build_id)

    def query(self, queries: DataFrame, **given: Any) -> DataFrame:
        return self.engine.query(queries, lexicon=self.lexicon, types=self.types, **given)


def _on(part: Mapping[str, Any]) -> bool:
    return part.get("enabled", True)


def corpus(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """The documents of all sources, in their order; a document of several is that of the first."""
    parts = []
    for s in config.get("corpus", {}).get("sources", []):
        impl, p = C.create("corpus", s["impl"], s.get("params"))
        if impl == "filesystem":
            d = scan.scan_files(spark, p["root"], [g.removeprefix("**/") for g in p.get("include", ["*"])], p.get("exclude", []), s.get("namespace", ""), p.get("max_bytes", scan.MAX_BYTES), p.get("metadata"))
        else:
            d = scan.scan_table(table(spark, p["folder"], p["table"]), F.expr(p["uri"]), F.col(p.get("text", "text")), s.get("namespace", ""), p.get("metadata", []))
        parts.append(d.select("document_id", "source_uri", "text", "content_hash", "media_type", "size"))
    if not parts:
        raise C.ConfigError("corpus has no sources")
    every = scan.concatenated(*parts) if len(parts) == 1 else scan.first_of_each(*parts)
    return every


def _holds(when: Mapping[str, Any]) -> Column:
    """A route's condition on documents."""
    out = F.lit(True)
    for key, value in when.items():
        size = F.octet_length("text")
        out = out & (F.col("media_type") == value if key == "media_type" else F.lower("source_uri").endswith(str(value).lower()) if key == "extension" else size <= value if key == "max_bytes" else size >= value if key == "min_bytes" else F.lit(False))
    return out


def settings(config: Mapping[str, Any]) -> tuple[EngineConfig, list[str], dict[str, str]]:
    """The engine's settings, the fields questions may name, and their types."""
    ingestion, query = config.get("ingestion", {}), config.get("query", {})
    parse, segment, enriching = ingestion.get("parse", {}), ingestion.get("segment", {}), ingestion.get("enrich", {})
    name = lambda stage, part, default: C.create(stage, part.get("impl", default), part.get("params"))[0]
    routes = [(_holds(r["when"]), C.create("parse", r["impl"])[0]) for r in parse.get("routes", [])] if _on(parse) else []
    enrichers, rules = [], []
    for e in enriching.get("enrichers", []) if _on(enriching) else []:
        if not _on(e):
            continue
        impl, params = C.create("enrich", e["impl"], e.get("params"))
        enrichers.append(impl)
        rules += [enrich.FieldRule(n, f["pattern"], f.get("type", "str"), f.get("group", 1)) for n, f in params.get("fields", {}).items()]
    lexical, vectors = False, []
    for i in ingestion.get("index", {}).get("indexes", []):
        impl, params = C.create("index", i["impl"], i.get("params"))
        if not _on(i):
            continue
        lexical = lexical or C.KINDS[impl] == "lexical"
        if C.KINDS[impl] == "dense":
            vectors.append(VectorIndex(i["name"], impl, params.get("dim", 256), params.get("model")))
    names = {i["name"]: "bm25" if C.KINDS.get(i["impl"]) == "lexical" else i["name"] for i in ingestion.get("index", {}).get("indexes", [])}
    fuse, rerank, routing = query.get("fuse", {}), query.get("rerank", {}), query.get("route", {})
    paths = routing.get("paths", {})
    most = query.get("retrieve", {}).get("default_top_k", 50)
    top = {p: {names[t]: spec.get("top_k", {}).get(t, most) for t in spec.get("targets", [])} for p, spec in paths.items()}
    types = {r.name: r.kind for r in rules}
    c = EngineConfig(
        parser=name("parse", parse.get("default", {}), "text") if _on(parse) else "passthrough", routes=routes, segmenter=name("segment", segment, "structural") if _on(segment) else "whole_document", max_tokens=segment.get("max_tokens", 512),
        rules=rules, enrichers=tuple(enrichers), lexical=lexical, vectors=tuple(vectors), fuse=name("fuse", fuse, "rrf") if _on(fuse) else "concat", rrf_k=fuse.get("k", 60), weights={names[k]: v for k, v in fuse.get("weights", {}).items()},
        candidates=most, path_top_k=top, rerank=name("rerank", rerank, "noop") if rerank and _on(rerank) else "noop", rerank_k=rerank.get("top_k_in", rerank.get("top_k", 20)), top_k=query.get("top_k", 10), step_budget=paths.get("iterative", {}).get("step_budget", 3),
        routed=_on(routing) and name("route", routing, "rules") == "rules", decision_log=routing.get("decision_log"), checkpoint=ingestion.get("checkpoint_documents"),
    )
    return c, list(types) if any(C.KINDS.get(i["impl"]) == "structured" and _on(i) for i in ingestion.get("index", {}).get("indexes", [])) else [], types


def assemble(spark: SparkSession, config: Mapping[str, Any] | str, overrides: Mapping[str, Any] | None = None) -> Assembled:
    """A configuration, or the path of its file, as an engine over its store. What makes it unusable is raised, all at once."""
    held = C.interpolated(C.overridden(C.load(config) if isinstance(config, str) else config, overrides or {}))
    if wrong := C.problems(held):
        raise C.ConfigError("; ".join(wrong))
    made, lexicon, types = settings(held)
    return Assembled(held, Engine(spark, held["paths"]["store"], made), lexicon, types, C.warnings(held))


def check(path: str) -> int:
    """Print what is wrong with a configuration file and what is doubtful; 1 if it can't be used."""
    try:
        held = C.interpolated(C.load(path))
        wrong = C.problems(held)
        if not wrong:
            settings_problems(held)
    except C.ConfigError as e:
        wrong = [str(e)]
    for text in wrong:
        print(f"error: {text}")
    for text in C.warnings(held) if not wrong else []:
        print(f"warning: {text}")
    if not wrong:
        print("usable")
    return int(bool(wrong))


def settings_problems(config: Mapping[str, Any]) -> None:
    """Raise for stages and parameters that don't exist, without a session."""
    ingestion, query = config.get("ingestion", {}), config.get("query", {})
    for stage, part in (("segment", ingestion.get("segment", {})), ("fuse", query.get("fuse", {})), ("rerank", query.get("rerank", {})), ("route", query.get("route", {}))):
        if "impl" in part:
            C.create(stage, part["impl"])
    for stage, parts in (("corpus", config.get("corpus", {}).get("sources", [])), ("parse", ingestion.get("parse", {}).get("routes", [])), ("enrich", ingestion.get("enrich", {}).get("enrichers", [])), ("index", ingestion.get("index", {}).get("indexes", []))):
        for part in parts:
            C.create(stage, part["impl"], part.get("params"))


if __name__ == "__main__":
    sys.exit(max(map(check, sys.argv[1:]), default=0))
