from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quernstone import config as C
from quernstone.functions import ids
from quernstone.operators import enrich, ledger, lexical
from quernstone.operators.structured import Compare, TextMatch
from quernstone.plans import assemble
from quernstone.plans.ablation import AblationRunner
from quernstone.plans.engine import Engine, EngineConfig, VectorIndex
from quernstone.sources import scan

FILES = {
    "timeouts.md": "# Timeouts\n\n" + "Reading waits for the read timeout of the client. " * 8 + "timeout=27\n\n## Connect\n\n" + "Connecting has a connect timeout of its own. " * 8,
    "sessions.md": "# Sessions\n\n" + "A session keeps cookies and pools connections. " * 8,
}


def corpus(spark, files):
    d = spark.createDataFrame(list(files.items()), "source_uri string, text string")
    return scan.scan_table(d, F.col("source_uri"), F.col("text"))


def engine(spark, path, **kw):
    return Engine(spark, str(path), EngineConfig(parser="markdown", rules=[enrich.FieldRule("timeout_seconds", r"timeout=(\d+)", "int")], enrichers=("section_prefix", "regex_fields"), dim=64, **kw))


@pytest.mark.filterwarnings("error:index")
def test_incremental_builds_and_queries(spark, tmp_path):
    e = engine(spark, tmp_path)
    assert e.build(corpus(spark, FILES), "b1") == {"ADDED": 2}
    before = {r[0] for r in e.units().select("unit_id").collect()}
    version = e.store.current()["number"]
    assert e.build(corpus(spark, FILES), "b2") == {"UNCHANGED": 2} and e.store.current()["number"] == version
    changed = FILES | {"timeouts.md": FILES["timeouts.md"].replace("27", "30")}
    assert e.build(corpus(spark, changed), "b3") == {"CHANGED": 1, "UNCHANGED": 1}
    after = {r[0] for r in e.units().select("unit_id").collect()}
    assert len(before & after) == len(before) - 1
    assert e.build(corpus(spark, {"sessions.md": FILES["sessions.md"]}), "b4") == {"REMOVED": 1, "UNCHANGED": 1}
    assert {r[0] for r in e.units().select("source_uri").distinct().collect()} == {"sessions.md"}
    assert e.build(corpus(spark, changed), "b5") == {"ADDED": 1, "UNCHANGED": 1}
    q = spark.createDataFrame([("a", "where do sessions keep cookies"), ("b", "timeout seconds greater than 20"), ("c", "compare read timeout versus connect timeout")], "query_id string, query string")
    got = e.query(q, lexicon=["timeout_seconds"], types={"timeout_seconds": "int"}).orderBy("query_id", "rank").collect()
    first = {r["query_id"]: r for r in reversed(got)}
    assert first["a"]["source_uri"] == "sessions.md" and first["a"]["path"] == "lookup"
    assert first["b"]["path"] == "structured" and "timeout=30" in first["b"]["text"] and first["c"]["path"] == "iterative"
    held = e.query(q, lexicon=["timeout_seconds"], types={"timeout_seconds": "int"}, where=TextMatch("source_uri", "sessions"))
    assert {r["source_uri"] for r in held.collect()} <= {"sessions.md"}
    other = engine(spark, tmp_path, max_tokens=64)
    assert other.build(corpus(spark, changed), "b6") == {"RESTAGED": 2}
    assert rows(other.plan(corpus(spark, changed)).select("change").distinct()) == [("UNCHANGED",)]


def test_lookups_and_rounds_are_searched_together(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path)
    e.build(corpus(spark, FILES), "b1")
    q = spark.createDataFrame([("a", "where do sessions keep cookies"), ("c\u00017", "compare read timeout versus connect timeout")], "query_id string, query string")
    searched, search = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda *args: searched.append(args) or search(*args))
    got = rows(e.query(q), "query_id", "path", "rank", "unit_id", "score")
    assert len(searched) == 1 and {(r[0], r[1]) for r in got} == {("a", "lookup"), ("c\u00017", "iterative")}
    e.config.path_top_k = {"lookup": {"bm25": 50, "hash": 50}}
    assert rows(e.query(q), "query_id", "path", "rank", "unit_id", "score") == got and len(searched) == 3


def test_many_structured_questions_with_all_their_rows(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.build(corpus(spark, {f"p{k:02}.md": f"# Page {k}\n\n" + "Reading waits for the read timeout of the client. " * 8 + f"timeout={k}" for k in range(55)}), "b1")
    asked = [(f"q{k:03}", f"timeout seconds greater than {k - 150}") for k in range(205)] + [("z1", "timeout seconds greater than 40"), ("z2", "where is the read timeout")]
    asked = [(q, t.replace("-", "")) for q, t in asked]  # up to 150 twice, distinct ones still more than one block
    many = [(f"m{k:03}", f"timeout seconds less than {k + 300}") for k in range(205)]
    q = spark.createDataFrame(asked + many, "query_id string, query string")
    got = e.query(q, lexicon=["timeout_seconds"], types={"timeout_seconds": "int"}).select("query_id", "path", "rank", "unit_id", "selected").collect()
    mine = lambda k: [r for r in got if r["query_id"] == k]
    assert [len(mine(k)) for k in ("m000", "m204", "z1", "q190")] == [50, 50, 14, 14]
    assert sorted(int(r["selected"]["timeout_seconds"]) for r in mine("z1")) == list(range(41, 55))
    assert [r["rank"] for r in sorted(mine("m007"), key=lambda r: r["unit_id"])] == list(range(1, 51))
    assert {r["path"] for r in mine("z2")} == {"lookup"} and all(r["selected"] is None for r in mine("z2"))


def test_a_build_that_dies_is_resumed(spark, tmp_path, monkeypatch):
    files = {f"p{k}.md": f"# Page {k}\n\n" + f"Reading page {k} waits for the read timeout. " * 8 for k in range(8)}
    e = engine(spark, tmp_path / "s", checkpoint=3)
    real, calls = e._build_batch, []

    def dies(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(*a)

    monkeypatch.setattr(e, "_build_batch", dies)
    with pytest.raises(RuntimeError):
        e.build(corpus(spark, files), "b1")
    first = e.documents().count()
    assert 0 < first < 8
    again = engine(spark, tmp_path / "s", checkpoint=3)
    assert again.build(corpus(spark, files), "b2") == {"ADDED": 8 - first, "UNCHANGED": first}
    whole = engine(spark, tmp_path / "w")
    whole.build(corpus(spark, files), "b1")
    assert rows(again.units(), "unit_id", "surface") == rows(whole.units(), "unit_id", "surface")
    index, fresh = again.lexical_index(), lexical.build(whole.units(), F.col("surface"))
    assert rows(index.terms) == rows(fresh.terms, *index.terms.columns) and (index.n_units, index.mean_length) == (fresh.n_units, fresh.mean_length)
    assert again.surface_problems() == []


def test_kept_index_follows_changes(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.build(corpus(spark, FILES), "b1")
    e.build(corpus(spark, {"timeouts.md": FILES["timeouts.md"].replace("27", "30 seconds"), "new.md": "# New\n\n" + "Something new about proxies. " * 9}), "b2")
    index, fresh = e.lexical_index(), lexical.build(e.units(), F.col("surface"))
    assert rows(index.terms) == rows(fresh.terms, *index.terms.columns) and (index.n_units, index.mean_length) == (fresh.n_units, fresh.mean_length)
    assert e.store.vacuum(1) == 0 and e.store.current()["number"] == 2


def test_other_settings_and_indexes(spark, tmp_path):
    """Latent vectors beside hashed ones, a cache that spares parsing, a log of decisions, an index that fails."""
    e = engine(spark, tmp_path / "s", vectors=(VectorIndex(dim=32), VectorIndex("lsa", "svd_embedding", 4)), decision_log=str(tmp_path / "log"), rerank="noop")
    e.build(corpus(spark, FILES), "b1")
    q = spark.createDataFrame([("a", "where do sessions keep cookies")], "query_id string, query string")
    assert e.query(q).orderBy("rank").first()["source_uri"] == "sessions.md"
    assert [r["path"] for r in spark.read.json(str(tmp_path / "log")).collect()] == ["lookup"]
    parts = len(e.store.parts("segmented"))
    restaged = engine(spark, tmp_path / "s", rerank="noop")
    assert restaged.build(corpus(spark, FILES), "b2") == {"RESTAGED": 2}
    assert restaged.store.read("segmented", restaged.store.parts("segmented")[parts:]).count() == 0
    restaged.config.vectors = (VectorIndex("none", "sentence_transformer"),)
    with pytest.warns(UserWarning, match="index none failed"):
        assert restaged.query(q).orderBy("rank").first()["source_uri"] == "sessions.md"


def test_a_commit_is_all_or_nothing(spark, tmp_path):
    store = ledger.Store(spark, str(tmp_path))
    store.commit({"t": spark.range(2)})
    store.write("t", spark.range(9))  # a build that died before its commit
    assert store.read("t").count() == 2
    store.commit(append={"t": spark.range(3)})
    assert store.read("t").count() == 5 and store.read("none") is None
    with pytest.raises(RuntimeError):
        store._publish(2, "{}")
    assert store.vacuum(1) == 1 and store.read("t").count() == 5


def test_plan_compares_key_sets_both_ways(spark):
    book = spark.createDataFrame([("a", "h", {"parse": "1", "enrich:x": "1"}), ("b", "h", None), ("gone", "h", {})], "document_id string, content_hash string, stage_keys map<string,string>")
    now = spark.createDataFrame([("a", "h"), ("b", "g"), ("new", "h")], "document_id string, content_hash string")
    assert rows(ledger.plan(now, book, {"parse": "1"})) == [("a", "RESTAGED", ["enrich:x"]), ("b", "CHANGED", []), ("gone", "REMOVED", []), ("new", "ADDED", [])]
    assert rows(ledger.plan(now.limit(0), book.limit(0), {})) == []


def test_accounts_hold_failures(spark):
    a = ledger.Accountant()
    with a.measure("parse", cost=0.5, hit=True):
        pass
    with pytest.raises(KeyError), a.measure("parse"):
        raise KeyError
    r = ledger.by_stage(a.runs(spark)).first()
    assert (r["calls"], r["cost"], r["hits"], r["errors"]) == (2, 0.5, 1, 1)
    assert ledger.unaccounted(a.runs(spark), 1e6).first()["accounted_fraction"] < 0.1


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("héllo")
    (tmp_path / "a" / "y.txt").write_text("t")
    (tmp_path / "big.md").write_text("x" * 100)
    got = rows(scan.scan_files(spark, str(tmp_path), ["*.md"], max_bytes=50, metadata={"top": "^([^/]+)/"}), "source_uri", "text", "media_type", "metadata")
    assert got == [("a/x.md", "héllo", "text/markdown", {"top": "a"})]
    g = tmp_path / "g.jsonl"
    g.write_text('{"_meta": {"v": 1}}\n\n# note\n{"id": "q", "query": "x", "relevant": [{"document_id": "d", "span": [0, 3], "weight": 2}], "origin": "human"}\n')
    golden = scan.read_golden(spark, str(g))
    assert golden.count() == 1 and golden.first()["relevant"][0]["span"] == [0, 3]
    scan.write_golden(golden, str(tmp_path / "out"))
    assert rows(scan.read_golden(spark, str(tmp_path / "out")), "query_id", "origin") == [("q", "human")]
    assert scan.golden_meta(spark, str(g)) == {"v": 1} and scan.golden_meta(spark, str(tmp_path / "out")) == {}
    scan.write_golden(golden, str(tmp_path / "out2"), {"v": 2})
    assert scan.golden_meta(spark, str(tmp_path / "out2")) == {"v": 2} and scan.read_golden(spark, str(tmp_path / "out2")).count() == 1
    blobs = spark.createDataFrame([(bytearray(b"a"), "t"), (bytearray(b"a"), "t"), (None, "t"), (bytearray(b"b"), None)], "content binary, media_type string")
    assert sorted(r["uri"].split("?")[1] for r in scan.artifacts(blobs).collect()) == ["type=application/octet-stream", "type=t"]
    both = scan.concatenated(scan.scan_files(spark, str(tmp_path), ["*.md"]).select("document_id"), spark.createDataFrame([("zz",)], "document_id string"), limit=2)
    assert both.count() == 2


def test_stream_into_store(spark, tmp_path):
    from quernstone.streaming import ingest

    src = tmp_path / "in"
    rows_ = corpus(spark, FILES).select(*ingest.CORPUS).withColumn("arrived_at", F.lit("2024-01-01").cast("timestamp"))
    rows_.write.parquet(str(src))
    stream = spark.readStream.schema(rows_.schema).parquet(str(src))
    e = engine(spark, tmp_path / "store")
    ingest.start(stream, e, str(tmp_path / "cp")).awaitTermination(120)
    assert e.documents().count() == 2
    gone = rows_.limit(1).withColumns({"text": F.lit(None).cast("string"), "arrived_at": F.lit("2024-01-02").cast("timestamp")})
    gone.write.mode("append").parquet(str(src))
    number = e.store.current()["number"]
    ingest.start(stream, e, str(tmp_path / "cp")).awaitTermination(120)
    assert e.documents().count() == 1 and e.store.current()["number"] == number + 1


@pytest.mark.filterwarnings("error:index")
def test_assembled_from_a_file(spark, tmp_path):
    """A folder of files and a YAML file: build, questions on every path, an override that needs a rebuild, what is wrong or doubtful."""
    (tmp_path / "docs").mkdir()
    for name, text in FILES.items():
        (tmp_path / "docs" / name).write_text(text)
    (tmp_path / "base.yaml").write_text("""
paths: {store: ./unused}
ingestion:
  parse: {routes: [{when: {media_type: text/markdown}, impl: markdown}], default: {impl: text}}
  segment: {impl: structural, max_tokens: 200}
  enrich:
    enrichers:
      - {impl: section_prefix}
      - {impl: regex_fields, params: {fields: {timeout_seconds: {pattern: 'timeout=(\\d+)', type: int}}}}
  index: {indexes: [{name: words, impl: bm25}, {name: dense, impl: hash_embedding, params: {dim: 32}}, {name: fields, impl: structured}]}
query:
  route: {impl: rules, paths: {structured: {targets: [fields]}, lookup: {targets: [words, dense], top_k: {words: 5}}, iterative: {targets: [words], step_budget: 2}}}
  fuse: {impl: rrf, k: 10, weights: {words: 2.0}}
  rerank: {impl: lexical_overlap}
""")
    (tmp_path / "own.yaml").write_text(f"extends: base.yaml\npaths: {{store: {tmp_path}/store}}\ncorpus: {{sources: [{{impl: filesystem, params: {{root: {tmp_path}/docs, include: ['**/*.md']}}}}]}}\n")
    a = assemble.assemble(spark, str(tmp_path / "own.yaml"))
    assert a.warnings == [] and a.engine.config.path_top_k["lookup"] == {"bm25": 5, "dense": 50} and a.engine.config.weights == {"bm25": 2.0}
    assert a.build("b1") == {"ADDED": 2}
    q = spark.createDataFrame([("a", "where do sessions keep cookies"), ("b", "timeout seconds greater than 20"), ("c", "compare read timeout versus connect timeout")], "query_id string, query string")
    got = {r["query_id"]: r for r in a.query(q).filter("rank = 1").collect()}
    assert {k: r["path"] for k, r in got.items()} == {"a": "lookup", "b": "structured", "c": "iterative"} and got["a"]["source_uri"] == "sessions.md"
    changes = {"ingestion.index.indexes[dense].params.dim": 16, "ingestion.index.indexes[0].impl": "bm25_memory"}
    b = assemble.assemble(spark, str(tmp_path / "own.yaml"), changes)
    assert C.needs_rebuild(changes) and b.build("b2") == {"RESTAGED": 2} and len(b.engine.vectors("dense").first()["vector"]) == 16
    assert assemble.check(str(tmp_path / "own.yaml")) == 0
    off = C.overridden(C.load(str(tmp_path / "own.yaml")), {"ingestion.index.indexes[1].enabled": False, "query.rerank.enabled": False, "ingestion.enrich.enrichers[1].enabled": False, "eval": {"k_values": [10]}})
    assert len(C.warnings(off)) == 4
    for wrong in ({"ingestion.segment.impl": "none"}, {"query.route.paths.lookup.targets": ["x"]}, {"ingestion.index.indexes[9].impl": "bm25"}, {"ingestion.index.indexes[none]": {}}):
        with pytest.raises(C.ConfigError):
            assemble.assemble(spark, str(tmp_path / "own.yaml"), wrong)
    assert C.overridden({"l": [1, {"name": "n"}]}, {"l[n]": 5, "l[0]": 2}) == {"l": [2, 5]}


BASE = {"ingestion": {"index": {"indexes": [{"name": "bm25", "impl": "bm25"}, {"name": "s", "impl": "structured"}]}}, "query": {"route": {"paths": {p: {"targets": ["s" if p == "structured" else "bm25"]} for p in ("structured", "lookup", "iterative")}}}}


def test_config(tmp_path):
    assert C.problems(BASE) == []
    bad = C.overridden(BASE, {"query.route.paths.lookup.step_budget": 2, "query.route.paths.structured.targets": ["bm25"], "query.fuse.params.weights": {"x": 1}})
    assert len(C.problems(bad)) == 3 and "step_budget" not in BASE["query"]["route"]["paths"]["lookup"]
    assert C.overridden(BASE, {"ingestion.index.indexes[bm25].impl": "other"})["ingestion"]["index"]["indexes"][0]["impl"] == "other"
    assert C.merged({"a": {"x": 1, "l": [1, 2]}, "b": 1}, {"a": {"l": [3]}}) == {"a": {"x": 1, "l": [3]}, "b": 1}
    assert C.interpolated({"a": "${env:X:d}/${b.c}", "b": {"c": "z"}}, {}) == {"a": "d/z", "b": {"c": "z"}}
    with pytest.raises(C.ConfigError):
        C.interpolated({"a": "${a}"}, {})
    assert C.redacted({"api_key": "s", "max_tokens": 5, "auth_token": "t"}) == {"api_key": "***", "max_tokens": 5, "auth_token": "***"}
    (tmp_path / "a.json").write_text('{"extends": "b.json", "x": 1}')
    (tmp_path / "b.json").write_text('{"x": 0, "y": 2}')
    assert C.load(str(tmp_path / "a.json")) == {"x": 1, "y": 2}
    (tmp_path / "b.json").write_text('{"extends": "a.json"}')
    with pytest.raises(C.ConfigError):
        C.load(str(tmp_path / "a.json"))
    assert C.needs_rebuild({"ingestion.segment": 1}) and not C.needs_rebuild({"query.fuse": 1})
    C.register("fuse", "mine", dict)
    with pytest.raises(C.ConfigError):
        C.register("fuse", "mine", dict)
    assert C.create("fuse", "mine", {"k": 1}) == {"k": 1}
    assert ids.config_hash({"a": 1}) != ids.config_hash({"a": 2})
    assert Compare("a", "eq", 1) == Compare("a", "eq", 1)


def test_ablation(spark, tmp_path):
    """Three arms over one corpus: two share a store, one is segmented otherwise, one fails and doesn't end the others."""
    (tmp_path / "docs").mkdir()
    for name, text in FILES.items():
        (tmp_path / "docs" / name).write_text(text)
    base = C.merged(BASE, {"corpus": {"sources": [{"impl": "filesystem", "params": {"root": str(tmp_path / "docs")}}]}, "ingestion": {"parse": {"default": {"impl": "markdown"}}, "enrich": {"enrichers": [{"impl": "section_prefix"}, {"impl": "regex_fields", "params": {"fields": {"timeout_seconds": {"pattern": r"timeout=(\d+)", "type": "int"}}}}]}}, "query": {"rerank": {"impl": "lexical_overlap"}}})
    one = assemble.assemble(spark, C.merged(base, {"paths": {"store": str(tmp_path / "probe")}}))
    one.build()
    gold_units = {r["source_uri"]: r for r in one.engine.units().filter("ordinal = 0").collect()}
    questions = spark.createDataFrame([("a", "where do sessions keep cookies", "factual", "cookies", "text"), ("b", "how many have timeout seconds greater than 20", "structured", None, None)], "query_id string, query string, query_type string, answer string, answer_type string")
    g = gold_units["sessions.md"]
    gold = spark.createDataFrame([("a", g["document_id"], g["span_start"], g["span_end"], 3)], "query_id string, document_id string, span_start int, span_end int, weight int")
    runner = AblationRunner(spark, base, str(tmp_path / "work"))
    scored = runner.run({"base": {}, "no rerank": {"query.rerank.impl": "noop"}, "windows": {"ingestion.segment": {"impl": "fixed_window"}}, "broken": {"query.fuse.impl": "none"}}, questions, gold)
    assert set(runner.errors) == {"broken"} and scored.count() == 6 and len(list((tmp_path / "work").iterdir())) == 2
    got = {(r["arm"], r["query_id"]): r for r in scored.collect()}
    assert got["base", "a"]["reciprocal_rank"] == 1.0 and got["base", "a"]["correct"] and got["base", "b"]["route_correct"] and not got["base", "b"]["failed"] and got["base", "b"]["recall_5"] is None
    report = {r["arm"]: r for r in runner.report(scored, "base").collect()}
    assert report["base"]["d_failure_rate"] == 0.0 and report["no rerank"]["recall_20"] == 1.0
