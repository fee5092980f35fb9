"""The engine: incremental builds of a store of appended parts, and whole batches of questions answered in one job.

Every row of a build's tables carries the number of its build, and the ledger, a journal of documents, says which build a document is live in.
So an increment only appends: rows of documents that were replaced or removed stay until a merge, and reading leaves them out by one join
with the ledger. The lexical index is kept with the build: units' tokens, and signed deltas of the terms' and lengths' statistics. A build
commits after each CHECKPOINT of its documents; one that dies leaves what it committed, and the next plan finds the rest still to do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import ids
from quernstone.functions.text import quick_fold, tokens
from quernstone.operators import dense, enrich, ledger, lexical, parse, retrieve, route, segment, structured
from quernstone.session import cut, passes
from quernstone.sources import scan


@dataclass
class VectorIndex:
    """A vector index over the units' surfaces: hashed features, latent semantics, or a model given as functions of texts to rows."""

    name: str = "hash"
    impl: str = "hash_embedding"
    dim: int = 256
    model: Callable | None = None
    #: Latent semantics are fitted anew when the units have become more or fewer by this share since the last fit.
    refit: float = 0.1


@dataclass
class EngineConfig:
    parser: str = "text"
    routes: list = field(default_factory=list)
    segmenter: str = "structural"
    max_tokens: int = 512
    rules: list[enrich.FieldRule] = field(default_factory=list)
    enrichers: tuple[str, ...] = ("section_prefix",)
    dim: int = 256
    lexical: bool = True
    vectors: tuple[VectorIndex, ...] | None = None
    fuse: str = "rrf"
    rrf_k: int = 60
    weights: dict[str, float] = field(default_factory=dict)
    candidates: int = 50
    path_top_k: dict[str, dict[str, int]] = field(default_factory=dict)
    rerank: str = "lexical_overlap"
    rerank_k: int = 20
    score_pairs: Callable | None = None
    top_k: int = 10
    step_budget: int = 3
    routed: bool = True
    decision_log: str | None = None
    #: Whether parsed and segmented documents are kept for later builds.
    cache: bool = True
    #: Documents in one commit of a build; None for all in one.
    checkpoint: int | None = None

    def indexes(self) -> tuple[VectorIndex, ...]:
        return (VectorIndex(dim=self.dim),) if self.vectors is None else self.vectors

    def keys(self) -> dict[str, str]:
        return ledger.stage_keys({
            "parse": {"parser": self.parser, "routes": [str(r) for r in self.routes]}, "segment": {"segmenter": self.segmenter, "max_tokens": self.max_tokens},
            "enrich": {e: {"rules": [vars(r) for r in self.rules] if e == "regex_fields" else []} for e in self.enrichers},
            "index": ({"bm25": {}} if self.lexical else {}) | {v.name: {"impl": v.impl, "dim": v.dim} for v in self.indexes()} | {"structured": {}},
        })


LEDGER = "document_id string, source_uri string, content_hash string, unit_ids array<string>, stage_keys map<string,string>, build_id string, build bigint"
FIELDS = "map<string,string>"
#: Distinct structured queries that one reading of the records answers.
STRUCTURED_BLOCK = 50
#: Parts of a table beyond which it is merged into one.
PARTS = 16


class Engine:
    """build() brings the store to a corpus, doing anew only what the plan says; query() answers a batch from the committed version."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None) -> None:
        self.spark, self.config = spark, config or EngineConfig()
        self.store = ledger.Store(spark, path)
        self.accountant = ledger.Accountant()

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """The ledger: the last row of each document that is live."""
        journal = self.store.read("ledger")
        return self._empty(LEDGER) if journal is None else ledger.latest(journal, "build").filter("content_hash is not null").select(*[c.split(" ")[0] for c in LEDGER.split(", ")])

    def _live(self, name: str) -> DataFrame | None:
        """A table's rows of live documents."""
        held = self.store.read(name)
        return None if held is None else held.join(self.documents().select("document_id", "build"), ["document_id", "build"], "left_semi")

    def units(self) -> DataFrame | None:
        return self._live("units")

    def vectors(self, name: str) -> DataFrame | None:
        return self._live(f"vectors-{name}")

    def plan(self, corpus: DataFrame, partial: bool = False) -> DataFrame:
        """What is to be done for CORPUS. If it is PARTIAL, documents it doesn't hold stay, and those with a null text are removed."""
        held = self.documents()
        if not partial:
            return ledger.plan(corpus, held, self.config.keys())
        named = held.join(corpus.select("document_id"), "document_id", "left_semi")
        return ledger.plan(corpus.filter("text is not null"), named, self.config.keys())

    def _segmented(self, documents: DataFrame) -> DataFrame:
        """Units of documents before enrichment; those whose parsing and segmenting an earlier build kept are taken from there. The key is
        of both stages' settings, the content and the document."""
        c, keys = self.config, self.config.keys()
        settings = {"parse": keys["parse"], "segment": keys["segment"]}
        keyed = documents.withColumn("cache_key", ids.cache_key("segment", c.segmenter, "1", settings, F.col("content_hash"), F.col("document_id")))
        cache = self.store.read("segmented") if c.cache else None
        misses = keyed if cache is None else ledger.cache_misses(keyed, cache.select("cache_key").distinct())
        d = misses.select("document_id", "source_uri", "text", "media_type", "cache_key")
        parsed = parse.parse_routed(d, c.routes, c.parser) if c.routes else parse.PARSERS[c.parser](d)
        units = segment.segment_structural(parsed, c.max_tokens) if c.segmenter == "structural" else segment.SEGMENTERS[c.segmenter](parsed)
        titles = enrich.document_titles(parsed)
        new = units.join(titles, "document_id", "left").join(d.select("document_id", "cache_key"), "document_id")
        part = self.store.write("segmented", new)
        if not c.cache:
            return self.store.read("segmented", [part])
        self._pending.setdefault("segmented", []).append(part)
        fresh = self.store.read("segmented", [part])
        return fresh if cache is None else fresh.unionByName(cache.join(keyed.select("cache_key"), "cache_key", "left_semi"))

    def _enriched(self, raw: DataFrame, documents: DataFrame) -> DataFrame:
        """Units with their surface and fields; an enricher that doesn't give one row for each unit ends the build."""
        c, units = self.config, raw.drop("title", "cache_key")
        titles = raw.select("document_id", "title").distinct()
        made = None
        for name in c.enrichers:
            e = {"section_prefix": lambda: enrich.section_prefix(units, titles), "extractive_context": lambda: enrich.extractive_context(units, self._reparsed(documents)), "regex_fields": lambda: enrich.regex_fields(units, c.rules)}[name]()
            made = e if made is None else made.unionByName(e)
        if made is None:
            return units.withColumns({"surface": F.col("text"), "fields": F.create_map().cast(FIELDS)})
        made = cut(made, "enrichments")
        if wrong := enrich.missing_enrichments(units, made, list(c.enrichers)).limit(5).collect():
            raise ValueError(f"an enricher must give one row per unit: {[tuple(r) for r in wrong]}")
        fields = enrich.merged_fields(made).groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))
        return enrich.surface(units, made).join(fields, "unit_id", "left")

    def _reparsed(self, documents: DataFrame) -> DataFrame:
        c, d = self.config, documents.select("document_id", "source_uri", "text", "media_type")
        return parse.parse_routed(d, c.routes, c.parser) if c.routes else parse.PARSERS[c.parser](d)

    def build(self, corpus: DataFrame, build_id: str = "", partial: bool = False) -> dict[str, int]:
        """Plan, rebuild what was added, changed or restaged, leave out what was removed, commit. Returns counts of the plan."""
        c = self.config
        with self.accountant.measure("plan"):
            work = cut(self.plan(corpus, partial), "plan")
            counts = {r["change"]: r["count"] for r in work.groupBy("change").count().collect()}
        if set(counts) <= {"UNCHANGED"} and self.store.current():
            return counts
        todo = work.filter(F.col("change").isin("ADDED", "CHANGED", "RESTAGED")).select("document_id")
        n_todo = counts.get("ADDED", 0) + counts.get("CHANGED", 0) + counts.get("RESTAGED", 0)
        batches = max(1, -(-n_todo // c.checkpoint)) if c.checkpoint else 1
        removed = work.filter("change = 'REMOVED'").select("document_id")
        for k in range(batches):
            own = todo if batches == 1 else todo.filter(F.pmod(F.xxhash64("document_id"), F.lit(batches)) == k)
            self._build_batch(corpus.join(own, "document_id", "left_semi"), removed if k == 0 else None, build_id, counts)
        self._compact()
        return counts

    def _build_batch(self, documents: DataFrame, removed: DataFrame | None, build_id: str, counts: dict[str, int]) -> None:
        """Everything of some documents, in one commit."""
        c = self.config
        number = (self.store.current() or {"number": 0})["number"] + 1
        self._pending: dict[str, list[str]] = {}
        stamped = lambda df: df.withColumn("build", F.lit(number).cast("bigint"))
        append = lambda name, df: self._pending.setdefault(name, []).append(self.store.write(name, df))
        with self.accountant.measure("parse and segment"):
            raw = self._segmented(documents)
        with self.accountant.measure("enrich"):
            append("units", stamped(self._enriched(raw, documents)))
        fresh = self.store.read("units", self._pending["units"])
        with self.accountant.measure("index"):
            gone = documents.select("document_id") if removed is None else documents.select("document_id").unionByName(removed)
            if c.lexical:
                forward = stamped(fresh.select("document_id", "unit_id", F.coalesce(tokens(quick_fold(F.col("surface"))), F.array().cast("array<string>")).alias("tokens")))
                append("forward", forward)
                new, old = self.store.read("forward", self._pending["forward"]), self._live("forward")
                signed = new.select("tokens", F.lit(1).alias("sign"))
                if old is not None:
                    signed = signed.unionByName(old.join(gone, "document_id", "left_semi").select("tokens", F.lit(-1).alias("sign")))
                append("terms", signed.select(F.explode(F.array_distinct("tokens")).alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).filter("df <> 0"))
                append("lengths", signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.size("tokens")), F.lit(0)).alias("l")))
            for v in c.indexes():
                append(f"vectors-{v.name}", stamped(self._embedded(v, fresh)))
        keys = F.create_map(*[x for k, v in c.keys().items() for x in (F.lit(k), F.lit(v))])
        own = fresh.groupBy("document_id").agg(F.sort_array(F.collect_list("unit_id")).alias("unit_ids"))
        book = documents.select("document_id", "source_uri", "content_hash").join(own, "document_id", "left").withColumns({"stage_keys": keys, "build_id": F.lit(build_id)})
        if removed is not None:
            book = book.unionByName(removed, allowMissingColumns=True)
        append("ledger", stamped(book).select(*[c_.split(" ")[0] for c_ in LEDGER.split(", ")]))
        with self.accountant.measure("commit"):
            self.store.commit(append=self._pending, manifest={"build_id": build_id, "counts": counts})

    def _embedded(self, v: VectorIndex, units: DataFrame, text: str = "surface") -> DataFrame:
        """(unit_id, document_id, vector) of units."""
        if v.impl == "hash_embedding":
            return dense.hash_embed(units, v.dim, text=text, keep=("document_id",))
        made = self._latent(v, units).embed(units, "unit_id", text) if v.impl == "svd_embedding" else dense.model_embed(units, "unit_id", v.model, text=text)
        return made.join(units.select("unit_id", "document_id"), "unit_id")

    def _latent(self, v: VectorIndex, fresh: DataFrame | None = None) -> dense.LatentModel:
        """The latent model in force. With FRESH units, it is fitted anew over all when there is none or the units have changed much; earlier
        vectors are then made anew too."""
        name, model = f"latent-{v.name}", self.store.read(f"latent-{v.name}")
        if fresh is None:
            return dense.LatentModel(model.drop("fitted"), v.dim)
        every = fresh.select("unit_id", F.col("surface").alias("text"))
        before = self._live("units")
        old = None if before is None else before.join(fresh.select("document_id").distinct(), "document_id", "left_anti").select("unit_id", F.col("surface").alias("text"))
        if old is not None:
            every = every.unionByName(old)
        n = every.count()
        if model is not None and model.head(1) and abs(n - model.first()["fitted"]) <= v.refit * model.first()["fitted"]:
            return dense.LatentModel(model.drop("fitted"), v.dim)
        terms = dense.fit_latent(every, v.dim).terms.withColumn("fitted", F.lit(n))
        self.store.commit({name: terms})
        fitted = dense.LatentModel(self.store.read(name).drop("fitted"), v.dim)
        if old is not None:
            again = fitted.embed(old, "unit_id").join(before.select("unit_id", "document_id", "build"), "unit_id")
            self.store.commit({f"vectors-{v.name}": again})
        return fitted

    def _compact(self) -> None:
        """Merge tables of many parts, without the rows no document is live in."""
        self.store.compacted("ledger", lambda j: ledger.latest(j, "build").select(*j.columns), PARTS)
        self.store.compacted("terms", lambda t: t.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), PARTS)
        self.store.compacted("lengths", lambda t: t.agg(F.sum("n").alias("n"), F.sum("l").alias("l")), PARTS)
        for name in ("units", "forward", *(f"vectors-{v.name}" for v in self.config.indexes())):
            self.store.compacted(name, lambda _, name=name: self._live(name), PARTS)

    def lexical_index(self) -> lexical.LexicalIndex:
        """The kept index: live units' tokens, and the sums of the statistics' deltas."""
        forward = self._live("forward").select("unit_id", "tokens")
        terms = self.store.read("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        s = self.store.read("lengths").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
        return lexical.LexicalIndex(forward, terms, s["n"] or 0, s["l"] / s["n"] if s["n"] else 0.0)

    def targets(self, units: DataFrame, allowed: DataFrame | None, path: str) -> list[tuple[str, Callable, int]]:
        """The indexes a path asks, each with its number of candidates."""
        c, out = self.config, []
        top = lambda name: c.path_top_k.get(path, {}).get(name, c.candidates)
        asked = lambda name: path not in c.path_top_k or name in c.path_top_k[path]
        if c.lexical and asked("bm25"):
            index = self.lexical_index()
            out.append(("bm25", lambda x, k: lexical.search(index, x, k, allowed), top("bm25")))
        for v in c.indexes():
            if asked(v.name):
                out.append((v.name, lambda x, k, v=v: self._near(v, x, k, units, allowed), top(v.name)))
        return out

    def _near(self, v: VectorIndex, queries: DataFrame, k: int, units: DataFrame, allowed: DataFrame | None) -> DataFrame:
        vectors = self.vectors(v.name)
        if allowed is not None:
            vectors = vectors.join(allowed, "unit_id", "left_semi")
        if v.impl == "hash_embedding":
            asked = dense.hash_embed_queries(queries, units.select("unit_id", F.col("surface").alias("text")), v.dim)
        elif v.impl == "svd_embedding":
            asked = self._latent(v).embed(queries, "query_id", "query")
        else:
            asked = dense.model_embed(queries, "query_id", v.model, text="query")
        return dense.search(vectors, asked, k)

    def query(self, queries: DataFrame, routed: bool | None = None, lexicon: list[str] = (), types: dict[str, str] | None = None, where: structured.Predicate | None = None) -> DataFrame:
        """(query_id, path, rank, unit_id, score, document_id, ...): each question by its path: structured rows, one pass, or rounds over its
        sub-questions; lists are fused, reranked and hydrated, TOP_K of them; structured rows are as many as the question's query asks for, with
        its fields in `selected`. WHERE holds on every path. An index that fails gives no rows; a reranker's rows that it wasn't given are
        left out; decisions are appended to the log."""
        c, units = self.config, cut(self.units(), "live-units")
        records = self._records(units, types or {})
        wanted = c.routed if routed is None else routed
        q = route.route(queries, list(lexicon), types, structured=bool(lexicon), budget=c.step_budget) if wanted else route.route_passthrough(queries)
        if c.decision_log:
            q = cut(q, "decisions")
            scan.log_decisions(route.log_records(q), c.decision_log)
        allowed = records.filter(structured.compiled(where, records.schema)).select("unit_id") if where is not None else None
        lookups = q.filter("path = 'lookup'").select(F.concat("query_id", F.lit("\u0001-1")).alias("query_id"), "query")
        parts = q.filter("path = 'iterative'").select("query_id", F.posexplode(F.array_distinct(F.concat(F.array("query"), F.coalesce("sub_queries", F.array().cast("array<string>"))))).alias("step", "query")).filter(F.col("step") < c.step_budget)
        chained = parts.select(F.concat_ws("\u0001", "query_id", F.col("step").cast("string")).alias("query_id"), "query")
        if c.path_top_k.get("lookup") == c.path_top_k.get("iterative"):  # paths that ask the same indexes read them once
            hits = retrieve.fan_out(cut(lookups.unionByName(chained), "asked"), self.targets(units, allowed, "lookup"))
        else:
            hits = retrieve.fan_out(lookups, self.targets(units, allowed, "lookup")).unionByName(retrieve.fan_out(chained, self.targets(units, allowed, "iterative")))
        hits = hits.withColumns({"step": F.element_at(F.split("query_id", "\u0001"), -1).cast("int"), "query_id": F.regexp_replace("query_id", "\u0001-?[0-9]+$", "")})
        hits = cut(hits, "hits")
        single, rounds = hits.filter("step < 0").withColumn("step", F.lit(0)), hits.filter("step >= 0")
        lists = single.unionByName(retrieve.iterative(rounds, c.step_budget).select(*single.columns))
        fused = retrieve.fuse_rrf(lists, c.rrf_k, c.weights) if c.fuse == "rrf" else retrieve.fuse_concat(lists)
        ranked = self._reranked(fused, queries, units).filter(F.col("rank") <= c.top_k)
        found = retrieve.hydrate(ranked.select("query_id", "rank", "unit_id", "score"), units.drop("section")).join(q.select("query_id", "path"), "query_id")
        rows = self._structured(q.filter("path = 'structured'"), records, where)
        return found if rows is None else found.unionByName(retrieve.hydrate(rows, units).withColumn("path", F.lit("structured")), allowMissingColumns=True)

    def _reranked(self, fused: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
        c, texts = self.config, units.select("unit_id", F.col("surface").alias("text"))
        if c.rerank == "noop":
            return fused
        if c.rerank == "lexical_overlap":
            return retrieve.rerank_overlap(fused, queries, texts, c.rerank_k)
        return retrieve.rerank_model(fused, queries, texts, c.rerank_k, c.score_pairs).join(fused.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_semi")

    def _records(self, units: DataFrame, types: dict[str, str]) -> DataFrame:
        sql = {"int": "bigint", "float": "double", "bool": "boolean", "date": "date", "str": "string"}
        return units.select("unit_id", "document_id", "source_uri", *[F.try_element_at("fields", F.lit(k)).try_cast(sql[v]).alias(k) for k, v in types.items()])

    def _structured(self, asked: DataFrame, records: DataFrame, where: structured.Predicate | None) -> DataFrame | None:
        """(query_id, rank, unit_id, score, selected): the rows each question's own query asks for. Questions with the same query share it;
        distinct queries run in blocks, each one reading of the records, so their number has no bound."""
        asked = cut(asked.select("query_id", "predicate", "select"), "structured-questions")
        out = None
        for held in passes(asked.select("predicate", "select").distinct(), "predicate", 10_000)[1]:
            for a in range(0, len(held), STRUCTURED_BLOCK):
                block = held[a : a + STRUCTURED_BLOCK]
                plans = [structured.StructuredQuery(structured.all_of([x for x in (route.predicate_of(r["predicate"]), where) if x is not None]), tuple(r["select"]), limit=route.LIMIT) for r in block]
                named = self.spark.createDataFrame([(i, r["predicate"], r["select"]) for i, r in enumerate(block)], "number int, predicate string, select array<string>")
                rows = cut(structured.run_each(records, plans).join(F.broadcast(named), "number").drop("number"), "structured-rows")
                out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.join(asked, ["predicate", "select"]).select("query_id", "rank", "unit_id", "score", "selected")

    def surface_problems(self, probes: int = 5) -> list[str]:
        """The contract of indexes: every index searches the surface, so a term that only a unit's context has must find the unit. One per
        index that misses a probe."""
        folded = lambda c: tokens(quick_fold(F.col(c)))
        only = F.filter(F.array_except(folded("surface"), folded("text")), lambda t: F.length(t) > 5)
        u = self.units().withColumn("_only", only).filter(F.size("_only") > 0).orderBy("unit_id").limit(probes).select(F.col("unit_id").alias("query_id"), F.get("_only", F.lit(0)).alias("query"))
        asked = cut(u, "probes")
        out = []
        for name, search, _ in self.targets(self.units(), None, "check"):
            if name != "bm25":
                continue
            found = search(asked, max(1, self.units().count())).filter("query_id = unit_id").select("query_id")
            out += [f"{name}: {r['query']!r} of its context doesn't find unit {r['query_id']}" for r in asked.join(found, "query_id", "left_anti").collect()]
        return out
