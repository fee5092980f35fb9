from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations, product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quernstone import session
from quernstone.operators import dense, enrich, evaluation, lexical, retrieve, route, structured
from quernstone.operators.retrieve import _proximity
from quernstone.plans import reference_queries
from quernstone.plans.engine import EngineConfig
from quernstone.session import cumulated

UNITS = [("u1", "the read timeout in seconds"), ("u2", "connection pooling and retries"), ("u3", "timeout timeout pooling"), ("u4", ""), ("u5", None), ("u6", "read the manual"), ("u7", "read the manual")]
QUESTIONS = [("q1", "read timeout timeout"), ("q2", "pooling"), ("q3", "absent"), ("q4", ""), ("q5", None)]


def bm25(units, questions, k):
    docs = {u: (t or "").lower().split() for u, t in units}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = []
    for q, text in questions:
        s = {}
        for u, d in docs.items():
            tf = Counter(d)
            v = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in set((text or "").lower().split()) if tf[w])
            if v:
                s[u] = round(v, 9)
        out += [(q, r, u, v) for r, (u, v) in enumerate(sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_bm25_against_brute_force(spark, monkeypatch):
    units, questions = spark.createDataFrame(UNITS, "unit_id string, text string").withColumn("term", F.lit("clash")), spark.createDataFrame(QUESTIONS, "query_id string, query string").withColumn("df", F.lit(1))
    index = lexical.build(units)
    full = rows(lexical.search(index, questions, 3))
    assert [(a, b, c) for a, b, c, _ in full] == [(a, b, c) for a, b, c, _ in bm25(UNITS, QUESTIONS, 3)]
    assert np.allclose([r[3] for r in full], [r[3] for r in bm25(UNITS, QUESTIONS, 3)])
    assert {r[2] for r in rows(lexical.search(index, questions, 3, units.filter("unit_id in ('u3', 'u6')")))} == {"u3", "u6"}
    assert rows(lexical.search(lexical.build(units.limit(0)), questions, 3)) == []
    left = lexical.without_units(index, spark.createDataFrame([("u3",)], "unit_id string"))
    assert rows(lexical.search(left, questions, 9), "query_id", "unit_id") == sorted((a, c) for a, _, c, _ in bm25([u for u in UNITS if u[0] != "u3"], QUESTIONS, 9))


def test_bm25_in_blocks_is_exact(spark, monkeypatch):
    r = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = 1 / np.arange(1, 61)
    units = [(f"u{k:03}", " ".join(r.choice(vocabulary, 12, p=weights / weights.sum()))) for k in range(300)]
    questions = [(f"q{k:02}", " ".join(r.choice(vocabulary, 4))) for k in range(40)]
    index = lexical.build(spark.createDataFrame(units, "unit_id string, text string"))
    got = rows(lexical.search(index, spark.createDataFrame(questions, "query_id string, query string"), 5))
    assert [x[:3] for x in got] == [x[:3] for x in bm25(units, questions, 5)]


def in_process(units, questions, k, batch):
    """(query_id, unit_id) of one task of the search, without a session."""
    docs = [t.split() for _, t in units]
    df = Counter(w for d in docs for w in set(d))
    asked = [{"query_id": q, "term": w, "idf": math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))} for q, t in questions for w in set(t.split()) if df[w]]
    forward = pa.RecordBatch.from_arrays([pa.array([u for u, _ in units]), pa.array(docs)], ["unit_id", "tokens"])
    shared = SimpleNamespace(value=lexical._Questions(asked, k, sum(map(len, docs)) / len(docs)))
    return [r for b in lexical._best(shared)(iter(forward.slice(a, batch) for a in range(0, len(units), batch))) for r in b.to_pylist()]


def test_bm25_task_gives_k_rows_of_equal_units():
    got = in_process([(f"u{k:03}", "read the manual") for k in range(400, 0, -1)], [("q", "manual")], 3, 500)
    assert [r["unit_id"] for r in got] == ["u001", "u002", "u003"]


def test_bm25_lists_in_order_of_weight_are_exact(monkeypatch):
    r = np.random.default_rng(8)
    monkeypatch.setattr(lexical, "_UNITS", 90, raising=False)
    monkeypatch.setattr(lexical, "_ROWS", 5, raising=False)
    vocabulary = [f"w{k:02}" for k in range(60)]
    weights = 1 / np.arange(1, 61) ** 1.2
    units = [(f"u{k:03}", " ".join(r.choice(vocabulary, r.integers(1, 20), p=weights / weights.sum()))) for k in r.permutation(400)]
    questions = [(f"q{k:02}", " ".join(r.choice(vocabulary, r.integers(1, 7)))) for k in range(60)]
    for k in (1, 5, 1000):
        kept = Counter()
        got = [(q, kept.__setitem__(q, kept[q] + 1) or kept[q], u, s) for q, u, s in sorted(((x["query_id"], x["unit_id"], x["score"]) for x in in_process(units, questions, k, 40)), key=lambda x: (x[0], -x[2], x[1]))]
        assert [x[:3] for x in got if x[1] <= k] == [x[:3] for x in bm25(units, questions, k)]


def test_dense_search_against_numpy(spark):
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(50, 8)), 3)
    units = spark.createDataFrame([(k, v[k].tolist()) for k in range(50)] + [(99, None), (98, [1.0])], "unit_id bigint, vector array<float>").withColumn("score", F.lit(0))
    q = spark.createDataFrame([(k, v[k].tolist()) for k in (0, 7)] + [(5, None)], "query_id bigint, vector array<float>")
    got = rows(dense.search(units, q, 4))
    v32 = v.astype(np.float32).astype(float)
    want = sorted((k, i + 1, u, round(float(v32[k] @ v32[u]), 6)) for k in (0, 7) for i, u in enumerate(sorted(range(50), key=lambda u: (-round(float(v32[k] @ v32[u]), 6), u))[:4]))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert rows(dense.search(units, q.limit(0), 4)) == []


def test_dense_search_scores_in_double_precision_only_what_may_be_among_the_best(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.standard_normal((400, 40))
    v[200:] = v[:200] * (1 + r.uniform(-3e-7, 3e-7, (200, 1)))  # pairs that single precision can't tell apart
    q = r.standard_normal((30, 40))
    scored, einsum = [], np.einsum
    task = dense._nearest(spark, pa.table({"q": [f"q{k:02}" for k in range(30)], "vector": q.tolist()}), 5, "q", "u", 9)
    monkeypatch.setattr(dense.np, "einsum", lambda how, a, b: scored.append(len(a)) or einsum(how, a, b))
    batches = [pa.record_batch({"u": [f"u{k:03}" for k in range(a, a + 50)], "vector": v[a : a + 50].tolist()}) for a in range(0, 400, 50)]
    got = Counter()
    for b in task(iter(batches)):
        for name, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            got[name, s] += 1
    want = np.round(q @ v.T, 9)
    for k in range(30):
        best = sorted(want[k])[-5:]
        assert sorted(s for (name, s), n in got.items() for _ in range(n) if name == f"q{k:02}")[-5:] == pytest.approx(best, abs=1e-12)
    assert sum(scored) < 30 * 400 / 3


def test_hashing_many_texts_equals_hashing_each(monkeypatch):
    texts = ["The read  timeout\n\tin seconds", "", "abc", "ab", "über Straße 漢字漢字漢 😀😀😀😀😀", "the read timeout the read"]
    words = [t.lower().split() for t in texts]
    df = {"w:the": 3, "c:read": 2}
    for dim, n in ((8, 4), (256, 3), (16, 40)):
        for args in ((), (df, 9)):
            got = dense.hashed_all(texts, pa.array(words), dim, n, *args)
            assert got.tolist() == [dense.hashed(t, w, dim, n, *args) for t, w in zip(texts, words, strict=True)]


def test_pinned_hash_vectors(spark):
    texts = spark.createDataFrame([("a", "the read timeout in seconds"), ("b", "connection pooling and retries"), ("z", ""), ("n", None)], "unit_id string, text string")
    got = {r["unit_id"]: [round(x, 5) for x in r["vector"]] for r in dense.hash_embed(texts, 8).collect()}
    assert np.allclose(got["a"], [0.1525, -0.1525, 0.1525, -0.76249, 0.305, -0.1525, -0.4575, 0.1525], atol=1e-5)
    assert np.allclose(got["b"], [-0.62554, -0.41703, 0.41703, 0.41703, 0, 0, -0.20851, 0.20851], atol=1e-5)
    assert got["z"] == [0.0] * 8 == got["n"]
    q = dense.hash_embed_queries(spark.createDataFrame([("q", "read timeout")], "query_id string, query string"), texts.filter("unit_id in ('a', 'b')"), 8).collect()[0]["vector"]
    assert np.allclose(q, [0, -0.37796, 0, -0.75593, 0, -0.37796, 0, 0.37796], atol=1e-5)


def test_questions_beyond_one_pass_are_all_answered(spark, monkeypatch):
    r = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(30)]
    units = spark.createDataFrame([(f"u{k:03}", " ".join(r.choice(vocabulary, 8))) for k in range(60)], "unit_id string, text string")
    questions = spark.createDataFrame([(f"q{k:02}", " ".join(r.choice(vocabulary, 3))) for k in range(23)] + [("q98", ""), ("q99", None)], "query_id string, query string")
    index, some = lexical.build(units), units.filter("unit_id < 'u030'")

    def results():
        asked = dense.hash_embed_queries(questions, units, 16)
        return [rows(x) for x in (asked, dense.search(dense.hash_embed(units, 16), asked, 4), lexical.search(index, questions, 4), lexical.search(index, questions, 4, some))]

    whole = results()
    monkeypatch.setattr(dense, "MOST_QUERIES", 6)
    monkeypatch.setattr(dense, "MOST_FEATURES", 40, raising=False)
    monkeypatch.setattr(lexical, "MOST_TERMS", 15)
    assert results() == whole and len(whole[0]) == 25 and len({q for q, *_ in whole[1]}) == 25 and len({q for q, *_ in whole[2]}) == 23


def test_latent_model_spans_the_leading_subspace(spark):
    r = np.random.default_rng(2)
    topics = [[f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)], [f"c{k}" for k in range(8)]]
    texts = [(f"u{k:02}", " ".join(r.choice(topics[k % 3], 10))) for k in range(30)]
    df = spark.createDataFrame(texts, "unit_id string, text string")
    vec = {x["unit_id"]: np.array(x["vector"]) for x in dense.fit_latent(df, 3).embed(df, "unit_id").collect()}
    same = [vec[a] @ vec[b] for (a, _), (b, _) in product(texts, texts) if a < b and int(a[1:]) % 3 == int(b[1:]) % 3]
    other = [vec[a] @ vec[b] for (a, _), (b, _) in product(texts, texts) if a < b and int(a[1:]) % 3 != int(b[1:]) % 3]
    assert min(same) > 0.7 > 0.2 > max(np.abs(other))
    zero = dense.fit_latent(df, 3).embed(spark.createDataFrame([("x", "unknown words"), ("y", "")], "unit_id string, text string"), "unit_id").collect()
    assert all(x["vector"] == [0.0] * 3 for x in zero)


def test_latent_model_is_the_svd_and_keeps_little(spark, small, monkeypatch, tmp_path):
    units = spark.read.parquet(f"{small}/units.parquet").select("unit_id", "text").distinct()
    words = [Counter(re.findall(r"\w+(?:[.\-]\w+)*", (r["text"] or "").lower())) for r in units.filter("unit_id is not null").orderBy("unit_id").collect()]
    df = Counter(t for w in words for t in w)
    at = {t: k for k, t in enumerate(t for t, n in df.items() if n >= 2)}
    m, n = np.zeros((len(words), len(at))), units.count()
    for k, w in enumerate(words):
        for t in w.keys() & at.keys():
            m[k, at[t]] = (1 + np.log(w[t])) * (np.log((1 + n) / (1 + df[t])) + 1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    _, _, v = np.linalg.svd(m, full_matrices=False)
    y = m @ v[:8].T
    want = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)

    def vectors(rounds):
        model = dense.fit_latent(units, 8, rounds=rounds, extra=40)
        return np.array([r["vector"] for r in model.embed(units, "unit_id").filter("unit_id is not null").orderBy("unit_id").collect()])

    session.shared_dir(spark)
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    got = vectors(3)
    assert got.shape == want.shape and np.allclose(np.abs((got * want).sum(axis=0)), (want * want).sum(axis=0), rtol=2e-2)
    kept = sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file() and "latent-words" not in str(p) and "latent-counts" not in str(p))
    assert kept < 4 * len(at) * 48 * 8  # not a basis and a step for each round
    monkeypatch.setattr(dense, "MOST_SENT", 400_000)
    monkeypatch.setattr(dense, "_ROWS", 300)
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "other"))
    assert np.allclose(vectors(3), got, atol=1e-3)


def test_latent_vectors_are_one_per_key(spark):
    texts = [(f"u{k}", " ".join(w)) for k, w in enumerate(permutations("abcde", 3))]
    model = dense.fit_latent(spark.createDataFrame(texts, "unit_id string, text string"), 3)
    asked = [("x", "a b"), ("x", "c c"), ("y", "a b c c"), ("z", None), (None, "d"), (None, "e")]
    got = {r["k"]: r["vector"] for r in model.embed(spark.createDataFrame(asked, "k string, text string"), "k").collect()}
    assert set(got) == {"x", "y", "z", None} and got["x"] == got["y"] and got["z"] == [0.0] * 3 and any(got[None])
    assert dense.fit_latent(spark.createDataFrame([("a", "one")], "unit_id string, text string"), 3).embed(spark.createDataFrame([("a", "one")], "k string, text string"), "k").first()["vector"] == [0.0] * 3


def test_registered_embeddings_have_the_reference_dimensions(spark, monkeypatch):
    asked = []

    def seen(name):
        def f(*args, **kw):
            asked.append((name, args[1] if name != "hash_embed_queries" else args[2]))
            raise LookupError
        return f

    for query, name in (("lsa_embed", "fit_latent"), ("hash_embed", "hash_embed"), ("hash_search", "hash_embed"), ("hash_search", "hash_embed_queries")):
        with monkeypatch.context() as m:
            m.setattr(dense, name, seen(name))
            with pytest.raises(LookupError):
                reference_queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert asked == [("fit_latent", 512), ("hash_embed", 256), ("hash_embed", 256), ("hash_embed_queries", 256)] and EngineConfig().dim == 256


def test_model_embedder(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", None)], "k string, text string")
    load = lambda: lambda texts: np.array([[len(t), 1.0, 5.0] for t in texts])
    got = {r["k"]: r["vector"] for r in dense.model_embed(df, "k", load, "p: ", 2).collect()}
    assert np.allclose(np.linalg.norm(got["a"]), 1, atol=1e-6) and len(got["b"]) == 2


HITS = [("q", "lex", 0, 0, 1, "a", 9.0), ("q", "lex", 0, 0, 2, "b", 8.0), ("q", "den", 1, 0, 1, "b", 0.9), ("q", "den", 1, 0, 2, "c", 0.8), ("r", "den", 1, 0, 1, "z", 0.1)]
HS = "query_id string, source string, target int, step int, rank int, unit_id string, score double"


def test_fusion(spark):
    h = spark.createDataFrame(HITS, HS)
    f = rows(retrieve.fuse_rrf(h), "query_id", "rank", "unit_id", "best_rank", "found_by")
    assert f == [("q", 1, "b", 1, ["den", "lex"]), ("q", 2, "a", 1, ["lex"]), ("q", 3, "c", 2, ["den"]), ("r", 1, "z", 1, ["den"])]
    assert rows(retrieve.fuse_rrf(h.orderBy("unit_id"))) == rows(retrieve.fuse_rrf(h))
    assert rows(retrieve.fuse_rrf(h, weights={"lex": 100.0}), "query_id", "rank", "unit_id")[0] == ("q", 1, "a")
    assert rows(retrieve.fuse_concat(h), "rank", "unit_id", "source") == [(1, "a", "lex"), (1, "z", "den"), (2, "b", "lex"), (3, "c", "den")]
    assert rows(retrieve.sparse_ranks(h.filter("source = 'lex'"))) == [] and rows(retrieve.fuse_rrf(h.limit(0))) == []


def test_fusion_keeps_the_best_hit(spark):
    h = spark.createDataFrame([*HITS, ("q", "phr", 2, 0, 1, "b", 5.0), ("q", "phr", 2, 1, 2, "a", 4.0)], HS)
    want = [("a", 1, "lex", 9.0), ("b", 1, "den", 0.9), ("c", 2, "den", 0.8), ("z", 1, "den", 0.1)]
    assert rows(retrieve.fuse_rrf(h), "unit_id", "best_rank", "best_source", "best_score") == want
    assert rows(retrieve.fuse_rrf(h.orderBy(F.desc("target"))), "unit_id", "best_rank", "best_source", "best_score") == want


def test_hybrid_search_tells_which_list_found_a_unit(spark, small):
    got = reference_queries.QUERIES["hybrid_search"](spark, small).select("best_rank", "found_by", "best_source").distinct().collect()
    assert {r["found_by"] for r in got} <= {"bm25", "dense", "bm25 dense"} and all(r["best_source"] in r["found_by"].split() and r["best_rank"] >= 1 for r in got) and got


def test_iteration_stops(spark):
    rounds = [("q", "lex", 0, s, r, u, 1.0) for s, units in enumerate([["a", "b", "c", "d"], ["a", "e"], ["f", "g", "h", "i"]]) for r, u in enumerate(units, 1)]
    got = rows(retrieve.iterative(spark.createDataFrame(rounds, HS), 3), "step", "rank", "unit_id")
    assert got == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (0, 4, "d"), (1, 1, "e")]
    assert {x[0] for x in rows(retrieve.iterative(spark.createDataFrame(rounds, HS), 3, min_new=1), "step")} == {0, 1, 2}
    assert {x[0] for x in rows(retrieve.iterative(spark.createDataFrame(rounds, HS), 1), "step")} == {0}


def test_proximity_against_all_windows():
    r = np.random.default_rng(0)
    for _ in range(200):
        passage, q = r.choice(list("abcdef"), 12).tolist(), r.choice(list("abcdef"), 3).tolist()
        at = [i for i, t in enumerate(passage) if t in q]
        kinds = {passage[i] for i in at}
        if len(at) < 2 or len(kinds) < 2:
            want = 1.0 if len(at) == 1 else 0.0
        else:
            want = len(kinds) / max(len(kinds), min(j - i + 1 for i in at for j in at if j >= i and kinds <= set(passage[i : j + 1])))
        assert _proximity([passage], [q])[0] == want


def test_rerank(spark):
    h = spark.createDataFrame([("q", 1, "a", 1.0), ("q", 2, "b", 0.5), ("w", 1, "a", 1.0), ("w", 2, "b", 0.9)], "query_id string, rank int, unit_id string, score double")
    q = spark.createDataFrame([("q", "read timeout"), ("w", "to it")], "query_id string, query string")
    t = spark.createDataFrame([("a", "nothing of note"), ("b", "the read timeout")], "unit_id string, text string")
    got = retrieve.rerank_overlap(h, q, t, 10)
    assert rows(got, "query_id", "rank", "unit_id") == [("q", 1, "b"), ("q", 2, "a"), ("w", 1, "a"), ("w", 2, "b")]
    assert rows(retrieve.introduced(h, got)) == []
    assert rows(retrieve.rerank_model(h, q, t, 10, lambda a, b: [float(len(x)) for x in b]), "query_id", "rank", "unit_id")[0] == ("q", 1, "b")
    assert retrieve.hydrate(got, t).filter("unit_id = 'b'").first()["text"] == "the read timeout"


def test_surface_is_in_order_of_names(spark):
    u = spark.createDataFrame([("u", "d", "body", ["S"], 0)], "unit_id string, document_id string, text string, section_path array<string>, ordinal int")
    e = spark.createDataFrame([("u", "z", " last "), ("u", "a", "first"), ("u", "m", "  ")], "unit_id string, enricher string, context string")
    assert enrich.surface(u, e).first()["surface"] == "first\n\nlast\n\nbody"
    assert rows(enrich.missing_enrichments(u, e, ["a", "b"])) == [("u", "b", 0)]
    f = enrich.regex_fields(u.withColumn("text", F.lit("Timeout = 1_000\nstable: YES on 2024-02-31")), [enrich.FieldRule("t", r"timeout = ([\d_]+)", "int"), enrich.FieldRule("s", r"stable: (\w+)", "bool"), enrich.FieldRule("d", r"on (\S+)", "date"), enrich.FieldRule("x", "absent")])
    assert f.first()["fields"] == {"t": "1000", "s": "true"}


def test_scores(spark):
    gold = spark.createDataFrame([("q", "d", 0, 100, 3), ("q", "d", 200, 200, 1), ("x", "d", 0, 10, 2)], "query_id string, document_id string, span_start int, span_end int, weight int")
    hits = spark.createDataFrame([("q", 1, "e", 0, 100), ("q", 2, "d", 40, 160), ("q", 3, "d", 190, 210), ("q", 4, "d", 60, 90)], "query_id string, rank int, document_id string, span_start int, span_end int")
    g = evaluation.graded(hits, gold)
    assert rows(g, "rank", "grade") == [(1, 0), (2, 3), (3, 1), (4, 0)]
    assert rows(evaluation.graded(hits, gold, "span_containment"), "rank", "grade") == [(1, 0), (2, 0), (3, 1), (4, 0)]
    s = {r["query_id"]: r for r in evaluation.scores(spark.createDataFrame([("q",), ("x",), ("n",)], "query_id string"), g, gold).collect()}
    dcg = 7 / math.log2(3) + 1 / math.log2(4)
    assert (s["q"]["precision_5"], s["q"]["recall_5"], s["q"]["reciprocal_rank"], s["q"]["failed"]) == (0.4, 1.0, 0.5, False)
    assert abs(s["q"]["ndcg_10"] - dcg / (7 + 1 / math.log2(3))) < 1e-8
    assert (s["x"]["recall_5"], s["x"]["ndcg_10"], s["x"]["failed"]) == (0.0, 0.0, True) and s["n"]["recall_5"] is None and s["n"]["failed"]


def test_correlation_of_constant_columns(spark):
    def r(*data):
        return spark.createDataFrame(data, "a double, b double").agg(evaluation.correlation("a", "b")).first()[0]

    data = [(0.2, 1.0), (0.4, 0.5), (0.0, 0.0), (1.0, 0.25), (None, 0.3), (0.7, None)]
    assert abs(r(*data) - np.corrcoef(*zip(*data[:4]))[0, 1]) < 1e-12
    assert all(math.isnan(r(*d)) for d in ([(0.0, 0.0)] * 3, [(0.1, 1.0), (0.1, 0.5), (0.1, 0.2)], [(1.0, 1.0)])) and r((None, 1.0)) is None


def test_metric_corr_when_nothing_is_found(spark, small, tmp_path):
    for name in ("units", "relevant_spans", "golden_queries"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    spark.read.parquet(f"{small}/hits.parquet").withColumn("unit_id", F.concat(F.lit("gone-"), "unit_id")).write.parquet(str(tmp_path / "hits.parquet"))
    assert math.isnan(reference_queries.QUERIES["metric_corr"](spark, str(tmp_path)).first()["r"])


def test_percentiles_are_exclusive(spark):
    data = [("a", float(k)) for k in range(1, 11)] + [("b", 7.0), ("c", None)] + [(None, 1.0), (None, 3.0)] + [("t", 5.0)] * 50
    got = {(r["g"], r["p"]): r["value"] for r in evaluation.percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    assert got == {k: pytest.approx(v) for k, v in {("a", 50): 5.5, ("a", 95): 10.45, ("b", 50): 7.0, ("b", 95): 7.0, (None, 50): 2.0, (None, 95): 4.7, ("t", 50): 5.0, ("t", 95): 5.0}.items()}


def test_running_sums_over_ranges(spark):
    r = np.random.default_rng(0)
    data = [(g, int(v), int(r.integers(1, 9))) for g in "ab" for v in r.permutation(500)]
    c = cumulated(spark.createDataFrame(data, "g string, v int, n bigint").repartition(7), ["g"], "v").collect()
    for g in "ab":
        own = sorted((x["v"], x["n"], x["upto"]) for x in c if x["g"] == g)
        assert [u for *_, u in own] == np.cumsum([n for _, n, _ in own]).tolist() and len(own) == 500


def test_questions_by_a_model(spark):
    u = spark.createDataFrame([("u1", "d", 0, 9, "the read timeout in seconds"), ("u2", "d", 9, 20, "pooling of connections")], "unit_id string, document_id string, span_start int, span_end int, text string")
    got = evaluation.model_bootstrap(u, lambda texts: ["how long until reading gives up" if "timeout" in t else t for t in texts])
    assert rows(got, "unit_id", "lexical_overlap") == [("u1", 0.0)]
    g = spark.createDataFrame([("q", "read timeout", None), ("r", "x", 0.5)], "query_id string, query string, lexical_overlap double")
    p = spark.createDataFrame([("q", "the read limit"), ("r", "x")], "query_id string, snippet string")
    assert rows(evaluation.golden_overlap(g, p), "query_id", "lexical_overlap") == [("q", 0.5), ("r", 0.5)]


def test_questions_from_fields(spark):
    from datetime import date

    data = [(f"u{k}", "aabbbbcd"[k % 8], k, date(2015 + k, 1, 1)) for k in range(10)]
    df = spark.createDataFrame(data, "unit_id string, package string, version_major int, release_date date")
    q = evaluation.field_questions(df, 4).collect()
    assert len({x["query"] for x in q}) == len(q) and {x["field"] for x in q} == {"package", "version_major", "release_date"}
    inside = [int(x["query"].split()[-1]) for x in q if x["field"] == "version_major"]
    assert inside and all(1 <= v <= 8 for v in inside) and "which entries have package b" in {x["query"] for x in q}
    asked = route.Scanner(["package", "version_major", "release_date"], {"package": "str", "version_major": "int", "release_date": "date"})
    for x in q:
        if x["query"].startswith("which"):
            assert df.filter(structured.compiled(asked.query(x["query"]).where, df.schema)).count() > 0, x["query"]
    assert [r[0] for r in spark.createDataFrame([("my_pkg-core/x.md",), (None,)], "n string").select(evaluation.subject_of(F.col("n"))).collect()] == ["my pkg core x", ""]


def test_judges(spark):
    d = spark.createDataFrame([("12", "number", "it took 12.0 s"), ("1,200", "number", "1200 units"), ("2024-01-02", "date", "on 2024-01-02."), ("yes", "boolean", "true"), ("Foo", "text", "a foo b"), (None, "text", "x"), ("5", "number", "none")], "e string, k string, a string")
    got = [r[0] for r in d.select(evaluation.judged_exact(F.col("e"), F.col("k"), F.col("a"))).collect()]
    assert got == [True, True, True, True, True, None, False]
    c = spark.createDataFrame([("alpha beta gamma", "alpha beta"), ("a b", "a"), (None, "x")], "g string, a string")
    assert [r[0] for r in c.select(evaluation.judged_containment(F.col("g"), F.col("a"))).collect()] == [True, None, None]


def test_tables_of_arms(spark):
    r = spark.createDataFrame([("base", "f", 0.2), ("new", "f", 0.1), ("low", "f", 0.01)], "arm string, metric string, value double")
    c = spark.createDataFrame([("a", "base", "new", "f", 0.5, 0.2), ("b", "base", "gone", "f", 0.5, 0.2), ("c", "new", "base", "f", 0.5, 0.2), ("d", "low", "new", "f", 0.5, 0.2)], "name string, baseline_arm string, treatment_arm string, metric string, expected_reduction double, tolerance double")
    assert rows(evaluation.verdicts(r, c), "name", "passed", "diagnosis") == [("a", True, "as expected"), ("b", False, "metric missing in an arm"), ("c", False, "worse than the baseline"), ("d", False, "no headroom in the baseline")]
    d = evaluation.delta_table(spark.createDataFrame([("base", 1.0), ("x", 1.5)], "arm string, m double"), "base", ["m"])
    assert rows(d) == [("base", 1.0, 0.0), ("x", 1.5, 0.5)]
