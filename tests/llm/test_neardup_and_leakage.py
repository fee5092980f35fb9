from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import leakage, neardup
from quernstone.llm.words import codes

UNITS = "unit_id string, text string"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def similar(data, run=3, least=0.5):
    sets, whole = {}, {}
    for u, t in data:
        if u is not None and t is not None:
            w = words(t)
            sets[u], whole[u] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}, w
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if whole[a] == whole[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least))


def corpus(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    data = []
    for k in range(n):
        text = r.choice(vocabulary, 60).tolist()
        data.append((f"a{k:03}", " ".join(text)))
        for j in range(int(r.integers(0, 4))):
            edited = list(text)
            for _ in range(int(r.integers(0, 7))):
                edited[int(r.integers(0, 60))] = "edit" + str(int(r.integers(0, 99)))
            data.append((f"a{k:03}x{j}", ", ".join(edited).upper() if j % 2 else " ".join(edited[30:] + edited[:30])))
    return data


def test_pairs_against_brute_force(spark):
    data = corpus(5, 40)
    df = spark.createDataFrame(data + data[:5], UNITS).withColumns({"c1": F.lit("clash"), "key": F.lit(1)})
    got, want = rows(neardup.similar_pairs(df)), similar(data)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 40
    strong = similar(data, least=0.65)
    assert set(strong) <= set(got)


@pytest.mark.parametrize("bound", [1, 4])
def test_divided_nodes_lose_nothing(spark, monkeypatch, bound):
    data = corpus(6, 15)
    df = spark.createDataFrame(data, UNITS)
    plain = rows(neardup.similar_pairs(df))
    monkeypatch.setattr(neardup, "NODE", bound)
    assert set(rows(neardup.similar_pairs(df))) <= set(similar(data)) and set(rows(neardup.similar_pairs(df))) >= set(plain)


def test_a_large_node_is_replicated_within_bounds(spark, monkeypatch):
    """2,000 distinct texts in one node, which share a third of their words and are no pairs: each goes to PAIRS lower nodes at most."""
    r = np.random.default_rng(1)
    common = [f"c{k}" for k in range(30)]
    data = [(f"u{k:04}", " ".join([*common, *[f"w{x}" for x in r.integers(0, 10**6, 60)]])) for k in range(2000)]
    data += [(f"v{k:04}", " ".join([*t.split()[:-3], "x", "y", "z"])) for k, (_, t) in enumerate(data[:50])]
    df = spark.createDataFrame(data, UNITS)
    monkeypatch.setattr(neardup, "NODE", 100)
    sizes = []
    lower = neardup._lower_nodes
    monkeypatch.setattr(neardup, "_lower_nodes", lambda big, firsts: (sizes.append((big.count(), (x := lower(big, firsts)).count())), x)[1])
    assert rows(neardup.similar_pairs(df)) == similar(data)
    assert sizes and sizes[0][1] <= neardup.PAIRS * sizes[0][0]


def test_copies_and_edges(spark):
    data = [("a", "One two, three four"), ("b", "one TWO three four!"), ("c", "one two three four"), ("s1", "tiny"), ("s2", "Tiny."), ("e1", ""), ("e2", "--"), ("n", None), (None, "one two three four"), ("long", "x y z " * 30_000)]
    df = spark.createDataFrame(data, UNITS)
    assert rows(neardup.similar_pairs(df)) == [("a", "b"), ("a", "c"), ("b", "c"), ("e1", "e2"), ("s1", "s2")] == similar(data)
    assert rows(neardup.groups(df)) == [("a", "a"), ("b", "a"), ("c", "a"), ("e1", "e1"), ("e2", "e1"), ("s1", "s1"), ("s2", "s1")]
    assert rows(neardup.similar_pairs(df, copies=2)) == [("a", "b"), ("a", "c"), ("e1", "e2"), ("s1", "s2")]
    assert rows(neardup.membership(df)) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("e1", "e1", 2), ("e2", "e1", 2), ("long", "long", 1), ("s1", "s1", 2), ("s2", "s1", 2)]
    assert rows(neardup.similar_pairs(df.limit(0))) == []


def test_large_classes_give_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(8)
    text = r.choice([f"w{k}" for k in range(99)], 60).tolist()
    same = lambda t, k: (", " if k % 2 else " ").join(w.upper() if k >> j & 1 else w for j, w in enumerate(t))
    near = [*text[:30], "edited", *text[31:]]
    data = [(f"a{k:03}", same(text, k)) for k in range(130)] + [(f"b{k:03}", same(near, k % 3)) for k in range(120)] + [("c", " ".join(["other", *text[1:]]))]
    df, want = spark.createDataFrame(data, UNITS), similar(data)
    assert len(want) == 251 * 250 // 2
    for chunk in (neardup.CHUNK, 50):
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        assert rows(neardup.similar_pairs(df)) == want
    assert set(rows(neardup.groups(df))) == {(u, "a000") for u, _ in data}


def test_chains_become_one_group(spark):
    r = np.random.default_rng(0)
    text = [f"w{k}" for k in r.integers(0, 5000, 80)]
    data = []
    for k in range(8):
        text = text[8:] + [f"n{k}{j}" for j in range(8)]
        data.append((f"u{k}", " ".join(text)))
    assert {g for _, g in rows(neardup.groups(spark.createDataFrame(data, UNITS)))} == {"u0"}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(0, 120), st.integers(0, 10**6))
def test_node_search_is_exact(n, radius, seed):
    r = np.random.default_rng(seed)
    code = r.integers(0, 2**63, (n, neardup.WORDS), dtype=np.int64).astype(np.uint64)
    code[n // 2 :] = code[: n - n // 2] ^ (np.uint64(1) << r.integers(0, 64, (n - n // 2, neardup.WORDS), dtype=np.int64).astype(np.uint64))
    found = sorted((int(a), int(b)) for q, i in neardup.Node(code).search(code, radius) for a, b in zip(q, i, strict=True))
    far = sum(np.bitwise_count(code[:, None, w] ^ code[None, :, w]).astype(int) for w in range(neardup.WORDS))
    assert found == sorted(zip(*map(lambda x: x.tolist(), np.nonzero(far <= radius)), strict=True))


def test_gray_order_is_a_gray_order():
    k = np.arange(1 << 10, dtype=np.uint64)
    gray = np.zeros((len(k), 2), np.uint64)
    gray[:, 0], gray[:, 1] = (k >> np.uint64(4)) ^ (k >> np.uint64(5)), ((k ^ (k >> np.uint64(1))) & np.uint64(15)) << np.uint64(60)
    order = np.lexsort(neardup.gray_rank(gray).T[::-1])
    step = gray[order]
    assert set(sum(np.bitwise_count(step[1:, w] ^ step[:-1, w]).astype(int) for w in range(2)).tolist()) == {1}


def test_words_of_arrow_texts():
    got, offsets = codes(pa.array(["Héllo, world_x", None, "", "hello HÉLLO", "..."]))
    assert np.diff(offsets).tolist() == [3, 0, 0, 2, 0] and got[0] == got[4] != got[3]
    part, at = codes(pa.array(["zzz", "a b", "c"]).slice(1))
    assert np.diff(at).tolist() == [2, 1] and len(part) == 3


DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def shares(doc, item, n=13):
    d, i = words(doc or ""), words(item or "")
    runs = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)}
    return any(tuple(d[k : k + n]) in runs for k in range(len(d) - n + 1))


def test_leaks_against_brute_force(spark):
    r = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(30)] + ["é", "Zürich"]
    items = [(k, " ".join(r.choice(vocabulary, 40))) for k in range(12)]
    docs = []
    for k in range(60):
        text = r.choice(vocabulary, 50).tolist()
        if k % 2:
            n, source = int(r.integers(10, 17)), items[k % 12][1].split()
            a = int(r.integers(0, 40 - n))
            text[20:20] = [w.upper() + ("," if j % 3 else "\n>") for j, w in enumerate(source[a : a + n])]
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "x " * 100_000 + items[1][1])]
    items += [(50, None), (51, "too short"), (52, items[0][1])]
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(0))
    got = rows(leakage.verified(leakage.leaks(d, spark.createDataFrame(items, ITEMS))))
    assert got == sorted({(i, k) for k, t in docs for i, x in items if shares(t, x)}, key=repr)
    full = leakage.leaks(d, spark.createDataFrame(items, ITEMS)).filter("doc_id = 102 and item_id = 0").first()
    assert full["longest_run"] == 40 and full["similarity"] == pytest.approx(1.0)
    assert rows(leakage.leaks(d.limit(0), spark.createDataFrame(items, ITEMS))) == []
    assert rows(leakage.leaks(d, spark.createDataFrame([], ITEMS))) == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 5))
def test_blocks_miss_nothing_within_the_radius(seed, radius):
    r = np.random.default_rng(seed)
    words = np.array([hash(("w", int(k))) & (2**63 - 1) for k in r.integers(0, 99, 40)], np.uint64)
    layer = leakage.Layer(words, np.array([0, 40]), 13, radius)
    flips = np.zeros(len(layer.prints), np.uint64)
    for _ in range(radius + 1):
        flips ^= np.uint64(1) << r.integers(0, 64, len(flips), dtype=np.int64).astype(np.uint64)
    prints = layer.prints ^ flips
    q, w = layer.candidates(prints)
    far = np.bitwise_count(prints[:, None] ^ layer.prints[None, :])
    assert set(zip(q.tolist(), w.tolist(), strict=True)) == set(zip(*map(lambda x: x.tolist(), np.nonzero(far <= radius)), strict=True))


def test_whole_items_are_found_by_similarity(spark):
    """Items copied with an edited word every 12 share no passage of 13 words; at a lower threshold the item-sized windows find them."""
    r = np.random.default_rng(6)
    vocabulary = [f"v{k}" for k in range(4000)]
    items = [(k, " ".join(r.choice(vocabulary, int(r.integers(30, 97))))) for k in range(60)]
    docs = []
    for k, text in items:
        w = text.split()
        w[11::12] = [f"edited{j}" for j in range(len(w[11::12]))]
        docs.append((k, " ".join([*r.choice(vocabulary, 100), *w, *r.choice(vocabulary, 100)])))
        docs.append((1000 + k, " ".join([*r.choice(vocabulary, 50), *text.split()[:-1], "end", *r.choice(vocabulary, 50)])))
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = {(x["item_id"], x["doc_id"]): x for x in leakage.leaks(d, i).collect()}
    assert all(found[k, 1000 + k]["similarity"] >= 0.8 and found[k, 1000 + k]["longest_run"] >= 29 for k, _ in items)
    edited = [found[k, k] for k, _ in items if (k, k) in found]
    assert len(edited) >= 54 and all(x["longest_run"] == 0 and 0.4 < x["similarity"] < 0.8 for x in edited)
    assert leakage.leaks(d, i, whole=False).filter("item_id = doc_id and longest_run = 0").count() < len(edited)


def test_items_in_several_passes(spark, monkeypatch):
    r = np.random.default_rng(9)
    vocabulary = [f"v{k}" for k in range(60)]
    common = r.choice(vocabulary, 20).tolist()
    items = [(k, " ".join([*common, *r.choice(vocabulary, 20)])) for k in range(40)]
    docs = [(k, " ".join([*r.choice(vocabulary, 30), *items[k % 40][1].split()[5:40]])) for k in range(60)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    once = rows(leakage.leaks(d, i).withColumn("similarity", F.round("similarity", 9)))
    monkeypatch.setattr(leakage, "MOST_ITEMS", 15)
    assert rows(leakage.leaks(d, i).withColumn("similarity", F.round("similarity", 9))) == once and len(once) > 60
