from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from quernstone.llm import aggregation, distinctive, lines

HITS = "query_id string, `index` string, rank int, score double, unit_id string"


def hits(spark, data):
    return spark.createDataFrame(data, HITS).withColumns({"at": F.lit("clash"), "_n": F.lit(0)})


def chance(ranks: list[float]) -> float:
    """The least probability, over k, that of so many uniform ranks k are as low, by summing over subsets; times their number."""
    m = len(ranks)
    best = 1.0
    for k, r in enumerate(sorted(ranks), 1):
        best = min(best, sum(r ** len(s) * (1 - r) ** (m - len(s)) for j in range(k, m + 1) for s in combinations(range(m), j)))
    return min(1.0, best * m)


def brute(data, top):
    out = []
    for q in {d[0] for d in data if d[0]}:
        lists: dict = {}
        for qq, i, _, s, u in data:
            if qq == q:
                lists.setdefault(i, {})
                lists[i][u] = max(s, lists[i].get(u, s))
        units = {u for v in lists.values() for u in v}
        scored = []
        for u in units:
            ranks = []
            for v in lists.values():
                if u in v:
                    first = 1 + sum(x > v[u] for x in v.values())
                    last = sum(x >= v[u] for x in v.values())
                    ranks.append(min(1.0, (first + last) / 2 / len(units)))
                else:
                    ranks.append(1.0)
            scored.append((round(chance(ranks), 12), round(sum(ranks) / len(ranks), 9), u))
        out += [(q, k, u) for k, (_, _, u) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(seed, queries=6):
    r = np.random.default_rng(seed)
    data = []
    for q in range(queries):
        for i in range(int(r.integers(1, 6))):
            units = r.choice(20, int(r.integers(1, 15)), replace=False)
            scale = 10.0 ** r.integers(-2, 5)
            data += [(f"q{q}", f"i{i}", None, float(np.round(r.normal() * scale, 3)) if i else 1.0, f"u{u:02}") for u in units]
    return data + data[::7]


def test_ranking_against_brute_force(spark):
    data = made(1)
    got = rows(aggregation.combined_ranking(hits(spark, data), 4), "query_id", "position", "unit_id")
    assert got == brute(data, 4)
    assert rows(aggregation.best_units(hits(spark, data))) == [(q, u) for q, _, u in brute(data, 1)]


def test_hot_query_gets_the_same_ranking(spark):
    data = made(2, 3) + [("hot", f"i{i}", None, float((k * 7919 + i * 13) % 101), f"v{k:03}") for i in range(3) for k in range(120)]
    plain = rows(aggregation.best_units(hits(spark, data)))
    assert rows(aggregation.best_units(hits(spark, data), rows=40)) == plain
    assert rows(aggregation.combined_ranking(hits(spark, data), 5, rows=40)) == rows(aggregation.combined_ranking(hits(spark, data), 5))


def test_scales_dont_matter(spark):
    data = made(3)
    scaled = [(q, i, r, s * 1e6 + 5 if i == "i2" else s, u) for q, i, r, s, u in data]
    assert rows(aggregation.best_units(hits(spark, data))) == rows(aggregation.best_units(hits(spark, scaled)))


def test_ranking_edges(spark):
    data = [("q", "a", 1, None, "x"), ("q", "a", 2, None, "y"), ("q", "b", None, None, "y"), ("n", "a", None, float("nan"), "z"), (None, "a", 1, 1.0, "z"), ("q", None, 1, 9.0, "z"), ("q", "a", 1, 9.0, None), ("t", "a", 1, 1.0, "b"), ("t", "a", 2, 1.0, "a")]
    assert rows(aggregation.best_units(hits(spark, data))) == [("n", "z"), ("q", "x"), ("t", "a")]
    assert rows(aggregation.best_units(hits(spark, []))) == []


UNITS = "unit_id string, text string"


def test_distinctive_terms(spark):
    data = [("a", "The Zork the zork and the cat"), ("b", "the cat and the dog"), ("c", "the dog zork"), ("a", "The Zork the zork and the cat"), ("e", ""), ("n", None), ("t", "ä-ß ß ä"), ("long", "word " * 50_000 + "rare rare rare")]
    units = spark.createDataFrame(data, UNITS).withColumns({"term": F.lit("clash"), "n": F.lit(1)})
    asked = spark.createDataFrame([("a",), ("a",), ("e",), ("n",), ("x",), (None,), ("t",)], "unit_id string")
    assert rows(distinctive.best_terms(units, asked)) == [("a", "zork"), ("t", "ß")] or rows(distinctive.best_terms(units, asked))[1][1] in ("ä", "ß")
    s = {(r["unit_id"], r["term"]): r["score"] for r in distinctive.term_scores(units, asked).collect()}
    once = {}
    for u, t in set(data):
        once[u] = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    every = [w for d in once.values() for w in d]
    z = sum(every.count(w) ** 0.4 for w in set(every))
    for (u, w), v in s.items():
        assert abs(v - max(0.0, np.log(once[u].count(w) / len(once[u]) * z / every.count(w) ** 0.4))) < 1e-6
    assert rows(distinctive.best_terms(units.limit(0), asked)) == [] and rows(distinctive.best_terms(units, asked.limit(0))) == []


LINES = "unit_id string, source_uri string, text string"
NOTE = "Copyright 2020 the Foo contributors, all rights"


def documents():
    data = [(f"u{k}", f"site/p{k}", f"own line number {'abcdefgh'[k]} of this document\n{NOTE.upper() if k % 2 else NOTE + ' !'}\nshort") for k in range(6)]
    return [*data, ("u0", "site/p0", data[0][2]), ("v", "other/p", NOTE), ("w", "site/p0", NOTE), ("n", None, NOTE), ("e", "site/e", ""), ("x", "site/x", None)]


def test_repeated_lines_incrementally_and_at_once(spark, tmp_path):
    df = spark.createDataFrame(documents(), LINES).withColumns({"site": F.lit("clash"), "h1": F.lit(0), "doc": F.lit(0)})
    want = sorted([(f"u{k}", 2) for k in range(6)] + [("w", 1)])
    assert rows(lines.LineLedger(spark, str(tmp_path / "once")).add(df), "unit_id", "line_no") == want
    ledger = lines.LineLedger(spark, str(tmp_path / "steps"))
    assert rows(ledger.add(df.filter("unit_id in ('u0', 'u1', 'u2', 'v')"))) == []
    assert rows(ledger.add(df.filter("unit_id in ('u3', 'u4', 'w', 'n', 'e', 'u0')"))) == []
    third = ledger.add(df.filter("unit_id in ('u5', 'x')"))
    assert rows(third, "unit_id", "line_no") == want == rows(ledger.repeated())
    fourth = ledger.add(spark.createDataFrame([("y", "site/y", "first\n" + NOTE), ("z", "site/z", "nothing of the kind at all in this")], LINES))
    assert rows(fourth, "unit_id", "line_no") == [("y", 2)]  # earlier records aren't found again
    fixed = {r["unit_id"]: (r["text"], r["n_removed"]) for r in lines.rebuilt(df, third).collect()}
    assert fixed["w"] == ("", 1) and fixed["u1"] == ("own line number b of this document\nshort", 1) and "v" not in fixed


def test_increments_write_as_much_as_they_bring(spark, tmp_path):
    """What is written for a partition follows the partition, and earlier texts aren't asked for."""
    ledger = lines.LineLedger(spark, str(tmp_path / "l"))
    big = spark.range(2000).selectExpr("concat('b', id) as unit_id", "concat('s/', id) as source_uri", "concat('line of letters ', repeat(chr(97 + id % 26), 30), repeat(chr(97 + id % 7), 20)) as text")
    ledger.add(big)
    ledger.add(spark.createDataFrame([("n", "s/new", "one more line with letters only here")], LINES))
    parts = ledger.store.parts("held")
    assert [ledger.store.read("held", [p]).count() for p in parts] == [2000, 1]


def test_lines_edges(spark, tmp_path):
    df = spark.createDataFrame([], LINES)
    empty = lines.LineLedger(spark, str(tmp_path / "e"))
    assert rows(empty.add(df)) == [] and rows(empty.add(df)) == []
    many = spark.createDataFrame([(f"u{k}", f"s/{k}", ("1234567890 " * 10 + "\n") * 3 + "ẞtraße und viele weitere Wörter " + str(k)) for k in range(7)], LINES)
    assert {r["line_no"] for r in empty.add(many).collect()} == {4}


def test_beta_probabilities():
    """Against sums of binomial probabilities, and for more lists than are written out."""
    r = np.random.default_rng(3)
    for m in (1, 2, 5, 9, 40, 120):
        k = r.integers(1, m + 1, 200)
        x = np.concatenate([r.random(196), [0.0, 1.0, 1e-9, 0.5]])
        want = [sum(comb(m, j) * v**j * (1 - v) ** (m - j) for j in range(a, m + 1)) for a, v in zip(k.tolist(), x.tolist())]
        assert np.allclose(aggregation.beta_cdf(k, m - k + 1, x), want, rtol=1e-9, atol=1e-13)


def test_any_number_of_lists(spark, monkeypatch):
    data = [("q", f"i{i:03}", None, float((k * 7919 + i * 104729) % 997), f"v{k:02}") for i in range(100) for k in range(12)]
    df = spark.createDataFrame(data, "query_id string, index string, rank int, score double, unit_id string")
    got = aggregation.combined_ranking(df).collect()
    assert [r["position"] for r in got] == list(range(1, 13))
    few = df.filter("index < 'i005'")
    plain = rows(aggregation.combined_ranking(few).withColumn("rho", F.round("rho", 10)))
    monkeypatch.setattr(aggregation, "WRITTEN_OUT", 1)
    assert rows(aggregation.combined_ranking(few).withColumn("rho", F.round("rho", 10))) == plain
