from __future__ import annotations

from pathlib import Path

import held_out
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import markup, packing, pii

UNITS = "unit_id string, source_uri string, text string"
MARKED = ["# Head", "## Head\ntext", "a <b>c</b> d", "x &amp; y", "&#39;", "see [a](https://x.y/z)", "![i](./p.png)", "**bold**", "*em* word", "use `code` here", "```py\nx\n```", "| a | b |\n|---|---|", "> quoted", "* item", "- item", "Title\n=====", ".. note:: x", ":param x: y", "see ``lit``", "`t <u>`_", "Example::\n\n  x", "== Head ==", "[[Link|x]]", "{{tpl|x}}", "'''b'''", r"\section{A}", r"\item thing", "$$ x $$", r"$\alpha_{i}$", "<!-- c -->", "end of a unit <a", "~~gone~~", "href='https://a.b/c'>word"]
PLAIN = ["a < 3 and b > 4", "from $5 to $12 per codec", r"under C:\logs\item on host", "run a | sort | b to see", "use --flag -x or -v", "footnote [20] says", "Home > Site > Docs > guides", "Share this page: a | b | c", "R&D at x counts 2 * 3 * 8 slots", "arrow a -> b or x => y", "snake_case and C# and C++", "assert a == b {not c} before", "[44] Posted by the bot at 16:58", "-- Home > X > Y --", "", "a*b*c", "List<String> and std::vector", ">>> x = f(1)", "2 ** 3 ** 4", "$ pip install x"]


def test_constructs_and_plain_text(spark):
    df = spark.createDataFrame([(t,) for t in [*MARKED, *PLAIN]], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", F.size(markup.found_tokens(F.col("t"))).alias("n")).collect()}
    assert [t for t in MARKED if not got[t]] == [] and [t for t in PLAIN if got[t]] == []


def test_markup_edges(spark):
    data = [("a", "s/x", "<p>x</p>"), ("a", "s/x", "<p>x</p>"), ("b", None, "**x**"), ("c", "s/y", None), ("d", "s/y", ""), (None, "s/y", "<p>"), ("long", "s/z", "word " * 40_000 + "<br/>")]
    df = spark.createDataFrame(data, UNITS).withColumns({"site": F.lit("clash"), "tokens": F.lit("clash")})
    assert rows(markup.held(markup.tokens(df, "units", "unit_id"))) == [("units", "a"), ("units", "b"), ("units", "long")]
    assert rows(markup.site_templates(markup.tokens(df.limit(0), "units", "unit_id"))) == []
    assert markup.cleaned(df, "units", "unit_id").filter("record_id = 'd'").first()["text"] == ""


def test_slots_between_the_tokens_of_a_template(spark):
    page = lambda k: f"<table><tr><td>name {k}</td><td>**v{k}** &amp; more</td></tr></table>tail {k}" + ("<b>odd</b>" if k == 2 else "")
    data = [(f"p{k}", f"host/{k}", page(k)) for k in (0, 1, 2, 2)] + [("q", "else/q", "<i>one</i>")]
    df = spark.createDataFrame(data, UNITS)
    t = markup.site_templates(markup.tokens(df, "units", "unit_id"))
    assert {r["site"] for r in t.collect()} == {"host", "else"}
    got = markup.slots(df, t, "units", "unit_id").collect()
    want = {f"p{k}": [f"name {k}", f"v{k}", "& more", f"tail {k}" + ("odd" if k == 2 else "")] for k in range(3)}
    assert {p: [r["text"].strip() for r in sorted(got, key=lambda r: r["slot"]) if r["record_id"] == p] for p in want} == want
    assert {r["record_id"] for r in got} == set(want) and all(r["class_id"] is not None for r in got)
    fenced = markup.slot_texts(["a", "```py", "\n**x**\n", "```", "\n**y**"], [None, "```", None, "```", None], {"```": 7})
    assert fenced == [(None, "a"), (7, f"{markup.CODE} **x**"), (7, "y")]


def test_templates_are_classes_of_equal_vectors(spark):
    pages = [(f"p{k}", f"host/{k}", "<table>" + "<tr><td>x</td></tr>" * (k + 1) + "</table>" + ("<b>odd</b>" if k == 2 else "")) for k in range(4)] + [("q", "else/q", "<i>one</i>")]
    t = {tuple(r["tokens"]): r for r in markup.site_templates(markup.tokens(spark.createDataFrame(pages, UNITS), "units", "unit_id")).collect()}
    inner, outer = t["<tr>", "<td>", "</td>", "</tr>"], t["<table>", "</table>"]
    assert outer["valid"] and outer["pages"] == 4 and outer["total"] == 4 and outer["inside"] is None
    assert inner["valid"] and inner["total"] == 10 and inner["inside"] == outer["class_id"]
    assert not t["<b>", "</b>"]["valid"] and not t["<i>", "</i>"]["valid"]


def test_clean_text_keeps_structure():
    h, i, c, f = markup.HEADING, markup.ITEM, markup.CODE, markup.FORMULA
    cases = {
        "## A <b>bold</b> title\n\n* one\n* two &amp; three": f"{h} A bold title\n\n{i} one\n{i} two & three",
        "Title\n=====\n\nSee ``x`` and `text <https://a.b>`_.\n\n.. code-block:: python\n\n   a = b[*c*]\n\nrest": f"{h} Title\n\nSee x and text.\n\n{c}    a = b[*c*]\n\nrest",
        "<h2 class='k'>T</h2><ul><li>a</li><li>b</li></ul><pre><code>if a &lt; b:\n  c()</code></pre>": f"{h} T\n\n{i} a\n{i} b\n\n{c} if a < b:\n{c}   c()",
        r"\section{Intro} we have $\alpha_{i} \leq 2$ and \emph{x}" + "\n$$ y^2 $$": f"{h} Intro\n we have {f} \\alpha_{{i}} \\leq 2 {f} and x\n{f} y^2 {f}",
        "== W ==\n[[page|label]] '''b''' {{t|u}} end": f"{h} W\nlabel b  end",
        "| a | b |\n|---|:--:|\n| 1 | 2 |": "a\tb\n1\t2",
        "plain $5 to $12, a < b": "plain $5 to $12, a < b",
    }
    for text, want in cases.items():
        assert markup.clean_text(text) == want


def test_cleaned_texts_hold_no_markup():
    import re

    pattern = re.compile(markup.PATTERN)
    for text in MARKED:
        left = [x for x in markup.clean_text(text).split("\n") if not x.startswith(markup.CODE) and markup.FORMULA not in x]
        assert text == "end of a unit <a" or text.startswith("href") or not pattern.search("\n".join(left)), text


DOCS = "doc_id bigint, text string"
need = pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="no tokenizer files")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plans_fill_every_slot_once(histogram):
    slots = packing.plan_slots(histogram, 64)
    used: dict[int, int] = {}
    for n, count in histogram.items():
        own = sorted((a, z, c, per) for length, a, z, c, per in slots if length == n)
        assert own[0][0] == 0 and own[-1][1] == count - 1 and all(x[1] + 1 == y[0] for x, y in zip(own, own[1:], strict=False))
        for a, z, c, per in own:
            for rank in range(a, z + 1):
                used[c + (rank - a) // per] = used.get(c + (rank - a) // per, 0) + n
    assert max(used.values(), default=0) <= 64
    total, least = sum(n * k for n, k in histogram.items()), max((n for n in histogram), default=0)
    if used:
        assert len(used) <= 11 / 9 * -(-total // 64) + 1 + sum(k for n, k in histogram.items() if n > 32) or least


@need
def test_packing_against_its_rules(spark):
    r = np.random.default_rng(8)
    data = [(k, " ".join(r.choice(["alpha", "beta", "Straße", "0x1f"], int(r.integers(1, 120))))) for k in range(300)] + [(900, "tok " * 700), (901, ""), (902, None), (903, "same"), (903, "same"), (903, "same")]
    df = spark.createDataFrame(data, DOCS).withColumn("n_tokens", F.lit(-1))
    got = packing.pack(df, 256).collect()
    sizes = {}
    for row in packing.token_counts(df).collect():
        sizes.setdefault(row["doc_id"], []).append(row["n_tokens"])
    fill: dict = {}
    for row in got:
        fill.setdefault(row["container_id"], []).append(row)
    assert all(sum(x["n_tokens"] for x in v) <= 256 for v in fill.values())
    for doc, own in sizes.items():
        pieces = sorted((x["first_token"], x["n_tokens"]) for x in got if x["doc_id"] == doc)
        assert sum(n for _, n in pieces) == sum(own) and (len(pieces) == len(own) or max(own) > 256)
    long = sorted((x["first_token"], x["n_tokens"]) for x in got if x["doc_id"] == 900)
    assert all(n == 256 for _, n in long[:-1]) and {901, 902}.isdisjoint(x["doc_id"] for x in got)
    least = max(-(-sum(x["n_tokens"] for x in got) // 256), sum(x["n_tokens"] > 128 for x in got))
    assert len(fill) <= 1.02 * least + 1
    assert packing.pack(df.limit(0), 256).count() == 0
    ranked_apart = packing.pack(df, 256, piece=7).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    assert sorted(r["n"] for r in ranked_apart) == sorted(sum(x["n_tokens"] for x in v) for v in fill.values()) and sum(r["k"] for r in ranked_apart) == len(got)


@pytest.fixture(scope="module")
def field():
    return pii._field()


PERSONAL = [
    ("Reported by Mara K. Oldenbrook.", "name"), ("Merci à Dupontel, Alix pour le correctif.", "name"), ("Dear MS. HOLLOWAY, hello", "name"), ("Gemeldet von Prof. Baumstark.", "name"), ("Authors: JANA VELTMAN, and others", "name"), ("Write to jo.bloggs+x@mail.example.org for access.", "email"), ("cc jo [at] example [dot] org", "email"),
    ("Call +44 20 7946 0018 out of hours.", "phone"), ("Tel. (555) 010-2345", "phone"), ("Tel. 030/12345-678", "phone"), ("SSN 912-34-5678", "id_number"), ("DNI 12345678Z", "id_number"), ("Ausweisnummer 00 123 456 789", "id_number"), ("Office: 12 Elm Grove Road, Ashby", "address"), ("Adresse : 7, rue Lamartine, 69003 Lyon", "address"),
    ("Anschrift: Gartenstraße 12a, 10115 Berlin", "address"), ("Dirección: Calle Mayor 3, 28013 Madrid", "address"), ("copies to P.O. Box 1234, Ashby", "address"),
]
HARMLESS = ["The Main Lane scheduler was renamed to Kestrel Road Map.", "See page 4, table 2, of the Kestrel Handbook.", "Released on 2021-03-04 as x 2.0.", "Build 1234-56-7890123 was promoted.", "Ports 3050-4568 stay closed.", "Listening on 192.0.2.161:1131.", "Pin kestrel@5.18.9 in the lockfile.", "The decorator @cached takes no arguments.", "Version 12.23.14 of Kestrel caches it.", "Checksum block 1118 9749 failed in the Street View sample.", "Whenever Kestrel polls, it stops at shutdown. The end", "", "Seit Version 21.15 liest Kestrel den Lauf."]


def test_details_and_decoys(field):
    for text, kind in PERSONAL:
        assert {pii.LABELS[y] for *_, y in field.find([text])} == {kind}, text
    assert [t for t in HARMLESS if field.find([t])] == []


@pytest.mark.parametrize(("kind", "group", "least"), [("name", held_out.NAMES, 0.9), ("email", held_out.EMAILS, 1.0), ("phone", held_out.PHONES, 0.95), ("id_number", held_out.IDENTITIES, 0.85), ("address", held_out.ADDRESSES, 0.95)])
def test_held_out_sentences(field, kind, group, least):
    """Recall on sentences written apart from the training's phrases, in four languages, and no other kind in them."""
    found = [{pii.LABELS[y] for *_, y in field.find([t])} for t in group]
    assert sum(kind in f for f in found) >= least * len(group)
    assert sum(bool(f - {kind}) for f in found) <= 0.1 * len(group)


def test_held_out_sentences_without_details(field):
    assert sum(bool(field.find([t])) for t in held_out.HARMLESS) <= 0.05 * len(held_out.HARMLESS)


def test_repeated_mentions_share_their_label(field):
    """Where a person and a thing could stand, the clear mention elsewhere in the document decides, whatever lies between."""
    person, thing, between = "Thanks to Vora Teskin for the report.", "The Vora Teskin scheduler starts at boot.", "\n" + "nothing here. " * 500 + "\n"
    unclear = "Vora Teskin waits."
    label = lambda text, **kw: [pii.LABELS[y] for y in field.labels([text], **kw)[1]][-1]
    assert label(person + between + unclear) == "name" and label(thing + between + unclear) == "O"
    assert label(person + between + unclear, without=("skip",)) == label(thing + between + unclear, without=("skip",))


def test_skip_edges_decide_on_the_documents(field):
    table = Path("/root/testdata/sf0.1/documents.parquet")
    if not table.exists():
        pytest.skip("no test tables here")
    texts = pq.read_table(table, columns=["text"])["text"].to_pylist()
    _, with_, = field.labels(texts)
    _, without = field.labels(texts, without=("skip",))
    assert 0 < (with_ != without).sum() < 0.01 * len(with_)


def test_spans_have_no_bounds(field):
    local, line = "a" * 5000 + ".b", "word " * 3000
    text = f"mail {local}@host.example.org now\n{line}Thanks to Vora Teskin for the report, {line}call +44 20 7946 0018"
    got = [(text[a:z], pii.LABELS[y]) for _, a, z, y in field.find([text])]
    assert (f"{local}@host.example.org", "email") in got and ("Vora Teskin", "name") in got and ("+44 20 7946 0018", "phone") in got
    many = "Contact Vora Teskin at a@b.example. " * 3000
    assert len(field.find([many])) == 6000


def test_messages_on_a_tree_are_exact():
    r = np.random.default_rng(1)
    n = len(pii.LABELS)
    f = pii.Field({}, np.zeros((0, n)), {e: r.normal(size=(n, n)) for e in pii.EDGES})
    scores = r.normal(size=(3, n))
    b = f.beliefs(scores, {"chain": np.array([[0, 1]]), "skip": np.array([[1, 2]])}, rounds=60)
    whole = scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None, :] + f.pair["chain"][:, :, None] + f.pair["skip"][None]
    p = np.exp(whole - whole.max())
    for k, axes in enumerate([(1, 2), (0, 2), (0, 1)]):
        want = p.sum(axis=axes) / p.sum()
        got = np.exp(b[k] - b[k].max())
        assert np.allclose(got / got.sum(), want, atol=1e-6)


def test_lines_and_placeholders(spark):
    data = [(1, "x\r\nReported by Mara Oldenbrook.\ny\nTel. (555) 010-2345"), (1, "x\r\nReported by Mara Oldenbrook.\ny\nTel. (555) 010-2345"), (2, None), (3, ""), (None, "cc a@b.org"), (4, "z " * 50_000 + "\ncc a.b@c.org, d@e.org")]
    df = spark.createDataFrame(data, DOCS).withColumns({"line_no": F.lit("clash"), "pii_kind": F.lit(0)})
    assert rows(pii.find_lines(df)) == [(1, 2, "name"), (1, 4, "phone"), (4, 2, "email")]
    out = {r["doc_id"]: (r["text"], r["n_masked"]) for r in pii.masked(df).collect()}
    assert out[1] == ("x\r\nReported by [NAME].\ny\nTel. [PHONE]", 2) and out[4][0].endswith("\ncc [EMAIL], [EMAIL]") and out[2] == ("", 0)
    assert rows(pii.find_lines(df.limit(0))) == []


def test_queries_are_all_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {"p8_pack"} <= names and set(e.oracle_sql()) <= names


@pytest.mark.parametrize("text", ["JOHN.DOE [AT] EXAMPLE.COM", "JOHN.DOE (AT) EXAMPLE [DOT] COM"])
def test_addresses_in_capitals_alone(text):
    assert pii.candidates(text) == [(0, len(text), "email")]
