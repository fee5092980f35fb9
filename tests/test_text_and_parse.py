from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import ids
from quernstone.functions import text as T
from quernstone.operators import enrich, parse, segment

DOC = "document_id string, source_uri string, text string"


def test_fold_and_tokens(spark):
    given_ = ["Größe STRASSE", "città è", "requests.get read-timeout a.b-c", "日本 x_1", None, ""]
    df = spark.createDataFrame([(t,) for t in given_], "t string")
    got = [r[0] for r in df.select(T.tokens(T.fold(F.col("t")))).collect()]
    assert got == [["grösse", "strasse"], ["città", "è"], ["requests.get", "read-timeout", "a.b-c"], ["日本", "x_1"], None, []]
    assert unicodedata.normalize("NFC", "è") == got[1][1]


def test_ids_equal_hashlib(spark):
    def merge(*parts):
        h = hashlib.sha256()
        for p in parts:
            b = p.encode()
            h.update(len(b).to_bytes(8, "big") + b)
        return h.hexdigest()

    df = spark.createDataFrame([("dö", "tëxt")], "d string, t string").withColumn("h", ids.text_hash(F.col("t")))
    r = df.select("h", ids.unit_id(F.col("d"), F.col("h"), F.lit(2)).alias("u"), ids.document_id("ns", F.col("d")).alias("doc")).first()
    want = "sha256:" + hashlib.sha256("tëxt".encode()).hexdigest()
    assert r["h"] == want and r["u"] == merge("unit", "dö", want, "2")[:24] and r["doc"] == merge("doc", "ns", "dö")[:24]
    with pytest.raises(TypeError):
        ids.canonical({"a": object()})
    assert ids.canonical({"b": {2, 1}, "a": 1}) == '{"a":1,"b":[1,2]}'


MD = "# Top\nIntro line\nmore\n\n- one\n- two\n  deep\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n```py\n# no heading\n```\n## Sub\n~~~\nopen"


def test_markdown_blocks():
    got = [(b["kind"], b["text"]) for b in parse.markdown_blocks(MD)]
    assert got == [("heading", "Top"), ("paragraph", "Intro line\nmore"), ("list_item", "- one\n- two\n  deep"), ("table", "| a | b |\n|---|---|\n| 1 | 2 |"), ("paragraph", "after"), ("code", "```py\n# no heading\n```"), ("heading", "Sub"), ("code", "~~~\nopen")]
    table = parse.markdown_blocks(MD)[3]["table"]
    assert [[c["text"] for c in r] for r in table["rows"]] == [["a", "b"], ["1", "2"]] and table["rows"][0][0]["is_header"]
    assert [b["kind"] for b in parse.markdown_blocks(MD, keep_code=False)].count("code") == 0
    assert parse.rst_blocks("") == [] and parse.rst_blocks("\n \n") == []
    assert parse.markdown_blocks("") == [] and parse.markdown_blocks("   \n\n") == []


RST = "Title\n=====\n\nText here::\n\n   lit one\n   lit two\n\n.. note:: hi\n   more\n\nSub\n---\n.. code-block:: python\n\n   x = 1\nplain\nT2\n==\n"


def test_rst_blocks():
    got = [(b["kind"], b["text"], b.get("level")) for b in parse.rst_blocks(RST)]
    assert got == [("heading", "Title", 1), ("paragraph", "Text here::", None), ("code", "   lit one\n   lit two", None), ("other", ".. note:: hi\n   more", None), ("heading", "Sub", 2), ("code", ".. code-block:: python\n\n   x = 1", None), ("paragraph", "plain", None), ("heading", "T2", 1)]


def docs(spark, texts):
    return spark.createDataFrame([(f"d{k}", f"s/d{k}.md", t) for k, t in enumerate(texts)], DOC)


@pytest.mark.parametrize("name", sorted(parse.PARSERS))
def test_parsers_keep_the_contract(spark, name):
    parsed = parse.PARSERS[name](docs(spark, [MD, RST, "", None, "a\n\n b \n\n\n\nc", "x" * 50_000]))
    assert rows(parse.parse_violations(parsed)) == []
    assert parsed.count() == 6


def test_routed_parsing(spark):
    d = docs(spark, [MD, RST]).withColumn("media_type", F.when(F.col("document_id") == "d0", "text/markdown"))
    p = parse.parse_routed(d, [(F.col("media_type") == "text/markdown", "markdown")], "text")
    assert {r["document_id"]: r["parser"] for r in p.select("document_id", "parser").collect()} == {"d0": "markdown", "d1": "text"}


def packed_sentences(text, limit):
    """The rule of long blocks by brute force: whole sentences of at most so many estimated tokens together, each estimate rounded down."""
    units, sizes = [""], 0
    for sentence in re.findall(r"[^.]+\. ?", text):
        n = max(1, len(sentence) // 4)
        if units[-1] and sizes + n > limit:
            units, sizes = [*units, ""], 0
        units[-1], sizes = units[-1] + sentence, sizes + n
    return units


def test_structural_units(spark):
    text = "# A\n\n" + "One sentence here. " * 300 + "\n\n# B\n\nshort\n\n# C\n\nshort"
    parsed = parse.parse_markdown(docs(spark, [MD, text, ""]))
    units = segment.segment_structural(parsed, 512, 32)
    assert rows(segment.unit_violations(units, parsed)) == []
    got = units.orderBy("document_id", "ordinal").collect()
    long = [u for u in got if u["document_id"] == "d1"]
    packed = packed_sentences("One sentence here. " * 299 + "One sentence here.", 512)
    assert [u["text"] for u in long[:-1]] == packed[:-1] and long[-1]["text"] == packed[-1] + "\n\nB\n\nshort\n\nC\n\nshort"
    assert [u["prev_id"] for u in long][1:] == [u["unit_id"] for u in long][:-1]
    assert not [u for u in got if u["document_id"] == "d2"]


def test_edits_elsewhere_leave_ids(spark):
    body = "\n\n".join(f"# H{k}\n\n" + f"Paragraph number {k} speaks. " * 20 for k in range(5))
    a, b = (segment.segment_structural(parse.parse_markdown(docs(spark, [t]))) for t in (body, body.replace("number 1 speaks", "number 1 talks")))
    assert rows(segment.unstable_units(a, b)) == []
    assert a.join(b, "unit_id").count() == 4


def test_equal_texts_get_occurrences(spark):
    parsed = parse.parse_markdown(docs(spark, ["# A\n\n" + "same words again. " * 10 + "\n\n# B\n\n" + "same words again. " * 10]))
    u = segment.segment_structural(parsed).orderBy("ordinal").collect()
    assert [x["occurrence"] for x in u] == [0, 1] and len({x["unit_id"] for x in u}) == 2


def test_table_split_repeats_header(spark):
    table = "| h1 | h2 |\n|----|----|\n" + "\n".join(f"| row {k} | {'v' * 20} |" for k in range(200))
    pieces = segment.split_table(table, 1)
    assert len(pieces) > 1 and all(p.startswith("| h1 | h2 |\n|----|") for p in pieces)
    assert sum(p.count("| row ") for p in pieces) == 200


def test_fixed_windows(spark):
    parsed = parse.parse_passthrough(docs(spark, ["abcdefghij" * 10, "  ", None]))
    w = segment.segment_fixed_window(parsed, 10, 2).orderBy("ordinal").collect()
    assert [(u["span_start"], u["span_end"]) for u in w] == [(0, 40), (32, 72), (64, 100), (96, 100)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["paragraph", "heading", "code", "list_item"]), st.text("aB. \n(é", min_size=1, max_size=400).filter(lambda t: t.strip()), st.integers(1, 3)), max_size=8))
def test_units_are_slices(blocks):
    text, made = "", []
    for k, (kind, body, level) in enumerate(blocks):
        text += ("\n\n" if k else "") + body
        made.append({"block_id": f"b{k}", "kind": kind, "text": body, "span_start": len(text) - len(body), "span_end": len(text), "level": level})
    units = segment.plan_units(text, made, 40, 4)
    assert all(text[u["span_start"] : u["span_end"]] == u["text"] for u in units)
    assert all(a["span_end"] <= b["span_start"] for a, b in zip(units, units[1:], strict=False))
    content = [b for b in made if b["kind"] != "heading"]
    assert all(any(u["span_start"] <= b["span_start"] and b["span_end"] <= u["span_end"] for u in units) or len(b["text"]) // 4 > 40 for b in content)


def test_contracts_are_checked(spark):
    parsed = parse.parse_markdown(docs(spark, [MD])).withColumn("reading_order_confidence", F.lit(1.5))
    assert rows(parse.parse_violations(parsed)) == [("d0", None, "confidence out of bounds")]
    assert rows(parse.parse_violations(parsed.drop("reading_order_confidence").withColumn("document_id", F.lit(""))), "problem") == [("no document id",)]
    assert rows(parse.blocks_by_kind(parsed, "heading"), "ordinal", "text") == [(0, "Top"), (6, "Sub")]
    units = segment.segment_structural(parsed.drop("reading_order_confidence"))
    strange = units.withColumns({"verbatim": F.lit(False), "text": F.lit("nothing of this kind stands there")})
    assert {r[1] for r in rows(segment.unit_violations(strange, parsed))} == {"words are not of its span"} and rows(segment.unit_violations(units, parsed)) == []


def test_context_by_a_model(spark):
    units = spark.createDataFrame([("u1", "some text"), ("u2", None)], "unit_id string, text string")
    got = enrich.model_context(units, "mine", lambda texts: [None if t is None else t.upper() for t in texts])
    assert rows(got, "unit_id", "enricher", "context") == [("u1", "mine", "SOME TEXT"), ("u2", "mine", None)]
