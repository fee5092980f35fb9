"""Parsers: documents to ordered, typed blocks whose spans are slices of one canonical text.

A document is a row (document_id, source_uri, text, media_type, ...); a parsed one has `text`, the canonical text, and `blocks`, an
array of (block_id, kind, text, span_start, span_end, level, directive, table). Canonical text is the blocks' texts joined by blank
lines, so text[start:end] is the block by construction. Plain text and pass-through are native expressions. Markdown and
reStructuredText are each one pattern of blocks, whose alternatives are the formats' constructs, run over the whole text.

Defined cases: a null text is an empty document with no blocks; a row per input row, repeated rows included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import stripped

CELL = "struct<text:string,row_span:int,col_span:int,is_header:boolean>"
BLOCK = f"struct<block_id:string,kind:string,text:string,span_start:int,span_end:int,level:int,directive:string,table:struct<rows:array<array<{CELL}>>,header_rows:int>>"
_JOINT = "\n\n"


def _laid_out(texts: Column, kind: str) -> tuple[Column, Column]:
    """Canonical text and blocks of an array of block texts."""
    ends = F.transform(texts, lambda t, k: F.aggregate(F.slice(F.transform(texts, F.length), 1, k + 1), F.lit(0), lambda a, n: a + n + 2) - 2)
    empty = F.lit(None)
    blocks = F.transform(
        F.arrays_zip(texts.alias("t"), ends.alias("e")),
        lambda z, k: F.struct(F.concat(F.lit("b"), k).alias("block_id"), F.lit(kind).alias("kind"), z["t"].alias("text"), (z["e"] - F.length(z["t"])).alias("span_start"), z["e"].alias("span_end"), empty.cast("int").alias("level"), empty.cast("string").alias("directive"), empty.cast(BLOCK.split("table:")[1][:-1]).alias("table")),
    )
    return F.array_join(texts, _JOINT), blocks


def parse_text(documents: DataFrame) -> DataFrame:
    """Paragraphs between blank lines."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n(?U:\s)*\n"), stripped), lambda p: p != "")
    d = documents.withColumn("_parts", parts)
    text, blocks = _laid_out(F.col("_parts"), "paragraph")
    return d.withColumns({"blocks": blocks, "text": text}).drop("_parts")


def parse_passthrough(documents: DataFrame) -> DataFrame:
    """The whole text as one block; none if it is blank."""
    whole = stripped(F.coalesce("text", F.lit("")))
    d = documents.withColumn("_parts", F.filter(F.array(whole), lambda p: p != ""))
    text, blocks = _laid_out(F.col("_parts"), "other")
    return d.withColumns({"blocks": blocks, "text": text}).drop("_parts")


_BLANK = r"[^\S\n]*$"
_FENCED = r"[^\S\n]*(?P<fence>```|~~~).*(?:\n(?![^\S\n]*(?P=fence)).*)*(?:\n[^\S\n]*(?P=fence).*)?"
_TITLE = r"(?P<marks>#{1,6})[^\S\n]+(?P<title>.*)"
_ITEM = r"[^\S\n]*(?:[-*+]|\d+\.)[^\S\n]"
#: A table is a line with a pipe over a line of cells that are only dashes, at least two, with colons for the alignment.
_DASHES = r"[^\S\n]*:?-{2,}:?[^\S\n]*"
_HEAD_ROWS = rf"(?=.*\|).*\n[^\S\n]*\|?{_DASHES}(?:\|{_DASHES})*\|?{_BLANK}"
_PROSE = rf"(?!{_BLANK}|[^\S\n]*(?:```|~~~)|{_TITLE.replace('?P<marks>', '?:').replace('?P<title>', '?:')}|{_HEAD_ROWS}|{_ITEM}).+"
#: Markdown as one pattern of blocks over the text; the first alternative that holds at a line takes it.
_MARKDOWN = re.compile(
    rf"^(?:(?P<code>{_FENCED})|(?P<heading>{_TITLE})|(?P<table>{_HEAD_ROWS}(?:\n(?=.*\|).*)*)|(?P<list_item>{_ITEM}.*(?:\n(?:{_ITEM}|  ).*)*)|(?P<paragraph>{_PROSE}(?:\n{_PROSE})*))", re.M
)


def _cells(line: str, header: bool) -> list[dict]:
    return [{"text": c.strip(), "row_span": 1, "col_span": 1, "is_header": header} for c in line.strip().strip("|").split("|")]


def markdown_blocks(text: str, keep_code: bool = True) -> list[dict]:
    """Blocks of a Markdown text, each a slice of it. An open fence runs to the end."""
    found = []
    for m in _MARKDOWN.finditer("\n".join(text.splitlines())):
        kind, body = m.lastgroup, m[0]
        if kind == "heading":
            found.append({"kind": kind, "text": m["title"].strip(), "level": len(m["marks"])})
        elif kind == "table":
            head, _, *rest = body.split("\n")
            found.append({"kind": kind, "text": body, "table": {"rows": [_cells(head, True), *(_cells(x, False) for x in rest)], "header_rows": 1}})
        elif kind == "code":
            found += [{"kind": kind, "text": body}] if keep_code else []
        elif body.strip():
            found.append({"kind": kind, "text": body.strip()})
    return found


#: A noncharacter set before lines that an underline long enough follows; taken out of texts first.
_MARK = "﷐"
#: The characters that underline a title, and the directives that hold code.
UNDERLINES = "=-`:'\"~^_*+#"
CODE_DIRECTIVES = ("code", "code-block", "sourcecode")
_UNDERLINED = re.compile(rf"^(?!{_BLANK})(.++)(?=\n(([{re.escape(UNDERLINES)}])\3+)[^\S\n]*$)", re.M)
_DIRECTIVE = r"\.\.[^\S\n]+(?P<name>\w[\w-]*)::.*"
_BODY = rf"(?:\n(?:{_MARK}?[ \t].*|{_BLANK}))*"
_LEADS = rf"(?!{_MARK}|\.\.[^\S\n]+\w[\w-]*::).*::{_BLANK}"
_SPEECH = rf"(?!{_MARK}|\.\.[^\S\n]+\w[\w-]*::|{_BLANK}|.*::{_BLANK}).+"
#: reStructuredText likewise, over the text with marked titles.
_RST = re.compile(rf"^(?:(?P<heading>{_MARK}(?P<title>.*)\n(?P<rule>.*))|(?P<directive>{_DIRECTIVE}{_BODY})|(?P<literal>(?P<lead>(?:{_SPEECH}\n)*+{_LEADS})(?P<body>{_BODY}))|(?P<paragraph>{_SPEECH}(?:\n{_SPEECH})*))", re.M)


def rst_blocks(text: str) -> list[dict]:
    """Blocks of a reStructuredText text; a title's level is the place of its underline's character among those seen before."""
    lines = "\n".join(text.replace(_MARK, "").splitlines())
    found, order = [], []
    for m in _RST.finditer(_UNDERLINED.sub(lambda u: (_MARK if len(u[2]) >= len(u[1].strip()) - 1 else "") + u[1], lines)):
        kind, body = m.lastgroup, m[0].replace(_MARK, "")
        if kind == "heading":
            mark = m["rule"].replace(_MARK, "")[0]
            order += [] if mark in order else [mark]
            found.append({"kind": kind, "text": m["title"].strip(), "level": order.index(mark) + 1})
        elif kind == "directive":
            found.append({"kind": "code" if m["name"] in CODE_DIRECTIVES else "other", "text": body.rstrip(), "directive": m["name"]})
        elif kind == "literal":
            inner = m["body"].replace(_MARK, "").strip("\n")
            found.append({"kind": "paragraph", "text": m["lead"].strip()})
            found += [{"kind": "code", "text": inner}] if inner.strip() else []
        elif body.strip():
            found.append({"kind": kind, "text": body.strip()})
    return found


def _by_lines(documents: DataFrame, blocks_of: Callable[[str], list[dict]]) -> DataFrame:
    schema = documents.drop("text", "blocks").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, all_blocks = [], []
            for text in b["text"]:
                at, out = 0, []
                for k, x in enumerate(blocks_of(text or "")):
                    out.append({"block_id": f"b{k}", "level": None, "directive": None, "table": None, **x, "span_start": at, "span_end": at + len(x["text"])})
                    at += len(x["text"]) + len(_JOINT)
                texts.append(_JOINT.join(x["text"] for x in out))
                all_blocks.append(out)
            yield b.drop(columns=["text"]).assign(text=texts, blocks=all_blocks)

    out = T.StructType([*schema.fields, T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T._parse_datatype_string(BLOCK)))])
    return documents.drop("blocks").mapInPandas(run, out)


def parse_markdown(documents: DataFrame, keep_code: bool = True) -> DataFrame:
    """Headings, fenced code, pipe tables with their grid, lists, paragraphs."""
    return _by_lines(documents, lambda t: markdown_blocks(t, keep_code))


def parse_rst(documents: DataFrame) -> DataFrame:
    """Underlined headings (levels in order of appearance), directives, literal blocks, paragraphs."""
    return _by_lines(documents, rst_blocks)


PARSERS = {"text": parse_text, "passthrough": parse_passthrough, "markdown": parse_markdown, "rst": parse_rst}
_CONFIDENCE = {"text": ("text/%", 0.3, 0.1), "markdown": ("text/markdown", 0.9, 0.2), "rst": ("text/x-rst", 0.9, 0.15), "passthrough": ("", 0.05, 0.05)}


def can_parse(parser: str, media_type: Column) -> Column:
    """How sure a parser is of a media type."""
    like, yes, no = _CONFIDENCE[parser]
    return F.when(media_type.like(like), F.lit(yes)).otherwise(F.lit(no))


def parse_routed(documents: DataFrame, routes: list[tuple[Column, str]], default: str = "text") -> DataFrame:
    """Each document by the parser of the first route that holds, one branch per parser."""
    choice = F.lit(None).cast("string")
    for holds, parser in reversed(routes):
        choice = F.when(F.coalesce(holds, F.lit(False)), F.lit(parser)).otherwise(choice)
    named = documents.withColumn("parser", F.coalesce(choice, F.lit(default)))
    parts = [PARSERS[p](named.filter(F.col("parser") == p)) for p in dict.fromkeys([*(p for _, p in routes), default])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_violations(parsed: DataFrame) -> DataFrame:
    """(document_id, block_id, problem): blocks that break the contract of spans, order, tables and levels; with a null block_id documents
    without an id, or whose reading_order_confidence, where there is one, isn't between 0 and 1."""
    b = parsed.select("document_id", F.col("text").alias("_canonical"), F.posexplode("blocks").alias("k", "b")).select("document_id", "_canonical", "k", "b.*")
    b = b.withColumn("_before", F.max("span_end").over(Window.partitionBy("document_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    problems = [F.when((F.col("span_start") < 0) | (F.col("span_end") < F.col("span_start")) | (F.col("span_end") > F.length("_canonical")), "span out of bounds"), F.when(F.col("span_start") < F.col("_before"), "out of order")]
    if "text" in b.columns:
        problems.append(F.when(F.substring("_canonical", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) != F.col("text"), "text is not its span"))
    if "level" in b.columns:
        problems += [F.when((F.col("kind") == "heading") & F.col("level").isNull(), "heading without level"), F.when((F.col("kind") == "table") & F.col("table").isNull(), "table without grid")]
    whole = [F.when(F.coalesce("document_id", F.lit("")) == "", "no document id")]
    if "reading_order_confidence" in parsed.columns:
        sure = F.col("reading_order_confidence")
        whole.append(F.when(~sure.between(0, 1) | F.isnan(sure), "confidence out of bounds"))
    of_documents = parsed.select("document_id", F.lit(None).cast("string").alias("block_id"), F.explode(F.array_compact(F.array(*whole))).alias("problem"))
    return b.select("document_id", "block_id", F.explode(F.array_compact(F.array(*problems))).alias("problem")).unionByName(of_documents)


def blocks_by_kind(parsed: DataFrame, *kinds: str) -> DataFrame:
    """(document_id, block_id, kind, text): the blocks of some kinds, in order, each cut out of its document's text."""
    b = parsed.select("document_id", "text", F.posexplode("blocks").alias("ordinal", "b")).filter(F.col("b.kind").isin(*kinds))
    return b.select("document_id", "ordinal", "b.block_id", "b.kind", span_text(F.col("text"), F.col("b.span_start"), F.col("b.span_end")).alias("text"))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The slice of a canonical text; what lies outside it is left off."""
    return F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))
