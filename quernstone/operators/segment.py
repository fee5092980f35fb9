"""Segmenters: parsed documents to units, each a slice of its document's canonical text.

Units: (unit_id, document_id, source_uri, text, span_start, span_end, section_path, kind, ordinal, table_ref, verbatim, block_ids,
content_hash, occurrence, prev_id, next_id). The whole-document and fixed-window segmenters are native. The structural one plans in
spans: greedy packing is sequential, so each document is planned by one call, documents in parallel, and the only text that is no
slice is that of split tables. Identity and neighbours come from windows over each document's units.

Defined cases: a document without blocks, or with blank text, has no units; blank pieces are no units; documents are told apart by
document_id, and equal rows are to be removed before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import ids
from quernstone.functions.text import quick_fold, tokens

MAX_TOKENS, MERGE_BELOW = 512, 32
#: A table is split at this size whatever the units' own limit is.
TABLE_TOKENS = 512
_KINDS = {"code": "code", "table": "table", "figure": "figure", "list_item": "list"}
_PIECE = "document_id string, source_uri string, text string, span_start int, span_end int, section_path array<string>, kind string, ordinal int, table_ref string, verbatim boolean, block_ids array<string>, occurrence int"


def linked(pieces: DataFrame) -> DataFrame:
    """Units with ids and neighbours from pieces that know their occurrence."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    u = pieces.withColumn("content_hash", ids.text_hash(F.col("text")))
    u = u.withColumn("unit_id", ids.unit_id(F.col("document_id"), F.col("content_hash"), F.col("occurrence")))
    return u.withColumns({"prev_id": F.lag("unit_id").over(order), "next_id": F.lead("unit_id").over(order)})


def _numbered(pieces: DataFrame) -> DataFrame:
    p = pieces.withColumn("_h", F.xxhash64("text", F.length("text")))
    return linked(p.withColumn("occurrence", (F.row_number().over(Window.partitionBy("document_id", "_h", "text").orderBy("ordinal")) - 1).cast("int")).drop("_h"))


def segment_whole(parsed: DataFrame) -> DataFrame:
    """One unit per document."""
    whole = parsed.filter((F.size("blocks") > 0) & F.col("text").rlike(r"\S"))
    p = whole.select("document_id", "source_uri", "text", F.lit(0).alias("span_start"), F.length("text").alias("span_end"), F.array().cast("array<string>").alias("section_path"), F.lit("prose").alias("kind"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("table_ref"), F.lit(True).alias("verbatim"), F.col("blocks.block_id").alias("block_ids"))
    return _numbered(p)


def section_at(offset: Column) -> Column:
    """The heading trail at an offset: of the headings up to it, each that no later one of its level or a higher one closes."""
    heads = F.filter("blocks", lambda b: (b["kind"] == "heading") & (b["span_start"] <= offset))
    open_ = F.filter(heads, lambda h: ~F.exists(heads, lambda x: (x["span_start"] > h["span_start"]) & (F.coalesce(x["level"], F.lit(1)) <= F.coalesce(h["level"], F.lit(1)))))
    return F.transform(open_, lambda h: h["text"])


def segment_fixed_window(parsed: DataFrame, window_tokens: int = 512, overlap_tokens: int = 64) -> DataFrame:
    """Windows of characters with overlap; blank ones and those over no block are dropped."""
    window, step = window_tokens * 4, max(1, (window_tokens - overlap_tokens) * 4)
    w = parsed.select("document_id", "source_uri", F.col("text").alias("_t"), "blocks", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(step))).alias("span_start"))
    w = w.withColumn("text", F.substring(F.col("_t"), F.col("span_start") + 1, F.lit(window))).filter(F.col("text").rlike(r"(?U)\S"))
    w = w.withColumn("span_end", F.col("span_start") + F.length("text"))
    covering = F.filter("blocks", lambda b: (b["span_start"] < F.col("span_end")) & (b["span_end"] > F.col("span_start")))
    has_level = "level" in parsed.schema["blocks"].dataType.elementType.names
    w = w.withColumns({"block_ids": F.transform(covering, lambda b: b["block_id"]), "section_path": section_at(F.col("span_start")) if has_level else F.array().cast("array<string>")}).filter(F.size("block_ids") > 0)
    order = Window.partitionBy("document_id").orderBy("span_start")
    w = w.select("document_id", "source_uri", "text", "span_start", "span_end", "section_path", F.lit("prose").alias("kind"), (F.row_number().over(order) - 1).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("table_ref"), F.lit(True).alias("verbatim"), "block_ids")
    return _numbered(w)


def _tokens(n: int) -> int:
    return max(1, n // 4)


def sentence_cuts(text: str) -> list[int]:
    """Offsets where a sentence begins: after . ! ? and white space, at a capital letter of any script or an opening bracket."""
    return [m.end() for m in re.finditer(r"(?<=[.!?])\s+", text) if m.end() < len(text) and (text[m.end()].isupper() or text[m.end()] in "([")]


def _packed(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs [i, j) of consecutive sizes, each as long as its sum stays within the limit."""
    runs, first, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > limit:
            runs.append((first, k))
            first, total = k, 0
        total += n
    return [*runs, (first, len(sizes))] if sizes else []


def plan_units(text: str, blocks: list[dict], max_tokens: int = MAX_TOKENS, merge_below: int = MERGE_BELOW) -> list[dict]:
    """The units of one document, in order: sections at headings, tables apart, blocks packed greedily, a block over the limit cut at
    sentences, and a short last run of a group folded into the unit before it as one slice of the text."""
    units: list[dict] = []
    counts: dict[str, int] = {}

    def add(start: int, end: int, path: list[str], kind: str = "prose", own: str | None = None, **rest) -> None:
        body = text[start:end] if own is None else own
        if body.strip():
            n = counts[body] = counts.get(body, -1) + 1
            units.append({"text": body, "span_start": start, "span_end": end, "section_path": path, "kind": kind, "occurrence": n, "table_ref": None, "verbatim": own is None or body == text[start:end], **rest})

    def run(group: list[dict], path: list[str]) -> None:
        sizes = [_tokens(b["span_end"] - b["span_start"]) for b in group]
        big = [k for k, n in enumerate(sizes) if n > max_tokens]
        for a, z in zip([0, *(k + 1 for k in big)], [*big, len(group)], strict=True):
            packs = _packed(sizes[a:z], max_tokens)
            for i, j in packs:
                start, end = group[a + i]["span_start"], group[a + j - 1]["span_end"]
                if z == len(group) and (i, j) == packs[-1] and sum(sizes[a + i : a + j]) < merge_below and units:
                    last = units.pop()
                    add(last["span_start"], end, last["section_path"], last["kind"])
                else:
                    add(start, end, path)
            if z < len(group):
                b = group[z]
                body, base = text[b["span_start"] : b["span_end"]], b["span_start"]
                edges = [0, *sentence_cuts(body), len(body)]
                for i, j in _packed([_tokens(y - x) for x, y in zip(edges, edges[1:], strict=False)], max_tokens):
                    add(base + edges[i], base + edges[j], path, _KINDS.get(b["kind"], "prose"))

    trail: list[tuple[int, str]] = []
    group: list[dict] = []
    for b in [*blocks, {"kind": "heading", "level": 1, "text": "", "span_start": len(text), "span_end": len(text)}]:
        table = b["kind"] == "table" and b.get("table") is not None
        if b["kind"] == "heading" or table:
            run(group, [t for _, t in trail])
            group = []
        if table:
            body, path = text[b["span_start"] : b["span_end"]], [t for _, t in trail]
            pieces = split_table(body, b["table"]["header_rows"] or 0)
            for k, piece in enumerate(pieces):
                add(b["span_start"], b["span_end"], path, "table_rows" if len(pieces) > 1 else "table", piece, table_ref=f"{b['block_id']}#{k}")
        elif b["kind"] == "heading":
            level = b.get("level") or 1
            trail = [*(x for x in trail if x[0] < level), (level, b["text"] if "text" in b else text[b["span_start"] : b["span_end"]])]
        else:
            group.append(b)
    for k, u in enumerate(units):
        u["ordinal"] = k
        u["block_ids"] = [b["block_id"] for b in blocks if b["kind"] != "heading" and b["span_start"] < u["span_end"] and b["span_end"] > u["span_start"]]
    return units


def split_table(body: str, header_rows: int) -> list[str]:
    """A rendered table in groups of rows, each led by the header lines."""
    if _tokens(len(body)) <= TABLE_TOKENS:
        return [body]
    lines = body.splitlines()
    head = lines[: max(header_rows, 1) + 1]
    rows = lines[len(head) :]
    room = TABLE_TOKENS - _tokens(len("\n".join(head)))
    return ["\n".join([*head, *rows[i:j]]) for i, j in _packed([_tokens(len(r)) for r in rows], room)] or [body]


def segment_structural(parsed: DataFrame, max_tokens: int = MAX_TOKENS, merge_below: int = MERGE_BELOW) -> DataFrame:
    """The structural segmenter; one call per document, no shuffle before identity and neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in _PIECE.replace("array<string>", "x").split(", ")]
        for b in batches:
            rows = []
            for doc, uri, text, blocks in b[["document_id", "source_uri", "text", "blocks"]].itertuples(index=False):
                held = [dict(x) for x in blocks] if blocks is not None else []
                for u in plan_units(text or "", held, max_tokens, merge_below):
                    rows.append({"document_id": doc, "source_uri": uri, **u})
            yield pd.DataFrame(rows, columns=columns)

    return linked(parsed.select("document_id", "source_uri", "text", "blocks").mapInPandas(run, _PIECE))


SEGMENTERS = {"whole_document": segment_whole, "fixed_window": segment_fixed_window, "structural": segment_structural}


def unit_violations(units: DataFrame, parsed: DataFrame) -> DataFrame:
    """(unit_id, problem): repeated ids, spans out of bounds, verbatim text that is not in its span, other text of which less than 60 % of the
    words are, and repeated ordinals."""
    p = parsed.select("document_id", F.col("text").alias("_canonical"))
    u = units.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("unit_id")), "_before": F.lag("ordinal").over(Window.partitionBy("document_id").orderBy("ordinal"))}).join(p, "document_id", "left")
    held = F.substring(F.col("_canonical"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    own = F.array_distinct(tokens(quick_fold(F.col("text"))))
    problems = [
        F.when(F.col("_n") > 1, "repeated id"), F.when(F.col("_canonical").isNull(), "no such document"), F.when((F.col("span_start") < 0) | (F.col("span_end") > F.length("_canonical")), "span out of bounds"),
        F.when(F.col("verbatim") & ~held.contains(F.col("text")), "text is not in its span"), F.when(F.col("ordinal") == F.col("_before"), "repeated ordinal"),
        F.when(~F.col("verbatim") & (F.size(F.array_intersect(own, tokens(quick_fold(held)))) < 0.6 * F.size(own)), "words are not of its span"),
    ]
    return u.select("unit_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def unstable_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units of which an edit elsewhere changed the id though not the text."""
    a, b = before.select("document_id", "text", F.col("unit_id").alias("old_id")), after.select("document_id", "text", F.col("unit_id").alias("new_id"))
    same = a.join(b, [a["document_id"] == b["document_id"], a["text"] == b["text"], a["old_id"] == b["new_id"]], "left_anti")
    return same.join(b, ["document_id", "text"], "left_semi")
