"""Enrichers: context prepended to a unit's retrieval surface, and typed fields taken from its text.

Every enricher maps units to (unit_id, enricher, context, fields) with exactly one row per unit. Contexts are joined in the order of
the enrichers' names, so the surface doesn't depend on configuration order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

_NONE = "map<string,string>"


def _shape(df: DataFrame, enricher: str, context: Column, fields: Column | None = None) -> DataFrame:
    return df.select("unit_id", F.lit(enricher).alias("enricher"), context.alias("context"), (fields if fields is not None else F.lit(None).cast(_NONE)).alias("fields"))


def document_titles(parsed: DataFrame) -> DataFrame:
    """(document_id, title): the first heading, else the file's name without extension."""
    head = F.get(F.filter("blocks", lambda b: b["kind"] == "heading"), F.lit(0))
    has_text = "text" in parsed.schema["blocks"].dataType.elementType.names
    first = head["text"] if has_text else F.substring(F.col("text"), head["span_start"] + 1, head["span_end"] - head["span_start"])
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("source_uri", "/"), -1), r"\.[^.]*$", ""), "[_-]", " ")
    return parsed.select("document_id", F.coalesce(first, name).alias("title"))


def section_prefix(units: DataFrame, titles: DataFrame) -> DataFrame:
    """Title and section trail joined by " > "; null if both are empty."""
    u = units.join(titles, "document_id", "left")
    parts = F.filter(F.concat(F.array("title"), F.coalesce("section_path", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return _shape(u, "section_prefix", F.when(F.size(parts) > 0, F.array_join(parts, " > ")))


def top_terms(documents: DataFrame, n: int) -> DataFrame:
    """(document_id, terms): the N most frequent topical words, equal counts in alphabetical order."""
    w = documents.select("document_id", F.explode(T.topical(T.words(T.quick_fold(F.col("text"))))).alias("term")).groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n"))
    ranked = w.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "term"))).filter(F.col("rank") <= n)
    return ranked.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def lead(text: Column, n: int) -> Column:
    """The first N sentences without the title line."""
    lines = F.filter(F.split(T.stripped(text), r"\r?\n"), lambda x: x.rlike(r"\S"))
    prose = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), " ")).otherwise(T.stripped(text))
    return T.stripped(F.array_join(F.slice(T.sentences(prose), 1, n), " "))


def extractive_context(units: DataFrame, parsed: DataFrame, max_chars: int = 400, n_lead: int = 2, n_terms: int = 6) -> DataFrame:
    """What situates a unit in its document: title, trail, lead sentences, and the document's frequent words the unit lacks."""
    about = parsed.select("document_id", lead(F.col("text"), n_lead).alias("lead")).join(document_titles(parsed), "document_id").join(top_terms(parsed, n_terms * 3), "document_id", "left")
    u = units.join(about, "document_id", "left")
    missing = F.slice(F.array_except(F.coalesce("terms", F.array().cast("array<string>")), T.words(T.quick_fold(F.col("text")))), 1, n_terms)
    parts = F.array(F.col("title"), F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")), F.col("lead"), F.when(F.size(missing) > 0, F.concat(F.lit("Topics: "), F.array_join(missing, ", "), F.lit("."))))
    context = T.stripped(F.substring(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "), 1, max_chars))
    return _shape(u, "extractive_context", F.when(context != "", context))


@dataclass(frozen=True)
class FieldRule:
    name: str
    pattern: str
    kind: str = "str"
    group: int = 1


def coerced(raw: Column, kind: str) -> Column:
    """A text as its declared type, in canonical spelling; null if it isn't one."""
    plain = F.regexp_replace(raw, r"[,_\s]", "")
    if kind == "int":
        return plain.try_cast("bigint").cast("string")
    if kind == "float":
        return plain.try_cast("double").cast("string")
    if kind == "bool":
        return F.lower(F.trim(raw)).isin("true", "yes", "1").cast("string")
    if kind == "date":
        return F.substring(raw, 1, 10).try_cast("date").cast("string")
    return raw


def regex_fields(units: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """Typed fields by the first match of each rule, in any case and line by line; what doesn't match or parse is left out."""
    entries = []
    for r in rules:
        pattern = f"(?im){r.pattern}"
        value = coerced(F.regexp_extract(F.col("text"), pattern, r.group), r.kind)
        entries.append(F.struct(F.lit(r.name).alias("key"), F.when(F.col("text").rlike(pattern), value).alias("value")))
    return _shape(units, "regex_fields", F.lit(None).cast("string"), F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())))


def model_context(units: DataFrame, name: str, write: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Context by a model: WRITE maps a batch of texts to contexts and is called once per Arrow batch. No model comes with the package."""
    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return pd.Series(write(texts.tolist()), dtype="object")

    return _shape(units, name, written(F.col("text")))


def surface(units: DataFrame, enrichments: DataFrame) -> DataFrame:
    """units with `surface`, the one text all indexes read: contexts in the order of the enrichers' names, then the unit's text."""
    c = enrichments.filter(F.trim("context") != "").groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("enricher", "context"))), lambda x: F.trim(x["context"])).alias("_c"))
    return units.join(c, "unit_id", "left").withColumn("surface", F.array_join(F.concat(F.coalesce("_c", F.array().cast("array<string>")), F.array("text")), "\n\n")).drop("_c")


def merged_fields(enrichments: DataFrame) -> DataFrame:
    """(unit_id, name, value): of equal names the enricher last in order holds."""
    e = enrichments.filter("fields is not null").select("unit_id", "enricher", F.explode("fields").alias("name", "value"))
    return e.groupBy("unit_id", "name").agg(F.max_by("value", "enricher").alias("value"))


def missing_enrichments(units: DataFrame, enrichments: DataFrame, enrichers: list[str]) -> DataFrame:
    """(unit_id, enricher, n) where an enricher didn't give exactly one row per unit."""
    want = units.select("unit_id", F.explode(F.array(*[F.lit(e) for e in enrichers])).alias("enricher"))
    have = enrichments.groupBy("unit_id", "enricher").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["unit_id", "enricher"], "left").select("unit_id", "enricher", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def context_specificity(units: DataFrame, contexts: DataFrame) -> DataFrame:
    """(document_id, mean_jaccard, n_pairs): likeness of the contexts of neighbouring units; near 1 they tell units apart no more."""
    u = units.select("document_id", "unit_id", "ordinal").join(contexts.filter("context is not null").select("unit_id", F.array_distinct(T.tokens(T.quick_fold(F.col("context")))).alias("t")), "unit_id")
    before = F.lag("t").over(Window.partitionBy("document_id").orderBy("ordinal"))
    pairs = u.withColumn("p", before).filter(F.col("p").isNotNull() & (F.size(F.array_union("t", "p")) > 0))
    return pairs.groupBy("document_id").agg(F.round(F.avg(F.size(F.array_intersect("t", "p")) / F.size(F.array_union("t", "p"))), 9).alias("mean_jaccard"), F.count(F.lit(1)).alias("n_pairs"))
