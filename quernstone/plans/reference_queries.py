"""Queries for the document indexing, retrieval and evaluation operators, and the SQL each is held against.

Queries without SQL are state machines or hashes DuckDB lacks; tests/ hold them against brute force on small fixtures."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import ids
from quernstone.functions import text as T
from quernstone.operators import dense, eav, enrich, evaluation, ledger, lexical, parse, retrieve, route, segment, structured
from quernstone.operators.structured import Aggregation, And, Compare, Exists, In, Not, Or, StructuredQuery, TextMatch
from quernstone.plans.data_queries import _CELLS, _KIND, _WIDE
from quernstone.session import cut, scratch, table
from quernstone.sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# fixed values: the tokens' and words' patterns, in SQL
_TOKENS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '([\p{{L}}\p{{N}}_]+(?:[.\-][\p{{L}}\p{{N}}_]+)*)', 1)"
_WORDS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '([\p{{L}}\p{{Nl}}\p{{No}}_][\p{{L}}\p{{N}}_.\-]{{2,}})', 1)"
_STOP = "('" + "', '".join(dict.fromkeys(T.STOPWORDS)) + "')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_HASH = "'sha256:' || sha256({})"
_LED = "unhex(lpad(to_hex(strlen({0})), 16, '0')) || encode({0})"
_UNITS = "u as (select distinct unit_id, document_id, source_uri, span_start, span_end, section, text from units)"
_SPANS = "g as (select distinct query_id, document_id, span_start, span_end, weight from relevant_spans)"


def _merged_sql(*parts: str) -> str:
    return "'sha256:' || sha256(" + " || ".join(_LED.format(p) for p in parts) + ")"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "units").select("unit_id", "document_id", "source_uri", "span_start", "span_end", "section", "text").distinct()


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "relevant_spans").select("query_id", "document_id", "span_start", "span_end", "weight").distinct()


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "golden_queries").select("query_id", "query", "query_type")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_uri"), "text", F.lit("text/plain").alias("media_type"))


# text and identity


@query("tokenize_stats", f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct from (select doc_id, {_TOKENS.format('text')} as t from documents)")
def _(spark, sf):
    t = T.tokens(T.quick_fold(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("content_words_topk", f"""
with w as (select doc_kind, unnest({_WORDS.format('text')}) as term from documents),
c as (select doc_kind, term, count(*) as n from w where term not in {_STOP} and not regexp_full_match(term, '\\p{{Nd}}+') and length(term) >= 4 group by 1, 2)
select doc_kind, term, n, rank from (select *, row_number() over (partition by doc_kind order by n desc, term) as rank from c) where rank <= 20""")
def _(spark, sf):
    from pyspark.sql import Window

    w = table(spark, sf, "documents").select("doc_kind", F.explode(T.content_words(T.quick_fold(F.col("text")))).alias("term")).groupBy("doc_kind", "term").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("doc_kind").orderBy(F.desc("n"), "term"))).filter("rank <= 20")


@query("unit_identity", f"with {_UNITS}, h as (select *, {_HASH.format('text')} as content_hash from u) select unit_id as given_id, content_hash, substr({_merged_sql(chr(39) + 'unit' + chr(39), 'document_id', 'content_hash', chr(39) + '0' + chr(39))}, 8, 24) as unit_id from h")
def _(spark, sf):
    u = _units(spark, sf).withColumn("content_hash", ids.text_hash(F.col("text")))
    return u.select(F.col("unit_id").alias("given_id"), "content_hash", ids.unit_id(F.col("document_id"), F.col("content_hash"), F.lit("0")).alias("unit_id"))


@query("cache_key", f"select document_id, {_merged_sql(chr(39) + 'parse' + chr(39), chr(39) + 'text' + chr(39), chr(39) + '1' + chr(39), chr(39) + ids.config_hash({}) + chr(39), 'coalesce(source_hash, ' + chr(39) * 2 + ')', 'document_id')} as cache_key from parsed_documents")
def _(spark, sf):
    return table(spark, sf, "parsed_documents").select("document_id", ids.cache_key("parse", "text", "1", {}, F.coalesce("source_hash", F.lit("")), F.col("document_id")).alias("cache_key"))


@query("content_hash", f"select doc_id, {_HASH.format('text')} as content_hash from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.text_hash(F.col("text")).alias("content_hash"))


@query("dup_occurrence_ids", f"select doc_id, row_number() over (partition by source, text order by doc_id) - 1 as occurrence from documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_id"), ids.text_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("ordinal"))
    return d.select("doc_id", ids.occurrence().cast("bigint").alias("occurrence"))


# scanning


@query("scan_media_type", "select document_id, case lower(regexp_extract(source_uri, '\\.([A-Za-z0-9]+)$', 1)) when 'md' then 'text/markdown' when 'rst' then 'text/x-rst' when 'txt' then 'text/plain' when 'html' then 'text/html' else 'application/octet-stream' end as media_type, regexp_extract(source_uri, '^([^/]+)/', 1) as site, regexp_extract(source_uri, '/([a-z]+)/', 1) as folder from parsed_documents")
def _(spark, sf):
    m = scan.path_metadata(F.col("source_uri"), {"site": "^([^/]+)/", "folder": "/([a-z]+)/"})
    return table(spark, sf, "parsed_documents").select("document_id", scan.media_type(F.col("source_uri")).alias("media_type"), F.coalesce(F.try_element_at(m, F.lit("site")), F.lit("")).alias("site"), F.coalesce(F.try_element_at(m, F.lit("folder")), F.lit("")).alias("folder"))


@query("scan_documents", f"select substr({_merged_sql(chr(39) + 'doc' + chr(39), chr(39) + 'docs' + chr(39), 'source_uri')}, 8, 24) as document_id, source_uri, {_HASH.format('text')} as content_hash, strlen(text)::int as size from (select source || '/' || doc_id as source_uri, text from documents)")
def _(spark, sf):
    d = scan.scan_table(table(spark, sf, "documents"), F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("text"), "docs", ["lang", "doc_kind"])
    return d.select("document_id", "source_uri", "content_hash", "size")


# parsing


@query("parse_text_blocks", f"""
with p as (select doc_id, list_filter([{_STRIP.format('x')} for x in string_split(regexp_replace(text, '\\n[\\s\\p{{Z}}]*\\n', chr(1), 'g'), chr(1))], lambda x: x <> '') as p from documents),
e as (select doc_id, unnest(p) as text, unnest(range(len(p))) as k, p from p)
select doc_id, 'b' || k as block_id, text, (list_sum([length(x) + 2 for x in p[1:k+1]]) - 2 - length(text))::int as span_start, (list_sum([length(x) + 2 for x in p[1:k+1]]) - 2)::int as span_end from e""")
def _(spark, sf):
    b = parse.parse_text(_corpus(spark, sf)).select(F.col("document_id").cast("bigint").alias("doc_id"), F.explode("blocks").alias("b"))
    return b.select("doc_id", "b.block_id", "b.text", "b.span_start", "b.span_end")


@query("parse_passthrough", f"select doc_id, case when {_STRIP.format('text')} = '' then 0 else 1 end::int as n_blocks, length({_STRIP.format('text')})::int as n_chars from documents")
def _(spark, sf):
    return parse.parse_passthrough(_corpus(spark, sf)).select(F.col("document_id").cast("bigint").alias("doc_id"), F.size("blocks").alias("n_blocks"), F.length("text").alias("n_chars"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "parsed_documents").select("document_id", "source_uri", "text", scan.media_type(F.col("source_uri")).alias("media_type"))


def _blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select("document_id", F.posexplode("blocks").alias("ordinal", "b")).select("document_id", "ordinal", "b.kind", "b.level", "b.directive", "b.span_start", "b.span_end", "b.text", F.size("b.table.rows").alias("n_rows"))


@query("parse_markdown")
def _(spark, sf):
    return _blocks(parse.parse_markdown(_files(spark, sf).filter("media_type = 'text/markdown'")))


@query("parse_rst")
def _(spark, sf):
    return _blocks(parse.parse_rst(_files(spark, sf).filter("media_type = 'text/x-rst'")))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_routed(_files(spark, sf), [(F.col("media_type") == "text/markdown", "markdown"), (F.col("media_type") == "text/x-rst", "rst")], "text")


@query("parse_routed")
def _(spark, sf):
    return _blocks(_routed(spark, sf))


_MARKDOWN = "# Top\nIntro line\nmore\n\n- one\n- two\n  deep\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n```py\n# no heading\n```\n## Sub\n~~~\nopen"
_RST = "Title\n=====\n\nText here::\n\n   lit one\n   lit two\n\n.. note:: hi\n   more\n\nSub\n---\n.. code-block:: python\n\n   x = 1\nplain\nT2\n==\n"
_PINNED_BLOCKS = [
    ("md", 0, "heading", 1, "Top"), ("md", 1, "paragraph", None, "Intro line\nmore"), ("md", 2, "list_item", None, "- one\n- two\n  deep"), ("md", 3, "table", None, "| a | b |\n|---|---|\n| 1 | 2 |"), ("md", 4, "paragraph", None, "after"),
    ("md", 5, "code", None, "```py\n# no heading\n```"), ("md", 6, "heading", 2, "Sub"), ("md", 7, "code", None, "~~~\nopen"),
    ("rst", 0, "heading", 1, "Title"), ("rst", 1, "paragraph", None, "Text here::"), ("rst", 2, "code", None, "   lit one\n   lit two"), ("rst", 3, "other", None, ".. note:: hi\n   more"), ("rst", 4, "heading", 2, "Sub"), ("rst", 5, "code", None, ".. code-block:: python\n\n   x = 1"), ("rst", 6, "paragraph", None, "plain"), ("rst", 7, "heading", 1, "T2"),
]


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of literal rows."""
    one = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()
    return "select * from (values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") as t({columns})"


@query("parse_pinned", _values(_PINNED_BLOCKS, "document_id, ordinal, kind, level, text"))
def _(spark, sf):
    d = spark.createDataFrame([("md", "d.md", _MARKDOWN), ("rst", "d.rst", _RST)], "document_id string, source_uri string, text string")
    both = parse.parse_markdown(d.filter("document_id = 'md'")).unionByName(parse.parse_rst(d.filter("document_id = 'rst'")))
    return _blocks(both).select("document_id", "ordinal", "kind", "level", "text")


@query("check_parsed_planted", """
with b as (select document_id, text, unnest(blocks) as b, unnest(range(len(blocks))) as k from parsed_documents),
x as (select document_id, b.block_id as block_id, (b.span_start - case when k % 3 = 1 then 5 else 0 end)::int as s, (b.span_end + case when k % 5 = 4 then 1000000 else 0 end)::int as e, k, length(text) as n from b),
y as (select *, max(e) over (partition by document_id order by k rows between unbounded preceding and 1 preceding) as before from x),
c as (select document_id from parsed_documents where page_count is not null and page_count % 2 = 0)
select document_id, block_id, 'span out of bounds' as problem from y where s < 0 or e < s or e > n union all select document_id, block_id, 'out of order' from y where s < before union all select document_id, null, 'confidence out of bounds' from c""")
def _(spark, sf):
    """Planted faults: every third block begins five characters early, every fifth ends far outside, documents of even page counts are surer than sure."""
    d = table(spark, sf, "parsed_documents").select("document_id", "text", F.when(F.col("page_count") % 2 == 0, 1.5).alias("reading_order_confidence"), F.transform("blocks", lambda b, k: b.withField("span_start", (b["span_start"] - F.when(k % 3 == 1, 5).otherwise(0)).cast("int")).withField("span_end", (b["span_end"] + F.when(k % 5 == 4, 1_000_000).otherwise(0)).cast("int"))).alias("blocks"))
    return parse.parse_violations(d)


@query("blocks_by_kind", "select document_id, k::int as ordinal, b.block_id as block_id, b.kind as kind, substr(text, b.span_start + 1, b.span_end - b.span_start) as text from (select document_id, text, unnest(blocks) as b, unnest(range(len(blocks))) as k from parsed_documents) where b.kind in ('heading', 'code')")
def _(spark, sf):
    return parse.blocks_by_kind(table(spark, sf, "parsed_documents"), "heading", "code")


@query("check_parsed", """
with b as (select document_id, text, unnest(blocks) as b, unnest(range(len(blocks))) as k from parsed_documents),
x as (select document_id, b.block_id as block_id, b.kind as kind, b.span_start as s, b.span_end as e, length(text) as n, max(b.span_end) over (partition by document_id order by k rows between unbounded preceding and 1 preceding) as before from b)
select document_id, block_id, 'span out of bounds' as problem from x where s < 0 or e < s or e > n union all select document_id, block_id, 'out of order' from x where s < before""")
def _(spark, sf):
    return parse.parse_violations(table(spark, sf, "parsed_documents").select("document_id", "text", "blocks"))


# segmenting


@query("segment_whole", f"select doc_id, length({_STRIP.format('text')})::int as span_end, {_HASH.format(_STRIP.format('text'))} as content_hash from documents where regexp_matches(text, '\\S')")
def _(spark, sf):
    u = segment.segment_whole(parse.parse_passthrough(_corpus(spark, sf)))
    return u.select(F.col("document_id").cast("bigint").alias("doc_id"), "span_end", "content_hash")


@query("segment_fixed_window", f"""
with d as (select doc_id, {_STRIP.format('text')} as t from documents), w as (select doc_id, t, unnest(range(0, greatest(length(t), 1), 1792)) as s from d)
select doc_id, s::int as span_start, (s + length(substr(t, s + 1, 2048)))::int as span_end, {_HASH.format('substr(t, s + 1, 2048)')} as content_hash, (row_number() over (partition by doc_id order by s) - 1)::int as ordinal
from w where regexp_matches(substr(t, s + 1, 2048), '[^\\s\\p{{Z}}]')""")
def _(spark, sf):
    u = segment.segment_fixed_window(parse.parse_passthrough(_corpus(spark, sf)))
    return u.select(F.col("document_id").cast("bigint").alias("doc_id"), "span_start", "span_end", "content_hash", "ordinal")


@query("segment_sentences", "select doc_id, len(s)::int as n_sentences, s[1] as first_sentence from (select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as s from documents)")
def _(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"))


@query("segment_structural")
def _(spark, sf):
    return segment.segment_structural(_routed(spark, sf)).select("unit_id", "document_id", "span_start", "span_end", F.array_join("section_path", " > ").alias("section"), "kind", "ordinal", "verbatim")


@query("check_units", f"""
with {_UNITS}, j as (select u.*, d.text as canon, count(*) over (partition by unit_id) as n from u left join parsed_documents d using (document_id))
select unit_id, 'repeated id' as problem from j where n > 1 union all select unit_id, 'no such document' from j where canon is null
union all select unit_id, 'span out of bounds' from j where span_start < 0 or span_end > length(canon)
union all select unit_id, 'text is not in its span' from j where not contains(substr(canon, span_start + 1, span_end - span_start), text)""")
def _(spark, sf):
    from pyspark.sql import Window

    u = _units(spark, sf)
    u = u.withColumns({"verbatim": F.lit(True), "ordinal": F.row_number().over(Window.partitionBy("document_id").orderBy("span_start", "span_end", "unit_id"))})
    return segment.unit_violations(u, table(spark, sf, "parsed_documents"))


_LINKS = f"with {_UNITS}, o as (select *, row_number() over (partition by document_id order by span_start, span_end, unit_id) as k from u), h as (select *, {_HASH.format('text')} as content_hash, row_number() over (partition by document_id, text order by k) - 1 as occurrence from o), i as (select document_id, k, substr({_merged_sql(chr(39) + 'unit' + chr(39), 'document_id', 'content_hash', 'occurrence::varchar')}, 8, 24) as unit_id from h) select document_id, k::int as ordinal, unit_id, lag(unit_id) over w as prev_id, lead(unit_id) over w as next_id from i window w as (partition by document_id order by k)"


@query("neighbour_links", _LINKS)
def _(spark, sf):
    """Units numbered anew in their documents: occurrences, ids and links as the segmenters make them."""
    from pyspark.sql import Window

    u = _units(spark, sf).withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("span_start", "span_end", "unit_id")))
    return segment._numbered(u.drop("unit_id")).select("document_id", "ordinal", "unit_id", "prev_id", "next_id")


# enriching

_TITLES = r"t as (select document_id, coalesce(substr(text, h[1].span_start + 1, h[1].span_end - h[1].span_start), regexp_replace(regexp_replace(string_split(source_uri, '/')[-1], '\.[^.]*$', ''), '[_-]', ' ', 'g')) as title from (select document_id, text, source_uri, list_filter(blocks, lambda b: b.kind = 'heading') as h from parsed_documents))"


def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).withColumn("section_path", F.when(F.coalesce("section", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("section", " > ")))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.document_titles(table(spark, sf, "parsed_documents"))


_PREFIX = f"x as (select u.unit_id, u.document_id, u.span_start, u.span_end, u.text, nullif(case when coalesce(section, '') = '' then title when title = '' then section else title || ' > ' || section end, '') as context from u join t using (document_id))"


@query("enrich_section_prefix", f"with {_UNITS}, {_TITLES}, {_PREFIX} select unit_id, context from x")
def _(spark, sf):
    return enrich.section_prefix(_sectioned(spark, sf).join(table(spark, sf, "parsed_documents").select("document_id"), "document_id", "left_semi"), _titles(spark, sf)).select("unit_id", "context")


@query("enrich_top_terms", f"""
with w as (select doc_id, unnest({_WORDS.format('text')}) as term from documents),
c as (select doc_id, term, count(*) as n from w where term not in {_STOP} and not regexp_full_match(term, '\\p{{Nd}}+') group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by n desc, term) as k from c) select doc_id, string_agg(term, ' ' order by k) as terms from r where k <= 18 group by 1""")
def _(spark, sf):
    return enrich.top_terms(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"), 18).select(F.col("document_id").alias("doc_id"), F.array_join("terms", " ").alias("terms"))


@query("enrich_lead", f"""
with l as (select doc_id, {_STRIP.format('text')} as b from documents), p as (select doc_id, b, list_filter(string_split(regexp_replace(b, '\\r?\\n', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\\S')) as l from l),
s as (select doc_id, string_split(regexp_replace(case when len(l) > 1 then array_to_string(l[2:], ' ') else b end, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as s from p)
select doc_id, {_STRIP.format("array_to_string(s[1:2], ' ')")} as lead from s""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", enrich.lead(F.col("text"), 2).alias("lead"))


@query("enrich_regex_fields", r"""
select doc_id, case when regexp_matches(text, '(?i)version (\d+)') then regexp_extract(text, '(?i)version (\d+)', 1)::bigint::varchar end as major,
  case when regexp_matches(text, '(?i)in (\d+) ms') then regexp_extract(text, '(?i)in (\d+) ms', 1)::double::bigint end as ms,
  case when regexp_matches(text, '(\d{4}-\d{2}-\d{2})') then try_cast(regexp_extract(text, '(\d{4}-\d{2}-\d{2})', 1) as date)::varchar end as released from documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("unit_id", F.col("doc_id"))
    rules = [enrich.FieldRule("major", r"version (\d+)", "int"), enrich.FieldRule("ms", r"in (\d+) ms", "float"), enrich.FieldRule("released", r"(\d{4}-\d{2}-\d{2})", "date")]
    f = enrich.regex_fields(d, rules)
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return f.select(F.col("unit_id").alias("doc_id"), get("major").alias("major"), get("ms").cast("double").cast("bigint").alias("ms"), get("released").alias("released"))


@query("enrich_extractive")
def _(spark, sf):
    parsed = table(spark, sf, "parsed_documents").select("document_id", "source_uri", "text", "blocks")
    return enrich.extractive_context(_sectioned(spark, sf), parsed).select("unit_id", "context")


@query("indexing_surface", f"with {_UNITS}, {_TITLES}, {_PREFIX} select u.unit_id, {_HASH.format(chr(40) + 'case when x.context is null then u.text else x.context || chr(10) || chr(10) || u.text end' + chr(41))} as surface_hash from u left join x using (unit_id)")
def _(spark, sf):
    u = _sectioned(spark, sf)
    e = enrich.section_prefix(u.join(table(spark, sf, "parsed_documents").select("document_id"), "document_id", "left_semi"), _titles(spark, sf))
    return enrich.surface(u, e).select("unit_id", ids.text_hash(F.col("surface")).alias("surface_hash"))


@query("context_specificity", f"""
with {_UNITS}, {_TITLES}, {_PREFIX}, o as (select document_id, list_distinct({_TOKENS.format('context')}) as t, row_number() over (partition by document_id order by span_start, span_end, unit_id) as k from x),
p as (select document_id, t, lag(t) over (partition by document_id order by k) as p from o)
select document_id, round(avg(len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p)))), 9) as mean_jaccard, count(*) as n_pairs from p where p is not null and len(list_concat(t, p)) > 0 group by 1""")
def _(spark, sf):
    from pyspark.sql import Window

    u = _sectioned(spark, sf).withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("span_start", "span_end", "unit_id")))
    u = u.join(table(spark, sf, "parsed_documents").select("document_id"), "document_id", "left_semi")
    return enrich.context_specificity(u, enrich.section_prefix(u, _titles(spark, sf)))


# lexical

_BM25 = f"""{_UNITS},
tok as (select unit_id, {_TOKENS.format('text')} as t from u), post as (select unit_id, term, count(*) as tf, any_value(l) as len from (select unit_id, unnest(t) as term, len(t) as l from tok) group by 1, 2),
st as (select count(*) as n, sum(len(t)) / count(*) as avg_len from tok), df as (select term, count(*) as df from post group by 1),
qt as (select distinct query_id, unnest({_TOKENS.format('query')}) as term from golden_queries),
sc as (select query_id, p.unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) as score from qt join df using (term) join post p using (term), st group by 1, 2)"""


@query("bm25_postings", f"with {_BM25} select term, unit_id, tf, len::int as len from post")
def _(spark, sf):
    return lexical.postings_of(_units(spark, sf))


@query("bm25_stats", f"with {_BM25} select n as unit_count, (select count(*) from df) as vocabulary, round(avg_len, 6) as mean_length from st")
def _(spark, sf):
    return lexical.statistics(lexical.build(_units(spark, sf)))


@query("bm25_topk", f"with {_BM25} select query_id, rank, unit_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from sc) where rank <= 10")
def _(spark, sf):
    return lexical.search(lexical.build(_units(spark, sf)), _questions(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("bm25_filtered_topk", f"with {_BM25} select query_id, rank, unit_id, round(score, 6) as score from (select sc.*, row_number() over (partition by query_id order by score desc, sc.unit_id) as rank from sc join u using (unit_id) where source_uri like '%.md') where rank <= 10")
def _(spark, sf):
    u = _units(spark, sf)
    return lexical.search(lexical.build(u), _questions(spark, sf), 10, u.filter("source_uri like '%.md'")).withColumn("score", F.round("score", 6))


# dense

_DOT = "round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6)"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"), "label")
    return v, v.filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), "vector")


@query("dense_topk", f"select query_id, rank, unit_id, score from (select q.vec_id as query_id, v.vec_id as unit_id, {_DOT} as score, row_number() over (partition by q.vec_id order by {_DOT} desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 20 = 0) where rank <= 10")
def _(spark, sf):
    v, q = _vectors(spark, sf)
    return dense.search(v, q, 10)


@query("dense_filtered_topk", f"select query_id, rank, unit_id, score from (select q.vec_id as query_id, v.vec_id as unit_id, {_DOT} as score, row_number() over (partition by q.vec_id order by {_DOT} desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.label in (1, 3, 5)) where rank <= 10")
def _(spark, sf):
    v, q = _vectors(spark, sf)
    return dense.search(v.filter("label in (1, 3, 5)"), q, 10)


@query("hash_embed")
def _(spark, sf):
    return dense.hash_embed(_units(spark, sf), 256)


@query("hash_search")
def _(spark, sf):
    u = _units(spark, sf)
    return dense.search(dense.hash_embed(u, 256), dense.hash_embed_queries(_questions(spark, sf), u, 256), 10)


@query("lsa_embed")
def _(spark, sf):
    u = cut(_units(spark, sf).select("unit_id", "text"), "lsa-units")
    return dense.fit_latent(u, 512).embed(u, "unit_id")


#: Three texts and their hashed vectors of eight columns.
_PINNED_VECTORS = [
    ("d1", "0.1525 -0.1525 0.1525 -0.76249 0.305 -0.1525 -0.4575 0.1525"),
    ("d2", "-0.62554 -0.41703 0.41703 0.41703 0.0 0.0 -0.20851 0.20851"),
    ("q", "0.0 -0.37796 0.0 -0.75593 0.0 -0.37796 0.0 0.37796"),
]


@query("hash_embed_pinned", _values(_PINNED_VECTORS, "id, vector"))
def _(spark, sf):
    u = spark.createDataFrame([("d1", "the read timeout in seconds"), ("d2", "connection pooling and retries")], "unit_id string, text string")
    asked = dense.hash_embed_queries(spark.createDataFrame([("q", "read timeout")], "query_id string, query string"), u, 8)
    both = dense.hash_embed(u, 8).withColumnRenamed("unit_id", "id").unionByName(asked.withColumnRenamed("query_id", "id"))
    return both.select("id", F.array_join(F.transform("vector", lambda x: (F.round(x.cast("double"), 5) + 0.0).cast("string")), " ").alias("vector"))


# predicates and structured queries, over the typed wide table of unit fields


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return eav.widen(table(spark, sf, "unit_fields"), table(spark, sf, "field_specs")).drop("_misplaced")


_RECORDS = _CELLS + ", best as (select unit_id, name, arg_max(row(s, i, f, d), row(written_at, s, i, f, d)) as v from (select unit_id, name, written_at, s, i, f, d from typed where coalesce(s, i::varchar, f::varchar, d::varchar) is not null) group by 1, 2), r as (select u.unit_id, " + ", ".join(f"max(case when b.name = '{n}' then b.v[{'sifd'.index(_KIND.get(n, 's')) + 1}] end) as {n}" for n in _WIDE) + " from (select distinct unit_id from unit_fields where unit_id is not null) u left join best b using (unit_id) group by u.unit_id) "
_PREDICATES = {
    "pred_compare_int": (Compare("version_major", "gte", 5), "version_major >= 5"),
    "pred_compare_float": (Compare("reading_confidence", "lt", 0.25), "reading_confidence < 0.25"),
    "pred_compare_int_field_float": (Compare("version_major", "gt", 2.5), "version_major > 2.5"),
    "pred_compare_date": (Compare("release_date", "lt", date(2018, 1, 1)), "release_date < date '2018-01-01'"),
    "pred_compare_text": (Compare("license_id", "eq", "MIT-like"), "license_id = 'MIT-like'"),
    "pred_compare_ne": (Compare("timeout_seconds", "ne", 30), "timeout_seconds <> 30"),
    "pred_eq_none": (Compare("page_count", "eq", None), "page_count is null"),
    "pred_ne_none": (Compare("page_count", "ne", None), "false"),
    "pred_in": (In("version_major", (0, 2, 4)), "version_major in (0, 2, 4)"),
    "pred_in_none": (In("doc_audience", ("operators", None)), "coalesce(doc_audience = 'operators', false) or doc_audience is null"),
    "pred_exists": (Exists("deprecated_on"), "deprecated_on is not null"),
    "pred_missing": (Exists("deprecated_on", False), "deprecated_on is null"),
    "pred_text_contains": (TextMatch("license_id", "COPY"), "contains(lower(license_id), 'copy')"),
    "pred_text_prefix": (TextMatch("python_requires", ">=3", "prefix"), "starts_with(lower(python_requires), '>=3')"),
    "pred_text_exact": (TextMatch("doc_audience", "Developers", "exact"), "lower(doc_audience) = 'developers'"),
    "pred_and": (And((Compare("version_major", "gte", 1), TextMatch("license_id", "open"))), "coalesce(version_major >= 1, false) and coalesce(contains(lower(license_id), 'open'), false)"),
    "pred_or": (Or((Compare("version_major", "eq", 3), Exists("download_mb"))), "coalesce(version_major = 3, false) or download_mb is not null"),
    "pred_not": (Not(Compare("version_major", "gte", 1)), "not coalesce(version_major >= 1, false)"),
    "pred_nested": (And((Not(Or((Exists("page_count"), Exists("max_connections")))), Or((Compare("version_major", "gte", 2), In("doc_audience", ("operators", "developers")))))), "page_count is null and max_connections is null and (coalesce(version_major >= 2, false) or coalesce(doc_audience in ('operators', 'developers'), false))"),
    "pred_empty_or": (Or(()), "false"),
    "pred_empty_and": (And(()), "true"),
}
for _name, (_p, _where) in _PREDICATES.items():
    query(_name, _RECORDS + f"select unit_id from r where coalesce({_where}, false)")(lambda spark, sf, p=_p: (lambda r: r.filter(structured.compiled(p, r.schema)).select("unit_id"))(_records(spark, sf)))


def _run(spark: SparkSession, sf: str, q: StructuredQuery) -> DataFrame:
    out = structured.run(_records(spark, sf), q)
    return out.withColumn("_sources", F.array_join("_sources", " ")).withColumnRenamed("_sources", "sources")


@query("struct_select_order_limit", _RECORDS + "select package, version_major, unit_id as sources from r where coalesce(version_major >= 2, false) order by version_major desc nulls last, unit_id limit 25")
def _(spark, sf):
    return _run(spark, sf, StructuredQuery(where=Compare("version_major", "gte", 2), select=("package", "version_major"), order_by=(("version_major", True),), limit=25))


@query("struct_group_agg", _RECORDS + "select license_id, count(*) as count, round(avg(version_major), 6) as avg_version_major, min(release_date) as min_release_date, max(release_date) as max_release_date from r group by 1 order by license_id nulls first limit 1000")
def _(spark, sf):
    q = StructuredQuery(select=("license_id",), group_by=("license_id",), aggregations=(Aggregation("count"), Aggregation("avg", "version_major"), Aggregation("min", "release_date"), Aggregation("max", "release_date")), order_by=(("license_id", False),))
    return structured.run(_records(spark, sf), q).withColumn("avg_version_major", F.round("avg_version_major", 6))


@query("struct_global_agg", _RECORDS + "select count(*) as count, sum(version_major)::bigint as sum_version_major, min(download_mb) as min_download_mb, max(download_mb) as max_download_mb from r where coalesce(starts_with(lower(doc_audience), 'dev'), false)")
def _(spark, sf):
    q = StructuredQuery(where=TextMatch("doc_audience", "DEV", "prefix"), aggregations=(Aggregation("count"), Aggregation("sum", "version_major"), Aggregation("min", "download_mb"), Aggregation("max", "download_mb")))
    return structured.run(_records(spark, sf), q)


@query("struct_citations", _RECORDS + "select doc_audience, unit_id from r where deprecated_on is not null")
def _(spark, sf):
    return structured.citations(_records(spark, sf), StructuredQuery(where=Exists("deprecated_on"), select=("doc_audience",), group_by=("doc_audience",), aggregations=(Aggregation("count"),)))


@query("struct_filter_search", _RECORDS + "select unit_id, row_number() over (order by unit_id) as rank, 1.0::double as score from r where coalesce(version_major = 0, false) order by unit_id limit 40")
def _(spark, sf):
    return structured.filter_search(_records(spark, sf), Compare("version_major", "eq", 0), 40)


_LONG = " union all ".join(f"select unit_id, '{n}' as name, " + ", ".join(f"{n if _KIND.get(n, 's') == k else 'null::' + t} as {c}" for k, t, c in (("s", "varchar", "v_text"), ("i", "bigint", "v_int"), ("f", "double", "v_num"), ("d", "date", "v_date"))) + f" from r where {n} is not null" for n in _WIDE)


@query("struct_fields_long", _RECORDS + _LONG)
def _(spark, sf):
    return structured.fields_long(_records(spark, sf))


# routing

_LEXICON = ["package", "release_date", "version", "version_major", "timeout_seconds"]
_NAMED = " or ".join(f"contains(lower(query), '{f.replace('_', ' ')}')" for f in _LEXICON)
_S = {k: "regexp_matches(query, '" + v.replace("'", "''") + "')" for k, v in route.SIGNS.items()}
_CASE = f"case when {_S['aggregate']} and (({_NAMED}) or {_S['numeric']}) then 'structured' when {_S['numeric']} then 'numeric' when {_S['temporal']} and (({_NAMED}) or {_S['date']}) then 'temporal' when {_S['comparative']} then 'comparative' when {_S['multi_hop']} then 'multi_hop' when {_S['summary']} then 'summary' else 'factual' end"


@query("route_classify", f"select query_id, {_CASE} as kind from golden_queries")
def _(spark, sf):
    return _questions(spark, sf).select("query_id", route.classified(F.col("query"), _LEXICON).alias("kind"))


@query("route_paths")
def _(spark, sf):
    types = {"release_date": "date", "version": "str", "version_major": "int", "package": "str", "timeout_seconds": "int"}
    return route.route(_questions(spark, sf).select("query_id", "query"), _LEXICON, types).select("query_id", "query_type", "path", "step_budget", "confidence", "reason", "predicate", F.array_join("sub_queries", " | ").alias("sub_queries"))


_ROUTE_TYPES = {"release_date": "date", "version": "str", "version_major": "int", "package": "str", "timeout_seconds": "int"}
#: Questions that name fields, their paths and predicates.
_PINNED_ROUTES = [
    ("which entries have release date before 2023-06-27", "structured", '["compare", "release_date", "lt", {"date": "2023-06-27"}]'),
    ("how many have release date since 2020-01-01", "structured", '["compare", "release_date", "gte", {"date": "2020-01-01"}]'),
    ("which entries have version major greater than 2", "structured", '["compare", "version_major", "gt", 2]'),
    ("how many entries have version major at least 1,000", "structured", '["compare", "version_major", "gte", 1000]'),
    ("how many have timeout seconds less than 30", "structured", '["compare", "timeout_seconds", "lt", 30]'),
    ("how many have version 1.0.0", "structured", '["text", "version", "1.0.0", "exact"]'),
    ("how many have package requests", "structured", '["text", "package", "requests", "exact"]'),
    ("total of package is flask and version major over 3", "structured", '["and", [["text", "package", "flask", "exact"], ["compare", "version_major", "gt", 3]]]'),
    ("how many distinct package values are recorded", "structured", '["exists", "package", true]'),
    ("compare requests versus httpx pooling", "iterative", None),
    ("explain where the read timeout of the client is set", "lookup", None),
    ("more than 5 failures", "lookup", None),
]


@query("route_pinned", _values(_PINNED_ROUTES, "query, path, predicate"))
def _(spark, sf):
    q = spark.createDataFrame([(f"p{k}", r[0]) for k, r in enumerate(_PINNED_ROUTES)], "query_id string, query string")
    return route.route(q, _LEXICON, _ROUTE_TYPES).select("query", "path", "predicate")


@query("route_passthrough", "select query_id, 'lookup' as path, 1 as step_budget from golden_queries")
def _(spark, sf):
    return route.route_passthrough(_questions(spark, sf).select("query_id", "query")).select("query_id", "path", "step_budget")


# retrieval

_LISTS = "l as (select query_id, \"index\" as source, unit_id, min(rank) as rank, min(step) as step, dense_rank() over (order by \"index\") - 1 as target from hits where rank is not null group by 1, 2, 3)"


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "hits").filter("rank is not null").groupBy("query_id", F.col("index").alias("source"), "unit_id").agg(F.min("rank").alias("rank"), F.min("step").alias("step"), F.max("score").alias("score"))
    place = F.when(F.col("source") == "dense", 0).when(F.col("source") == "fields", 1).when(F.col("source") == "lexical", 2).when(F.col("source") == "phrase", 3).otherwise(4)
    return h.withColumn("target", place)


_RRF = "select query_id, rank, unit_id, score, best_rank, found_by from (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from (select query_id, unit_id, round(sum({w} / (60 + rank)), 9) as score, min(rank) as best_rank, string_agg(distinct source, ' ' order by source) as found_by from l group by 1, 2))"


@query("rrf_fuse", f"with {_LISTS} " + _RRF.format(w="1.0"))
def _(spark, sf):
    return retrieve.fuse_rrf(_lists(spark, sf)).drop("best_source", "best_score").withColumn("found_by", F.array_join("found_by", " "))


@query("rrf_weighted", f"with {_LISTS} " + _RRF.format(w="case source when 'lexical' then 2.0 when 'dense' then 0.5 else 1.0 end"))
def _(spark, sf):
    return retrieve.fuse_rrf(_lists(spark, sf), weights={"lexical": 2.0, "dense": 0.5}).drop("best_source", "best_score").withColumn("found_by", F.array_join("found_by", " "))


_PLACE = "case source when 'dense' then 0 when 'fields' then 1 when 'lexical' then 2 when 'phrase' then 3 else 4 end"
_BARE = "l as (select query_id, \"index\" as source, unit_id, min(rank) as rank, min(step) as step from hits where rank is not null group by 1, 2, 3)"


@query("concat_fuse", f"with {_BARE}, f as (select *, row_number() over (partition by query_id, unit_id order by step, {_PLACE}, rank) as n from l) select query_id, row_number() over (partition by query_id order by step, {_PLACE}, rank, unit_id) as rank, unit_id, source from f where n = 1")
def _(spark, sf):
    h = _lists(spark, sf)
    from pyspark.sql import Window

    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "step", "target").orderBy("rank", "unit_id")))
    return retrieve.fuse_concat(h).select("query_id", "rank", "unit_id", "source")


@query("iterative_retrieve", f"""
with {_BARE}, h as (select *, {_PLACE} as target from l where step < 3), f as (select * from (select *, row_number() over (partition by query_id, unit_id order by step, target, rank) as n from h) where n = 1),
fresh as (select query_id, step, count(*) as new from f group by 1, 2), r as (select distinct query_id, step from h),
e as (select r.query_id, r.step, coalesce(max(case when r.step > 0 and coalesce(new, 0) < 3 then 1 else 0 end) over (partition by r.query_id order by r.step rows between unbounded preceding and 1 preceding), 0) as ended from r left join fresh using (query_id, step))
select query_id, source, step, row_number() over (partition by query_id, step, target order by f.rank, unit_id) as rank, unit_id from f join e using (query_id, step) where ended = 0""")
def _(spark, sf):
    from pyspark.sql import Window

    h = _lists(spark, sf)
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "step", "target").orderBy("rank", "unit_id")))
    return retrieve.iterative(h, 3).select("query_id", "source", "step", "rank", "unit_id")


@query("rerank_lexical_overlap")
def _(spark, sf):
    h = _lists(spark, sf).filter("source = 'lexical'").select("query_id", "rank", "unit_id", "score")
    return retrieve.rerank_overlap(h, _questions(spark, sf), _units(spark, sf), 20)


@query("rerank_coverage", f"""
with {_BARE}, {_UNITS}, q as (select query_id, list_distinct(list_filter({_TOKENS.format('query')}, lambda x: length(x) > 2)) as q from golden_queries)
select l.query_id, l.unit_id, l.rank as prior_rank, round(len(list_intersect(q, {_TOKENS.format("coalesce(u.text, '')")})) / greatest(len(q), 1), 9) as coverage from l join q using (query_id) left join u using (unit_id) where source = 'lexical' and rank <= 20""")
def _(spark, sf):
    h = _lists(spark, sf).filter("source = 'lexical'").select("query_id", "rank", "unit_id", "score")
    return retrieve.rerank_overlap(h, _questions(spark, sf), _units(spark, sf), 20).select("query_id", "unit_id", "prior_rank", "coverage")


@query("check_ranks", f"with l as (select query_id || ' ' || \"index\" as query_id, rank from hits where rank is not null) select query_id, count(*) as n, max(rank) as last from l group by 1 having min(rank) <> 1 or max(rank) <> count(*) or count(distinct rank) <> count(*)")
def _(spark, sf):
    h = table(spark, sf, "hits").filter("rank is not null").select(F.concat_ws(" ", "query_id", "index").alias("query_id"), "rank")
    return retrieve.sparse_ranks(h)


@query("hybrid_search", f"""
with {_BM25}, b as (select query_id, unit_id, row_number() over (partition by query_id order by score desc, unit_id) as rank from sc), d as (select query_id, unit_id, min(rank) as rank from hits where "index" = 'dense' and rank is not null group by 1, 2),
x as (select query_id, unit_id, rank, 'bm25' as source, 0 as target from b where rank <= 50 union all select query_id, unit_id, rank, 'dense', 1 from d where rank <= 50),
f as (select query_id, unit_id, round(sum(1.0 / (60 + rank)), 9) as score, min(rank)::int as best_rank, string_agg(distinct source, ' ' order by source) as found_by, arg_min(source, 2 * rank + target) as best_source from x group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from f)
select query_id, rank, r.unit_id, score, document_id, span_start, span_end, best_rank, found_by, best_source from r left join u using (unit_id) where rank <= 10""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """All questions in one job: BM25 over the units and the dense lists given, fused, cut and hydrated, with the lists that found each unit
    and the one that found it best."""
    u = _units(spark, sf)
    index = lexical.build(u)
    given = table(spark, sf, "hits").filter("`index` = 'dense' and rank is not null").groupBy("query_id", "unit_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score")).select("query_id", "rank", "unit_id", "score")
    lists = retrieve.fan_out(_questions(spark, sf), [("bm25", lambda q, k: lexical.search(index, q, k), 50), ("dense", lambda q, k: given.filter(F.col("rank") <= k), 50)])
    top = retrieve.fuse_rrf(lists).filter("rank <= 10")
    found = retrieve.hydrate(top, u).withColumn("found_by", F.array_join("found_by", " "))
    return found.select("query_id", "rank", "unit_id", "score", "document_id", "span_start", "span_end", "best_rank", "found_by", "best_source")


def _store(spark: SparkSession, sf: str):
    """An engine over all parsed documents, built from nothing."""
    from quernstone.plans.engine import Engine, EngineConfig

    d = _files(spark, sf).filter("text is not null").withColumn("content_hash", ids.text_hash(F.col("text")))
    rules = [enrich.FieldRule("timeout_seconds", r"timeout_seconds?\D{1,3}(\d+)", "int"), enrich.FieldRule("release_date", r"(\d{4}-\d{2}-\d{2})", "date"), enrich.FieldRule("version", r"version (\d+\.\d+(?:\.\d+)?)", "str")]
    routes = [(F.col("media_type") == "text/markdown", "markdown"), (F.col("media_type") == "text/x-rst", "rst")]
    e = Engine(spark, scratch(spark, "engine"), EngineConfig(routes=routes, rules=rules, enrichers=("section_prefix", "regex_fields")))
    return e, d


@query("engine_build")
def _(spark, sf):
    """A cold build over all documents: the ledger it leaves."""
    e, d = _store(spark, sf)
    e.build(d, "cold")
    return e.documents().select("document_id", "content_hash", F.size("unit_ids").alias("n_units"), "build_id")


@query("engine_query")
def _(spark, sf):
    """All golden questions by their own path over a built store: routed, BM25 and hashed vectors, fused, reranked, hydrated."""
    e, d = _store(spark, sf)
    e.build(d, "cold")
    types = {"release_date": "date", "version": "str", "timeout_seconds": "int"}
    return e.query(_questions(spark, sf).select("query_id", "query"), lexicon=list(types), types=types).select("query_id", "path", "rank", "unit_id", "score", "document_id", "span_start", "span_end")


# ledger

_KEYS = {"parse": "p1", "segment": "s1", "index:bm25": "b1"}
_LEDGER = "l as (select document_id, case when page_count is null then source_hash else source_hash || 'x' end as old, reading_order_confidence is null as stale from parsed_documents where indexed_at < timestamp '2025-01-01' union all select 'gone-' || document_id, source_hash, false from parsed_documents where removed_at is not null)"


@query("plan_changes", f"with {_LEDGER} select document_id, case when d.document_id is null then 'REMOVED' when l.document_id is null then 'ADDED' when source_hash <> old then 'CHANGED' when stale then 'RESTAGED' else 'UNCHANGED' end as change, case when d.document_id is not null and source_hash = old and stale then 'index:bm25 segment' else '' end as stale from parsed_documents d full join l using (document_id)")
def _(spark, sf):
    d = table(spark, sf, "parsed_documents")
    keys = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    old = d.filter("indexed_at < timestamp_ntz '2025-01-01'").select("document_id", F.when(F.col("page_count").isNull(), F.col("source_hash")).otherwise(F.concat("source_hash", F.lit("x"))).alias("content_hash"), F.when(F.col("reading_order_confidence").isNull(), keys({"parse": "p1", "segment": "s0"})).otherwise(keys(_KEYS)).alias("stage_keys"))
    gone = d.filter("removed_at is not null").select(F.concat(F.lit("gone-"), "document_id").alias("document_id"), F.col("source_hash").alias("content_hash"), keys(_KEYS).alias("stage_keys"))
    p = ledger.plan(d.select("document_id", F.col("source_hash").alias("content_hash")), old.unionByName(gone), _KEYS)
    return p.withColumn("stale", F.array_join("stale", " "))


@query("unit_diff", f"with {_UNITS}, c as (select u.document_id, unit_id from u join units using (unit_id) where removed_at is null), p as (select u.document_id, unit_id from u join units using (unit_id) where indexed_at < timestamp '2025-01-01') select distinct document_id, unit_id, 'added' as diff from c where unit_id not in (select unit_id from p) union all select distinct document_id, unit_id, 'removed' from p where unit_id not in (select unit_id from c)")
def _(spark, sf):
    u = table(spark, sf, "units").select("document_id", "unit_id", "indexed_at", "removed_at").distinct()
    return ledger.unit_diff(u.filter("removed_at is null"), u.filter("indexed_at < timestamp_ntz '2025-01-01'"))


@query("accounting_by_stage", "select event_type as stage, count(*) as calls, round(sum(value), 2) as wall_ms, round(sum(user_id * 0.25), 2) as cost, sum(user_id)::bigint as tokens, sum(case when user_id % 2 = 0 then 1 else 0 end)::bigint as hits, count(case when value < 1 then 1 end) as errors from events group by 1")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("wall_ms"), (F.col("user_id") * 0.25).cast("double").alias("cost"), (F.col("user_id") % 2 == 0).cast("int").alias("hits"), F.col("user_id").alias("tokens"), F.when(F.col("value") < 1, "slow").alias("error"))
    return ledger.by_stage(e).select("stage", "calls", F.round("wall_ms", 2).alias("wall_ms"), F.round("cost", 2).alias("cost"), "tokens", "hits", "errors")


# evaluation

_HITS = "h as (select l.query_id, l.rank, l.unit_id, u.document_id, u.span_start, u.span_end from l join u using (unit_id) where source = 'lexical')"
_GRADED = f"{_BARE}, {_UNITS}, {_SPANS}, {_HITS}, gr as (select h.query_id, h.rank, h.unit_id, coalesce(max(case when (g.span_end = g.span_start and h.span_start <= g.span_start and h.span_end >= g.span_end) or (g.span_end > g.span_start and greatest(0, least(h.span_end, g.span_end) - greatest(h.span_start, g.span_start)) / (g.span_end - g.span_start) >= 0.5) then weight end), 0) as grade from h left join g using (query_id, document_id) group by 1, 2, 3)"


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    h = _lists(spark, sf).filter("source = 'lexical'").select("query_id", "rank", "unit_id")
    del Window
    h = h.join(_units(spark, sf).select("unit_id", "document_id", "span_start", "span_end"), "unit_id")
    return evaluation.graded(h, _gold(spark, sf))


@query("eval_match_spans", f"with {_GRADED} select query_id, rank, unit_id, grade from gr")
def _(spark, sf):
    return _graded(spark, sf).select("query_id", "rank", "unit_id", "grade")


_SCORED = f"""{_GRADED}, gn as (select query_id, count(*) as n_gold, list(weight order by weight desc) as ideal from g group by 1),
a as (select query_id, min(case when grade > 0 then rank end) as first, sum(case when rank <= 5 and grade > 0 then 1 else 0 end) as n5, sum(case when rank <= 20 and grade > 0 then 1 else 0 end) as n20, sum(case when rank <= 10 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as d10 from gr group by 1),
s as (select q.query_id, q.query_type, round(coalesce(n5, 0) / 5, 9) as precision_5, round(least(coalesce(n20, 0), n_gold) / n_gold, 9) as recall_20,
  case when list_sum([(pow(2, w) - 1) / log2(i + 1) for w, i in ideal[1:10]]) > 0 then round(coalesce(d10, 0) / list_sum([(pow(2, w) - 1) / log2(i + 1) for w, i in ideal[1:10]]), 9) end as ndcg_10, coalesce(round(1 / first, 9), 0) as reciprocal_rank, coalesce(n20, 0) = 0 as failed
  from golden_queries q left join gn using (query_id) left join a using (query_id))"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.scores(_questions(spark, sf).select("query_id", "query_type"), _graded(spark, sf), _gold(spark, sf))


@query("eval_metrics", f"with {_SCORED} select query_id, precision_5, recall_20, round(ndcg_10, 6) as ndcg_10, reciprocal_rank, failed from s")
def _(spark, sf):
    return _scored(spark, sf).select("query_id", "precision_5", "recall_20", F.round("ndcg_10", 6).alias("ndcg_10"), "reciprocal_rank", "failed")


@query("eval_by_type", f"with {_SCORED} select query_type, count(*) as n_queries, round(avg(precision_5), 6) as precision_5, round(avg(recall_20), 6) as recall_20, round(avg(reciprocal_rank), 6) as reciprocal_rank, round(avg(failed::int), 6) as failure_rate from s group by 1")
def _(spark, sf):
    return evaluation.aggregated(_scored(spark, sf), "query_type").select("query_type", "n_queries", "precision_5", "recall_20", "reciprocal_rank", "failure_rate")


@query("eval_latency_pct", """
with v as (select event_type, list(value order by value) as v, count(*) as n from events where value is not null group by 1), p as (select *, unnest([50.0, 95.0]) as p from v),
j as (select *, p / 100 * (n + 1) as at_, greatest(1, least(floor(p / 100 * (n + 1))::int, n - 1)) as j from p)
select event_type, p::int as p, round(v[j] * (1 - (at_ - j)) + v[j + 1] * (at_ - j), 6) as value from j""")
def _(spark, sf):
    return evaluation.percentiles(table(spark, sf, "events"), ["event_type"], "value").select("event_type", "p", F.round("value", 6).alias("value"))


@query("eval_expected_path", "select query_id, case when query_type in ('structured', 'numeric', 'temporal') then 'structured' when query_type in ('multi_hop', 'comparative') then 'iterative' end as path from golden_queries")
def _(spark, sf):
    return _questions(spark, sf).select("query_id", evaluation.expected_path(F.col("query_type")).alias("path"))


@query("judge_containment", f"""
with {_UNITS}, s as (select distinct span_id, document_id, snippet, span_start from relevant_spans), a as (select span_id, snippet, string_agg(text, ' ' order by u.span_start, unit_id) as answer from s join u using (document_id) where u.span_start <= s.span_start and u.span_end > s.span_start group by 1, 2),
w as (select span_id, list_distinct(list_filter({_TOKENS.format('snippet')}, lambda x: length(x) > 3)) as w, {_TOKENS.format('answer')} as t from a)
select span_id, case when len(w) > 0 then len(list_intersect(w, t)) / len(w) >= 0.6 end as correct from w""")
def _(spark, sf):
    s = table(spark, sf, "relevant_spans").select("span_id", "document_id", "snippet", F.col("span_start").alias("at")).distinct()
    j = s.join(_units(spark, sf), "document_id").filter("span_start <= at and span_end > at").groupBy("span_id", "snippet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_start", "unit_id", "text"))), lambda x: x["text"]), " ").alias("answer"))
    return j.select("span_id", evaluation.judged_containment(F.col("snippet"), F.col("answer")).alias("correct"))


@query("judge_exact", r"select query_id, case when answer is null then null else len(list_filter(regexp_extract_all(query, '(-?\d[\d,_]*(?:\.\d+)?)', 1), lambda x: abs(try_cast(regexp_replace(x, '[,_]', '', 'g') as double) - try_cast(regexp_replace(answer, '[,_]', '', 'g') as double)) <= greatest(1e-6, abs(try_cast(regexp_replace(answer, '[,_]', '', 'g') as double)) * 1e-9))) > 0 end as number_correct, contains(lower(query), lower(answer)) as text_correct from golden_queries")
def _(spark, sf):
    g = table(spark, sf, "golden_queries")
    judge = lambda kind: evaluation.judged_exact(F.col("answer"), F.lit(kind), F.col("query"))
    return g.select("query_id", judge("number").alias("number_correct"), judge("text").alias("text_correct"))


@query("bootstrap_terms", f"""
with {_UNITS}, c as (select document_id, unit_id, term, count(*) as n from (select document_id, unit_id, unnest({_WORDS.format('text')}) as term from u) where term not in {_STOP} and not regexp_full_match(term, '\\p{{Nd}}+') and length(term) >= 4 group by 1, 2, 3),
tk as (select distinct document_id, unit_id, unnest({_TOKENS.format('text')}) as term from u), sp as (select document_id, term, count(*) as k from tk group by 1, 2),
s as (select c.unit_id, c.term, c.n * case when coalesce(k, 0) - (tk.term is not null)::int > 0 then 1.0 else 2.0 end as score from c left join sp using (document_id, term) left join tk using (document_id, unit_id, term)),
r as (select *, row_number() over (partition by unit_id order by score desc, term) as rank from s) select unit_id, string_agg(term, ' ' order by rank) as terms from r where rank <= 3 group by 1""")
def _(spark, sf):
    return evaluation.distinctive_terms(_units(spark, sf)).withColumn("terms", F.array_join("terms", " "))


@query("bootstrap_interior", _RECORDS + ", v as (select distinct version_major as t from r where version_major is not null), o as (select t, row_number() over (order by t) - 1 as k, count(*) over () as n from v) select 'version_major' as field, t as threshold from o where k >= greatest(floor(n / 6), 1) and k < least(n - floor(n / 6), n - 1)")
def _(spark, sf):
    return evaluation.interior(_records(spark, sf), "version_major")


@query("bootstrap_golden")
def _(spark, sf):
    u = _units(spark, sf)
    names = scan.path_metadata(F.col("source_uri"), {"name": "([^/]+)$"})
    subjects = u.select("document_id", evaluation.subject_of(F.try_element_at(names, F.lit("name"))).alias("subject")).distinct()
    index = lexical.build(u)
    return evaluation.bootstrap(u, subjects, lambda q, k: lexical.search(index, q, k), want=200).select("query_id", "query", "unit_id", "lexical_overlap")


@query("bootstrap_fields")
def _(spark, sf):
    """Questions that the typed fields of units answer."""
    return evaluation.field_questions(_records(spark, sf))


@query("golden_stats", "select query_type, count(*) as n, sum(case when origin in ('human', 'verified', 'bootstrap_verified') then 1 else 0 end)::bigint as n_verified from golden_queries group by 1")
def _(spark, sf):
    return evaluation.golden_stats(table(spark, sf, "golden_queries"))


@query("golden_merge", "with a as (select query_id, origin, 0 as s from golden_queries union all select query_id, case when query_type = 'numeric' then 'human' else 'bootstrap' end, 1 from golden_queries) select query_id, origin from (select *, row_number() over (partition by query_id order by case when origin = 'human' then 3 when origin in ('verified', 'bootstrap_verified') then 2 when origin = 'log' then 1 else 0 end desc, s) as n from a) where n = 1")
def _(spark, sf):
    g = table(spark, sf, "golden_queries").select("query_id", "origin", "query_type")
    return evaluation.merged_golden(g.select("query_id", "origin"), g.select("query_id", F.when(F.col("query_type") == "numeric", "human").otherwise("bootstrap").alias("origin")))


@query("golden_overlap", f"""
with {_UNITS}, s as (select distinct q.query_id, s.span_id, query, snippet from golden_queries q join relevant_spans s using (query_id) where snippet is not null), t as (select query_id, span_id, list_distinct(list_filter({_TOKENS.format('query')}, lambda x: length(x) >= 3 and x not in {_STOP} and not regexp_full_match(x, '\\p{{Nd}}+'))) as q, {_TOKENS.format('snippet')} as p from s)
select query_id, span_id, case when len(q) > 0 then round(len(list_intersect(q, p)) / len(q), 9) end as overlap from t""")
def _(spark, sf):
    s = table(spark, sf, "relevant_spans").filter("snippet is not null").join(_questions(spark, sf), "query_id").select("query_id", "span_id", "query", "snippet").distinct()
    return s.select("query_id", "span_id", F.round(T.overlap(T.quick_fold(F.col("query")), T.quick_fold(F.col("snippet"))), 9).alias("overlap"))


_ARMS = "ev as (select event_type as arm, avg(value) as a, avg(user_id % 7) as b from events group by 1)"


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.avg("value").alias("a"), F.avg(F.col("user_id") % 7).alias("b"))


@query("ablation_delta", f"with {_ARMS}, m as (select min(arm) as arm from ev), b as (select ev.* from ev join m using (arm)) select ev.arm, round(ev.a, 4) as a, round(ev.a - b.a, 4) as d_a, round(ev.b, 4) as b, round(ev.b - b.b, 4) as d_b from ev, b")
def _(spark, sf):
    r = _arms(spark, sf)
    first = r.agg(F.min("arm").alias("arm")).first()["arm"]
    return evaluation.delta_table(r, first, ["a", "b"]).select("arm", *[F.round(c, 4).alias(c) for c in ("a", "d_a", "b", "d_b")])


@query("sanity_verdicts", f"with {_ARMS}, m as (select min(arm) as x, max(arm) as y from ev), v as (select x, y, l.a as la, r.a as ra from m join ev l on l.arm = x join ev r on r.arm = y) select 'first to last' as name, round((ra - la) / nullif(la, 0), 6) as observed, (ra - la) / nullif(la, 0) between -0.45 and -0.05 as passed from v")
def _(spark, sf):
    r = _arms(spark, sf)
    ends = r.agg(F.min("arm").alias("baseline_arm"), F.max("arm").alias("treatment_arm"))
    checks = ends.select(F.lit("first to last").alias("name"), "baseline_arm", "treatment_arm", F.lit("a").alias("metric"), F.lit(0.25).alias("expected_reduction"), F.lit(0.8).alias("tolerance"))
    return evaluation.verdicts(r.select("arm", F.lit("a").alias("metric"), F.col("a").alias("value")), checks).select("name", F.round("observed", 6).alias("observed"), "passed")


@query("metric_corr", f"with {_SCORED} select round(corr(precision_5, reciprocal_rank), 6) as r from s")
def _(spark, sf):
    return _scored(spark, sf).agg(F.round(evaluation.correlation("precision_5", "reciprocal_rank"), 6).alias("r"))
