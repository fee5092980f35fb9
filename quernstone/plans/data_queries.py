"""p3_ and p5_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import eav, orphans
from quernstone.session import scratch, table


def p3_wide(spark: SparkSession, sf: str) -> DataFrame:
    """unit_fields as one typed row per unit."""
    return eav.widen(table(spark, sf, "unit_fields"), table(spark, sf, "field_specs")).drop("_misplaced")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a value of the declared type outside that type's own column."""
    wide = eav.widen(table(spark, sf, "unit_fields"), table(spark, sf, "field_specs"))
    return wide.select("unit_id", F.explode("_misplaced").alias("name"))


def _ledger(spark: SparkSession, sf: str) -> orphans.OrphanLedger:
    """Counts of all references and records as one delta, those of snippets as the next."""
    fields = table(spark, sf, "unit_fields").select("unit_id", "written_at")
    spans = table(spark, sf, "relevant_spans").select("span_id", "document_id", "snippet", "created_at")
    units = table(spark, sf, "units").select("unit_id", "indexed_at", "removed_at").distinct()
    documents = table(spark, sf, "parsed_documents")
    held = orphans.OrphanLedger(spark, scratch(spark, "orphans"))
    references = orphans.reference_deltas(fields, "unit_fields", "units", "unit_id", "unit_id", "written_at").unionByName(orphans.reference_deltas(spans, "relevant_spans", "parsed_documents", "document_id", "span_id", "created_at"))
    existence = orphans.existence_deltas(units, "units", "unit_id", "indexed_at", "removed_at").unionByName(orphans.existence_deltas(documents.select("document_id", "indexed_at", "removed_at").distinct(), "parsed_documents", "document_id", "indexed_at", "removed_at"))
    held.apply(references, existence)
    held.apply(*orphans.snippet_deltas(spans, documents.select("document_id", "text")))
    return held


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """References whose target is missing, removed or later, or whose snippet is stale."""
    return _ledger(spark, sf).orphans().select("ref_table", "ref_key", "ref_month").distinct()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return _ledger(spark, sf).orphans().groupBy("ref_table", "ref_month", "reason").agg(F.count_distinct("ref_key").alias("n_keys"))


QUERIES = {"p3_found": p3_found, "p3_wide": p3_wide, "p5_found": p5_found, "p5_report": p5_report}

_CELLS = r"""
with spec as (select *, lower(regexp_replace(name, '[^\p{L}\p{N}]', '', 'g')) as k from field_specs),
t as (select f.unit_id, s.name, s.field_type as kind, f.v_num, f.v_int, f.v_date, f.v_text, f.written_at,
    regexp_replace(regexp_replace(f.v_text, '^\s+|\s+$', '', 'g'), '([0-9])[,_]([0-9])', '\1\2', 'g') as x, regexp_replace(f.v_text, '^\s+|\s+$', '', 'g') as st
  from unit_fields f left join spec s on lower(regexp_replace(f.name, '[^\p{L}\p{N}]', '', 'g')) = s.k where f.unit_id is not null),
c as (select *, case when regexp_full_match(x, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?') then try_cast(x as double) end as xn,
    coalesce(try_strptime(st, ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%Y%m%d', '%Y-%m-%dT%H:%M:%S', '%d %b %Y', '%b %d, %Y', '%d %B %Y', '%B %d, %Y'])::date) as xd
  from t),
typed as (select unit_id, name, kind, written_at, v_int, v_num, v_date,
    case when kind = 'str' and lower(coalesce(st, '')) not in ('', '-', '--', 'n/a', 'na', 'none', 'null', 'tbd', 'unknown', 'see notes', 'soon', 'latest', '?') then v_text end as s,
    case when kind = 'int' then coalesce(v_int, case when v_num = floor(v_num) then v_num::bigint end, case when xn = floor(xn) then xn::bigint end) end as i,
    case when kind = 'float' then coalesce(v_num, v_int::double, xn) end as f,
    case when kind = 'date' then coalesce(try_cast(v_date as date), xd) end as d from c)
"""
_WIDE = ["package", "version", "version_major", "release_date", "timeout_seconds", "license_id", "stable", "max_connections", "reading_confidence", "python_requires", "deprecated_on", "download_mb", "doc_audience", "page_count"]
_KIND = {"version_major": "i", "release_date": "d", "timeout_seconds": "i", "max_connections": "i", "reading_confidence": "f", "deprecated_on": "d", "download_mb": "f", "page_count": "i"}

_ORPHANS = r"""
with ref as (
  select 'unit_fields' as ref_table, unit_id as ref_key, unit_id as target, 'units' as tt, written_at as made from unit_fields where unit_id is not null
  union all select 'relevant_spans', span_id::varchar, document_id, 'parsed_documents', created_at from relevant_spans where document_id is not null),
live as (select 'units' as tt, unit_id as k, min(case when removed_at is null then indexed_at end) as since, count(*) filter (removed_at is null) as n from units group by unit_id
  union all select 'parsed_documents', document_id, min(case when removed_at is null then indexed_at end), count(*) filter (removed_at is null) from parsed_documents group by document_id),
case_ as (select ref_table, ref_key, strftime(made, '%Y-%m') as ref_month, case when n is null then 'missing' when n <= 0 then 'removed' when since > made then 'later' end as reason
    from ref left join live on ref.tt = live.tt and ref.target = live.k
  union all select 'relevant_spans', span_id::varchar, strftime(created_at, '%Y-%m'), 'stale' from relevant_spans s join parsed_documents d using (document_id)
    where snippet <> '' and not contains(lower(regexp_replace(coalesce(d.text, ''), '[\s\v\p{Z}\x{85}]+', '', 'g')), lower(regexp_replace(snippet, '[\s\v\p{Z}\x{85}]+', '', 'g'))))
"""

ORACLES = {
    "p3_found": _CELLS + "select distinct unit_id, name from typed where (kind = 'int' and v_int is null and i is not null) or (kind = 'float' and v_num is null and f is not null) or (kind = 'date' and v_date is null and d is not null)",
    "p3_wide": _CELLS + ", best as (select unit_id, name, arg_max(row(s, i, f, d), row(written_at, s, i, f, d)) as v from (select unit_id, name, written_at, s, i, f, d from typed where coalesce(s, i::varchar, f::varchar, d::varchar) is not null) group by 1, 2) select u.unit_id, "
    + ", ".join(f"max(case when b.name = '{n}' then b.v[{'sifd'.index(_KIND.get(n, 's')) + 1}] end) as {n}" for n in _WIDE)
    + " from (select distinct unit_id from unit_fields where unit_id is not null) u left join best b using (unit_id) group by u.unit_id",
    "p5_found": _ORPHANS + "select distinct ref_table, ref_key, ref_month from case_ where reason is not null",
    "p5_report": _ORPHANS + "select ref_table, ref_month, reason, count(distinct ref_key) as n_keys from case_ where reason is not null group by 1, 2, 3",
}
