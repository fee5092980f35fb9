"""p1_, p2_, p4_ and p6_ to p10_ queries and their SQL."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import aggregation, distinctive, leakage, lines, markup, neardup, packing, pii
from quernstone.session import cut, scratch, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The unit at the top of each query's combined ranking."""
    return aggregation.best_units(table(spark, sf, "hits"))


def p1_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's combined ranking, whole."""
    return aggregation.combined_ranking(table(spark, sf, "hits")).withColumn("rho", F.round("rho", 9))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The most characteristic word of each unit of term_probes."""
    return distinctive.best_terms(table(spark, sf, "units"), table(spark, sf, "term_probes"))


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every word of the units of term_probes."""
    return distinctive.term_scores(table(spark, sf, "units"), table(spark, sf, "term_probes")).withColumn("score", F.round("score", 6))


def _repeated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Units, and their repeated lines as two increments find them: live units are the first partition, removed ones the second."""
    units = table(spark, sf, "units").select("unit_id", "source_uri", "text", "removed_at")
    ledger = lines.LineLedger(spark, scratch(spark, "lines"))
    first = ledger.add(units.filter("removed_at is null"))
    return units, first.unionByName(ledger.add(units.filter("removed_at is not null"))).select("unit_id", "line_no").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that recur in at least six documents of their site."""
    return _repeated(spark, sf)[1]


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The units that hold such lines, without them."""
    return lines.rebuilt(*_repeated(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of units whose sets of runs of three words have a Jaccard similarity of at least 0.5."""
    return neardup.similar_pairs(table(spark, sf, "units"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The groups these pairs connect."""
    return neardup.groups(table(spark, sf, "units"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of units equal in words that each unit is in."""
    return neardup.membership(table(spark, sf, "units"))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return markup.tokens(table(spark, sf, "units"), "units", "unit_id").unionByName(markup.tokens(table(spark, sf, "parsed_documents"), "parsed_documents", "document_id"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Units and documents whose text holds a construct of a markup language."""
    return markup.held(_marked(spark, sf))


def p7_templates(spark: SparkSession, sf: str) -> DataFrame:
    """The classes of tokens that make up each site's templates."""
    return markup.site_templates(_marked(spark, sf)).withColumn("tokens", F.array_join("tokens", " "))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of every unit and document."""
    return markup.cleaned(table(spark, sf, "units"), "units", "unit_id").unionByName(markup.cleaned(table(spark, sf, "parsed_documents"), "parsed_documents", "document_id"))


def p7_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The slots of every unit and document between the tokens of its site's templates."""
    templates = cut(markup.site_templates(_marked(spark, sf)).select("site", "class_id", "tokens", "valid"), "templates")
    return markup.slots(table(spark, sf, "units"), templates, "units", "unit_id").unionByName(markup.slots(table(spark, sf, "parsed_documents"), templates, "parsed_documents", "document_id"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 2,048 tokens and the documents in them."""
    return packing.pack(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share at least 13 consecutive words with an evaluation item."""
    return leakage.verified(leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), whole=False))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an evaluation item nearly whole or a passage of it, with both measures."""
    return leakage.near_items(leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))).withColumn("similarity", F.round("similarity", 6))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold personal details, by kind."""
    return pii.find_lines(table(spark, sf, "documents"))


def p10_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with placeholders in place of personal details."""
    return pii.masked(table(spark, sf, "documents"))


QUERIES = {"p1_found": p1_found, "p1_ranking": p1_ranking, "p2_found": p2_found, "p2_scores": p2_scores, "p4_found": p4_found, "p4_clean": p4_clean, "p6_found": p6_found, "p6_groups": p6_groups, "p6_classes": p6_classes, "p7_found": p7_found, "p7_templates": p7_templates, "p7_clean": p7_clean, "p7_slots": p7_slots, "p8_pack": p8_pack, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_masked": p10_masked}


def _tail_sql(k: int, r: str, most: int = 5) -> str:
    by_m = " ".join(f"when {m} then " + (" + ".join(f"{comb(m, j)} * pow({r}, {j}) * pow(1 - {r}, {m - j})" for j in range(k, m + 1)) if k <= m else "null") for m in range(1, most + 1))
    return f"case m {by_m} end"


_RANKING = (
    """
with h as (select query_id, "index" as ix, unit_id, max(score) as score, min(rank) as rank from hits where query_id is not null and "index" is not null and unit_id is not null group by 1, 2, 3),
p as (select *, count(*) over (partition by query_id, ix) as size, (rank() over (partition by query_id, ix order by score desc nulls last)
    + count(*) over (partition by query_id, ix order by score desc nulls last range between unbounded preceding and current row)) / 2.0 as mid from h),
a as (select query_id, unit_id, ix, case when score is not null then mid else greatest(1.0, least(coalesce(rank, size), size)) end as at_ from p),
n as (select query_id, count(distinct unit_id) as n, count(distinct ix) as m from a group by 1),
u as (select query_id, unit_id, list_sort(list(at_)) as ats, any_value(n) as n, any_value(m) as m from a join n using (query_id) group by 1, 2),
r as (select query_id, unit_id, m, """
    + ", ".join(f"coalesce(least(ats[{k}] / n, 1.0), 1.0) as r{k}" for k in range(1, 6))
    + " from u), s as (select query_id, unit_id, round(least(1.0, m * least("
    + ", ".join(_tail_sql(k, f"r{k}") for k in range(1, 6))
    + ")), 15) as rho, round(("
    + " + ".join(f"case when m >= {k} then r{k} else 0 end" for k in range(1, 6))
    + ") / m, 12) as mr from r), o as (select query_id, unit_id, rho, row_number() over (partition by query_id order by rho, mr, unit_id) as position from s) "
)
_WORDS = r"""
with u as (select distinct unit_id, text from units where text is not null),
w as (select unit_id, unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) as term from u),
t as (select term, count(*) as n_term from w where term <> '' group by 1),
z as (select sum(pow(n_term, 0.4)) as z from t),
o as (select unit_id, term, count(*) as n from w where term <> '' and unit_id in (select unit_id from term_probes) group by 1, 2),
s as (select unit_id, term, n, round(greatest(0.0, ln(n / sum(n) over (partition by unit_id) * z / pow(n_term, 0.4))), 9) as score from o join t using (term), z)
"""
_LINES = r"""
with l as (select distinct unit_id, source_uri, i as line_no, string_split(text, chr(10))[i] as line from units, unnest(range(1, len(string_split(text, chr(10))) + 1)) as r(i)),
k as (select *, string_split(source_uri, '/')[1] as site, replace(regexp_replace(lower(line), '[^\p{L}]+', '', 'g'), 'ß', 'ss') as k from l),
c as (select site, k from k where length(k) >= 20 group by 1, 2 having count(distinct source_uri) >= 6)
"""
_LEAKS = r"""
with d as (select distinct doc_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from documents),
e as (select item_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from eval_items),
g as (select distinct item_id, array_to_string(w[i:i+12], ' ') as s from e, unnest(range(1, len(w) - 11)) as r(i)),
f as (select doc_id, array_to_string(w[i:i+12], ' ') as s from d, unnest(range(1, len(w) - 11)) as r(i))
select distinct item_id, doc_id from f join g using (s)
"""

_NEAR = r"""
with d as (select distinct doc_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from documents),
e as (select item_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from eval_items),
g as (select item_id, i as ii, array_to_string(w[i:i+12], ' ') as s from e, unnest(range(1, len(w) - 11)) as r(i)),
f as (select doc_id, i as di, array_to_string(w[i:i+12], ' ') as s from d, unnest(range(1, len(w) - 11)) as r(i)),
m as (select distinct item_id, doc_id, di - ii as diagonal, di from f join g using (s)),
o as (select *, di - row_number() over (partition by item_id, doc_id, diagonal order by di) as island from m),
run as (select item_id, doc_id, max(n) + 12 as n from (select item_id, doc_id, count(*) as n from o group by item_id, doc_id, diagonal, island) group by 1, 2),
h as (select distinct item_id, array_to_string(w[i:i+4], ' ') as s from e, unnest(range(1, len(w) - 3)) as r(i)),
wt as (select s, ln(1 + (select count(*) from e) / count(*)) as wt from h group by 1),
t as (select item_id, sum(wt) as total from h join wt using (s) group by 1),
k as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as s from d, unnest(range(1, len(w) - 3)) as r(i)),
sim as (select item_id, doc_id, sum(wt) as got from h join wt using (s) join k using (s) group by 1, 2)
select item_id, doc_id, coalesce(n, 0)::int as longest_run, round(got / total, 6) as similarity from sim join t using (item_id) left join run using (item_id, doc_id) where n is not null or got / total >= 0.8
"""

_PAIRS = r"""
with u as (select distinct unit_id, text from units where text is not null),
w as (select unit_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from u),
s as (select unit_id, array_to_string(w, ' ') as whole, list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) as s from w),
x as (select unit_id, unnest(s) as g, len(s) as n from s),
j as (select a.unit_id as unit_id_a, b.unit_id as unit_id_b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.g = b.g and a.unit_id < b.unit_id group by 1, 2),
p as (select unit_id_a, unit_id_b from j where c >= 0.5 * (na + nb - c)
  union select a.unit_id, b.unit_id from s a join s b on a.whole = b.whole and a.unit_id < b.unit_id)
"""

ORACLES = {
    "p1_found": _RANKING + "select query_id, unit_id from o where position = 1",
    "p1_ranking": _RANKING + "select query_id, position, unit_id, round(rho, 9) as rho from o",
    "p2_found": _WORDS + "select unit_id, arg_min(term, row(-score, term)) as term from s group by 1",
    "p2_scores": _WORDS + "select unit_id, term, n, round(score, 6) as score from s",
    "p4_found": _LINES + "select distinct unit_id, line_no from k join c using (site, k)",
    "p4_clean": _LINES + "select unit_id, coalesce(string_agg(line, chr(10) order by line_no) filter (c.site is null), '') as text, (count(*) filter (c.site is not null))::int as n_removed from k left join c using (site, k) group by unit_id having count(c.site) > 0",
    "p6_found": _PAIRS + "select unit_id_a, unit_id_b from p",
    "p6_groups": _PAIRS.replace("with u as", "with recursive u as", 1) + ", e as (select unit_id_a as a, unit_id_b as b from p union select unit_id_b, unit_id_a from p), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as unit_id, least(a, min(b)) as group_id from r group by a",
    "p6_classes": _PAIRS + "select unit_id, min(unit_id) over (partition by whole) as class_id, count(*) over (partition by whole) as n_members from s",
    "p9_found": _LEAKS,
    "p9_leaks": _NEAR,
}
