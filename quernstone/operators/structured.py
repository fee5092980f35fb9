"""Predicates, structured queries and filter-only search over a typed wide table of fields.

Predicates are values of the classes below and compile to one Column. Every leaf is two-valued: a missing field makes it false, and
so its negation true, except that Compare EQ None and Exists(present=False) hold for a missing field.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import fold, quick_fold

OPS = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Exists:
    field: str
    present: bool = True


@dataclass(frozen=True)
class TextMatch:
    field: str
    text: str
    mode: str = "contains"


@dataclass(frozen=True)
class And:
    clauses: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or:
    clauses: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not:
    clause: Predicate


Predicate = Compare | In | Exists | TextMatch | And | Or | Not


def all_of(clauses: Sequence[Predicate]) -> Predicate | None:
    """None, the only clause, or their conjunction."""
    return None if not clauses else clauses[0] if len(clauses) == 1 else And(tuple(clauses))


def fields_of(p: Predicate | None) -> set[str]:
    if p is None:
        return set()
    if isinstance(p, And | Or):
        return set().union(*map(fields_of, p.clauses))
    return fields_of(p.clause) if isinstance(p, Not) else {p.field}


def _family(t: T.DataType) -> str:
    return "number" if isinstance(t, T.NumericType) else "bool" if isinstance(t, T.BooleanType) else "time" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "text" if isinstance(t, T.StringType) else "other"


def _kind(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "time" if isinstance(v, date | datetime) else "text"


def compiled(p: Predicate | None, schema: T.StructType, exact_fold: bool = False) -> Column:
    """A predicate as a Column that is never null. Ordering a field against a value of another type is refused; equality is false."""
    types = {f.name: f.dataType for f in schema.fields}
    folded = fold if exact_fold else quick_fold

    def leaf(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def column(name: str) -> Column:
        return F.col(f"`{name}`") if name in types else F.lit(None)

    def build(p: Predicate) -> Column:
        match p:
            case Compare(field, op, None):
                return column(field).isNull() if op == "eq" else F.lit(False)
            case Compare(field, op, value):
                if field not in types:
                    return F.lit(False)
                if _family(types[field]) != _kind(value):
                    if op in ("eq", "ne"):
                        return F.lit(False) if op == "eq" else column(field).isNotNull()
                    raise TypeError(f"{field} is {types[field].simpleString()}, which has no order with {value!r}")
                return leaf(OPS[op](column(field), F.lit(value)))
            case In(field, values):
                same = [v for v in values if v is not None and field in types and _kind(v) == _family(types[field])]
                held = leaf(column(field).isin(same)) if same else F.lit(False)
                return held | column(field).isNull() if None in values else held
            case Exists(field, present):
                return column(field).isNotNull() if present else column(field).isNull()
            case TextMatch(field, text, mode):
                if mode not in ("contains", "prefix", "exact"):
                    raise ValueError(f"unknown mode {mode!r}")
                if field not in types or _family(types[field]) != "text":
                    return F.lit(False)
                c, v = folded(column(field)), folded(F.lit(text))
                return leaf(c.contains(v) if mode == "contains" else c.startswith(v) if mode == "prefix" else c == v)
            case And(clauses):
                return reduce(Column.__and__, map(build, clauses), F.lit(True))
            case Or(clauses):
                return reduce(Column.__or__, map(build, clauses), F.lit(False))
            case Not(clause):
                return ~build(clause)
        raise TypeError(f"{p!r} is no predicate")

    return F.lit(True) if p is None else build(p)


@dataclass(frozen=True)
class Aggregation:
    op: str
    field: str | None = None
    name: str | None = None

    def column(self, schema: T.StructType) -> Column:
        if self.op == "count":
            c = F.count(F.lit(1))
        elif self.op in ("sum", "avg") and _family(schema[self.field].dataType) != "number":
            raise TypeError(f"{self.op} of {self.field}, which is {schema[self.field].dataType.simpleString()}")
        else:
            c = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.op](F.col(f"`{self.field}`"))
        return c.alias(self.name or (f"{self.op}_{self.field}" if self.field else self.op))


@dataclass(frozen=True)
class StructuredQuery:
    where: Predicate | None = None
    select: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None


def _ordered(order_by: tuple[tuple[str, bool], ...]) -> list[Column]:
    return [F.col(f"`{f}`").desc_nulls_last() if down else F.col(f"`{f}`").asc_nulls_first() for f, down in order_by]


def run(records: DataFrame, query: StructuredQuery, key: str = "unit_id") -> DataFrame:
    """A structured query over typed records. Single rows have `_sources`, the key they came from; those of groups are in citations(). Nulls come
    first in ascending order; the key settles ties of single rows. No limit, or 0, means 1000."""
    held = records.filter(compiled(query.where, records.schema))
    top = query.limit or 1000
    if not query.aggregations and not query.group_by:
        chosen = query.select or tuple(c for c in (key, "document_id") if c in records.columns)
        rows = held.orderBy(*_ordered(query.order_by), F.col(key)).limit(top)
        return rows.select(*[F.col(f"`{c}`") for c in chosen], F.array(F.col(key).cast("string")).alias("_sources"))
    if query.select and not query.group_by:
        raise ValueError("a field beside aggregates needs grouping by it")
    if set(query.select) - set(query.group_by):
        raise ValueError("only fields grouped by can be selected")
    aggregates = [a.column(records.schema) for a in query.aggregations]
    if not query.group_by:
        return held.agg(*aggregates)
    grouped = held.groupBy(*query.group_by).agg(*aggregates)
    rows = grouped.orderBy(*_ordered(query.order_by), *[F.col(f"`{g}`") for g in query.group_by]).limit(top)
    return rows.select(*[F.col(f"`{c}`") for c in query.select], *[c for c in grouped.columns if c not in query.group_by])


def citations(records: DataFrame, query: StructuredQuery, key: str = "unit_id") -> DataFrame:
    """(*GROUP_BY, KEY): the records behind each row of an aggregating query, one row per record, so that a group may be of any size."""
    return records.filter(compiled(query.where, records.schema)).select(*[F.col(f"`{g}`") for g in query.group_by], key)


def run_each(records: DataFrame, queries: Sequence[StructuredQuery], key: str = "unit_id") -> DataFrame:
    """(number, rank, KEY, selected, score): queries for single rows in the order of their key, by their place in QUERIES, in one reading
    of the records. `selected` has the fields asked for as text. The limit is as in run()."""
    if any(q.group_by or q.aggregations or q.order_by for q in queries):
        raise ValueError("only queries for single rows, without an order of their own, run together")

    def hit(i: int, q: StructuredQuery) -> Column:
        fields = [x for c in q.select if c in records.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        row = F.struct(F.lit(i).alias("number"), F.lit(q.limit or 1000).alias("most"), (F.create_map(*fields) if fields else F.create_map()).cast("map<string,string>").alias("selected"))
        return F.when(compiled(q.where, records.schema), row)

    hits = records.select(F.col(key), F.explode(F.array_compact(F.array(*[hit(i, q) for i, q in enumerate(queries)]))).alias("h")).select(key, "h.*")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(key)))
    return ranked.filter(F.col("rank") <= max(q.limit or 1000 for q in queries)).filter("rank <= most").select("number", "rank", key, "selected", F.lit(1.0).alias("score"))


def filter_search(records: DataFrame, where: Predicate | None, top_k: int, unit_ids: Sequence[str] | None = None) -> DataFrame:
    """(unit_id, rank, score) of records that pass a filter or are named; with neither, none."""
    if where is None and unit_ids is None:
        return records.select("unit_id").limit(0).select("unit_id", F.lit(0).alias("rank"), F.lit(1.0).alias("score"))
    held = records.filter(compiled(where, records.schema))
    if unit_ids is not None:
        held = held.filter(F.col("unit_id").isin(list(unit_ids)))
    first = held.select("unit_id").orderBy("unit_id").limit(top_k)
    return first.select("unit_id", F.row_number().over(Window.orderBy("unit_id")).alias("rank"), F.lit(1.0).alias("score"))


def fields_long(records: DataFrame, key: str = "unit_id") -> DataFrame:
    """Typed records as (unit_id, name, v_text, v_int, v_num, v_date), one row per value."""
    rows = []
    for f in records.schema.fields:
        if f.name == key:
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType
        whole, num, day = isinstance(kind, T.IntegralType | T.BooleanType), isinstance(kind, T.FractionalType), _family(kind) == "time"
        none = F.lit(None)
        rows.append(F.struct(F.lit(f.name).alias("name"), (none if whole or num or day else c).cast("string").alias("v_text"), (c if whole else none).cast("bigint").alias("v_int"), (c if num else none).cast("double").alias("v_num"), (c if day else none).cast("date").alias("v_date")))
    return records.select(key, F.explode(F.array(*rows)).alias("f")).select(key, "f.*").filter("v_text is not null or v_int is not null or v_num is not null or v_date is not null")
