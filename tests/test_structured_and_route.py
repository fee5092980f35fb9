from __future__ import annotations

from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quernstone.operators import route
from quernstone.operators import structured as s
from quernstone.operators.structured import And, Compare, Exists, In, Not, Or, TextMatch

DATA = [("d0", "requests", 2, date(2023, 5, 22), True, 1.5), ("d1", "Straße", 1, date(2020, 1, 1), False, 2.0), ("d2", "50%_off", 3, None, True, None), ("d3", "flask", 0, date(2024, 2, 2), None, 0.0), ("d4", None, None, date(2021, 7, 7), False, -1.0)]
SCHEMA = "unit_id string, package string, version_major bigint, released date, stable boolean, size double"


def holds(p, r) -> bool:
    """The two-valued meaning of a predicate on one record."""
    ops = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}
    if isinstance(p, And | Or):
        return (all if isinstance(p, And) else any)(holds(c, r) for c in p.clauses)
    if isinstance(p, Not):
        return not holds(p.clause, r)
    v = r.get(p.field)
    if isinstance(p, Compare):
        return (v is None and p.op == "eq") if p.value is None else v is not None and ops[p.op](v, p.value)
    if isinstance(p, In):
        return v in p.values
    if isinstance(p, Exists):
        return (v is not None) == p.present
    return isinstance(v, str) and {"contains": lambda a, b: b in a, "prefix": str.startswith, "exact": str.__eq__}[p.mode](v.casefold(), p.text.casefold())


GRID = [*(Compare("version_major", op, 1) for op in s.OPS), Compare("size", "eq", 2), Compare("version_major", "gt", 0.5), Compare("released", "lt", date(2022, 1, 1)), Compare("released", "eq", date(2020, 1, 1)), Compare("package", "eq", "flask"), Compare("stable", "eq", True), Compare("package", "eq", None), Compare("package", "ne", None), Compare("nothing", "eq", 1), Compare("nothing", "eq", None),
        In("version_major", (0, 3)), In("package", ("flask", None)), In("package", ()), Exists("released"), Exists("released", False), Exists("nothing"), TextMatch("package", "STRASSE"), TextMatch("package", "%_"), TextMatch("package", "REQ", "prefix"), TextMatch("package", "FLASK", "exact"), TextMatch("version_major", "1"),
        Not(Compare("version_major", "eq", 1)), Not(Exists("released")), Not(TextMatch("package", "a")), And(()), Or(()), And((Exists("released"), Or((Compare("stable", "eq", True), Not(In("version_major", (1,)))))))]


def test_predicates_against_meaning(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    names = df.columns
    got = df.select("unit_id", *[s.compiled(p, df.schema, exact_fold=k % 2 == 0).alias(f"p{k}") for k, p in enumerate(GRID)]).collect()
    for r, raw in zip(got, DATA, strict=True):
        record = dict(zip(names, raw, strict=True))
        for k, p in enumerate(GRID):
            assert r[f"p{k}"] == holds(p, record), (p, record)


def test_types_are_checked(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    with pytest.raises(TypeError):
        s.compiled(Compare("released", "lt", 2022), df.schema)
    with pytest.raises(TypeError):
        s.run(df, s.StructuredQuery(aggregations=(s.Aggregation("sum", "released"),)))
    with pytest.raises(ValueError):
        s.run(df, s.StructuredQuery(select=("package",), aggregations=(s.Aggregation("count"),)))
    with pytest.raises(ValueError):
        s.compiled(TextMatch("package", "a", "suffix"), df.schema)


def test_queries_cite_their_rows(spark):
    df = spark.createDataFrame([*DATA, ("d5", None, 9, None, None, None)], SCHEMA)
    query = s.StructuredQuery(select=("stable",), group_by=("stable",), aggregations=(s.Aggregation("count"), s.Aggregation("max", "released")), order_by=(("stable", False),))
    assert [(r["stable"], r["count"]) for r in s.run(df, query).collect()] == [(None, 2), (False, 2), (True, 2)]
    assert rows(s.citations(df, query)) == sorted([(None, "d3"), (None, "d5"), (False, "d1"), (False, "d4"), (True, "d0"), (True, "d2")], key=repr)
    top = s.run(df, s.StructuredQuery(select=("package",), order_by=(("version_major", True),), limit=2)).collect()
    assert [r["_sources"] for r in top] == [["d5"], ["d2"]]
    assert rows(s.filter_search(df, None, 5)) == [] and s.filter_search(df, None, 5, ["d1", "d9"]).count() == 1
    assert rows(s.fields_long(df.select("unit_id", "size")).filter("unit_id = 'd0'"), "name", "v_num") == [("size", 1.5)]


LEX = ["package", "release_date", "version", "version_major"]
TYPES = {"package": "str", "release_date": "date", "version": "str", "version_major": "int"}


@pytest.mark.parametrize(("question", "clause"), [
    ("release date before 2023-06-27", Compare("release_date", "lt", date(2023, 6, 27))), ("which have release date since 2020-01-01?", Compare("release_date", "gte", date(2020, 1, 1))),
    ("version major greater than 2", Compare("version_major", "gt", 2)), ("version major at least 1,000", Compare("version_major", "gte", 1000)), ("version 1.0.0", TextMatch("version", "1.0.0", "exact")),
    ("how many package values", Exists("package")), ("package is flask", TextMatch("package", "flask", "exact")), ("version major of 3", Compare("version_major", "eq", 3)), ("release date before 2023-13-45", Exists("release_date")),
])
def test_predicates_of_questions(question, clause):
    assert route.structured_query(question, LEX, TYPES).where == clause
    assert route.predicate_of(route.as_json(clause)) == clause


def test_field_names_by_length_and_case():
    assert route.fields_named("the Version Major and version", ["version", "Version_Major"]) == ["Version_Major"]
    assert route.fields_named("nothing here", LEX) == [] and route.structured_query("hello", LEX) is None


def test_paths(spark):
    q = spark.createDataFrame([("1", "how many have version major greater than 2"), ("2", "compare requests versus httpx pooling"), ("3", "where is the timeout set"), ("4", "more than 5 failures"), ("5", None)], "query_id string, query string")
    got = {r["query_id"]: r for r in route.route(q, LEX, TYPES).collect()}
    assert [got[k]["path"] for k in "12345"] == ["structured", "iterative", "lookup", "lookup", "lookup"]
    assert got["2"]["sub_queries"] == ["compare requests", "httpx pooling"] and got["2"]["step_budget"] == 3 and "no predicate" in got["4"]["reason"]
    assert {r["path"] for r in route.route(q, LEX, TYPES, structured=False).collect()} == {"iterative", "lookup"}
    assert q.select(route.sub_questions(F.col("query"))).count() == 5
