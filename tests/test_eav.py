from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quernstone.operators import eav

FIELDS = "unit_id string, name string, v_text string, v_num double, v_int bigint, v_date string, written_at timestamp_ntz"
SPECS = [("package", "str"), ("version_major", "int"), ("reading_confidence", "float"), ("release_date", "date")]
AT = [datetime(2024, 1, d) for d in range(1, 9)]


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame(SPECS, "name string, field_type string")


def wide(spark, specs, data, **kw):
    return eav.widen(spark.createDataFrame(data, FIELDS), specs, **kw)


def test_types_spellings_and_latest(spark, specs):
    data = [
        ("a", "versionMajor", " 007 ", None, None, None, AT[0]), ("a", "VERSION-MAJOR", None, None, 8, None, AT[1]), ("a", "Version Major", "soon", None, None, None, AT[5]),
        ("a", "Release Date", "May 5, 2021", None, None, None, AT[0]), ("a", "package", "unknown", None, None, None, AT[0]), ("a", "note", "x", None, None, None, AT[0]),
        ("b", "reading_confidence", "1.5e-1", None, None, None, AT[0]), ("b", "version_major", None, 3.0, None, None, AT[0]), ("b", "release_date", None, None, None, "2020-02-30", AT[0]),
        ("c", "note", "x", None, None, None, AT[0]), (None, "package", "p", None, None, None, AT[0]), ("d", None, "p", None, None, None, AT[0]),
        ("b", "version_major", None, 3.0, None, None, AT[0]), ("b", "package", "pkg", None, None, None, None),
    ]
    got = {r["unit_id"]: r for r in wide(spark, specs, data).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"]["version_major"], got["a"]["release_date"], got["a"]["package"]) == (8, date(2021, 5, 5), None)
    assert (got["b"]["version_major"], got["b"]["reading_confidence"], got["b"]["release_date"], got["b"]["package"]) == (3, 0.15, None, "pkg")
    assert sorted(got["a"]["_misplaced"]) == ["release_date", "version_major"] and sorted(got["b"]["_misplaced"]) == ["reading_confidence", "version_major"]
    assert got["c"]["_misplaced"] == [] and got["c"]["package"] is None


def test_texts_that_denote_values(spark):
    whole = {"+19": 19, "18_838": 18838, "3,485": 3485, "7.0": 7, "7.5": None, "1e3": 1000, "": None, "-": None, "4 5": None, "7.": 7, "NaN": None, "12d": None, "９": None}
    dates = {"20200106": "2020-01-06", "21 Oct 2013": "2013-10-21", "2014-11-15T00:00:00": "2014-11-15", "2021/03/21": "2021-03-21", "15.8.2020": "2020-08-15", "25/12/2020": "2020-12-25", "12/25/2020": "2020-12-25", "03/04/2020": None, "4/4/2020": "2020-04-04", "2020-13-01": None, "99999999": None, "Sept 3rd, 2019": "2019-09-03", "soon": None}
    df = spark.createDataFrame([(t,) for t in {**whole, **dates}], "t string")
    got = {r["t"]: (r["w"], r["d"]) for r in df.select("t", eav.whole_of(F.col("t")).alias("w"), eav.date_of(F.col("t")).cast("string").alias("d")).collect()}
    assert {t: got[t][0] for t in whole} == whole
    assert {t: got[t][1] for t in dates} == dates


def test_empty_clashing_and_long(spark, specs):
    assert rows(wide(spark, specs, [])) == []
    long = "x" * 200_000
    df = spark.createDataFrame([("a", "package", long, None, None, None, AT[0])], FIELDS).withColumns({"kind": F.lit("?"), "s": F.lit(1), "_key": F.lit("k")})
    assert wide_row(eav.widen(df, specs))["package"] == long
    with pytest.raises(ValueError):
        eav.widen(df, spark.createDataFrame([("a_b", "int"), ("aB", "int")], "name string, field_type string"))


def wide_row(df):
    return df.collect()[0]


def test_hot_entity_takes_the_other_way_with_the_same_result(spark, specs, monkeypatch):
    data = [("hot", "version_major", str(k), None, None, None, datetime(2024, 1, 1, 0, k % 60, k // 60)) for k in range(300)] + [("cold", "package", "p", None, None, None, AT[0])]
    plain = rows(wide(spark, specs, data))
    real = eav.split_hot
    monkeypatch.setattr(eav, "split_hot", lambda df, keys: real(df, keys, rows=100))
    assert rows(wide(spark, specs, data)) == plain and len(plain) == 2


def test_entities_cut_by_arrow_batches(spark, specs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [(f"u{k:02}", n, None, None, k, None, AT[0]) for k in range(20) for n in ("version_major", "package")]
        got = rows(wide(spark, specs, data), "unit_id", "version_major", "package")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(f"u{k:02}", k, str(k)) for k in range(20)]
