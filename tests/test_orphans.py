from __future__ import annotations

import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quernstone.operators import orphans as o

JAN, FEB, MAR = datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5)
REFS, RECORDS = "unit_id string, written_at timestamp_ntz", "unit_id string, indexed_at timestamp_ntz, removed_at timestamp_ntz"


def refs(spark, data, sign=1):
    return o.reference_deltas(spark.createDataFrame(data, REFS), "unit_fields", "units", "unit_id", "unit_id", "written_at", sign)


def records(spark, data, sign=1):
    return o.existence_deltas(spark.createDataFrame(data, RECORDS), "units", "unit_id", "indexed_at", "removed_at", sign)


def report(references, existence):
    return rows(o.orphans(references, existence), "ref_key", "ref_month", "n_refs", "reason")


def test_kinds_of_orphans(spark):
    r = o.merge_references(None, refs(spark, [("ok", FEB), ("late", JAN), ("late", MAR), ("gone", FEB), ("none", JAN), ("none", JAN), ("none", None), (None, JAN)]))
    e = o.merge_existence(None, records(spark, [("ok", JAN, None), ("late", FEB, None), ("gone", JAN, FEB), (None, JAN, None)]))
    assert report(r, e) == [("gone", "2024-02", 1, "removed"), ("late", "2024-01", 1, "later"), ("none", "2024-01", 2, "missing"), ("none", None, 1, "missing")]


def test_deltas_equal_a_rebuild(spark):
    """Adding and taking back in any order gives the state of what is left."""
    r = o.merge_references(None, refs(spark, [("a", JAN), ("b", JAN), ("b", JAN)]))
    r = o.merge_references(r, refs(spark, [("b", JAN), ("b", JAN), ("c", FEB)]))
    r = o.merge_references(r, refs(spark, [("a", JAN), ("b", JAN)], -1))
    e = o.merge_existence(None, records(spark, [("b", JAN, None)]))
    e = o.merge_existence(e, records(spark, [("c", JAN, None)]))
    assert report(r, e) == []
    e = o.merge_existence(e, records(spark, [("b", JAN, None)], -1))
    assert report(r, e) == [("b", "2024-01", 3, "removed")]


def test_a_record_that_comes_back_is_later_again(spark):
    r = o.merge_references(None, refs(spark, [("a", FEB)]))
    e = o.merge_existence(None, records(spark, [("a", JAN, None)]))
    assert report(r, e) == []
    e = o.merge_existence(e, records(spark, [("a", JAN, None)], -1))
    assert report(r, e) == [("a", "2024-02", 1, "removed")]
    e = o.merge_existence(e, records(spark, [("a", MAR, None)]))
    assert report(r, e) == [("a", "2024-02", 1, "later")]
    assert report(o.merge_references(r, refs(spark, [("a", FEB)], -1)), e) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_deltas_equal_a_rebuild(spark, tmp_path, seed):
    """Kept in a store: random additions and retractions, deltas one by one, give what is left over, built at once."""
    r, ledger = random.Random(seed), o.OrphanLedger(spark, str(tmp_path / "ledger"))
    held_refs, held_records = [], []
    for _ in range(5):
        steps = []
        for held, made in ((held_refs, lambda: (r.choice("abcd"), r.choice([JAN, FEB, MAR]))), (held_records, lambda: (r.choice("abcd"), r.choice([JAN, FEB, MAR]), r.choice([None, None, MAR])))):
            back = [held.pop(r.randrange(len(held))) for _ in range(r.randint(0, len(held)))]
            new = [made() for _ in range(r.randint(0, 4))]
            held += new
            steps.append((new, back))
        (new_refs, old_refs), (new_records, old_records) = steps
        ledger.apply(refs(spark, new_refs).unionByName(refs(spark, old_refs, -1)), records(spark, new_records).unionByName(records(spark, old_records, -1)))
    got = {x[:3] for x in rows(ledger.orphans(), "ref_key", "ref_month", "n_refs", "reason")}
    assert got == {x[:3] for x in report(refs(spark, held_refs), records(spark, held_records))}


def test_snippets(spark):
    spans = spark.createDataFrame([(1, "d", "Hello   WORLD", JAN), (2, "d", "hello mars", JAN), (3, "d", "", JAN), (4, "d", None, JAN), (5, None, "x", JAN), (6, "x", "x", JAN), (2, "d", "hello mars", JAN), (7, "n", "x", JAN)], "span_id bigint, document_id string, snippet string, created_at timestamp_ntz")
    docs = spark.createDataFrame([("d", "say hel lo\nworld"), ("n", None)], "document_id string, text string").withColumn("snippet", F.lit("clash"))
    assert rows(o.stale_snippets(spans, docs), "ref_key") == [("2",), ("7",)]


def test_empty(spark):
    assert report(o.merge_references(None, refs(spark, [])), o.merge_existence(None, records(spark, []))) == []
    assert report(o.merge_references(None, refs(spark, [("a", JAN)])), o.merge_existence(None, records(spark, []))) == [("a", "2024-01", 1, "missing")]


def test_a_stale_span_counts_in_each_month(spark):
    spans = spark.createDataFrame([(1, "d", "gone", "2024-01-05 00:00:00"), (1, "d", "gone", "2024-01-09 00:00:00"), (1, "d", "gone", "2024-03-05 00:00:00")], "span_id bigint, document_id string, snippet string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    documents = spark.createDataFrame([("d", "other text")], "document_id string, text string")
    got = o.stale_snippets(spans, documents).collect()
    assert sorted((r["ref_month"], r["n_refs"]) for r in got) == [("2024-01", 2), ("2024-03", 1)]
