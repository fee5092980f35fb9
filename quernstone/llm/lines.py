"""Lines repeated across the documents of one site, kept as incremental tables of counts.

State, in a store: `held`, where each line long enough stands (site, line, document, record, line number), `documents`, and `counts`, the
number of documents per (site, line); all are parts that increments append. A new partition of records is one delta: its lines are put into `held`,
its (line, document) pairs that `held` didn't have yet are a signed delta of `counts`, and lines whose count passes the threshold by it are
the newly crossed ones. What is found anew is then all crossed lines in the new partition, and the newly crossed ones in earlier
partitions, taken from `held`; earlier texts are not read again but for the records that are rebuilt, those that hold a line found anew.

A line is known by its sequence of letters in lower case (a 128-bit hash of it); lines of fewer letters than LETTERS never count.
The site is what stands before the first "/" of source_uri. A null uri belongs to no site: its lines stay. A null text has no lines,
an empty one has one empty line, which stays. Equal rows count once, as documents are counted. Line numbers begin at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.ledger import Store
from quernstone.session import bounded, cut

LETTERS = 20
DOCUMENTS = 6
_LINE = ["site", "h1", "h2"]


def site_of(uri: Column) -> Column:
    return F.substring_index(uri, "/", 1)


def letters_of(line: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(line), r"[^\p{L}]+", ""), F.lit("ß"), F.lit("ss"))


def long_lines(records: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(site, h1, h2, doc, unit_id, line_no) of each line with at least LETTERS letters; doc is a hash of its uri."""
    lines = records.select("unit_id", "source_uri", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.length("line") >= letters)
    key = lines.select(F.xxhash64("source_uri").alias("doc"), site_of(F.col("source_uri")).alias("site"), "unit_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), letters_of(F.col("line")).alias("_k"))
    key = key.filter((F.length("_k") >= letters) & F.col("site").isNotNull())
    return key.select("site", F.xxhash64("_k").alias("h1"), F.xxhash64(F.lit(7), "_k").alias("h2"), "doc", "unit_id", "line_no")


class LineLedger:
    """The lines of all partitions so far, in a store."""

    def __init__(self, spark: SparkSession, path: str, letters: int = LETTERS, documents: int = DOCUMENTS) -> None:
        self.store, self.letters, self.documents = Store(spark, path), letters, documents

    def add(self, partition: DataFrame) -> DataFrame:
        """Put in a new partition of records, in one commit. Returns what is found anew, a written table (unit_id, line_no, doc): repeated lines
        of the partition, and lines of earlier ones that crossed the threshold by it. `doc` is the hash of the uri."""
        before, had, earlier = self.store.parts("held"), self.store.read("counts"), self.store.read("documents")
        part = self.store.write("held", long_lines(partition, self.letters))
        new = self.store.read("held", [part])
        documents = self.store.write("documents", new.select("doc").distinct())
        pairs = new.select(*_LINE, "doc").distinct()
        if earlier is not None:
            # only documents that come in parts can have had a line before
            again = bounded(cut(self.store.read("documents", [documents]).join(earlier, "doc", "left_semi"), "lines-documents"))
            known = self.store.read("held", before).join(again, "doc", "left_semi").select(*_LINE, "doc").distinct()
            pairs = pairs.join(known, [*_LINE, "doc"], "left_anti")
        delta = self.store.write("counts", pairs.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("n")))
        counts = self.store.read("counts", [*self.store.parts("counts"), delta])
        total = counts.groupBy(*_LINE).agg(F.sum("n").alias("n")).filter(F.col("n") >= self.documents)
        if had is None:
            anew = new.join(bounded(cut(total.select(*_LINE), "lines-crossed")), _LINE, "left_semi")
        else:
            was = had.groupBy(*_LINE).agg(F.sum("n").alias("_was")).filter(F.col("_was") >= self.documents).select(*_LINE, F.lit(True).alias("_was"))
            crossed = cut(total.select(*_LINE).join(was, _LINE, "left"), "lines-crossed")
            newly = bounded(crossed.filter("_was is null").select(*_LINE))
            anew = new.join(bounded(crossed.select(*_LINE)), _LINE, "left_semi").unionByName(self.store.read("held", before).join(newly, _LINE, "left_semi"))
        found = cut(anew.select("unit_id", "line_no", "doc").distinct(), "lines-found")
        self.store.commit(append={"held": [part], "documents": [documents], "counts": [delta]})
        self.store.compacted("counts", lambda d: d.groupBy(*_LINE).agg(F.sum("n").alias("n")))
        self.store.compacted("held", lambda d: d.distinct())
        self.store.compacted("documents", lambda d: d.distinct())
        return found

    def repeated(self) -> DataFrame:
        """(unit_id, line_no) of all repeated lines of all partitions so far."""
        crossed = self.store.read("counts").groupBy(*_LINE).agg(F.sum("n").alias("n")).filter(F.col("n") >= self.documents)
        return self.store.read("held").join(crossed.select(*_LINE), _LINE, "left_semi").select("unit_id", "line_no").distinct()


def rebuilt(records: DataFrame, gone: DataFrame) -> DataFrame:
    """(unit_id, text, n_removed) of the records that hold lines of GONE (unit_id, line_no), without these lines. Other records are left out
    before their text is touched."""
    numbers = gone.groupBy("unit_id").agg(F.collect_set("line_no").alias("_gone"))
    held = records.select("unit_id", "text").join(bounded(gone.select("unit_id").distinct()), "unit_id", "left_semi").distinct()
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, k: F.struct(x.alias("x"), (k + 1).alias("k"))), lambda x: ~F.array_contains("_gone", x["k"].cast("bigint")))
    return held.join(numbers, "unit_id").select("unit_id", F.array_join(F.transform(kept, lambda x: x["x"]), "\n").alias("text"), F.size("_gone").alias("n_removed"))
