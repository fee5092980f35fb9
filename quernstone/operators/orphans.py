"""References to records that do not exist, from signed counts kept per key and time.

A change delta adds to or takes from the references to a key at a time, or from the records of a key that exist since a time. State and
deltas have one form, so merging is a union and one partially aggregated sum, and taking back leaves exactly what was never added.
Keys with positive references and no existence are the orphans; a record exists from the least time whose count is positive. A snippet is a
reference to a key of its own, its document and squeezed text, which exists while the document's text holds it.

OrphanLedger keeps the counts in a store: a delta is appended as a part, parts are summed when read and merged now and then, so an
increment writes as much as it brings.

Defined cases: a null key refers to nothing and is no reference; a null time is in the null period and is never "earlier than
the record"; equal rows count once each in n_refs; a record that was removed, at any time, counts +1 and -1. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.ledger import Store

REFERENCES = "ref_table string, target_table string, target_key string, ref_key string, at timestamp_ntz, n_refs bigint"
EXISTENCE = "target_table string, target_key string, since timestamp_ntz, n_live bigint"
SNIPPETS = "snippets"


def _ntz(at: Column) -> Column:
    return at.cast("timestamp_ntz")


def reference_deltas(rows: DataFrame, ref_table: str, target_table: str, target_key: str, ref_key: str, at: str, sign: int = 1) -> DataFrame:
    """Signed references of ROWS, pre-aggregated per key and time; SIGN -1 for rows that were deleted."""
    return (
        rows.select(F.col(target_key).cast("string").alias("target_key"), F.col(ref_key).cast("string").alias("ref_key"), _ntz(F.col(at)).alias("at"))
        .filter("target_key is not null")
        .groupBy("target_key", "ref_key", "at")
        .agg((F.count(F.lit(1)) * sign).alias("n_refs"))
        .select(F.lit(ref_table).alias("ref_table"), F.lit(target_table).alias("target_table"), "target_key", "ref_key", "at", "n_refs")
    )


def existence_deltas(rows: DataFrame, target_table: str, key: str, since: str, removed: str | None = None, sign: int = 1) -> DataFrame:
    """Signed existence of the records of ROWS since their time: +1 each, and -1 more for a removed one."""
    gone = F.col(removed).isNotNull() if removed else F.lit(False)
    return (
        rows.select(F.col(key).cast("string").alias("target_key"), _ntz(F.col(since)).alias("since"), F.when(gone, 0).otherwise(sign).alias("_n"))
        .filter("target_key is not null")
        .groupBy("target_key", "since")
        .agg(F.sum("_n").cast("bigint").alias("n_live"))
        .select(F.lit(target_table).alias("target_table"), "target_key", "since", "n_live")
    )


def merge_references(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """State after a delta; what sums to zero leaves it."""
    both = delta if state is None else state.unionByName(delta)
    return both.groupBy("ref_table", "target_table", "target_key", "ref_key", "at").agg(F.sum("n_refs").alias("n_refs")).filter("n_refs <> 0")


def merge_existence(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """State after a delta; zeros stay, so that a removed record is told from one that never was."""
    both = delta if state is None else state.unionByName(delta)
    return both.groupBy("target_table", "target_key", "since").agg(F.sum("n_live").alias("n_live"))


def orphans(references: DataFrame, existence: DataFrame) -> DataFrame:
    """(ref_table, ref_key, ref_month, n_refs, reason) of references whose target is missing, removed or later than they are, or whose
    snippet is stale. Both may be states or any number of deltas in one table."""
    live = merge_existence(None, existence).groupBy("target_table", "target_key").agg(F.sum("n_live").alias("n_live"), F.min(F.when(F.col("n_live") > 0, F.col("since"))).alias("live_from"))
    held = merge_references(None, references).filter("n_refs > 0").join(live, ["target_table", "target_key"], "left")
    snippet = F.col("target_table") == SNIPPETS
    reason = F.when(snippet & (F.coalesce("n_live", F.lit(0)) <= 0), "stale").when(F.col("n_live").isNull(), "missing").when(F.col("n_live") <= 0, "removed").when(~snippet & (F.col("live_from") > F.col("at")), "later")
    found = held.select("ref_table", "ref_key", F.date_format("at", "yyyy-MM").alias("ref_month"), "n_refs", reason.alias("reason")).filter("reason is not null")
    return found.groupBy("ref_table", "ref_key", "ref_month", "reason").agg(F.sum("n_refs").alias("n_refs")).select("ref_table", "ref_key", "ref_month", "n_refs", "reason")


class OrphanLedger:
    """The counts of references and existence in a store, brought up to date by deltas."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    def apply(self, references: DataFrame | None = None, existence: DataFrame | None = None) -> None:
        """Append deltas, in one commit."""
        given = {"references": references, "existence": existence}
        self.store.commit(append={name: df for name, df in given.items() if df is not None})
        self.store.compacted("references", lambda d: merge_references(None, d))
        self.store.compacted("existence", lambda d: merge_existence(None, d))

    def state(self, name: str) -> DataFrame:
        held = self.store.read(name)
        return held if held is not None else self.spark.createDataFrame([], {"references": REFERENCES, "existence": EXISTENCE}[name])

    def orphans(self) -> DataFrame:
        """The current report."""
        return orphans(self.state("references"), self.state("existence"))


def squeezed(text: Column) -> Column:
    """Text without white space and case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def _snippet_key(document: str, needle: str) -> Column:
    return F.concat_ws(":", document, F.sha2(needle, 256))


def snippet_deltas(spans: DataFrame, documents: DataFrame, ref_key: str = "span_id", at: str = "created_at", sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """Signed references of the snippets of SPANS, neither null nor empty, to their document's text, and the signed existence of those that
    the text of DOCUMENTS holds. A span without a document is an orphan, no reference to a text.

    Texts are normalised once per document, before the join; a document with very many spans is split by AQE's skew join, whose
    split side holds only spans."""
    s = spans.filter("document_id is not null and snippet <> ''").groupBy("document_id", F.col(ref_key).cast("string").alias("ref_key"), squeezed(F.col("snippet")).alias("_needle"), _ntz(F.col(at)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    d = documents.filter("document_id is not null").select("document_id", squeezed(F.coalesce("text", F.lit(""))).alias("_hay"))
    told = s.join(d, "document_id").select("ref_key", "at", "n", _snippet_key("document_id", "_needle").alias("target_key"), F.col("_hay").contains(F.col("_needle")).alias("_held"))
    references = told.groupBy("target_key", "ref_key", "at").agg((F.max("n") * sign).alias("n_refs"))
    existence = told.filter("_held").select("target_key").distinct()
    return (
        references.select(F.lit("relevant_spans").alias("ref_table"), F.lit(SNIPPETS).alias("target_table"), "target_key", "ref_key", "at", "n_refs"),
        existence.select(F.lit(SNIPPETS).alias("target_table"), "target_key", F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(sign).cast("bigint").alias("n_live")),
    )


def stale_snippets(spans: DataFrame, documents: DataFrame, ref_key: str = "span_id", at: str = "created_at") -> DataFrame:
    """(ref_table, ref_key, ref_month, n_refs, reason) of spans whose snippet is in no text of their document."""
    return orphans(*snippet_deltas(spans, documents, ref_key, at))
