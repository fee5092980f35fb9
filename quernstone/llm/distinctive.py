"""How distinctive a term is for a record: positive pointwise mutual information with smoothed term counts.

With n(t, d) the occurrences of term t in record d, n(d) those of all terms in d and Z all occurrences,
PPMI(t, d) = max(0, ln(n(t, d) / n(d) / p(t))), p(t) = n(t) ** a / sum of n(t') ** a. The exponent a < 1 raises the share of rare
terms, so a term that occurs once by chance scores less than one that recurs in the record: at 0.4, four occurrences of 32 in all
outrank the only occurrence of another term. Words are runs of letters or digits.

Defined cases: a null or empty text has no terms; a record in several equal rows counts once; equal scores are resolved by the
term's alphabetical order. A record asked for that the collection doesn't hold gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import bounded, cut

EXPONENT = 0.4
_BREAK = r"[^\p{L}\p{N}]+"


def _terms(records: DataFrame) -> DataFrame:
    words = F.split(F.lower("text"), _BREAK)
    return records.select("unit_id", F.explode(words).alias("term")).filter("term <> ''")


def term_scores(records: DataFrame, asked: DataFrame, exponent: float = EXPONENT) -> DataFrame:
    """(unit_id, term, n, score) of the records asked for, all of which count towards the collection.

    Counting the collection is one partially aggregated shuffle of terms; only the records asked for are ever kept apart by term.
    The join on the term has the collection's counts once per term on one side, so a term in every record skews only the other,
    which AQE splits."""
    records = records.select("unit_id", "text").filter("text is not null")
    wanted = bounded(asked.select("unit_id").filter("unit_id is not null").distinct())
    counts = cut(_terms(_once(records)).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "term-counts")
    z = counts.agg(F.sum(F.pow("n_term", F.lit(exponent))).alias("z")).first()["z"] or 1.0
    own = _terms(records.join(wanted, "unit_id", "left_semi").distinct()).groupBy("unit_id", "term").agg(F.count(F.lit(1)).alias("n"))
    lengths = own.groupBy("unit_id").agg(F.sum("n").alias("n_record"))
    scored = own.join(counts, "term").join(lengths, "unit_id")
    pmi = F.ln(F.col("n") / F.col("n_record") * z / F.pow("n_term", F.lit(exponent)))
    return scored.select("unit_id", "term", "n", F.round(F.greatest(F.lit(0.0), pmi), 9).alias("score"))


def _once(records: DataFrame) -> DataFrame:
    """Each record once; only the texts of repeated ids are compared, and shuffled."""
    again = bounded(records.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("unit_id"))
    return records.join(again, "unit_id", "left_anti").unionByName(records.join(again, "unit_id", "left_semi").distinct())


def best_terms(records: DataFrame, asked: DataFrame, exponent: float = EXPONENT) -> DataFrame:
    """(unit_id, term): the most distinctive term of each record asked for."""
    s = term_scores(records, asked, exponent)
    return s.groupBy("unit_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best")).select("unit_id", "best.term")
