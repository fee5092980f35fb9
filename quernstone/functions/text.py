"""Text functions as Spark expressions, and the exact caseless form as an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: English words that carry no topic.
STOPWORDS = (
    "the a an and or of to in for on with is are be was were this that these those it its as at by from not no if then than but can could will would should may might must "
    "have has had do does did you your we our they their he she his her i me my us them use used using which what when where who how all any some each other more most such "
    "only own same so very s t just don now one two also into out up down over under again further once here there both few too new see set get make like time way"
).split()
_TOKEN = r"([\p{L}\p{N}_]+(?:[.\-][\p{L}\p{N}_]+)*)"
_WORD = r"([\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_.\-]{2,})"


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC, then case folding: the exact caseless form. Null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def quick_fold(text: Column) -> Column:
    """The caseless form without leaving the JVM: equal to fold() for composed text whose only special letter is ß."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(folded: Column) -> Column:
    """Runs of word characters, dotted and hyphenated ones whole, of a folded text."""
    return F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(1))


def words(folded: Column) -> Column:
    """Identifier-like words of three characters or more that don't begin with a digit."""
    return F.regexp_extract_all(folded, F.lit(_WORD), F.lit(1))


def topical(terms: Column, least: int = 3) -> Column:
    """Those of an array of words that are no stopwords, no numbers and at least LEAST long."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    return F.filter(terms, lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^\p{Nd}+$") & (F.length(w) >= least))


def content_words(folded: Column, least: int = 4) -> Column:
    return topical(words(folded), least)


def query_terms(folded: Column) -> Column:
    """Distinct terms of a question that say something: longer than two characters and no stopword."""
    return F.array_distinct(topical(tokens(folded), 3))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def estimated_tokens(text: Column) -> Column:
    """About four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def overlap(question: Column, passage: Column) -> Column:
    """Share of the question's terms that the passage holds; null if it has none. Both folded."""
    terms = query_terms(question)
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, tokens(passage))) / F.size(terms))


def sentences(text: Column) -> Column:
    """Text cut after . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])\s+")
