"""BM25 for whole batches of questions in one job.

An index is a forward table (unit_id, tokens), postings (term, unit_id, tf, len), terms (term, df) and its statistics. Scores use global
statistics; filters only drop candidates. A question's terms count once each. Scores are rounded to nine places before ranking, ties go
by unit_id.

Search reads the forward table once per pass and never shuffles it: the questions' terms are sent to the executors, in passes of a fixed number;
each makes postings of its units in blocks and keeps the K best per question. A question's terms are taken in order of their greatest weights
in the block: the units of the first one are scored, then those of the second that lack the first, and so on, as long as the greatest weights
of the terms that are left add up to the K-th best score so far; a unit is dropped as soon as it can't reach that. So all units are considered,
and those left out can't be among the K best.
What is shuffled is about K rows per question and task. Joining questions to postings instead makes a row per question and unit for
every frequent term, which is nearly all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import quick_fold, tokens
from quernstone.session import cut, passes

K1, B = 1.2, 0.75
#: Terms of all questions together that one pass takes; more are searched in several.
MOST_TERMS = 2_000_000
#: Units of which a task holds the postings at once.
_UNITS = 65_536
#: More than rounding to nine places and another order of summing can change.
_SLACK = 1e-8
_NONE, _NO_UNITS = np.empty(0), np.empty(0, np.int64)
#: Terms of a block that have their weights as a row of all units, the most frequent ones.
_ROWS = 256


@dataclass
class LexicalIndex:
    forward: DataFrame
    terms: DataFrame
    n_units: int
    mean_length: float

    @property
    def postings(self) -> DataFrame:
        return _postings(self.forward)


def _forward(units: DataFrame, text: Column | None) -> DataFrame:
    return units.filter("unit_id is not null").select("unit_id", F.coalesce(tokens(quick_fold(F.col("text") if text is None else text)), F.array().cast("array<string>")).alias("tokens"))


def _postings(forward: DataFrame) -> DataFrame:
    t = forward.select("unit_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return t.groupBy("unit_id", "term", "len").agg(F.count(F.lit(1)).alias("tf")).select("term", "unit_id", "tf", "len")


def postings_of(units: DataFrame, text: Column | None = None) -> DataFrame:
    """(term, unit_id, tf, len) of units' surfaces; len counts all tokens."""
    return _postings(_forward(units, text))


def _indexed(forward: DataFrame) -> LexicalIndex:
    forward = cut(forward, "forward")
    distinct = forward.select(F.explode(F.array_distinct("tokens")).alias("term"))
    terms = cut(distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    s = forward.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("l")).first()
    return LexicalIndex(forward, terms, s["n"], (s["l"] or 0) / s["n"] if s["n"] else 0.0)


def build(units: DataFrame, text: Column | None = None) -> LexicalIndex:
    """Index of units, each of which must be there once. Statistics are derived, never maintained. A unit without tokens counts as one of
    length zero."""
    return _indexed(_forward(units, text))


def without_units(index: LexicalIndex, gone: DataFrame) -> LexicalIndex:
    """Index without the units of GONE; statistics follow."""
    return _indexed(index.forward.join(gone.select("unit_id"), "unit_id", "left_anti"))


def question_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term of a question once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(quick_fold(F.col("query"))))).alias("term")).distinct()


class _Questions:
    """Questions as runs of (term, idf), and the K best scores of each so far."""

    def __init__(self, rows: list, k: int, mean_length: float) -> None:
        rows = sorted((r["query_id"], r["term"], r["idf"]) for r in rows)
        self.ids = list(dict.fromkeys(q for q, _, _ in rows))
        at = {q: k for k, q in enumerate(self.ids)}
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for _, t, _ in rows))}
        self.owner = np.array([at[q] for q, _, _ in rows], np.int64)
        self.term = np.array([self.vocabulary[t] for _, t, _ in rows], np.int64)
        self.idf = np.array([i for *_, i in rows], np.float64)
        self.edges = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        self.k, self.mean_length = k, mean_length

    def weights(self, lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, place, weight) of the terms asked for in each unit of a batch."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        codes = pc.index_in(lists.flatten(), words).fill_null(-1).to_numpy()
        lengths = np.diff(offsets)
        asked = np.flatnonzero(codes >= 0)
        unit = np.repeat(np.arange(len(lengths)), lengths)[asked]
        pairs, tf = np.unique(codes[asked].astype(np.int64) * len(lengths) + unit, return_counts=True)
        unit = pairs % len(lengths)
        return pairs // len(lengths), unit, tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[unit] / self.mean_length))

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        words = pa.array(list(self.vocabulary))
        held, size = [], 0
        for b in (b.slice(a, _UNITS) for b in batches for a in range(0, b.num_rows, _UNITS)):
            if held and size + b.num_rows > _UNITS:
                yield _Block(held, len(self.vocabulary))
                held, size = [], 0
            held.append((b.column(0), *self.weights(b.column(1), words)))
            size += b.num_rows
        if held:
            yield _Block(held, len(self.vocabulary))

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(units, question, unit, score) per block: of each question at most K, among them all of the K best of the task that are in the block."""
        n = len(self.ids)
        top, least = [_NONE] * n, np.zeros(n)
        for block in self.blocks(batches):
            most = block.most[self.term] * self.idf
            order = np.lexsort((-most, self.owner))
            most = most[order]
            sums = np.cumsum(most)
            after = sums[self.edges[1:] - 1][self.owner] - sums
            found = []
            for q in np.flatnonzero(most[self.edges[:-1]] + after[self.edges[:-1]] + _SLACK >= least).tolist():
                a, z = self.edges[q], self.edges[q + 1]
                units = self._likely(block, self.term[order[a:z]].tolist(), self.idf[order[a:z]].tolist(), most[a:z].tolist(), after[a:z].tolist(), least[q])
                u, s = _k_best(units, block.scores(units, self.term[a:z].tolist(), self.idf[a:z].tolist()), least[q], self.k)
                if len(u):
                    found.append((q, u, s))
                    top[q] = np.sort(np.concatenate([top[q], s]))[-self.k :]
                    least[q] = top[q][0] if len(top[q]) == self.k else 0.0
            if found:
                sizes = [len(u) for _, u, _ in found]
                yield block.ids, np.repeat([q for q, _, _ in found], sizes), np.concatenate([u for _, u, _ in found]), np.concatenate([s for *_, s in found])

    def _likely(self, block: _Block, terms: list[int], idf: list[float], most: list[float], after: list[float], reached: float) -> np.ndarray:
        """Units that may be among a question's K best, each once. Its terms are in order of their greatest weights in the block, AFTER has the
        sum of those that follow. The J-th list brings the units whose first term is the J-th."""
        units, scores = _NO_UNITS, _NONE
        for j, t in enumerate(terms):
            if most[j] <= 0 or most[j] + after[j] + _SLACK < reached:
                break
            u, s = block.of(t)
            s = s * idf[j]
            for i in range(j + 1, len(terms)):
                if most[i] <= 0:
                    break
                if reached > 0:
                    keep = np.flatnonzero(s >= reached - after[i - 1] - _SLACK)
                    if len(keep) < len(u):
                        u, s = u[keep], s[keep]
                if not len(u):
                    break
                s = s + idf[i] * block.at(terms[i], u)
            keep = s + _SLACK >= reached
            for i in range(j):
                keep &= block.at(terms[i], u) == 0
            units, scores = np.concatenate([units, u[keep]]), np.concatenate([scores, s[keep]])
            if len(scores) >= self.k:
                reached = max(reached, np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
        return units


def _k_best(units: np.ndarray, scores: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The K best in order, those of a positive score of LEAST or more; equal ones by place, which is the order of unit_ids."""
    keep = np.flatnonzero((scores > 0) & (scores >= least))
    if len(keep) > 4 * k:
        keep = keep[scores[keep] >= np.partition(scores[keep], len(keep) - k)[len(keep) - k]]
    keep = keep[np.lexsort((units[keep], -scores[keep]))[:k]]
    return units[keep], scores[keep]


class _Block:
    """Postings of some units: of each term its units, as places in the order of their ids, and their weights."""

    def __init__(self, parts: list, n_terms: int) -> None:
        ids = pa.concat_arrays([p[0] for p in parts])
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.cumsum([0, *[len(p[0]) for p in parts]])
        term, unit = np.concatenate([p[1] for p in parts]), place[np.concatenate([p[2] + a for p, a in zip(parts, starts, strict=False)])]
        by = np.argsort(term * len(order) + unit)
        term = term[by]
        self.ids = ids.take(pa.array(order))
        self.unit, self.weight = unit[by], np.concatenate([p[3] for p in parts])[by]
        self.edges = np.searchsorted(term, np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        if len(term):
            firsts = np.flatnonzero(np.diff(term, prepend=-1))
            self.most[term[firsts]] = np.maximum.reduceat(self.weight, firsts)
        sizes = np.diff(self.edges)
        frequent = np.argsort(-sizes, kind="stable")[:_ROWS]
        frequent = frequent[sizes[frequent] * 64 > len(order)]
        self.row = np.full(n_terms, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(order)))
        for r, t in enumerate(frequent):
            u, w = self.of(t)
            self.rows[r, u] = w

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.edges[term], self.edges[term + 1]
        return self.unit[a:z], self.weight[a:z]

    def at(self, term: int, units: np.ndarray) -> np.ndarray:
        """A term's weights in some units."""
        if (row := self.row[term]) >= 0:
            return self.rows[row][units]
        u, w = self.of(term)
        if not len(u):
            return np.zeros(len(units))
        at = np.minimum(u.searchsorted(units), len(u) - 1)
        return np.where(u[at] == units, w[at], 0.0)

    def scores(self, units: np.ndarray, terms: list[int], idf: list[float]) -> np.ndarray:
        """Scores of units, summed in the order of the terms in every block."""
        s = np.zeros(len(units))
        for t, i in zip(terms, idf, strict=True):
            s += i * self.at(t, units)
        return np.round(s, 9)


def search(index: LexicalIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, unit_id, score): the K best units of each question; only those of ALLOWED (unit_id) if it is given. A question
    without a term of the index has none."""
    kind = queries.schema["query_id"].dataType.simpleString()
    unit_kind = index.forward.schema["unit_id"].dataType.simpleString()
    idf = F.log1p((F.lit(index.n_units) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = question_terms(queries).filter("query_id is not null").join(index.terms, "term").select("query_id", "term", idf.alias("idf"))
    n, blocks = passes(terms, "query_id", MOST_TERMS) if index.n_units else (0, iter(()))
    forward = index.forward if allowed is None else index.forward.join(allowed.select("unit_id").distinct(), "unit_id", "left_semi")
    if n > 1 and allowed is not None:
        forward = cut(forward, "forward-allowed")
    # each task goes through all questions, so there are no more tasks than run at once
    forward = forward.select("unit_id", "tokens").coalesce(max(1, queries.sparkSession.sparkContext.defaultParallelism))
    near = None
    for asked in blocks:
        if asked:
            shared = queries.sparkSession.sparkContext.broadcast(_Questions(asked, k, index.mean_length))
            found = forward.mapInArrow(_best(shared), f"query_id {kind}, unit_id {unit_kind}, score double")
            near = found if near is None else near.unionByName(found)
    if near is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, rank int, unit_id {unit_kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "unit_id", "score")


def _best(shared: Broadcast):
    """From batches of the forward table: (query_id, unit_id, score) of all that may be among the K best of a question of SHARED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = shared.value
        names = pa.array(questions.ids)
        for ids, q, u, s in questions.best(batches):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(u)), pa.array(s)], ["query_id", "unit_id", "score"])

    return run


def statistics(index: LexicalIndex) -> DataFrame:
    """(unit_count, vocabulary, mean_length) in one row."""
    return index.terms.agg(F.lit(index.n_units).cast("bigint").alias("unit_count"), F.count(F.lit(1)).alias("vocabulary"), F.lit(round(index.mean_length, 6)).alias("mean_length"))
