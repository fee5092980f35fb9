"""Scoring retrieval against spans of gold, judges of answers, golden sets made from the corpus, and comparisons of arms."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quernstone.functions import text as T
from quernstone.session import bounded, cumulated, cut


def graded(hits: DataFrame, gold: DataFrame, policy: str = "span_overlap", least: float = 0.5) -> DataFrame:
    """hits (query_id, rank, document_id, span_start, span_end, ...) with `grade`, the greatest weight of a gold span each satisfies, or 0:
    an equi-join on question and document, then the span condition."""
    g = gold.select("query_id", "document_id", F.col("span_start").alias("_gs"), F.col("span_end").alias("_ge"), "weight").distinct()
    inside = (F.col("span_start") <= F.col("_gs")) & (F.col("span_end") >= F.col("_ge"))
    shared = F.greatest(F.lit(0), F.least("span_end", "_ge") - F.greatest("span_start", "_gs"))
    holds = {"span_overlap": F.when(F.col("_ge") == F.col("_gs"), inside).otherwise(shared / F.nullif(F.col("_ge") - F.col("_gs"), F.lit(0)) >= least), "span_containment": inside, "unit_id": (F.col("span_start") == F.col("_gs")) & (F.col("span_end") == F.col("_ge"))}[policy]
    best = hits.join(g, ["query_id", "document_id"]).filter(holds).groupBy("query_id", "rank").agg(F.max("weight").alias("_w"))
    return hits.join(best, ["query_id", "rank"], "left").withColumn("grade", F.coalesce("_w", F.lit(0))).drop("_w")


def _dcg(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def scores(queries: DataFrame, hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 20), failure_k: int = 20) -> DataFrame:
    """Per question: precision_K, recall_K, ndcg_K, reciprocal_rank and failed. HITS are graded. A question without gold has null recall
    and ndcg; one without hits scores zero and failed. Recall counts hits, at most as many as there are gold spans."""
    g = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.sort_array(F.collect_list("weight"), asc=False).alias("_ideal"))
    aggs = [F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("_first")]
    for k in ks:
        top = F.col("rank") <= k
        aggs += [F.sum(F.when(top & (F.col("grade") > 0), 1).otherwise(0)).alias(f"_n{k}"), F.sum(F.when(top, _dcg(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"_d{k}")]
    aggs.append(F.max(F.when((F.col("rank") <= failure_k) & (F.col("grade") > 0), 1).otherwise(0)).alias("_ok"))
    h = hits.groupBy("query_id").agg(*aggs)
    j = queries.join(g, "query_id", "left").join(h, "query_id", "left")
    out = {}
    for k in ks:
        ideal = F.aggregate(F.transform(F.slice("_ideal", 1, k), lambda w, i: _dcg(w, i + 1)), F.lit(0.0), lambda a, x: a + x)
        out[f"precision_{k}"] = F.round(F.coalesce(f"_n{k}", F.lit(0)) / k, 9)
        out[f"recall_{k}"] = F.round(F.least(F.coalesce(f"_n{k}", F.lit(0)), F.col("n_gold")) / F.col("n_gold"), 9)
        out[f"ndcg_{k}"] = F.when(ideal > 0, F.round(F.coalesce(f"_d{k}", F.lit(0.0)) / ideal, 9))
    out["reciprocal_rank"] = F.coalesce(F.round(1 / F.col("_first"), 9), F.lit(0.0))
    out["failed"] = F.coalesce(F.col("_ok"), F.lit(0)) == 0
    return j.withColumns(out).select(*queries.columns, *out)


def percentiles(rows: DataFrame, by: list[str], value: str, ps: tuple[float, ...] = (50, 95)) -> DataFrame:
    """(*BY, p, value): percentiles P (0 to 100) of each group by the exclusive method; at the ends the extremes are extended, one value is
    itself, nulls don't count. Values are counted first and ordered in ranges, so a group may be of any size."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    c = cumulated(counts, by, "_v")
    n, wanted = F.col("_total"), []
    for p in ps:
        at = F.lit(p / 100.0) * (n + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(at), n - 1)).cast("bigint")
        share = F.when(n > 1, at - j).otherwise(0.0)
        wanted += [F.struct(F.lit(p).alias("p"), j.alias("_at"), (1 - share).alias("_w")), F.struct(F.lit(p).alias("p"), F.least(j + 1, n).alias("_at"), share.alias("_w"))]
    wants = bounded(counts.groupBy(*by).agg(F.sum("n").alias("_total")).select(*[F.col(b).alias(f"_by_{b}") for b in by], F.explode(F.array(*wanted)).alias("_x")).select(*[f"_by_{b}" for b in by], "_x.*"))
    match = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by])
    hit = c.join(wants, match & (F.col("_at") <= F.col("upto")) & (F.col("_at") > F.col("upto") - F.col("n")))
    return hit.groupBy(*by, "p").agg(F.sum(F.col("_v") * F.col("_w")).alias("value"))


def aggregated(scored: DataFrame, *by: str) -> DataFrame:
    """Means over what is defined, the share of failures and, where there is one, latency percentiles, per arm or kind."""
    metrics = [c for c in scored.columns if c.startswith(("precision_", "recall_", "ndcg_")) or c == "reciprocal_rank"]
    aggs = [F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in metrics], F.round(F.avg(F.col("failed").cast("int")), 6).alias("failure_rate")]
    for name in ("correct", "route_correct"):
        if name in scored.columns:
            aggs.append(F.round(F.avg(F.col(name).cast("int")), 6).alias({"correct": "correctness"}.get(name, name)))
    out = scored.groupBy(*by).agg(*aggs)
    if "latency_ms" not in scored.columns:
        return out
    p = percentiles(scored, list(by), "latency_ms").groupBy(*by).agg(*[F.round(F.max(F.when(F.col("p") == q, F.col("value"))), 6).alias(f"p{q}_ms") for q in (50, 95)])
    return out.join(p, reduce(Column.__and__, [out[b].eqNullSafe(p[b]) for b in by]), "left").select(*[out[c] for c in out.columns], "p50_ms", "p95_ms")


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient as an aggregate over rows where both are there: null for no row, NaN if one of them has the same value in all
    rows. F.corr divides by zero there, which is an error in ANSI mode."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    same = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) > 0, F.when(same, F.lit(float("nan"))).otherwise(F.coalesce(r, F.lit(float("nan")))))


def with_records(scored: DataFrame, answered: DataFrame) -> DataFrame:
    """Scores in which a question that took the structured path is judged by its records: span metrics are null, and it failed if it got none.
    ANSWERED is (query_id, path, n_records)."""
    j = scored.join(answered, "query_id", "left")
    structured = F.coalesce(F.col("path") == "structured", F.lit(False))
    spans = [c for c in scored.columns if c.startswith(("precision_", "recall_", "ndcg_"))]
    return j.withColumns({**{c: F.when(~structured, F.col(c)) for c in spans}, "failed": F.when(structured, F.coalesce("n_records", F.lit(0)) == 0).otherwise(F.col("failed"))}).drop("n_records")


def expected_path(query_type: Column) -> Column:
    return F.when(query_type.isin("structured", "numeric", "temporal"), "structured").when(query_type.isin("multi_hop", "comparative"), "iterative")


def judged_containment(gold: Column, answer: Column, least: float = 0.6) -> Column:
    """Whether an answer holds enough of the gold passage's terms of four letters and more; null if there are none."""
    want = F.array_distinct(F.filter(T.tokens(T.quick_fold(gold)), lambda t: F.length(t) > 3))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, T.tokens(T.quick_fold(answer)))) / F.size(want) >= least)


def judged_exact(expected: Column, kind: Column, answer: Column, tolerance: float = 1e-6) -> Column:
    """Whether an answer holds what was expected, by its kind: a number within the tolerance, a date, yes or no, or the text in any case.
    Null if nothing was expected."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"(-?\d[\d,_]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, "[,_]", "").try_cast("double"))
    want = F.regexp_replace(expected, "[,_]", "").try_cast("double")
    near = F.exists(numbers, lambda x: F.abs(x - want) <= F.greatest(F.lit(tolerance), F.abs(want) * 1e-9))
    dates = F.transform(F.regexp_extract_all(answer, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda x: x.try_cast("date"))
    day = F.array_contains(dates, F.substring(expected, 1, 10).try_cast("date"))
    yes = lambda c: F.lower(T.stripped(c)).isin("true", "yes", "1", "y")
    return F.when(expected.isNull(), None).when(kind == "number", F.coalesce(near, F.lit(False))).when(kind == "date", F.coalesce(day, F.lit(False))).when(kind == "boolean", yes(expected) == yes(answer)).otherwise(T.quick_fold(answer).contains(T.quick_fold(expected)))


def answers(hits: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, answer): the first texts of each list, joined."""
    return hits.filter(F.col("rank") <= n).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("answer"))


def distinctive_terms(units: DataFrame, n: int = 3) -> DataFrame:
    """(unit_id, terms): a unit's content words, those its document's other units lack counting double, equal scores in alphabetical order."""
    folded = T.quick_fold(F.col("text"))
    here = units.select("document_id", "unit_id", F.explode(T.content_words(folded)).alias("term")).groupBy("document_id", "unit_id", "term").agg(F.count(F.lit(1)).alias("n"))
    spread = units.select("document_id", "unit_id", F.explode(F.array_distinct(T.tokens(folded))).alias("term")).groupBy("document_id", "term").agg(F.count_distinct("unit_id").alias("in_units"))
    own = units.select("document_id", "unit_id", F.explode(F.array_distinct(T.tokens(folded))).alias("term")).withColumn("_own", F.lit(1)).distinct()
    s = here.join(spread, ["document_id", "term"], "left").join(own, ["document_id", "unit_id", "term"], "left")
    others = F.coalesce("in_units", F.lit(0)) - F.coalesce("_own", F.lit(0))
    s = s.withColumn("score", F.col("n") * F.when(others > 0, 1.0).otherwise(2.0))
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= n)
    return ranked.groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def bootstrap(units: DataFrame, subjects: DataFrame, search=None, want: int = 200, per_document: int = 4, chars: tuple[int, int] = (220, 4000), detail: int = 3, seed: int = 20260917, easy_rank: int = 1, hard_rank: int = 50) -> DataFrame:
    """Golden questions (query_id, query, unit_id, document_id, span_start, span_end, snippet, lexical_overlap) from units: the document's
    subject and the unit's distinctive terms, in an order fixed by SEED. SEARCH, if given, screens candidates, slice by slice in that order until
    there are enough: what the baseline finds at once, or not among HARD_RANK, is left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("document_id"))
    u = units.withColumn("_n", n).filter(F.length("text").between(*chars) & (F.col("_n") > 1)).join(subjects, "document_id", "left").join(distinctive_terms(units, detail), "unit_id").filter(F.size("terms") >= 2)
    u = u.withColumn("query", F.array_join(F.array_distinct(F.filter(F.concat(F.array(F.coalesce("subject", F.lit(""))), "terms"), lambda x: x != "")), " ")).withColumn("_o", F.xxhash64("unit_id", F.lit(seed)))
    best = lambda x: x.withColumn("_k", F.row_number().over(Window.partitionBy("document_id").orderBy("_o", "unit_id"))).filter(F.col("_k") <= per_document)
    if search is None:
        u = best(u).orderBy("_o", "unit_id").limit(want)
    else:
        u = cut(u, "bootstrap-candidates")
        slices = max(1, u.count() // (want * 10))
        edges = [-(2**63) + k * 2**64 // slices for k in range(slices)]
        passed = None
        for lo, hi in zip(edges, [*edges[1:], 2**63 - 1], strict=True):  # in the order of the sample, so what passes first stays first
            part = u.filter((F.col("_o") >= lo) & ((F.col("_o") < hi) if hi < 2**63 - 1 else F.lit(True)))
            found = search(part.select(F.col("unit_id").alias("query_id"), "query"), hard_rank).filter("query_id = unit_id").select(F.col("query_id").alias("unit_id"), F.col("rank").alias("_r"))
            new = cut(part.join(found, "unit_id").filter(F.col("_r") > easy_rank), "bootstrap-passed")
            passed = new if passed is None else passed.unionByName(new)
            if best(passed).limit(want).count() >= want:
                break
        u = best(passed).orderBy("_o", "unit_id").limit(want)
    return u.select(F.concat(F.lit("q"), F.substring("unit_id", 1, 8)).alias("query_id"), "query", "unit_id", "document_id", "span_start", "span_end", F.substring("text", 1, 160).alias("snippet"), F.round(T.overlap(T.quick_fold(F.col("query")), T.quick_fold(F.col("text"))), 9).alias("lexical_overlap"))


def golden_overlap(golden: DataFrame, passages: DataFrame) -> DataFrame:
    """GOLDEN with `lexical_overlap`: the recorded value, else the share of the question's terms in its passage (query_id, snippet)."""
    g = golden if "lexical_overlap" in golden.columns else golden.withColumn("lexical_overlap", F.lit(None).cast("double"))
    p = passages.groupBy("query_id").agg(F.max("snippet").alias("_p"))
    measured = F.round(T.overlap(T.quick_fold(F.col("query")), T.quick_fold(F.col("_p"))), 9)
    return g.join(p, "query_id", "left").withColumn("lexical_overlap", F.coalesce("lexical_overlap", measured)).drop("_p")


def model_bootstrap(units: DataFrame, ask, most_overlap: float = 0.6, least_terms: int = 2) -> DataFrame:
    """(query_id, query, unit_id, document_id, span_start, span_end, lexical_overlap): questions by a model. ASK maps a batch of texts to a question
    each, or None, and is called once per Arrow batch; no model comes with the package. A question that says little, or is too near to its
    passage's words, is left out."""
    @F.pandas_udf("string")
    def asked(texts: pd.Series) -> pd.Series:
        return pd.Series(ask(texts.tolist()), dtype="object")

    q = units.withColumn("query", asked(F.col("text"))).filter(F.trim("query") != "")
    q = q.withColumns({"lexical_overlap": F.round(T.overlap(T.quick_fold(F.col("query")), T.quick_fold(F.col("text"))), 9), "_n": F.size(T.query_terms(T.quick_fold(F.col("query"))))})
    q = q.filter((F.col("_n") >= least_terms) & (F.col("lexical_overlap") <= most_overlap))
    return q.select(F.concat(F.lit("m"), F.substring("unit_id", 1, 8)).alias("query_id"), "query", "unit_id", "document_id", "span_start", "span_end", "lexical_overlap")


def interior(values: DataFrame, field: str) -> DataFrame:
    """(field, threshold): distinct values of a field away from its ends, by rank: from a sixth of them to the last sixth."""
    v = values.select(F.col(field).alias("threshold")).filter("threshold is not null").distinct().withColumn("n", F.lit(1).cast("bigint"))
    c = cumulated(v, [], "threshold")
    n = c.count()
    k = F.col("upto") - 1
    return c.filter((k >= max(n // 6, 1)) & (k < min(n - n // 6, n - 1))).select(F.lit(field).alias("field"), "threshold")


def subject_of(name: Column) -> Column:
    """A document's subject from its package's or file's name: without the extension, with spaces for dashes, underscores and slashes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.(md|rst|txt)$", ""), r"[_\-/]+", " "))


def field_questions(records: DataFrame, per_field: int = 8, seed: int = 20260917, key: str = "unit_id") -> DataFrame:
    """(query_id, query, query_type, answer, answer_type, field): questions that typed fields answer, each with rows by construction: numbers
    greater than, and dates before, values from the interior of the range; the most frequent texts; and how many texts there are. PER_FIELD of a
    kind and field, thresholds in an order fixed by SEED. A question is there once."""
    out = None
    for f in sorted(records.schema.fields, key=lambda f: f.name):
        if f.name in (key, "document_id", "source_uri"):
            continue
        pretty, kind = f.name.replace("_", " "), f.dataType
        if isinstance(kind, T_.NumericType | T_.DateType):
            dated = isinstance(kind, T_.DateType)
            picks = interior(records, f.name).orderBy(F.xxhash64(F.col("threshold").cast("string"), F.lit(seed)), "threshold").limit(per_field)
            q = picks.select(F.concat(F.lit(f"which entries have {pretty} {'before' if dated else 'greater than'} "), F.col("threshold").cast("string")).alias("query"), F.lit("temporal" if dated else "numeric").alias("query_type"), F.lit(None).cast("string").alias("answer"))
        elif isinstance(kind, T_.StringType):
            common = records.filter(F.col(f.name).isNotNull()).groupBy(F.col(f.name).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(per_field)
            q = common.select(F.concat(F.lit(f"which entries have {pretty} "), "v").alias("query"), F.lit("structured").alias("query_type"), F.col("v").alias("answer"))
            q = q.unionByName(common.limit(1).select(F.lit(f"how many distinct {pretty} values are recorded").alias("query"), F.lit("structured").alias("query_type"), F.lit(None).cast("string").alias("answer")))
        else:
            continue
        q = q.withColumns({"answer_type": F.lit("text"), "field": F.lit(f.name)})
        out = q if out is None else out.unionByName(q)
    if out is None:
        return records.sparkSession.createDataFrame([], "query_id string, query string, query_type string, answer string, answer_type string, field string")
    return out.dropDuplicates(["query"]).select(F.concat(F.lit("s"), F.substring(F.sha2("query", 256), 1, 12), F.lit("-"), F.substring("field", 1, 10)).alias("query_id"), "query", "query_type", "answer", "answer_type", "field")


def delta_table(reports: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """reports (arm, metric columns) with each metric's difference to the baseline arm's."""
    base = reports.filter(F.col("arm") == baseline).select(*[F.col(m).alias(f"_b_{m}") for m in metrics])
    j = reports.join(F.broadcast(base.limit(1)), F.lit(True), "left")
    return j.select("arm", *[c for m in metrics for c in (F.col(m), F.round(F.col(m) - F.col(f"_b_{m}"), 6).alias(f"d_{m}"))])


def verdicts(reports: DataFrame, checks: DataFrame) -> DataFrame:
    """checks (name, baseline_arm, treatment_arm, metric, expected_reduction, tolerance) with the observed change and whether it passed;
    REPORTS are (arm, metric, value). An arm that is missing, or a baseline of zero, doesn't pass."""
    r = reports.select("arm", "metric", "value")
    j = checks.join(r.select(F.col("arm").alias("baseline_arm"), "metric", F.col("value").alias("baseline_value")), ["baseline_arm", "metric"], "left")
    j = j.join(r.select(F.col("arm").alias("treatment_arm"), "metric", F.col("value").alias("treatment_value")), ["treatment_arm", "metric"], "left")
    j = j.withColumn("observed", (F.col("treatment_value") - F.col("baseline_value")) / F.nullif(F.col("baseline_value"), F.lit(0.0)))
    e, t = F.col("expected_reduction"), F.col("tolerance")
    passed = F.coalesce(F.col("observed").between(-e * (1 + t), -e * (1 - t)), F.lit(False))
    why = F.when(F.col("observed").isNull(), "metric missing in an arm").when(F.col("baseline_value") < 0.02, "no headroom in the baseline").when(passed, "as expected").when(F.col("observed") > 0, "worse than the baseline").when(F.abs("observed") < e * (1 - t), "smaller than expected").otherwise("larger than expected")
    return j.withColumns({"passed": passed, "diagnosis": why, "observed": F.round("observed", 9)})


def merged_golden(*sets: DataFrame) -> DataFrame:
    """One set of questions: of equal ids the most verified, among these the first set's, by id."""
    rank = lambda c: F.when(c == "human", 3).when(c.isin("verified", "bootstrap_verified"), 2).when(c == "log", 1).otherwise(0)
    every = None
    for k, s in enumerate(sets):
        s = s.withColumn("_set", F.lit(k))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy(rank(F.col("origin")).desc(), "_set")
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_set")


def golden_stats(golden: DataFrame) -> DataFrame:
    """(query_type, n, n_verified) of a golden set."""
    return golden.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("origin").isin("human", "verified", "bootstrap_verified"), 1).otherwise(0)).alias("n_verified"))
