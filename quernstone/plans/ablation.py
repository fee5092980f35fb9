"""Arms of one configuration, each asked the same golden questions, and their differences to a baseline arm."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import config as C
from quernstone.functions import ids
from quernstone.operators import evaluation
from quernstone.plans.assemble import assemble
from quernstone.session import cut

METRICS = ["precision_5", "recall_20", "ndcg_10", "reciprocal_rank", "failure_rate"]


@dataclass
class AblationRunner:
    """Runs arms, which are changes to a configuration. Arms that differ only in how they ask share one store; a build-time change gets its
    own, below WORK. An arm that fails is reported with its error and doesn't end the others."""

    spark: SparkSession
    config: Mapping[str, Any]
    work: str
    errors: dict[str, str] = field(default_factory=dict)

    def scored(self, arm: str, changes: Mapping[str, Any], questions: DataFrame, gold: DataFrame) -> DataFrame:
        """One row per question: its path, metrics, latency, and whether the path and the answer are right. QUESTIONS are (query_id, query,
        query_type, answer, answer_type); latency is the batch's, shared equally."""
        held = C.overridden(self.config, changes)
        store = f"{self.work}/{ids.config_hash({k: held.get(k) for k in ('corpus', 'ingestion')})[7:31]}"
        made = assemble(self.spark, {**held, "paths": {**held.get("paths", {}), "store": store}})
        made.build(arm)
        asked = questions.select("query_id", "query", "query_type")
        began = time.time()
        found = cut(made.query(asked.select("query_id", "query")), "ablation-hits")
        elapsed = (time.time() - began) * 1000
        hits = evaluation.graded(found.select("query_id", "rank", "document_id", "span_start", "span_end"), gold)
        s = evaluation.scores(asked.select("query_id", "query_type"), hits, gold)
        s = evaluation.with_records(s, found.groupBy("query_id", "path").agg(F.count(F.lit(1)).alias("n_records")))
        wanted = evaluation.expected_path(F.col("query_type"))
        answer = evaluation.answers(found)
        j = s.join(questions.select("query_id", F.col("answer").alias("_gold"), "answer_type"), "query_id", "left").join(answer, "query_id", "left")
        right = evaluation.judged_exact(F.col("_gold"), F.col("answer_type"), F.coalesce("answer", F.lit("")))
        return j.withColumns({"arm": F.lit(arm), "route_correct": F.when(wanted.isNotNull(), F.coalesce(F.col("path") == wanted, F.lit(False))), "correct": right, "latency_ms": F.lit(elapsed / max(1, asked.count()))}).drop("_gold", "answer_type", "answer")

    def run(self, arms: Mapping[str, Mapping[str, Any]], questions: DataFrame, gold: DataFrame) -> DataFrame:
        """The scores of all arms that ran, as a written table."""
        out = None
        for arm, changes in arms.items():
            try:
                s = cut(self.scored(arm, changes, questions, gold), "ablation")
            except Exception as e:
                self.errors[arm] = f"{type(e).__name__}: {str(e)[:300]}"
                continue
            out = s if out is None else out.unionByName(s)
        if out is None:
            raise RuntimeError(f"no arm ran: {self.errors}")
        return out

    def report(self, scored: DataFrame, baseline: str, metrics: list[str] | None = None) -> DataFrame:
        """Each arm's metrics, and their differences to the baseline's."""
        return evaluation.delta_table(evaluation.aggregated(scored, "arm"), baseline, metrics or METRICS)
