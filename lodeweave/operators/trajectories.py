"""Trajectories of the agent loop: scores per question, whether a coverage threshold means anything, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluation

KEPT, ADMITTED = 0.80, 0.20
THRESHOLDS = [0.60, 0.70, 0.75, 0.80, 0.85]


def threshold_rates(best: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, n_matched, n_null, matched_kept, null_admitted, usable) from (qid, facet, plan, sim).

    ``sim`` is a facet's best similarity to a plan's sub-questions; a pair is matched if the plan is the
    facet's own question's, else null. A threshold is usable if it keeps most matched pairs and admits
    few others. Two partial aggregates per threshold; without pairs of both kinds the rates are null.
    """
    own = F.col("plan") == F.col("qid")
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(own & (F.col("sim") >= t)).alias("kept"), F.count_if(~own & (F.col("sim") >= t)).alias("admitted")) for t in thresholds or THRESHOLDS]
    per = best.agg(F.count_if(own).alias("n_matched"), F.count_if(~own).alias("n_null"), F.array(*counts).alias("x")).select("n_matched", "n_null", F.explode("x").alias("y"))
    both = (F.col("n_matched") > 0) & (F.col("n_null") > 0)
    share = lambda part, whole: F.when(both, F.round(F.col(part) / F.col(whole), 6))
    out = per.select("y.threshold", "n_matched", "n_null", share("y.kept", "n_matched").alias("matched_kept"), share("y.admitted", "n_null").alias("null_admitted"))
    return out.withColumn("usable", (F.col("matched_kept") >= KEPT) & (F.col("null_admitted") <= ADMITTED))


def absolute_coverage_is_valid(best: DataFrame, thresholds: list[float] | None = None) -> bool | None:
    """If some threshold separates own plans from others; None if there is nothing to compare."""
    return threshold_rates(best, thresholds).agg(F.bool_or("usable")).first()[0]


def scores(trajectories: DataFrame, gold: DataFrame, sims: DataFrame, threshold: float = 0.60) -> DataFrame:
    """One row of measures per question.

    ``trajectories`` has qid, papers_before, papers_after (bare ids), used, planner_failed and
    critique_ran; ``gold`` qid, query_type and must_cite; ``sims`` qid, facet, plan and sim, a row per
    facet and sub-question. What does not apply is null: no facets, no rivals, nothing required.
    """
    cover = evaluation.coverage(sims.filter("plan = qid"), [threshold]).select("qid", F.col("coverage").alias("decomposition_coverage"))
    specific = evaluation.specificity(sims).select("qid", F.col("n").alias("facets_total"), F.col("specificity").alias("decomposition_specificity"))
    need = F.array_distinct(F.transform("must_cite", T.bare_paper))
    t = gold.select("qid", "query_type", need.alias("need")).join(trajectories, "qid").join(cover, "qid", "left").join(specific, "qid", "left")
    added = F.array_except("papers_after", "papers_before")
    found = F.size(F.array_intersect("need", "papers_after"))
    return t.select(
        "qid", "query_type", "decomposition_coverage", "decomposition_specificity", F.coalesce("facets_total", F.lit(0)).alias("facets_total"),
        F.when(F.size("need") > 0, F.round(found / F.nullif("used", F.lit(0)), 6)).alias("retrieval_efficiency"), found.cast("bigint").alias("required_found"), F.size("need").cast("bigint").alias("required_total"),
        F.col("used").alias("retrievals_used"), F.size(F.array_intersect(added, "need")).cast("bigint").alias("critique_added_required"), F.size(added).cast("bigint").alias("critique_added_any"), "critique_ran", "planner_failed",
    )


def summary(scored: DataFrame) -> DataFrame:
    """Means overall (query_type null) and per type, with how many questions each mean stands on."""
    names = ["decomposition_coverage", "decomposition_specificity", "retrieval_efficiency"]
    means = [e for m in names for e in (F.round(F.avg(m), 6).alias(m), F.count(m).alias(f"n_{m}"))]
    more = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("planner_failed")).alias("planner_failed"), F.count_if(F.col("critique_added_required") > 0).alias("critique_useful"), F.sum("retrievals_used").alias("retrievals_used")]
    return scored.groupingSets([["query_type"], []], "query_type").agg(*means, *more)
