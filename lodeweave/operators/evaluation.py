"""Evaluation: citation metrics, agreement, paired comparison, reproducibility, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def citation_metrics() -> dict[str, Column]:
    """Four metrics over columns cited, must_cite (array<string>), claims (array<struct<papers>>) and pairs (array<struct<a,b>>, arrays). Null means not applicable."""
    cited, must = F.array_distinct("cited"), F.array_distinct("must_cite")
    relevant = F.array_union(must, F.flatten(F.transform("claims", lambda c: c["papers"])))
    met = F.filter("claims", lambda c: (F.size(c["papers"]) == 0) | F.arrays_overlap(c["papers"], F.col("cited")))
    seen = F.filter("pairs", lambda p: F.arrays_overlap(p["a"], F.col("cited")) & F.arrays_overlap(p["b"], F.col("cited")))
    precision = F.when(F.size(relevant) == 0, None).when(F.size(cited) == 0, 1.0).otherwise(_share(F.size(F.array_intersect(cited, relevant)), F.size(cited)))
    return {
        "must_cite_recall": _share(F.size(F.array_intersect(must, cited)), F.size(must)),
        "citation_precision": precision,
        "key_claim_source_recall": _share(F.size(met), F.size("claims")),
        "refutation_surfaced": _share(F.size(seen), F.size("pairs")),
    }


def report(scores: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """(by, metric, mean, n): every metric overall (by null) and per group, each with its own n."""
    long = scores.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(by, "x.*")
    return long.groupingSets([[by, "metric"], ["metric"]], by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def quadratic_kappa(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Quadratic weighted kappa per group of ordinal columns a and b; null under two pairs or without spread."""
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group)
    # sum of w * observed = sum((a-b)^2); sum of w * expected = n * (var a + var b + (mean a - mean b)^2), all as populations
    stat = p.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).alias("o"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), (F.avg(a) - F.avg(b)).alias("dm"))
    expected = F.col("n") * (F.col("va") + F.col("vb") + F.col("dm") * F.col("dm"))
    return stat.select(*group, "n", F.when((F.col("n") >= 2) & (expected > 0), F.round(1 - F.col("o") / expected, 6)).alias("kappa"))


def spearman(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Spearman's rho per group, with average ranks for ties.

    Ranks come from counts per value, so what meets in a window is a row per distinct value.
    """
    kept = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, F.col(a).alias("_a"), F.col(b).alias("_b"))
    cells = kept.groupBy(*group, "_a", "_b").agg(F.count(F.lit(1)).alias("w"))
    for c, r in (("_a", "ra"), ("_b", "rb")):
        sizes = cells.groupBy(*group, c).agg(F.sum("w").alias("_w"))
        below = Window.partitionBy(*group).orderBy(c) if group else Window.orderBy(c)
        ranks = sizes.withColumn(r, F.sum("_w").over(below) - (F.col("_w") - 1) / 2.0).select(*group, F.col(c).alias("_k"), r)
        cond = F.col(c) == F.col("_k")
        for g in group:
            cond = cond & (cells[g] == ranks[g])
        joined = cells.join(ranks, cond)
        for g in group:
            joined = joined.drop(ranks[g])
        cells = joined.drop("_k")
    w = F.col("w")
    m = cells.groupBy(*group).agg(F.sum("w").alias("n"), F.sum(w * F.col("ra")).alias("sa"), F.sum(w * F.col("rb")).alias("sb"), F.sum(w * F.col("ra") * F.col("rb")).alias("sab"), F.sum(w * F.col("ra") * F.col("ra")).alias("saa"), F.sum(w * F.col("rb") * F.col("rb")).alias("sbb"))
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    va, vb = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    return m.select(*group, "n", F.when((va > 0) & (vb > 0), F.round(cov / F.sqrt(va * vb), 6)).alias("rho"))


def length_bias(scores: DataFrame, length: str, score: str, alpha: float = 0.05) -> DataFrame:
    """Slope of score on hundreds of characters, its p, and whether longer answers score higher."""
    x = (F.col(length) / 100.0).alias("x")
    s = scores.select(x, F.col(score).cast("double").alias("y")).agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))

    @F.udf("double")
    def p_value(n: int, slope: float | None, r2: float | None) -> float | None:
        if n is None or n < 3 or slope is None or r2 is None:
            return None
        if r2 >= 1:
            return 0.0
        return stats.t_two_sided((r2 * (n - 2) / (1 - r2)) ** 0.5, n - 2)

    out = s.withColumn("p", p_value("n", "slope", "r2"))
    return out.withColumn("biased", (F.col("slope") > 0) & (F.col("p") < alpha))


def per_query(scores: DataFrame, metric: str) -> DataFrame:
    """Mean over repeats per (arm, qid); nulls are left out."""
    return scores.filter(F.col(metric).isNotNull()).groupBy("arm", "qid").agg(F.avg(metric).alias("value"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid and diff for queries both arms have a value for."""
    return a.select("qid", F.col("value").alias("va")).join(b.select("qid", F.col("value").alias("vb")), "qid").select("qid", F.round(F.col("va") - F.col("vb"), 9).alias("diff"))


def paired_summary(diffs: DataFrame) -> DataFrame:
    d = F.col("diff")
    return diffs.agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.round(F.avg("diff"), 6).alias("mean_diff"))


def signed_rank(diffs: DataFrame) -> DataFrame:
    """W+ and n of the non-zero differences, ranks averaged over ties; ranks come from counts per magnitude."""
    kept = diffs.filter("diff <> 0").groupBy(F.abs("diff").alias("m")).agg(F.count(F.lit(1)).alias("w"), F.count_if(F.col("diff") > 0).alias("plus"))
    ranked = kept.withColumn("rank", F.sum("w").over(Window.orderBy("m")) - (F.col("w") - 1) / 2.0)
    return ranked.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("n"), F.round(F.coalesce(F.sum(F.col("plus") * F.col("rank")), F.lit(0.0)), 6).alias("w_plus"))


def consensus(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lower median of the samples per key."""
    return scores.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias(value))


def repro_outcome(gold: Column, system: Column) -> Column:
    """skipped, correct_absence, hallucinated, missed, correct or wrong."""
    silent = T.is_silent(system)
    return (
        F.when(gold.isNull(), "skipped")
        .when(gold == "not_reported", F.when(silent, "correct_absence").otherwise("hallucinated"))
        .when(silent, "missed")
        .when(T.plain_name(gold) == T.plain_name(system), "correct")
        .otherwise("wrong")
    )


def accuracy(outcomes: DataFrame, group: list[str], outcome: str = "outcome") -> DataFrame:
    right = F.count_if(F.col(outcome).isin("correct", "correct_absence"))
    return outcomes.groupBy(*group).agg(F.count_if(F.col(outcome) != "skipped").alias("scored"), _share(right, F.count_if(F.col(outcome) != "skipped")).alias("accuracy"))


def coverage(sims: DataFrame, thresholds: list[float]) -> DataFrame:
    """(qid, threshold, coverage): share of facets whose best similarity to a sub-question reaches the threshold.

    ``sims`` has qid, facet and sim, one row per facet and sub-question.
    """
    best = sims.groupBy("qid", "facet").agg(F.max("sim").alias("best"))
    at = best.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return at.groupBy("qid", "threshold").agg(F.round(F.avg((F.col("best") >= F.col("threshold")).cast("double")), 6).alias("coverage"))


def specificity(sims: DataFrame) -> DataFrame:
    """(qid, n, specificity): share of facets that their own plan meets better than every rival's.

    ``sims`` has qid, facet, plan and sim; a plan is a query's own when plan = qid.
    """
    own = F.col("plan") == F.col("qid")
    best = sims.groupBy("qid", "facet").agg(F.max(F.when(own, F.col("sim"))).alias("own"), F.max(F.when(~own, F.col("sim"))).alias("rival"))
    return best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("own") > F.col("rival")).cast("double")), 6).alias("specificity"))


def within_budget(steps: DataFrame, limit: int = 6) -> DataFrame:
    """Per query: retrievals used and refused, and which steps were within the budget."""
    by = Window.partitionBy("qid").orderBy("step")
    return steps.withColumn("nth", F.row_number().over(by)).withColumn("allowed", F.col("nth") <= limit)
