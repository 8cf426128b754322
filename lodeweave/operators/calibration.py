"""Agreement of graders: calibration of a judge per criterion, two passes of a person, length bias, p values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import evaluation

MIN_KAPPA, ALPHA = 0.6, 0.05
#: What a judge grades.
CRITERIA = ["coverage", "attribution", "hedging_accuracy", "refutation_handling", "synthesis"]


def grades(labels: DataFrame, criteria: list[str] = CRITERIA) -> DataFrame:
    """(qid, criterion, a, b) from labels (qid, a and b as maps criterion -> grade), where both graded."""
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col("a")[c].alias("a"), F.col("b")[c].alias("b")) for c in criteria])
    return labels.select("qid", F.explode(rows).alias("x")).select("qid", "x.*").filter("a is not null and b is not null")


def gradeable(labels: DataFrame, criteria: list[str] = CRITERIA) -> DataFrame:
    """(criterion, n): rows that both passes graded, 0 included."""
    counts = [F.struct(F.lit(c).alias("criterion"), F.count_if(F.col("a")[c].isNotNull() & F.col("b")[c].isNotNull()).alias("n")) for c in criteria]
    return labels.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("y")).select("y.*")


def calibrate(pairs: DataFrame, group: list[str], a: str, b: str, min_kappa: float = MIN_KAPPA) -> DataFrame:
    """(group, n, kappa, rho, p, trusted) per group; a rho that is not defined is 0 with p = 1.

    One row per group reaches the p value's function.
    """

    @F.udf("double")
    def p_value(rho: float | None, n: int) -> float:
        p = None if rho is None else stats.spearman_p(rho, n)
        return 1.0 if p is None else p

    kappa = evaluation.quadratic_kappa(pairs, group, a, b)
    rho = evaluation.spearman(pairs, group, a, b).drop("n")
    out = kappa.join(rho, group, "left").withColumn("p", p_value("rho", "n"))
    return out.select(*group, "n", "kappa", F.coalesce("rho", F.lit(0.0)).alias("rho"), "p", F.coalesce(F.col("kappa") >= min_kappa, F.lit(False)).alias("trusted"))


def agreement(labels: DataFrame, min_kappa: float = MIN_KAPPA, criteria: list[str] = CRITERIA) -> DataFrame:
    """Calibration of pass b on pass a per criterion; those with fewer than two pairs are left out."""
    return calibrate(grades(labels, criteria), ["criterion"], "a", "b", min_kappa).filter("n >= 2")


def length_bias(scores: DataFrame, group: str, length: str, score: str, alpha: float = ALPHA) -> DataFrame:
    """(group, slope per hundred characters, p, biased); no bias below three rows or where all lengths are equal."""

    @F.udf("double")
    def p_value(n: int, r2: float | None) -> float:
        return 0.0 if r2 is not None and r2 >= 1 else 1.0 if r2 is None or n < 3 else stats.t_two_sided((r2 * (n - 2) / (1 - r2)) ** 0.5, n - 2)

    x, y = F.col(length) / 100.0, F.col(score).cast("double")
    s = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_r2(y, x).alias("r2"), F.var_pop(x).alias("spread"))
    usable = (F.col("n") >= 3) & (F.col("spread") > 0)
    out = s.select(group, F.when(usable, F.round("s", 6)).otherwise(0.0).alias("slope"), F.when(usable, p_value("n", "r2")).otherwise(1.0).alias("p"))
    return out.withColumn("biased", (F.col("slope") > 0) & (F.col("p") < alpha))


def signed_rank_test(diffs: DataFrame, exact_up_to: int = 50) -> DataFrame:
    """(n, w_plus, p), one row: Wilcoxon's signed-rank test of ``diff``; zeros left out, p null under six pairs.

    Counts per magnitude decide everything: up to ``exact_up_to`` pairs they are few and the exact p is
    taken from them, beyond that the normal approximation with tie correction needs only their sums.
    """
    w = evaluation.signed_rank(diffs).first()
    kept = diffs.filter("diff <> 0")
    if w.n <= exact_up_to:
        p = stats.signed_rank_p([r.diff for r in kept.select("diff").limit(exact_up_to).collect()], exact_up_to)
    else:
        per = kept.groupBy(F.abs("diff").alias("m")).agg(F.count(F.lit(1)).alias("w"))
        ties = per.agg(F.sum(F.expr("double(w) * w * w - w")).alias("t")).first().t
        low, mean = min(w.w_plus, w.n * (w.n + 1) / 2 - w.w_plus), w.n * (w.n + 1) / 4
        p = stats.normal_two_sided((mean - low) / (w.n * (w.n + 1) * (2 * w.n + 1) / 24 - ties / 48) ** 0.5)
    return diffs.sparkSession.createDataFrame([(w.n, w.w_plus, p)], "n long, w_plus double, p double")


def report(criteria: DataFrame, bias: DataFrame) -> str:
    """The calibration as text: a row per criterion, what is biased by length, and what is not to be trusted."""
    rows = sorted(criteria.collect(), key=lambda r: r.criterion)
    out = ["Judge calibration:"]
    out += [f"  {'OK' if r.trusted else '!!'} {r.criterion:20s} kappa={'n/a' if r.kappa is None else format(r.kappa, '+.2f')} rho={r.rho:+.2f} (p={r.p:.3f}, n={r.n})" for r in rows]
    out += [f"  !! length bias on {b.criterion}: +{b.slope:.2f}/100chars (p={b.p:.3f})" for b in sorted(bias.filter("biased").collect(), key=lambda r: r.criterion)]
    bad = [r.criterion for r in rows if not r.trusted]
    return "\n".join([*out, f"  -> UNTRUSTED: {', '.join(bad)}" if bad else "  -> all criteria trusted"])
