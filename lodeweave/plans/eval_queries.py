"""Queries on evaluation, statistics and sampling over the fixture tables, with their SQL twins.

Orders stand for questions: lines returned (R) are required citations, lines of even number are
cited ones; quarters of lines by return flag are claims and refutation pairs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import sampling
from ..functions import vectors as V
from .text_queries import table


def _gold(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_partkey").cast("string"))
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("p"))))
    o = li.groupBy(F.col("l_orderkey").alias("qid")).agg(
        pick(F.col("l_returnflag") == "R").alias("must_cite"), pick(F.col("l_linenumber") % 2 == 0).alias("cited"),
        pick(F.col("l_linestatus") == "O").alias("c1"), pick(F.col("l_returnflag") == "A").alias("c2"), pick(F.col("l_linenumber") == 1).alias("a"), pick(F.col("l_linenumber") == 2).alias("b"),
    )
    claims = F.filter(F.array(F.struct(F.col("c1").alias("papers")), F.struct(F.col("c2").alias("papers"))), lambda c: F.size(c["papers"]) != 1)
    pairs = F.filter(F.array(F.struct("a", "b")), lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0))
    return o.withColumns({"claims": claims, "pairs": pairs})


METRICS = ["must_cite_recall", "citation_precision", "key_claim_source_recall", "refutation_surfaced"]


def _scores(spark, d):
    return _gold(spark, d).withColumns(E.citation_metrics()).select("qid", *METRICS)


def metric_must_cite_recall(spark, d):
    return _scores(spark, d).select("qid", "must_cite_recall")


def metric_citation_precision(spark, d):
    return _scores(spark, d).select("qid", "citation_precision")


def metric_key_claim_recall(spark, d):
    return _scores(spark, d).select("qid", "key_claim_source_recall")


def metric_refutation_surfaced(spark, d):
    return _scores(spark, d).select("qid", "refutation_surfaced")


def metric_report_grouping_sets(spark, d):
    kinds = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query_type"))
    return E.report(_scores(spark, d).join(kinds, "qid"), METRICS, "query_type")


def _graded(spark, d):
    """Two 1-5 grades per labelled document: by label and by length."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    l = table(spark, d, "labels").join(docs, "doc_id")  # noqa: E741
    return l.select("doc_id", "lang", "n_chars", (1 + F.col("quality") * 3 - F.col("toxic") + F.col("doc_id") % 2).cast("int").alias("human"), F.least(F.lit(5), 1 + F.floor(F.col("n_chars") / 900)).cast("int").alias("judge"))


def confusion_matrix(spark, d):
    return _graded(spark, d).groupBy("human", "judge").agg(F.count(F.lit(1)).alias("n"))


def qwk_kappa(spark, d):
    return E.quadratic_kappa(_graded(spark, d), ["lang"], "human", "judge")


def spearman_rho(spark, d):
    return E.spearman(_graded(spark, d), ["lang"], "human", "n_chars")


def ols_length_bias(spark, d):
    out = E.length_bias(_graded(spark, d), "n_chars", "human")
    return out.select("n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


def length_bias_p(spark, d):
    return E.length_bias(_graded(spark, d), "n_chars", "human")


def edge_precision(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    model = F.when(F.col("doc_id") % 3 == 0, "refutes").when(F.col("doc_id") % 3 == 1, "undercuts").otherwise("neither")
    return l.withColumn("model", model).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("precision"))


def band_precision(spark, d):
    l = table(spark, d, "labels").withColumn("band", T.band_of(0.6 + F.col("doc_id") % 45 / 100.0)).withColumn("kind", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))  # noqa: E741
    return l.filter("band is not null").groupingSets([["band"], ["kind"], []], "band", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("precision"))


def confidence_informative(spark, d):
    b = band_precision(spark, d).filter("band is not null")
    return b.agg(F.count(F.lit(1)).alias("bands"), F.when(F.count(F.lit(1)) >= 2, F.max("precision") - F.min("precision") >= 0.1).alias("informative"))


def _runs(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("repeat"), F.col("o_custkey").alias("qid"), F.round(F.col("l_discount") * 100).alias("value"))


def run_means(spark, d):
    return _runs(spark, d).groupBy("arm", "repeat").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def _diffs(spark, d):
    p = E.per_query(_runs(spark, d), "value")
    return E.paired(p.filter("arm = 'O'"), p.filter("arm = 'F'"))


def paired_arms(spark, d):
    return E.paired_summary(_diffs(spark, d))


def wilcoxon_w(spark, d):
    return E.signed_rank(_diffs(spark, d))


def median_consensus_lower(spark, d):
    return E.consensus(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity")


def _repro(spark, d):
    p = table(spark, d, "part")
    gold = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "not_reported").otherwise(F.col("p_brand"))
    system = F.when(F.col("p_partkey") % 4 == 0, "N/A").when(F.col("p_partkey") % 4 == 1, F.lower("p_brand")).when(F.col("p_partkey") % 4 == 2, None).otherwise(F.col("p_type"))
    return p.select("p_partkey", "p_type", E.repro_outcome(gold, system).alias("outcome"))


def repro_score_case(spark, d):
    return _repro(spark, d).select("p_partkey", "outcome")


def repro_accuracy(spark, d):
    return E.accuracy(_repro(spark, d), ["p_type"])


def repro_crosstab(spark, d):
    kinds = ["correct", "wrong", "missed", "correct_absence", "hallucinated", "skipped"]
    return _repro(spark, d).groupBy("p_type").pivot("outcome", kinds).agg(F.count(F.lit(1))).na.fill(0)


def token_containment(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.token_contained(F.col("p_brand"), F.concat_ws(" ", "p_brand", "p_type")).alias("whole"), T.token_contained(F.substring("p_brand", 2, 20), F.col("p_name")).alias("cut"))


def _facets(spark, d):
    """Facets (odd ids) and sub-questions (even ids) of each label: all vectors."""
    v = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    return v.filter("vec_id % 2 <> 0"), v.filter("vec_id % 2 = 0")


def _own_sims(spark, d):
    """The best similarity of every facet to a sub-question of its own label; below all others where there is none."""
    from ..operators import retrieval

    f, s = _facets(spark, d)
    best = retrieval.nearest(f.withColumnRenamed("vec_id", "qid"), s.withColumnRenamed("vec_id", "id"), 1, within="label")
    sims = f.select(F.col("label").alias("qid"), F.col("vec_id").alias("facet")).join(best.select(F.col("qid").alias("facet"), F.col("raw").alias("sim")), "facet", "left")
    return sims.na.fill(-2.0, ["sim"])


def facet_coverage(spark, d):
    return E.coverage(_own_sims(spark, d), [0.6]).select("qid", "coverage")


def coverage_sensitivity(spark, d):
    return E.coverage(_own_sims(spark, d), [0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])


def specificity_vs_rivals(spark, d):
    from ..operators import retrieval

    f, s = _facets(spark, d)
    facets = f.select(F.col("label").alias("qid"), F.col("vec_id").alias("facet"))
    plans = s.select(F.col("label").alias("plan")).distinct()
    asked = f.crossJoin(plans).select(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("plan").cast("string")).alias("qid"), "vector", "plan")  # every facet to every plan
    best = retrieval.nearest(asked, s.select(F.col("vec_id").alias("id"), "vector", F.col("label").alias("plan")), 1, within="plan")
    sims = best.select(F.split_part("qid", F.lit(":"), F.lit(1)).cast("bigint").alias("facet"), F.split_part("qid", F.lit(":"), F.lit(2)).cast("int").alias("plan"), F.col("raw").alias("sim"))
    sims = sims.unionByName(facets.select("facet", F.lit(None).cast("int").alias("plan"), F.lit(None).cast("double").alias("sim")))  # no facet is lost where there is no plan
    return E.specificity(facets.join(sims, "facet"))


def _steps(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("qid"), F.struct("ts", "event_id").alias("step"), "event_type", F.concat(F.lit("paper:"), (F.col("event_id") % 40).cast("string")).alias("paper"))


def budget_row_number(spark, d):
    b = E.within_budget(_steps(spark, d))
    return b.groupBy("qid").agg(F.count_if("allowed").alias("used"), F.count_if(~F.col("allowed")).alias("refused"), F.greatest(F.lit(0), F.lit(6) - F.count(F.lit(1))).cast("bigint").alias("remaining"))


def _reached(spark, d):
    b = E.within_budget(_steps(spark, d)).withColumn("bare", T.bare_paper(F.col("paper")))
    before = F.sort_array(F.collect_set(F.when(F.col("nth") <= 4, F.col("bare"))))
    after = F.sort_array(F.collect_set(F.when(F.col("nth") <= 6, F.col("bare"))))
    need = F.sort_array(F.collect_set(F.when(F.col("event_type") == "purchase", F.col("bare"))))
    return b.groupBy("qid").agg(before.alias("before"), after.alias("after"), need.alias("need"), F.count_if("allowed").alias("used"))


def trajectory_added_except(spark, d):
    r = _reached(spark, d)
    added = F.array_sort(F.array_except("after", "before"))
    return r.select("qid", F.array_join(added, ",").alias("added"), F.size(F.array_intersect(added, F.col("need"))).cast("bigint").alias("useful"))


def retrieval_efficiency(spark, d):
    r = _reached(spark, d)
    hit = F.size(F.array_intersect("after", "need"))
    return r.select("qid", hit.cast("bigint").alias("reached"), F.when(F.size("need") > 0, F.round(hit / F.nullif("used", F.lit(0)), 6)).alias("efficiency"))


def usage_cost_rollup(spark, d):
    """Events as model calls: type is the model, id and value the tokens; two models have prices."""
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tin"), F.floor("value").cast("bigint").alias("tout"))
    rates = F.when(F.col("model") == "click", F.struct(F.lit(0.20).alias("i"), F.lit(1.25).alias("o"))).when(F.col("model") == "view", F.struct(F.lit(0.75).alias("i"), F.lit(4.50).alias("o")))
    s = e.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tin").alias("tin"), F.sum("tout").alias("tout")).withColumn("r", rates)
    return s.select("model", "calls", "tin", "tout", F.round(F.col("tin") / 1e6 * F.col("r.i") + F.col("tout") / 1e6 * F.col("r.o"), 6).alias("cost"), F.col("r").isNotNull().alias("priced"))


def stratified_sample_quota(spark, d):
    sizes = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, "lang", 50)


def stratified_sample_counts(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def equal_sample_counts(spark, d):
    return sampling.equal(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def banded_sample_counts(spark, d):
    n = table(spark, d, "events").select("event_id", T.band_of(F.col("event_id") % 100 / 100.0).alias("band"), "event_type").filter("band is not null")
    return sampling.banded(n, "band", F.col("event_type") == "click", "event_id").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("special"))


def corpus_report(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(n_chars, 0.5)").alias("median"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg((F.col("n_chars") < 300).cast("double")), 6).alias("short"))


def tier_rollup(spark, d):
    """Counts by tier and type, all tiers present, of node types that events stand for."""
    e = table(spark, d, "events").withColumn("tier", F.when(F.col("event_type").isin("click", "view"), "A").when(F.col("event_type") == "purchase", "B").otherwise("C"))
    return e.rollup("tier", "event_type").agg(F.count(F.lit(1)).alias("n"))


def gold_mix_bounds(spark, d):
    """Share of each order priority against a range, as the gold file's mix is checked."""
    o = table(spark, d, "orders")
    n = Window.partitionBy(F.lit(0))
    c = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(n), 6))
    return c.select("o_orderpriority", "n", "share", F.col("share").between(0.15, 0.25).alias("in_range"))


QUERIES = {f.__name__: f for f in (
    metric_must_cite_recall, metric_citation_precision, metric_key_claim_recall, metric_refutation_surfaced, metric_report_grouping_sets, confusion_matrix, qwk_kappa,
    spearman_rho, ols_length_bias, length_bias_p, edge_precision, band_precision, confidence_informative, run_means, paired_arms, wilcoxon_w, median_consensus_lower,
    repro_score_case, repro_accuracy, repro_crosstab, token_containment, facet_coverage, coverage_sensitivity, specificity_vs_rivals, budget_row_number,
    trajectory_added_except, retrieval_efficiency, usage_cost_rollup, stratified_sample_quota, stratified_sample_counts, equal_sample_counts, banded_sample_counts,
    corpus_report, tier_rollup, gold_mix_bounds,
)}

_pick = lambda c: f"coalesce(list_sort(list(DISTINCT l_partkey::VARCHAR) FILTER ({c})), [])"
_GOLD = f"""g0 AS (SELECT l_orderkey AS qid, {_pick("l_returnflag = 'R'")} AS must, {_pick('l_linenumber % 2 = 0')} AS cited, {_pick("l_linestatus = 'O'")} AS c1, {_pick("l_returnflag = 'A'")} AS c2, {_pick('l_linenumber = 1')} AS a, {_pick('l_linenumber = 2')} AS b FROM lineitem GROUP BY l_orderkey),
g AS (SELECT *, list_filter([c1, c2], lambda c: len(c) <> 1) AS claims FROM g0), g2 AS (SELECT *, list_distinct(list_concat(must, flatten(claims))) AS relevant FROM g),
sc AS (SELECT qid, round(len(list_intersect(must, cited)) / nullif(len(must), 0)::DOUBLE, 6) AS must_cite_recall,
CASE WHEN len(relevant) = 0 THEN NULL WHEN len(cited) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(cited, relevant)) / len(cited)::DOUBLE, 6) END AS citation_precision,
round(len(list_filter(claims, lambda c: len(c) = 0 OR list_has_any(c, cited))) / nullif(len(claims), 0)::DOUBLE, 6) AS key_claim_source_recall,
CASE WHEN len(a) > 0 AND len(b) > 0 THEN (CASE WHEN list_has_any(a, cited) AND list_has_any(b, cited) THEN 1.0 ELSE 0.0 END)::DOUBLE END AS refutation_surfaced FROM g2)"""
_GRADED = "gr AS (SELECT doc_id, lang, n_chars, (1 + quality * 3 - toxic + doc_id % 2)::INT AS human, least(5, 1 + n_chars // 900)::INT AS judge FROM labels JOIN documents USING (doc_id))"
_BAND = "CASE WHEN {v} >= 0.65 AND {v} < 0.75 THEN '0.65-0.75' WHEN {v} >= 0.75 AND {v} < 0.85 THEN '0.75-0.85' WHEN {v} >= 0.85 AND {v} < 1.01 THEN '0.85-1.00' END"
_BANDS = f"lb AS (SELECT *, {_BAND.format(v='(0.6::DOUBLE + (doc_id % 45) / 100.0::DOUBLE)')} AS band, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS kind FROM labels)"
_RUNS = "ru AS (SELECT l_linestatus AS arm, l_linenumber AS repeat, o_custkey AS qid, round(l_discount * 100) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_DIFFS = _RUNS + ", pq AS (SELECT arm, qid, avg(value) AS v FROM ru GROUP BY ALL), df AS (SELECT qid, round(a.v - b.v, 9) AS diff FROM pq a JOIN pq b USING (qid) WHERE a.arm = 'O' AND b.arm = 'F')"
_NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_REPRO = f"""rp AS (SELECT p_partkey, p_type, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'not_reported' ELSE p_brand END AS g, CASE p_partkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN lower(p_brand) WHEN 2 THEN NULL ELSE p_type END AS s FROM part),
ro AS (SELECT p_partkey, p_type, CASE WHEN g IS NULL THEN 'skipped' WHEN g = 'not_reported' THEN CASE WHEN s IS NULL OR lower(trim(s)) = 'n/a' THEN 'correct_absence' ELSE 'hallucinated' END WHEN s IS NULL OR lower(trim(s)) = 'n/a' THEN 'missed' WHEN {_NORM.format(x='g')} = {_NORM.format(x='s')} THEN 'correct' ELSE 'wrong' END AS outcome FROM rp)"""
_FACETS = "fs AS (SELECT f.label AS qid, f.vec_id AS facet, s.label AS plan, round(list_cosine_similarity(f.embedding::DOUBLE[], s.embedding::DOUBLE[]), 9) AS sim FROM embeddings f, embeddings s WHERE f.vec_id % 2 <> 0 AND s.vec_id % 2 = 0)"
_STEPS = "st AS (SELECT user_id AS qid, event_type, (event_id % 40)::VARCHAR AS paper, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events)"
_REACHED = _STEPS + ", re AS (SELECT qid, coalesce(list(DISTINCT paper) FILTER (nth <= 4), []) AS before, coalesce(list(DISTINCT paper) FILTER (nth <= 6), []) AS after, coalesce(list(DISTINCT paper) FILTER (event_type = 'purchase'), []) AS need, count(*) FILTER (nth <= 6) AS used FROM st GROUP BY qid)"
_QUOTA = "z AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT *, n * 50 / sum(n) OVER () AS e FROM z), y AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY round(floor(e) - e, 9), lang) AS k, 50 - sum(floor(e)) OVER () AS rest FROM x)"
_long = " UNION ALL ".join(f"SELECT query_type, '{m}' AS metric, {m} AS value FROM sk" for m in METRICS)

ORACLE_SQL = {
    **{q: f"WITH {_GOLD} SELECT qid, {m} FROM sc" for q, m in zip(("metric_must_cite_recall", "metric_citation_precision", "metric_key_claim_recall", "metric_refutation_surfaced"), METRICS, strict=True)},
    "metric_report_grouping_sets": f"WITH {_GOLD}, sk AS (SELECT sc.*, o_orderpriority AS query_type FROM sc JOIN orders ON o_orderkey = qid), lo AS ({_long}) SELECT query_type, metric, round(avg(value), 6) AS mean, count(value) AS n FROM lo GROUP BY GROUPING SETS ((query_type, metric), (metric))",
    "confusion_matrix": f"WITH {_GRADED} SELECT human, judge, count(*) AS n FROM gr GROUP BY ALL",
    "qwk_kappa": f"WITH {_GRADED}, s AS (SELECT lang, count(*) AS n, sum((human - judge) * (human - judge)) AS o FROM gr GROUP BY lang), e AS (SELECT a.lang, sum((a.human - b.judge) * (a.human - b.judge)) / any_value(s.n)::DOUBLE AS e FROM gr a JOIN gr b USING (lang) JOIN s USING (lang) GROUP BY a.lang) SELECT lang, n, round(1 - o / e, 6) AS kappa FROM s JOIN e USING (lang)",
    "spearman_rho": f"WITH {_GRADED}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY human) + (count(*) OVER (PARTITION BY lang, human) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rb FROM gr) SELECT lang, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY lang",
    "ols_length_bias": f"WITH {_GRADED} SELECT count(*) AS n, round(regr_slope(human, n_chars / 100.0), 6) AS slope, round(regr_r2(human, n_chars / 100.0), 6) AS r2 FROM gr",
    "edge_precision": "SELECT CASE doc_id % 3 WHEN 0 THEN 'refutes' WHEN 1 THEN 'undercuts' ELSE 'neither' END AS model, count(*) AS n, round(avg(quality), 6) AS precision FROM labels GROUP BY ALL",
    "band_precision": f"WITH {_BANDS} SELECT band, kind, count(*) AS n, round(avg(quality), 6) AS precision FROM lb WHERE band IS NOT NULL GROUP BY GROUPING SETS ((band), (kind), ())",
    "confidence_informative": f"WITH {_BANDS}, b AS (SELECT band, round(avg(quality), 6) AS p FROM lb WHERE band IS NOT NULL GROUP BY band) SELECT count(*) AS bands, CASE WHEN count(*) >= 2 THEN max(p) - min(p) >= 0.1 END AS informative FROM b",
    "run_means": f"WITH {_RUNS} SELECT arm, repeat, round(avg(value), 6) AS mean, count(value) AS n FROM ru GROUP BY ALL",
    "paired_arms": f"WITH {_DIFFS} SELECT count(*) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties, round(avg(diff), 6) AS mean_diff FROM df",
    "wilcoxon_w": f"WITH {_DIFFS}, r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0::DOUBLE AS k FROM df WHERE diff <> 0) SELECT count(*) AS n, round(coalesce(sum(k) FILTER (diff > 0), 0), 6)::DOUBLE AS w_plus FROM r",
    "median_consensus_lower": "SELECT l_orderkey, quantile_disc(l_quantity, 0.5) AS l_quantity FROM lineitem GROUP BY l_orderkey",
    "repro_score_case": f"WITH {_REPRO} SELECT p_partkey, outcome FROM ro",
    "repro_accuracy": f"WITH {_REPRO} SELECT p_type, count(*) FILTER (outcome <> 'skipped') AS scored, round(count(*) FILTER (outcome IN ('correct', 'correct_absence')) / nullif(count(*) FILTER (outcome <> 'skipped'), 0)::DOUBLE, 6) AS accuracy FROM ro GROUP BY p_type",
    "repro_crosstab": f"WITH {_REPRO} SELECT p_type, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("correct", "wrong", "missed", "correct_absence", "hallucinated", "skipped")) + " FROM ro GROUP BY p_type",
    "token_containment": f"""WITH t AS (SELECT p_partkey, {_NORM.format(x='p_brand')} AS b, {_NORM.format(x="p_brand || ' ' || p_type")} AS w, {_NORM.format(x='substr(p_brand, 2, 20)')} AS c, {_NORM.format(x='p_name')} AS n FROM part)
SELECT p_partkey, b <> '' AND w <> '' AND (contains(' ' || b || ' ', ' ' || w || ' ') OR contains(' ' || w || ' ', ' ' || b || ' ')) AS whole, c <> '' AND n <> '' AND (contains(' ' || c || ' ', ' ' || n || ' ') OR contains(' ' || n || ' ', ' ' || c || ' ')) AS cut FROM t""",
    "facet_coverage": f"WITH {_FACETS}, b AS (SELECT qid, facet, max(sim) AS best FROM fs WHERE qid = plan GROUP BY ALL) SELECT qid, round(avg((best >= 0.6)::INT), 6) AS coverage FROM b GROUP BY qid",
    "coverage_sensitivity": f"WITH {_FACETS}, b AS (SELECT qid, facet, max(sim) AS best FROM fs WHERE qid = plan GROUP BY ALL) SELECT qid, t::DOUBLE AS threshold, round(avg((best >= t::DOUBLE)::INT), 6) AS coverage FROM b, (SELECT unnest([0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]) AS t) GROUP BY ALL",
    "specificity_vs_rivals": f"WITH {_FACETS}, b AS (SELECT qid, facet, max(sim) FILTER (plan = qid) AS own, max(sim) FILTER (plan <> qid) AS rival FROM fs GROUP BY ALL) SELECT qid, count(*) AS n, round(avg((own > rival)::INT), 6) AS specificity FROM b GROUP BY qid",
    "budget_row_number": f"WITH {_STEPS} SELECT qid, count(*) FILTER (nth <= 6) AS used, count(*) FILTER (nth > 6) AS refused, greatest(0, 6 - count(*))::BIGINT AS remaining FROM st GROUP BY qid",
    "trajectory_added_except": f"WITH {_REACHED}, a AS (SELECT qid, list_sort(list_filter(after, lambda x: NOT list_contains(before, x))) AS added, need FROM re) SELECT qid, array_to_string(added, ',') AS added, len(list_intersect(added, need)) AS useful FROM a",
    "retrieval_efficiency": f"WITH {_REACHED} SELECT qid, len(list_intersect(after, need)) AS reached, CASE WHEN len(need) > 0 THEN round(len(list_intersect(after, need)) / nullif(used, 0)::DOUBLE, 6) END AS efficiency FROM re",
    "usage_cost_rollup": "WITH s AS (SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000)::BIGINT AS tin, sum(floor(value)::BIGINT)::BIGINT AS tout FROM events GROUP BY ALL) SELECT model, calls, tin, tout, round((CASE model WHEN 'click' THEN tin / 1e6 * 0.20 + tout / 1e6 * 1.25 WHEN 'view' THEN tin / 1e6 * 0.75 + tout / 1e6 * 4.50 END)::DOUBLE, 6) AS cost, model IN ('click', 'view') AS priced FROM s",
    "stratified_sample_quota": f"WITH {_QUOTA} SELECT lang, least(n, (f + (k <= rest)::INT)::BIGINT) AS quota FROM y",
    "stratified_sample_counts": f"WITH {_QUOTA} SELECT lang, least(n, (f + (k <= rest)::INT)::BIGINT) AS n FROM y",
    "equal_sample_counts": "SELECT event_type, least(count(*), 20) AS n FROM events GROUP BY event_type",
    "banded_sample_counts": f"WITH b AS (SELECT {_BAND.format(v='((event_id % 100) / 100.0)::DOUBLE')} AS band, event_type FROM events), c AS (SELECT band, count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type <> 'click') AS o FROM b WHERE band IS NOT NULL GROUP BY band) SELECT band, least(20, s + o) AS n, least(s, greatest(7, 20 - o)) AS special FROM c",
    "corpus_report": "SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.5) AS median, min(n_chars) AS least, max(n_chars) AS most, round(avg((n_chars < 300)::INT), 6) AS short FROM documents GROUP BY lang",
    "tier_rollup": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'A' WHEN event_type = 'purchase' THEN 'B' ELSE 'C' END AS tier, event_type, count(*) AS n FROM events GROUP BY ROLLUP (tier, event_type)",
    "gold_mix_bounds": "WITH c AS (SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY ALL) SELECT o_orderpriority, n, share, share BETWEEN 0.15 AND 0.25 AS in_range FROM c",
}
