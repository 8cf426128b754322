"""Reports and lints over the fixture tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from . import eval_queries, text_queries
from .text_queries import table

#: Words that mark a passage on hardware.
HARDWARE = r"(?i)\b(qubit|gpu|processor|hardware|device|cluster|core)"
TIERS = ["A", "B", "C", "D"]


def gold_lint(spark, d):
    """Questions (orders) with their faults: no required citation, a cited part outside the corpus, a repeated customer and date."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), "o_custkey", "o_orderpriority")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_partkey", "l_returnflag")
    none = o.join(li.filter("l_returnflag = 'R'"), "qid", "left_anti").select("qid", F.lit("no_must_cite").alias("fault"))
    corpus = table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"))
    outside = li.join(corpus, "l_partkey", "left_anti").select("qid", F.lit("outside_corpus").alias("fault")).distinct()
    twice = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("qid")).filter("n > 1").select("qid", F.lit("duplicate").alias("fault"))
    return none.unionByName(outside).unionByName(twice)


def plan_outcome_coupling(spark, d):
    """Rank correlation of retrieval efficiency with the papers reached, over users as questions."""
    r = eval_queries.retrieval_efficiency(spark, d).filter("efficiency is not null")
    return E.spearman(r.withColumn("g", F.lit("all")), ["g"], "efficiency", "reached").select("n", "rho")


def verdict_summary(spark, d):
    """Near pairs by verdict: count, share, distinct vectors they span."""
    p = text_queries.knn_selfjoin_pairs(spark, d).withColumn("verdict", F.when(F.col("sim") >= 0.4, "same").otherwise("different"))
    every = Window.partitionBy(F.lit(0))
    c = p.select("verdict", F.explode(F.array("a", "b")).alias("v"), "a", "b").groupBy("verdict").agg(F.count_distinct(F.struct("a", "b")).alias("n"), F.count_distinct("v").alias("spanned"))
    return c.select("verdict", "n", "spanned", F.round(F.col("n") / F.sum("n").over(every), 6).alias("share"))


def hardware_passages(spark, d):
    """Sentences on hardware of 21 to 399 characters, the first twelve of a document."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.regexp_replace("text", "or", "core"))).alias("pos", "s"))
    s = s.filter(F.col("s").rlike(HARDWARE) & (F.char_length("s") > 20) & (F.char_length("s") < 400))
    by = Window.partitionBy("doc_id").orderBy("pos")
    return s.withColumn("nth", F.row_number().over(by)).filter("nth <= 12").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("nth").cast("long").alias("nth"))


def judge_stability(spark, d):
    """Kappa per repeat of the judge (documents by id modulo 3); certified only if the worst passes."""
    g = eval_queries._graded(spark, d).withColumn("sample", (F.col("doc_id") % 3).cast("long"))
    k = E.quadratic_kappa(g, ["sample"], "human", "judge")
    return k.agg(F.count(F.lit(1)).alias("samples"), F.min("kappa").alias("worst"), F.round(F.max("kappa") - F.min("kappa"), 6).alias("spread"), (F.min("kappa") >= 0.6).alias("certified"))


def ceiling_reading(spark, d):
    """What a language's judge agreement means beside that of two passes of the same grader."""
    g = eval_queries._graded(spark, d).withColumn("again", F.least(F.lit(5), F.col("human") + (F.col("doc_id") % 5 == 0).cast("int")))
    judge = E.quadratic_kappa(g, ["lang"], "human", "judge").select("lang", F.col("kappa").alias("judge"))
    twice = E.quadratic_kappa(g, ["lang"], "human", "again").select("lang", F.col("kappa").alias("human"))
    reading = F.when(F.col("human") < 0.6, "ambiguous_rubric").when(F.col("judge") >= 0.6, "trusted").when(F.col("judge") >= F.col("human") - 0.1, "at_ceiling").otherwise("judge_is_worse")
    return judge.join(twice, "lang").select("lang", "judge", "human", reading.alias("reading"))


def by_tier(spark, d):
    """Nodes and users per tier, tiers without any included."""
    tiers = spark.createDataFrame([(t,) for t in TIERS], "tier string")
    tier = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").otherwise("C")
    c = table(spark, d, "events").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return tiers.join(c, "tier", "left").na.fill(0)


def section_report(spark, d):
    """Section types: sections, documents, share, median length."""
    s = text_queries._sections(spark, d).withColumn("n", F.char_length("text"))
    every = Window.partitionBy(F.lit(0))
    c = s.groupBy("kind").agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("doc_id").alias("documents"), F.expr("percentile(n, 0.5)").alias("median"))
    return c.withColumn("share", F.round(F.col("sections") / F.sum("sections").over(every), 6))


def no_limitation_route(spark, d):
    """Documents without a section that may hold limitations."""
    k = text_queries.positional_refine(spark, d)
    return k.groupBy("doc_id").agg(F.bool_or(F.col("kind").isin(T.LIMITATION_TYPES)).alias("has")).agg(F.count_if(~F.col("has")).alias("without"), F.count(F.lit(1)).alias("documents"))


def arms_by_type(spark, d):
    """Mean value of each arm per order priority, side by side."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy("o_orderpriority").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_discount"), 6))


def refutation_sides(spark, d):
    """Tokens with a colon in assistant turns, as the ids of a refutation's sides."""
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    ids = T.papers_in(F.concat(F.lit("paper:"), F.col("conv_id").cast("string"), F.lit(", (paper:1). "), F.col("text")))
    return c.select("conv_id", "turn", F.array_join(F.array_sort(ids), " ").alias("ids"))


def first_node_per_id(spark, d):
    """Distinct nodes, the first row of an id wins."""
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    by = Window.partitionBy("id").orderBy("event_id")
    return e.withColumn("n", F.row_number().over(by)).filter("n = 1").select("id", "event_id", "event_type")


def limit_before_residual(spark, d):
    """Neighbours of which the cap took the place before pairs of one group were left out: kept and lost slots per label."""
    from ..operators import retrieval

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    near = retrieval.nearest(v.withColumnRenamed("id", "qid"), v, 5, skip_self=True).join(v.select(F.col("id").alias("qid"), "label"), "qid").join(v.select("id", F.col("label").alias("other")), "id")
    return near.groupBy("label").agg(F.count_if(F.col("label") != F.col("other")).alias("kept"), F.count_if(F.col("label") == F.col("other")).alias("lost"))


QUERIES = {f.__name__: f for f in (gold_lint, plan_outcome_coupling, verdict_summary, hardware_passages, judge_stability, ceiling_reading, by_tier, section_report, no_limitation_route, arms_by_type, refutation_sides, first_node_per_id, limit_before_residual)}

_KAPPA = "k_{n} AS (SELECT s.g, 1 - s.o / e.e AS kappa FROM (SELECT {g} AS g, count(*) AS n, sum(({a} - {b}) * ({a} - {b})) AS o FROM gz GROUP BY 1) s JOIN (SELECT x.{g0} AS g, sum((x.{a} - y.{b}) * (x.{a} - y.{b})) / count(DISTINCT x.doc_id)::DOUBLE AS e FROM gz x JOIN gz y ON x.{g0} = y.{g0} GROUP BY 1) e USING (g))"
_GZ = eval_queries._GRADED + ", gz AS (SELECT *, doc_id % 3 AS sample, least(5, human + (doc_id % 5 = 0)::INT) AS again FROM gr)"
_PAIRS = text_queries.ORACLE_SQL["knn_selfjoin_pairs"]

ORACLE_SQL = {
    "gold_lint": """SELECT o_orderkey AS qid, 'no_must_cite' AS fault FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
UNION ALL SELECT DISTINCT l_orderkey, 'outside_corpus' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)
UNION ALL SELECT min(o_orderkey), 'duplicate' FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1""",
    "plan_outcome_coupling": f"WITH e AS ({eval_queries.ORACLE_SQL['retrieval_efficiency']}), f AS (SELECT * FROM e WHERE efficiency IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY efficiency) + (count(*) OVER (PARTITION BY efficiency) - 1) / 2.0 AS a, rank() OVER (ORDER BY reached) + (count(*) OVER (PARTITION BY reached) - 1) / 2.0 AS b FROM f) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "verdict_summary": f"WITH p AS ({_PAIRS}), q AS (SELECT *, CASE WHEN sim >= 0.4 THEN 'same' ELSE 'different' END AS verdict FROM p), s AS (SELECT verdict, count(DISTINCT v) AS spanned FROM (SELECT verdict, a AS v FROM q UNION ALL SELECT verdict, b FROM q) GROUP BY verdict), c AS (SELECT verdict, count(*) AS n FROM q GROUP BY verdict) SELECT verdict, n, spanned, round(n / sum(n) OVER (), 6) AS share FROM c JOIN s USING (verdict)",
    "hardware_passages": "WITH s AS (SELECT doc_id, unnest(" + text_queries._SENT.format(t="replace(text, 'or', 'core')") + ") AS s, unnest(range(len(" + text_queries._SENT.format(t="replace(text, 'or', 'core')") + "))) AS pos FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM s WHERE regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])(qubit|gpu|processor|hardware|device|cluster|core)') AND length(s) > 20 AND length(s) < 400) SELECT doc_id, pos::BIGINT AS pos, nth FROM f WHERE nth <= 12",
    "judge_stability": f"WITH {_GZ}, {_KAPPA.format(n='s', g='sample', g0='sample', a='human', b='judge')} SELECT count(*) AS samples, round(min(kappa), 6) AS worst, round(round(max(kappa), 6) - round(min(kappa), 6), 6) AS spread, min(kappa) >= 0.6 AS certified FROM k_s",
    "ceiling_reading": f"WITH {_GZ}, {_KAPPA.format(n='j', g='lang', g0='lang', a='human', b='judge')}, {_KAPPA.format(n='h', g='lang', g0='lang', a='human', b='again')} SELECT j.g AS lang, round(j.kappa, 6) AS judge, round(h.kappa, 6) AS human, CASE WHEN h.kappa < 0.6 THEN 'ambiguous_rubric' WHEN j.kappa >= 0.6 THEN 'trusted' WHEN j.kappa >= h.kappa - 0.1 THEN 'at_ceiling' ELSE 'judge_is_worse' END AS reading FROM k_j j JOIN k_h h USING (g)",
    "by_tier": "WITH t(tier) AS (VALUES ('A'), ('B'), ('C'), ('D')), c AS (SELECT CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'C' END AS tier, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT tier, coalesce(n, 0) AS n, coalesce(users, 0) AS users FROM t LEFT JOIN c USING (tier)",
    "section_report": f"WITH {text_queries._SECTIONS}, c AS (SELECT kind, count(*) AS sections, count(DISTINCT doc_id) AS documents, quantile_cont(length(text), 0.5) AS median FROM secs GROUP BY kind) SELECT *, round(sections / sum(sections) OVER (), 6) AS share FROM c",
    "no_limitation_route": f"WITH k AS ({text_queries.ORACLE_SQL['positional_refine']}), h AS (SELECT doc_id, bool_or(kind IN ('conclusion', 'discussion', 'limitations')) AS has FROM k GROUP BY doc_id) SELECT count(*) FILTER (NOT has) AS without, count(*) AS documents FROM h",
    "arms_by_type": "SELECT o_orderpriority, round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "refutation_sides": r"WITH x AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(replace('paper:' || conv_id || ', (paper:1). ' || text, ',', ' '), '\s+'), lambda t: trim(t, '.;()[]')), lambda t: contains(t, ':')))) AS ids FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, array_to_string(ids, ' ') AS ids FROM x",
    "first_node_per_id": "SELECT user_id AS id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "limit_before_residual": f"WITH s AS (SELECT a.vec_id AS x, b.vec_id AS y, {text_queries._COS} AS raw, a.label, b.label AS other FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY raw DESC, y) AS n FROM s) SELECT label, count(*) FILTER (label <> other) AS kept, count(*) FILTER (label = other) AS lost FROM r WHERE n <= 5 GROUP BY label",
}
