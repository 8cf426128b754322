"""Parsing, audits and calibration over the fixture tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjudication, calibration, parsing, reproducibility
from .text_queries import _RULES_SQL, table


def _spans(spark, d):
    """Line items as spans of an order's page: an image where the quantity is large, blank where there is no discount."""
    text = F.when(F.col("l_discount") == 0, "  ").otherwise(F.concat("l_returnflag", "l_linestatus", F.lit(" ")))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (F.col("l_linenumber") % 2).alias("block"), F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("kind"),
        (F.col("l_linenumber") % 3).alias("line"), F.col("l_linenumber").alias("span"), text.alias("text"), (9 + F.col("l_quantity") / 10).alias("size"), F.when(F.col("l_tax") > 0.02, 17).otherwise(1).alias("flags"),
    )


def span_lines(spark, d):
    return parsing.lines_of(_spans(spark, d), "doc").select("doc", "block", "line", "text", "size", "bold")


def _lines(spark, d):
    """Lines of documents with a size and weight that follow from their place."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    return docs.withColumns({"size": 10 + (F.col("pos") % 4) * 0.25, "bold": (F.col("doc_id") + F.col("pos")) % 7 == 0})


def heading_lines(spark, d):
    lines = _lines(spark, d)
    marked = lines.join(parsing.body_size(lines, "doc_id"), "doc_id").withColumn("h", parsing.is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")))
    return marked.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("h").alias("n_headings"))


def line_sections(spark, d):
    s = parsing.split_sections(_lines(spark, d), "doc_id")
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "title", "section_type", F.char_length("text").cast("bigint").alias("chars"))


def conflict_neighbours(spark, d):
    """Parts as statements of brands: neighbours by key that may be in tension."""
    kind = F.when(F.col("p_size") % 3 == 0, "Claim").when(F.col("p_size") % 3 == 1, "Limitation").otherwise("Method")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("paper"), kind.alias("type"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise(" ").alias("name"))
    n = n.filter(adjudication.is_comparable(F.col("type"), F.col("name")))
    b = n.select((F.col("id") - 1).alias("id"), F.col("id").alias("b_id"), F.col("paper").alias("b_paper"))
    return n.join(b, "id").filter(adjudication.can_conflict(F.col("id"), F.col("paper"), F.col("b_id"), F.col("b_paper"))).select(F.col("id").alias("a"), F.col("b_id").alias("b"))


def _repro_nodes(spark, d):
    """Parts as extracted nodes of the paper that their size names."""
    kind = F.element_at(F.array(*map(F.lit, ["Hardware", "Dataset", "Software", "ReproducibilityArtifact"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    attrs = F.create_map(
        F.lit("quantum_vendor"), F.concat(F.lower("p_brand"), F.lit(" systems")), F.lit("vendor"), F.col("p_brand"), F.lit("qubit_count"), F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" qubits"))),
        F.lit("gpu_type"), F.when(F.col("p_partkey") % 11 == 0, "A100").otherwise("none"), F.lit("url"), F.col("p_type"), F.lit("access_type"), F.when(F.col("p_partkey") % 6 == 1, "open").otherwise(""),
    )
    return table(spark, d, "part").select(F.col("p_size").cast("string").alias("paper"), kind.alias("type"), F.col("p_name").alias("name"), attrs.alias("attrs"), F.col("p_partkey").alias("ord"))


def _repro_gold(spark, d):
    g = table(spark, d, "part").groupBy("p_size").agg(F.min("p_brand").alias("quantum_vendor"), F.max("p_name").alias("device_name"), F.min("p_type").alias("code_url"))
    null = F.lit(None).cast("string")
    return g.select(
        F.col("p_size").cast("string").alias("paper"), "quantum_vendor", F.when(F.col("p_size") % 3 == 0, "not_reported").otherwise(F.col("device_name")).alias("device_name"), F.col("p_size").cast("string").alias("qubit_count"),
        F.when(F.col("p_size") % 2 == 1, "not_reported").alias("gpu_type"), null.alias("gpu_count"), "code_url", F.lit("not_reported").alias("dataset_access"), null.alias("note"),
    )


def repro_candidates(spark, d):
    return reproducibility.candidates(_repro_nodes(spark, d)).select("paper", "field", "value", F.col("place.pref").cast("bigint").alias("pref"), F.col("place.ord").alias("ord"))


def repro_paper_scores(spark, d):
    return reproducibility.score_papers(_repro_gold(spark, d), _repro_nodes(spark, d))


def repro_summary(spark, d):
    s = reproducibility.summary(reproducibility.score_papers(_repro_gold(spark, d), _repro_nodes(spark, d)))
    return s.withColumn("field", F.coalesce("field", F.lit("all")))


def _labels(spark, d):
    """Line items as graded answers: the line's number picks the criterion, quantity and tax the grades of two passes."""
    criterion = F.element_at(F.array(*map(F.lit, calibration.CRITERIA)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    grade = lambda x: (F.pmod(F.floor("l_quantity") + x, F.lit(5)) + 1).cast("int")
    second = F.when(F.col("l_discount") > 0.08, None).otherwise(grade((F.col("l_tax") > 0.04).cast("int")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.create_map(criterion, grade(F.lit(0))).alias("a"), F.create_map(criterion, second).alias("b"))


def gradeable_n(spark, d):
    return calibration.gradeable(_labels(spark, d))


def pass_agreement(spark, d):
    return calibration.agreement(_labels(spark, d)).select("criterion", "n", "kappa", "rho", "trusted")


def length_bias_by_criterion(spark, d):
    rows = calibration.grades(_labels(spark, d).withColumn("b", F.col("a"))).withColumn("chars", F.pmod(F.col("qid") * 37, F.lit(4001)))
    return calibration.length_bias(rows, "criterion", "chars", "a").select("criterion", "slope")


def chunk_report(spark, d):
    """Lengths of documents by language: how many, median, extremes, and how many are under 300 characters."""
    n = F.char_length("text")
    out = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.median(n).alias("median"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"), F.count_if(n < 300).alias("short"))
    return out.withColumn("share_short", F.round(F.col("short") / F.col("n"), 6)).drop("short")


QUERIES = {f.__name__: f for f in (span_lines, heading_lines, line_sections, conflict_neighbours, repro_candidates, repro_paper_scores, repro_summary, gradeable_n, pass_agreement, length_bias_by_criterion, chunk_report)}

_LINES_SQL = """l AS (SELECT doc_id, pos - 1 AS pos, text, (10 + ((pos - 1) % 4) * 0.25)::DOUBLE AS size, (doc_id + pos - 1) % 7 = 0 AS bold FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(text, ' ') <> ''),
z AS (SELECT doc_id, size, sum(length(text)) AS n FROM l GROUP BY ALL),
b AS (SELECT doc_id, size AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) = 1),
h AS (SELECT l.*, body, length(text) <= 90 AND len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0b]+')) <= 12 AND NOT regexp_matches(text, '(?i)^\\s*(fig(ure)?|tab(le)?)\\b\\.?\\s*\\d')
  AND length(regexp_replace(text, '[^\\pL]', '', 'g')) >= 3 AND 2 * length(regexp_replace(text, '[^\\pL]', '', 'g')) >= length(text) AND (bold OR size >= body + 0.5) AS head FROM l JOIN b USING (doc_id))"""
_REPRO_SQL = """nodes AS (SELECT p_size::VARCHAR AS paper, ['Hardware', 'Dataset', 'Software', 'ReproducibilityArtifact'][p_partkey % 4 + 1] AS type, p_name AS name, p_partkey AS ord,
  lower(p_brand) || ' systems' AS quantum_vendor, p_brand AS vendor, CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE p_size || ' qubits' END AS qubit_count, CASE WHEN p_partkey % 11 = 0 THEN 'A100' ELSE 'none' END AS gpu_type, p_type AS url, CASE WHEN p_partkey % 6 = 1 THEN 'open' ELSE '' END AS access_type FROM part),
offered AS (SELECT paper, 'quantum_vendor' AS field, quantum_vendor AS value, 0 AS pref, ord FROM nodes WHERE type = 'Hardware' UNION ALL SELECT paper, 'quantum_vendor', vendor, 1, ord FROM nodes WHERE type = 'Hardware'
  UNION ALL SELECT paper, 'device_name', name, 2, ord FROM nodes WHERE type = 'Hardware' UNION ALL SELECT paper, 'qubit_count', qubit_count, 3, ord FROM nodes WHERE type = 'Hardware' UNION ALL SELECT paper, 'qubit_count', qubit_count, 4, ord FROM nodes WHERE type = 'Dataset'
  UNION ALL SELECT paper, 'gpu_type', gpu_type, 5, ord FROM nodes WHERE type = 'Hardware' UNION ALL SELECT paper, 'code_url', url, 8, ord FROM nodes WHERE type = 'Software' UNION ALL SELECT paper, 'dataset_access', access_type, 11, ord FROM nodes WHERE type = 'Dataset'),
cand AS (SELECT paper, field, value, pref, ord FROM offered WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('unknown', 'n/a', 'na', 'none', 'null', 'not reported', 'not specified', '') QUALIFY row_number() OVER (PARTITION BY paper, field, value ORDER BY pref, ord) = 1),
g0 AS (SELECT p_size AS s, min(p_brand) AS v, max(p_name) AS n, min(p_type) AS u FROM part GROUP BY p_size),
gold AS (SELECT s::VARCHAR AS paper, unnest(['quantum_vendor', 'device_name', 'qubit_count', 'gpu_type', 'gpu_count', 'code_url', 'dataset_access']) AS field,
  unnest([v, CASE WHEN s % 3 = 0 THEN 'not_reported' ELSE n END, s::VARCHAR, CASE WHEN s % 2 = 1 THEN 'not_reported' END, NULL, u, 'not_reported']) AS gold FROM g0),
plain AS (SELECT gold.paper, gold.field, gold, value, pref, ord, ' ' || trim(regexp_replace(lower(gold), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x, ' ' || trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) || ' ' AS y FROM gold LEFT JOIN cand ON gold.paper = cand.paper AND gold.field = cand.field),
fit AS (SELECT *, coalesce(gold <> 'not_reported' AND trim(x) <> '' AND trim(y) <> '' AND (contains(x, y) OR contains(y, x)), false) AS m FROM plain),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY paper, field ORDER BY (NOT m), pref, ord, value) = 1),
scored AS (SELECT paper, field, CASE WHEN gold IS NULL THEN 'skipped' WHEN gold = 'not_reported' THEN CASE WHEN value IS NULL THEN 'correct_absence' ELSE 'hallucinated' END WHEN value IS NULL THEN 'missed' WHEN x = y OR m THEN 'correct' ELSE 'wrong' END AS outcome FROM best)"""
_OUTCOMES = ["correct", "wrong", "missed", "correct_absence", "hallucinated", "skipped"]
_SUMMARY_SQL = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in _OUTCOMES) + ", round(count(*) FILTER (outcome IN ('correct', 'correct_absence')) / nullif(count(*) FILTER (outcome <> 'skipped'), 0)::DOUBLE, 6) AS accuracy"
_GRADES_SQL = f"""g AS (SELECT l_orderkey AS qid, {calibration.CRITERIA}[l_linenumber % 5 + 1] AS criterion, (floor(l_quantity)::BIGINT % 5) + 1 AS a, CASE WHEN l_discount > 0.08 THEN NULL ELSE ((floor(l_quantity)::BIGINT + (l_tax > 0.04)::INT) % 5) + 1 END AS b FROM lineitem)"""

ORACLE_SQL = {
    "span_lines": """WITH s AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS block, l_linenumber % 3 AS line, l_linenumber AS span, CASE WHEN l_discount = 0 THEN '  ' ELSE l_returnflag || l_linestatus || ' ' END AS text, 9 + l_quantity / 10 AS size, l_tax > 0.02 AS bold FROM lineitem WHERE NOT l_quantity > 45)
SELECT doc, block, line, trim(string_agg(text, '' ORDER BY span, text), ' ') AS text, round(max(size) FILTER (trim(text, ' ') <> ''), 1) AS size, bool_and(bold) FILTER (trim(text, ' ') <> '') AS bold FROM s GROUP BY doc, block, line HAVING count(*) FILTER (trim(text, ' ') <> '') > 0""",
    "heading_lines": f"WITH {_LINES_SQL} SELECT doc_id, body, count(*) AS n_lines, count(*) FILTER (head) AS n_headings FROM h GROUP BY doc_id, body",
    "line_sections": f"""WITH {_LINES_SQL},
t AS (SELECT *, CASE WHEN head THEN {_RULES_SQL.format(t="text")} END AS kind FROM h),
m AS (SELECT *, last_value(CASE WHEN kind <> 'other' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mode FROM t),
o AS (SELECT *, head AND NOT (coalesce(mode, '') = 'references' AND kind IN ('other', 'references')) AS opens FROM m),
c AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM o),
e AS (SELECT *, regexp_matches(text, '^\\s*\\[\\d{{1,3}}\\]') AS entry FROM c WHERE NOT opens),
w AS (SELECT *, sum(entry::INT) OVER (PARTITION BY doc_id, sec ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS near FROM e),
r AS (SELECT *, pos >= min(pos) FILTER (entry AND near >= 3) OVER (PARTITION BY doc_id, sec) AS refs FROM w),
p AS (SELECT doc_id, sec, coalesce(refs, false) AS refs, min(pos) AS pos, trim(string_agg(text, chr(10) ORDER BY pos), ' ') AS text FROM r GROUP BY doc_id, sec, coalesce(refs, false)),
k AS (SELECT doc_id, sec, text AS title, kind FROM c WHERE opens)
SELECT p.doc_id, pos, CASE WHEN refs THEN 'References' ELSE coalesce(title, 'Front Matter') END AS title, CASE WHEN refs THEN 'references' ELSE coalesce(kind, 'other') END AS section_type, length(text) AS chars FROM p LEFT JOIN k ON p.doc_id = k.doc_id AND p.sec = k.sec WHERE text <> ''""",
    "conflict_neighbours": "WITH n AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN p_brand END AS paper FROM part WHERE p_size % 3 IN (0, 1) AND p_size % 5 > 0) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON y.id = x.id + 1 WHERE x.paper <> y.paper",
    "repro_candidates": f"WITH {_REPRO_SQL} SELECT paper, field, value, pref::BIGINT AS pref, ord FROM cand",
    "repro_paper_scores": f"WITH {_REPRO_SQL} SELECT * FROM scored",
    "repro_summary": f"WITH {_REPRO_SQL} SELECT field, {_SUMMARY_SQL} FROM scored GROUP BY field UNION ALL SELECT 'all', {_SUMMARY_SQL} FROM scored",
    "gradeable_n": f"WITH {_GRADES_SQL} SELECT criterion, count(b) AS n FROM g GROUP BY criterion",
    "pass_agreement": f"""WITH {_GRADES_SQL}, p AS (SELECT * FROM g WHERE b IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY criterion ORDER BY a) + (count(*) OVER (PARTITION BY criterion, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY criterion ORDER BY b) + (count(*) OVER (PARTITION BY criterion, b) - 1) / 2.0 AS rb FROM p),
s AS (SELECT criterion, count(*) AS n, round(1 - sum((a - b) * (a - b)) / (count(*) * (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) * (avg(a) - avg(b)))), 6) AS kappa, coalesce(round(corr(ra, rb), 6), 0.0) AS rho FROM r GROUP BY criterion)
SELECT *, coalesce(kappa >= 0.6, false) AS trusted FROM s WHERE n >= 2""",
    "length_bias_by_criterion": f"WITH {_GRADES_SQL} SELECT criterion, round(regr_slope(a, (qid * 37 % 4001) / 100.0), 6) AS slope FROM g GROUP BY criterion",
    "chunk_report": "SELECT lang, count(*) AS n, median(length(text))::DOUBLE AS median, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, round(count(*) FILTER (length(text) < 300) / count(*)::DOUBLE, 6) AS share_short FROM documents GROUP BY lang",
}
