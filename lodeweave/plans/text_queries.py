"""Queries on text and retrieval over the fixture tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, retrieval


#: A table of texts this small may be one row group, which one task reads.
ONE_SPLIT = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table. Documents that fit one split are dealt out to all cores; larger ones have splits enough and are not moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= ONE_SPLIT:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as chunks: the document with the same id gives paper and length, the label the corpus and section type."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    kind = F.when(F.col("label") == 8, "availability").otherwise("method")
    corpus = F.when(F.col("label") % 2 == 0, "fulltext").otherwise("abstract")
    return table(spark, d, "embeddings").join(docs, "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), corpus.alias("corpus"), kind.alias("section_type"), "n_chars", F.col("source").alias("paper"), "label")


def _vec_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")


def vec_topk_exact(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.nearest(_vec_queries(spark, d), items, 10).select("qid", "id", F.round("raw", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def vec_topk_postfilter_damped(spark, d):
    found = retrieval.search(_vec_queries(spark, d), _items(spark, d), 10, "fulltext")
    return found.select("qid", "id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _hits(spark, d):
    items = _items(spark, d)
    return retrieval.nearest(_vec_queries(spark, d), items, 60).join(items.select("id", "paper"), "id")


def router_chunks_per_paper(spark, d):
    hits = _hits(spark, d)
    reached = hits.filter("rank <= 12").select("qid", "paper")
    return retrieval.route_chunks(hits, reached).select("qid", "paper", "id", F.col("rank").cast("long").alias("rank"), F.col("nth").cast("long").alias("nth"))


def evidence_handles(spark, d):
    hits = retrieval.with_handles(_hits(spark, d).filter("rank <= 20"))
    return retrieval.evidence(hits.withColumn("text", F.concat(F.lit("chunk "), F.col("id").cast("string"))))


def knn_selfjoin_pairs(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    near = retrieval.nearest(v.withColumnRenamed("id", "qid"), v, 5, within="label", skip_self=True).filter("raw >= 0.3")
    pair = near.select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), F.round("raw", 6).alias("sim"))
    return pair.distinct()


def cross_group_pairs(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    near = retrieval.nearest(v.withColumnRenamed("id", "qid"), v, 5, skip_self=True).filter("raw >= 0.3")
    near = near.join(v.select(F.col("id").alias("qid"), F.col("label").alias("la")), "qid").join(v.select("id", F.col("label").alias("lb")), "id").filter("la <> lb")
    return near.select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), F.round("raw", 6).alias("sim")).distinct()


def l2_normalize(spark, d):
    v = table(spark, d, "embeddings").withColumn("u", V.l2_normalize(F.col("embedding")))
    return v.select("vec_id", F.round(V.norm(F.col("u")), 6).alias("unit"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(V.norm(F.col("embedding")), 6).alias("length"))


def merge_batches_first_seen(spark, d):
    items = _items(spark, d)
    both = None
    for batch, corpus in enumerate(("fulltext", "abstract")):
        found = retrieval.nearest(_vec_queries(spark, d), items.filter(F.col("corpus") == corpus), 5).withColumn("batch", F.lit(batch))
        both = found if both is None else both.unionByName(found)
    again = retrieval.nearest(_vec_queries(spark, d), items, 5).withColumn("batch", F.lit(2))
    return retrieval.merge_hits(both.unionByName(again)).select("qid", "id", F.col("rank").cast("long").alias("rank"))


def _lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def classify_section_case(spark, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    lined = table(spark, d, "documents").select("doc_id", T.classify_section(first).alias("section_type"), T.classify_section(F.concat(F.lit("3. "), F.col("lang"), F.lit(" Experiments and data availability"))).alias("titled"))
    return lined


def approx_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


def sentence_split_counts(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.char_length)).cast("long").alias("longest"))


def _sections(spark, d):
    """Lines as sections: every line's type by its own words, blank lines left out."""
    return _lines(spark, d).filter(F.trim("line") != "").select("doc_id", "pos", F.col("line").alias("text"), T.classify_section(F.col("line")).alias("kind"))


def fragment_merge(spark, d):
    return chunking.fold_fragments(_sections(spark, d), "doc_id", "pos", "text", "kind").select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.char_length("text").cast("long").alias("chars"), "n_parts")


def positional_refine(spark, d):
    return chunking.retype(_sections(spark, d), "doc_id", "pos", "text", "kind").select("doc_id", F.col("pos").cast("long").alias("pos"), "kind")


def bibliography_cut(spark, d):
    numbered = _lines(spark, d).withColumn("line", F.when(F.char_length("line") < 300, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("line"))).otherwise(F.col("line")))
    return chunking.bibliography_start(numbered, "doc_id", "pos", "line").select("doc_id", F.col("start").cast("long").alias("start"))


def chunk_pack_greedy(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper"), F.lit(0).alias("section_index"), F.lit("other").alias("section_type"), "text")
    return chunking.chunks(docs).groupBy("paper").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


def modal_weighted_size(spark, d):
    sized = _lines(spark, d).select("doc_id", (F.size(T.words(F.col("line"))) % 7).cast("long").alias("size"), F.char_length("line").alias("n"))
    weighed = sized.groupBy("doc_id", "size").agg(F.sum("n").alias("n"))
    return weighed.groupBy("doc_id").agg(F.max(F.struct("n", "size"))["size"].alias("body_size"))


def bm25_topk(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25(docs, q).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def best_snippet(spark, d):
    lines = _lines(spark, d).select(F.col("doc_id").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("line").alias("text"))
    return retrieval.best_snippets(lines, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))


def slug_node_id(spark, d):
    return table(spark, d, "part").select("p_partkey", T.node_id(F.col("p_type"), F.col("p_name")).alias("node_id"))


def normalize_name(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.plain_name(F.col("s_name")).alias("name"))


def _glossed(spark, d):
    p = table(spark, d, "part").withColumn("b", F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    name = F.concat("p_name", F.lit(" ("), F.upper(F.substring("b", -3, 3)), F.lit("X"), F.lit(")"))
    return p.select("p_partkey", name.alias("name"), "p_name")


def acronym_extract(spark, d):
    return _glossed(spark, d).select("p_partkey", T.acronym_of(F.col("name")).alias("acronym"), T.without_gloss(F.col("name")).alias("bare"))


def acronym_ambiguity(spark, d):
    g = _glossed(spark, d).select(T.acronym_of(F.col("name")).alias("acronym"), T.plain_name(T.without_gloss(F.col("name"))).alias("expansion")).filter("acronym is not null")
    return g.groupBy("acronym").agg(F.count_distinct("expansion").alias("expansions")).filter("expansions > 1")


def citation_extract_distinct(spark, d):
    p = table(spark, d, "pages")
    cites = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1))))
    return p.select("page_id", F.array_join(cites, ",").alias("cited"), F.size(cites).cast("long").alias("n"))


def html_sections(spark, d):
    p = table(spark, d, "pages")
    paras = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return p.select("page_id", F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("title"), F.size(paras).cast("long").alias("n_paragraphs"), F.aggregate(paras, F.lit(0), lambda s, x: s + F.char_length(x)).cast("long").alias("chars"))


def wellformed_violations(spark, d):
    """Rules on assistant turns as answers; ``[the]``-like handles stand for dangling ones."""
    a = table(spark, d, "conversations").filter("role = 'assistant'")
    bare = F.trim("text")
    rules = F.array(F.when(bare == "", "empty_text"), F.when((bare != "") & (F.char_length(bare) < 80), "text_too_short"), F.when(~F.contains("text", F.lit("[paper:")), "no_citations"), F.when(F.col("text").rlike(r"\[P\d+"), "dangling_handle"))
    return a.select("conv_id", "turn", F.explode(F.array_compact(rules)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_conversations"))


QUERIES = {f.__name__: f for f in (
    vec_topk_exact, vec_topk_postfilter_damped, router_chunks_per_paper, evidence_handles, knn_selfjoin_pairs, cross_group_pairs, l2_normalize,
    merge_batches_first_seen, classify_section_case, approx_token_count, sentence_split_counts, fragment_merge, positional_refine, bibliography_cut,
    chunk_pack_greedy, modal_weighted_size, bm25_topk, best_snippet, slug_node_id, normalize_name, acronym_extract, acronym_ambiguity,
    citation_extract_distinct, html_sections, wellformed_violations,
)}

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
_SIMS = f"""sims AS (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS raw, a.label AS la, b.label AS lb FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"""
_CHUNKS = """chunks AS (SELECT vec_id AS id, source AS paper, n_chars, CASE WHEN label % 2 = 0 THEN 'fulltext' ELSE 'abstract' END AS corpus, CASE WHEN label = 8 THEN 'availability' ELSE 'method' END AS section_type FROM embeddings JOIN documents ON doc_id = vec_id)"""
_RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches({{t}}, '(?i){p}') THEN '{k}'" for k, p in T.SECTION_RULES) + " ELSE 'other' END"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOPS}))"
_SENT = r"string_split(regexp_replace({t}, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
_SECTIONS = _LINES + f", secs AS (SELECT doc_id, pos, line AS text, {_RULES_SQL.format(t='line')} AS kind FROM lines WHERE trim(line, ' ') <> '')"
_TOK = r"round(len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')) / 0.75)::BIGINT"

ORACLE_SQL = {
    "vec_topk_exact": f"WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS rank FROM sims) SELECT qid, id, round(raw, 6) AS sim, rank FROM r WHERE rank <= 10",
    "vec_topk_postfilter_damped": f"""WITH {_CHUNKS}, {_SIMS}, r AS (SELECT qid, sims.id, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, sims.id) AS n FROM sims JOIN chunks ON sims.id = chunks.id),
s AS (SELECT qid, r.id, raw, round(raw * CASE WHEN section_type = 'availability' THEN 1.0 ELSE least(1.0, n_chars / 800.0) END::DOUBLE, 9) AS score FROM r JOIN chunks ON r.id = chunks.id WHERE n <= 50 AND corpus = 'fulltext'),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM t WHERE rank <= 10""",
    "router_chunks_per_paper": f"""WITH {_CHUNKS}, {_SIMS}, h AS (SELECT qid, chunks.id, paper, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, chunks.id) AS rank FROM sims JOIN chunks ON sims.id = chunks.id),
h60 AS (SELECT * FROM h WHERE rank <= 60), k AS (SELECT DISTINCT qid, paper FROM h WHERE rank <= 12),
n AS (SELECT h60.*, row_number() OVER (PARTITION BY qid, paper ORDER BY rank) AS nth FROM h60 SEMI JOIN k USING (qid, paper))
SELECT qid, paper, id, rank, nth FROM n WHERE nth <= 4""",
    "evidence_handles": f"""WITH {_CHUNKS}, {_SIMS}, h AS (SELECT qid, chunks.id, paper, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, chunks.id) AS rank FROM sims JOIN chunks ON sims.id = chunks.id),
f AS (SELECT *, min(rank) OVER (PARTITION BY qid, paper) AS first FROM h WHERE rank <= 20), g AS (SELECT *, 'P' || dense_rank() OVER (PARTITION BY qid ORDER BY first) AS handle FROM f)
SELECT qid, string_agg('[' || handle || '] chunk ' || id, chr(10) || chr(10) ORDER BY rank) AS evidence, count(DISTINCT paper) AS n_papers FROM g GROUP BY qid""",
    "knn_selfjoin_pairs": f"""WITH s AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS raw FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY raw DESC, y) AS n FROM s) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, round(raw, 6) AS sim FROM r WHERE n <= 5 AND raw >= 0.3""",
    "cross_group_pairs": f"""WITH s AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS raw, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY raw DESC, y) AS n FROM s) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, round(raw, 6) AS sim FROM r WHERE n <= 5 AND raw >= 0.3 AND la <> lb""",
    "l2_normalize": "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings) SELECT vec_id, (CASE WHEN l = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS unit, round(v[1] / CASE WHEN l = 0 THEN 1 ELSE l END, 6) AS first, round(l, 6) AS length FROM n",
    "merge_batches_first_seen": f"""WITH {_CHUNKS}, {_SIMS}, x AS (SELECT qid, sims.id, raw, corpus FROM sims JOIN chunks ON sims.id = chunks.id),
b AS (SELECT qid, id, CASE corpus WHEN 'fulltext' THEN 0 ELSE 1 END AS batch, row_number() OVER (PARTITION BY qid, corpus ORDER BY raw DESC, id) AS n FROM x UNION ALL SELECT qid, id, 2, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) FROM x),
f AS (SELECT qid, id, min(batch * 100 + n) AS seen FROM b WHERE n <= 5 GROUP BY ALL) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY seen, id) AS rank FROM f""",
    "classify_section_case": f"SELECT doc_id, {_RULES_SQL.format(t='split_part(text, chr(10), 1)')} AS section_type, 'results' AS titled FROM documents",
    "approx_token_count": f"SELECT doc_id, {_TOK.format(t='text')} AS tokens FROM documents",
    "sentence_split_counts": f"SELECT doc_id, len({_SENT.format(t='text')}) AS n_sentences, list_max(list_transform({_SENT.format(t='text')}, lambda x: length(x))) AS longest FROM documents",
    "fragment_merge": f"""WITH {_SECTIONS}, m AS (SELECT *, kind = 'other' AND length(trim(text, ' ')) < 200 AS small FROM secs),
l AS (SELECT *, last_value(CASE WHEN NOT small THEN kind END IGNORE NULLS) OVER w AS lastk, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, (NOT small OR lastk IN ('references', 'acknowledgments') OR (lastk IS NULL AND rn = 1)) AS opens FROM l),
i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM o)
SELECT doc_id, min(pos)::BIGINT AS pos, arg_min(kind, pos) AS kind, (sum(length(text)) + count(*) - 1)::BIGINT AS chars, count(*) AS n_parts FROM i GROUP BY doc_id, island""",
    "positional_refine": f"""WITH {_SECTIONS}, f AS (SELECT *, min(CASE WHEN kind = 'other' THEN pos END) OVER (PARTITION BY doc_id) AS first FROM secs),
k AS (SELECT doc_id, pos, text, CASE WHEN kind = 'other' AND pos = first THEN 'introduction' ELSE kind END AS kind FROM f),
h AS (SELECT *, bool_or(kind IN ('conclusion', 'discussion', 'limitations')) OVER (PARTITION BY doc_id) AS has, max(CASE WHEN kind NOT IN ('references', 'appendix', 'acknowledgments', 'availability') THEN pos END) OVER (PARTITION BY doc_id) AS lastp FROM k)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN NOT has AND pos = lastp AND kind = 'other' AND length(trim(text, ' ')) >= 400 THEN 'conclusion' ELSE kind END AS kind FROM h""",
    "bibliography_cut": rf"""WITH {_LINES}, n AS (SELECT doc_id, pos, CASE WHEN length(line) < 300 THEN '[' || pos || '] ' || line ELSE line END AS line FROM lines),
e AS (SELECT *, regexp_matches(line, '^\s*\[\d{{1,3}}\]') AS entry FROM n),
r AS (SELECT *, sum(entry::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS near FROM e)
SELECT doc_id, min(pos)::BIGINT AS start FROM r WHERE entry AND near >= 3 GROUP BY doc_id""",
    "modal_weighted_size": rf"""WITH {_LINES}, s AS (SELECT doc_id, (len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) % 7)::BIGINT AS size, length(line) AS n FROM lines), w AS (SELECT doc_id, size, sum(n) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC) AS k FROM w) SELECT doc_id, size AS body_size FROM r WHERE k = 1""",
    "bm25_topk": f"""WITH t AS (SELECT doc_id AS id, {_TERMS.format(t='text')} AS terms FROM documents), d AS (SELECT id, len(terms) AS dl FROM t), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
x AS (SELECT id, unnest(terms) AS term FROM t), tf AS (SELECT id, term, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TERMS.format(t='text')}) AS term FROM benchmark),
s AS (SELECT qid, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN d USING (id) JOIN q USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, score, rank FROM r WHERE rank <= 12""",
    "best_snippet": f"""WITH {_LINES}, c AS (SELECT DISTINCT doc_id AS id, pos, unnest({_TERMS.format(t='line')}) AS term FROM lines), q AS (SELECT DISTINCT item_id AS qid, unnest({_TERMS.format(t='text')}) AS term FROM benchmark),
h AS (SELECT qid, id, pos, count(*) AS hits FROM c JOIN q USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY hits DESC, pos) AS n FROM h) SELECT qid, id, pos::BIGINT AS pos, hits FROM r WHERE n = 1""",
    "slug_node_id": "SELECT p_partkey, lower(p_type) || ':' || substr(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS node_id FROM part",
    "normalize_name": "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM supplier",
    "acronym_extract": "WITH g AS (SELECT p_partkey, p_name || ' (' || upper(right(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), 3)) || 'X)' AS name FROM part) SELECT p_partkey, upper(nullif(regexp_extract(name, '\\(([A-Z][A-Za-z0-9\\-]{1,9})s?\\)\\s*$', 1), '')) AS acronym, regexp_replace(name, '\\s*\\(([A-Z][A-Za-z0-9\\-]{1,9})s?\\)\\s*$', '') AS bare FROM g",
    "acronym_ambiguity": "WITH g AS (SELECT p_name || ' (' || upper(right(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), 3)) || 'X)' AS name FROM part), a AS (SELECT nullif(regexp_extract(name, '\\(([A-Z][A-Za-z0-9\\-]{1,9})s?\\)\\s*$', 1), '') AS acronym, trim(regexp_replace(lower(regexp_replace(name, '\\s*\\(([A-Z][A-Za-z0-9\\-]{1,9})s?\\)\\s*$', '')), '[^a-z0-9]+', ' ', 'g')) AS expansion FROM g) SELECT acronym, count(DISTINCT expansion) AS expansions FROM a WHERE acronym IS NOT NULL GROUP BY acronym HAVING count(DISTINCT expansion) > 1",
    "citation_extract_distinct": "WITH c AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1))) AS l FROM pages) SELECT page_id, array_to_string(l, ',') AS cited, len(l) AS n FROM c",
    "html_sections": "SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS n_paragraphs, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: length(x))), 0)::BIGINT AS chars FROM pages",
    "wellformed_violations": r"""WITH a AS (SELECT conv_id, text, trim(text, ' ') AS b FROM conversations WHERE role = 'assistant'), v AS (
SELECT conv_id, 'empty_text' AS code FROM a WHERE b = '' UNION ALL SELECT conv_id, 'text_too_short' FROM a WHERE b <> '' AND length(b) < 80 UNION ALL SELECT conv_id, 'no_citations' FROM a WHERE NOT contains(text, '[paper:') UNION ALL SELECT conv_id, 'dangling_handle' FROM a WHERE regexp_matches(text, '\[P\d+'))
SELECT code, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM v GROUP BY code""",
}
