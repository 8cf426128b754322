"""End-to-end arms, embedding, adjudication and streaming over the fixture tables; no SQL form, so rows only.

Documents are the papers, packed into chunks by ``chunking.chunks``, benchmark items the questions. Each
document also gives a Paper node, a Claim node per passage and citations of two earlier documents; sources
are Method nodes. Passages are the sentences, those over 600 characters in parts, so that every word is in
the name and the quote of a claim. Claims are provided by their papers, which address methods.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as T
from ..functions.storage import shared_dir, written
from ..operators import adjudication, arms, chunking
from ..sources import vectors
from ..streaming import ingest
from . import text_queries
from .text_queries import table


QUOTE = 600


def _passages(docs):
    """(doc_id, source, n, passage): all sentences in order, long ones in parts of at most ``QUOTE`` characters, between words where there are."""
    parts = F.transform(T.sentences(F.col("text")), lambda s: F.regexp_extract_all(s, F.lit(rf"(?s)\S.{{0,{QUOTE - 1}}}(?=\s|\z)|\S{{1,{QUOTE}}}"), F.lit(0)))
    return docs.select("doc_id", "source", F.posexplode_outer(F.flatten(parts)).alias("n", "passage")).filter("n is not null")  # outer: no inferred filter splits every text again


def _library(spark, d) -> arms.Library:
    docs = table(spark, d, "documents")
    paper = F.col("doc_id").cast("string")
    short = F.char_length(F.trim("text")) < chunking.MIN_CHUNK  # such a document has no chunk; it is one
    chunks = None
    for corpus, some in (("abstract", docs.filter("n_chars < 400")), ("fulltext", docs.filter("n_chars >= 400 or n_chars is null"))):
        sections = some.select(paper.alias("paper"), F.lit(0).alias("section_index"), F.lit("other").alias("section_type"), "text")
        packed = chunking.chunks(sections).select("id", "paper", "text", "section_type")
        whole = some.filter(short).select(F.concat(paper, F.lit("::whole")).alias("id"), paper.alias("paper"), "text", F.lit("other").alias("section_type"))
        both = packed.unionByName(whole).select("id", "paper", "text", F.lit(corpus).alias("corpus"), "section_type")
        chunks = both if chunks is None else chunks.unionByName(both)
    layer = F.lit("curated").alias("source_layer")
    passages = written(_passages(docs), "passages")  # found once; nodes and edges read it
    first = passages.filter("n = 0").select(F.col("doc_id"), "passage")
    papers = docs.join(first, "doc_id", "left").select(F.concat(F.lit("paper:"), paper).alias("id"), F.lit("Paper").alias("type"), F.coalesce("passage", F.lit("")).alias("name"), paper.alias("from_paper"), F.coalesce("passage", F.lit("")).alias("quote"), layer)
    claim = F.concat(F.lit("claim:"), paper, F.lit(":"), F.col("n").cast("string"))
    claims = passages.select(claim.alias("id"), F.lit("Claim").alias("type"), F.col("passage").alias("name"), paper.alias("from_paper"), F.col("passage").alias("quote"), layer)
    methods = docs.groupBy("source").agg(F.min("doc_id").cast("string").alias("p")).select(F.concat(F.lit("method:"), "source").alias("id"), F.lit("Method").alias("type"), F.col("source").alias("name"), F.col("p").alias("from_paper"), F.lit("").alias("quote"), layer)
    conf = (0.5 + F.col("doc_id") % 50 / 100.0).alias("confidence")
    stated = passages.select(claim.alias("src"), F.concat(F.lit("paper:"), paper).alias("dst"), F.lit("provides").alias("type"), conf, layer)
    made = docs.select(F.concat(F.lit("paper:"), paper).alias("src"), F.concat(F.lit("method:"), "source").alias("dst"), F.lit("addresses").alias("type"), conf, layer)
    ids = docs.select(F.col("doc_id").alias("cited"))
    cites = docs.filter("doc_id > 1").select("doc_id", F.explode(F.array(F.expr("doc_id div 2"), F.expr("doc_id div 3"))).alias("cited")).filter("cited <> doc_id").join(ids, "cited", "left_semi")
    cites = cites.select(F.concat(F.lit("paper:"), paper).alias("src"), F.concat(F.lit("paper:"), F.col("cited").cast("string")).alias("dst"), F.lit("cites").alias("type"), conf, layer).distinct()
    chunks = vectors.build_vectors(chunks, embedding.hash_embed, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}").load()
    return arms.Library(chunks, papers.unionByName(claims).unionByName(methods), stated.unionByName(made).unionByName(cites))


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")


def _arm(name):
    def run(spark, d):
        return arms.build_arm(name)(_library(spark, d), _questions(spark, d))

    run.__name__ = f"arm_{name}"
    return run


def agentic_answer(spark, d):
    return arms.build_arm("agentic")(_library(spark, d), _questions(spark, d))


def staged_plan(spark, d):
    q = _questions(spark, d)
    nodes, edges = arms.staged_plan(arms.build_arm("agentic_no_critique")(_library(spark, d), q), q)
    return nodes.groupBy("source_layer").agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def hash_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", embedding.hash_embed(F.col("text")).alias("vector"))


def folded_names(spark, d):
    return table(spark, d, "documents").select("doc_id", embedding.folded_name(F.col("text")).alias("name"))


def adjudicated_pairs(spark, d):
    """Near pairs judged by a rule in the model's place, a third of the verdicts from a cache."""
    pairs = written(text_queries.knn_selfjoin_pairs(spark, d), "pairs").select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.concat(F.lit("v"), F.col("a").cast("string")).alias("a_text"), F.concat(F.lit("v"), F.col("b").cast("string")).alias("b_text"), F.col("sim").alias("similarity"))
    cache = pairs.filter("a_id % 3 = 0").select(adjudication.cache_key("v1", F.col("a_text"), F.col("b_text"), True).alias("key"), F.lit("refutes").alias("verdict"), F.lit("cached").alias("reason"))
    found = adjudication.adjudicate(pairs, cache, lambda a, b: ("undercuts" if len(a) == len(b) else "unheard of", "by rule"), adjudication.CONTRADICTION, "v1", True)
    return adjudication.contradiction_edges(found).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def stream_dedup_ingest(spark, d):
    """Events as a stream: first row per (user, type) within the watermark, written once and read back."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    keyed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    ingest.run_once(ingest.first_seen(keyed, "key", "ts", "40 days"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("key").distinct()


QUERIES = {f.__name__: f for f in (*map(_arm, [a for a in arms.ARMS if a != "agentic"]), agentic_answer, staged_plan, hash_embed, folded_names, adjudicated_pairs, stream_dedup_ingest)}
ORACLE_SQL = {
    "adjudicated_pairs": f"WITH k AS ({text_queries.ORACLE_SQL['knn_selfjoin_pairs']}) SELECT CASE WHEN a % 3 = 0 THEN 'refutes' ELSE 'undercuts' END AS type, count(*) AS n FROM k WHERE a % 3 = 0 OR length(a::VARCHAR) = length(b::VARCHAR) GROUP BY 1",
    "stream_dedup_ingest": "SELECT DISTINCT user_id || ':' || event_type AS key FROM events",
}
