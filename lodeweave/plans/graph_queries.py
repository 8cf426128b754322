"""Queries on the graph, resolution and extraction over the fixture tables, with their SQL twins.

The star schema stands for the typed graph: customers, orders, parts, suppliers, nations and regions
are nodes; relations are edges; discounts give confidences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import parts_of
from ..operators import extraction, graph, resolution, retrieval
from .text_queries import table


def _edges(spark, d):
    """src, dst, type, confidence of the typed graph."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in_region").alias("type"), F.lit(1.0).alias("confidence"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("supplier_of").alias("type"), F.round(0.5 + F.pmod(F.col("s_suppkey"), F.lit(50)) / 100.0, 2).alias("confidence"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("customer_of").alias("type"), F.round(0.5 + F.pmod(F.col("c_custkey"), F.lit(50)) / 100.0, 2).alias("confidence"))
    return n.unionByName(s).unionByName(c)


def _nodes(spark, d):
    e = _edges(spark, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kind = F.substring("id", 1, 1)
    number = F.substring("id", 2, 20).cast("bigint")
    return ids.select("id", kind.alias("type"), F.when((kind == "c") & (number % 10 == 3), "staged").otherwise("curated").alias("source_layer"))


def bfs_two_hop_undirected(spark, d):
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    out = graph.expand(seeds, _edges(spark, d).filter("type <> 'customer_of'"), hops=2, cap=1_000_000)
    return out.select("qid", "id", F.col("hop").cast("long").alias("hop"), "via")


def bfs_cap_by_confidence(spark, d):
    seeds = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("r"), "r_regionkey").alias("id"))
    ok = graph.curated(_nodes(spark, d))
    out = graph.expand(seeds, _edges(spark, d), hops=2, cap=40, node_filter=ok)
    return out.select("qid", "id", F.col("hop").cast("long").alias("hop"), "via")


def cites_bfs_cap(spark, d):
    """Citations of every known part, walked from every part; the cap is the operator's."""
    part = table(spark, d, "part").select("p_partkey")
    seeds = part.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    li = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    cites = li.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.lit("cites").alias("type"), F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"))
    out = graph.expand(seeds, cites, hops=2, cap=30)
    return out.select("qid", "id", F.col("hop").cast("long").alias("hop"))


def degree_top10(spark, d):
    return graph.degree(_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(10)


def induced_subgraph(spark, d):
    ids = _nodes(spark, d).filter("type in ('n', 'r')").select("id")
    return graph.induced(_edges(spark, d), ids).select("src", "dst", "type")


def graph_type_counts(spark, d):
    n = _nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "type", "n")
    return n.unionByName(_edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def layer_separation_invariant(spark, d):
    return graph.layer_counts(_nodes(spark, d))


def promote_staged(spark, d):
    out, _ = graph.promote(_nodes(spark, d), approved=True)
    return out.groupBy("type").agg(F.count_if(F.col("source_layer") == "curated").alias("curated"), F.count_if(F.col("source_layer") == "staged").alias("staged"))


def upsert_last_writer(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag", "l_quantity")
    return graph.last_writer(rows, ["id"], "seq")


def edge_merge_drop_dangling(spark, d):
    nodes = table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("p"), "p_partkey").alias("id")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    li = table(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_discount")
    return graph.merge_edges(edges, nodes, "seq")


def _papers(spark, d):
    """Orders as papers: the clerk-like priority as venue, the customer as author, parts as references; in-corpus parts have small keys."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = parts_of(li)
    li = li.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))).alias("references"))
    o = o.select("o_orderkey", "o_orderpriority", "o_custkey").repartition(parts, "o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("venue"), F.array(F.col("o_custkey").cast("string")).alias("authors"), "references")


def tier_a_edges_union(spark, d):
    _, edges = graph.metadata_graph(_papers(spark, d))
    return edges


def tier_a_nodes(spark, d):
    nodes, _ = graph.metadata_graph(_papers(spark, d))
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def cites_in_corpus_semi(spark, d):
    _, edges = graph.metadata_graph(_papers(spark, d))
    return edges.filter("type = 'cites'").groupBy("dst").agg(F.count(F.lit(1)).alias("citers"))


def cocitation_hubs_anti(spark, d):
    return graph.cocitation_hubs(_papers(spark, d), least=10)


def citation_density_report(spark, d):
    p = _papers(spark, d)
    refs = p.select("id", F.explode("references").alias("ref")).join(p.select(F.col("id").alias("ref"), F.lit(1).alias("hit")), "ref", "left")
    per = refs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("inside"))
    out = per.agg(F.sum("n").alias("refs"), F.sum("inside").alias("inside"), F.count(F.lit(1)).alias("papers"), F.count_if(F.col("inside") > 0).alias("linked"))
    deg = F.col("inside") / F.col("papers")
    return out.select("refs", "inside", F.round(F.col("inside") / F.col("refs"), 6).alias("share"), F.round(deg, 6).alias("out_degree"), "linked", F.round(deg + deg * deg, 6).alias("two_hop_reach"), (deg >= 2.5).alias("dense"))


def connected_components_min(spark, d):
    from . import text_queries

    pairs = text_queries.knn_selfjoin_pairs(spark, d)
    return graph.components(pairs, "a", "b").select("node", "root")


def _entities(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Method").alias("type"), F.concat("p_type", F.when(F.col("p_partkey") % 5 == 0, F.lit(" (PT)")).otherwise(F.lit(""))).alias("name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Dataset").alias("type"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("SUP")).when(F.col("s_suppkey") % 4 == 1, F.lit("Supplier Unit (SUP)")).otherwise(F.col("s_name")).alias("name"))
    return p.unionByName(s)


def entity_map_canonical(spark, d):
    return resolution.entity_map(_entities(spark, d))


def merge_log_by_rule(spark, d):
    return resolution.entity_map(_entities(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("to_id").alias("targets"))


def remap_edges_drop_selfloops(spark, d):
    m = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("from_id"), F.concat(F.lit("p"), F.col("p_partkey") - F.col("p_partkey") % 10 + 1).alias("to_id")).filter("from_id <> to_id")
    li = table(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("p"), F.lag("l_partkey").over(_line_order())).alias("dst")).filter("dst is not null")
    return resolution.remap_edges(edges, m).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _line_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")


def attrs_json_parse(spark, d):
    a = T.flat_attrs(F.col("props"))
    return table(spark, d, "events").select("event_id", a["k"].alias("k"), F.size(F.map_keys(a)).cast("long").alias("n"))


def confidence_clamp(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("high")).otherwise((F.col("value") / 50).cast("string"))
    return table(spark, d, "events").select("event_id", F.round(T.confidence(raw), 6).alias("confidence"))


def _payload(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("unit"), F.col("event_id").alias("ord"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 13).cast("string")).alias("name"), F.round((F.col("event_id") % 100) / 100.0, 2).alias("confidence"))


def confidence_gate_edges(spark, d):
    nodes = extraction.gate_nodes(_payload(spark, d))
    p = _payload(spark, d)
    edges = p.select("unit", F.col("name").alias("src_name"), F.concat("type", F.lit(" "), (F.col("ord") % 11).cast("string")).alias("dst_name"), F.round((F.col("ord") % 37) / 37.0, 2).alias("confidence"), "ord")
    return extraction.gate_edges(edges, nodes, "unit").select("ord", "src_id", "dst_id", "confidence")


def node_dedup_max_conf(spark, d):
    nodes = extraction.gate_nodes(_payload(spark, d))
    return extraction.best_nodes(nodes, ["unit", "name"]).select("unit", "name", "id", "confidence")


def routing_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.classify_section(F.col("source")).alias("section_type"), F.col("lang").alias("text"))
    p = extraction.prompts(docs)
    return p.groupBy("section_type", "hint").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("node_types")).cast("long").alias("asked"))


def planner_hints_topk(spark, d):
    """Methods on curated edges, distinct by name and confidence, the 200 surest, then the 8 nearest to each query vector."""
    v = table(spark, d, "embeddings")
    named = v.select(F.col("vec_id"), F.concat(F.lit("method "), (F.col("vec_id") % 97).cast("string")).alias("name"), F.round(0.5 + F.col("vec_id") % 50 / 100.0, 2).alias("confidence"), "embedding", "label")
    hints = named.filter("label <> 3").groupBy("name", "confidence").agg(F.min("vec_id").alias("vec_id"))
    top = hints.orderBy(F.desc("confidence"), "name").limit(200).join(v.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = retrieval.nearest(q, top.select(F.col("vec_id").alias("id"), "vector"), 8)
    return found.join(top.select(F.col("vec_id").alias("id"), "name", "confidence"), "id").select("qid", "name", "confidence", F.round("raw", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (
    bfs_two_hop_undirected, bfs_cap_by_confidence, cites_bfs_cap, degree_top10, induced_subgraph, graph_type_counts, layer_separation_invariant, promote_staged,
    upsert_last_writer, edge_merge_drop_dangling, tier_a_edges_union, tier_a_nodes, cites_in_corpus_semi, cocitation_hubs_anti, citation_density_report,
    connected_components_min, entity_map_canonical, merge_log_by_rule, remap_edges_drop_selfloops, attrs_json_parse, confidence_clamp, confidence_gate_edges,
    node_dedup_max_conf, routing_join, planner_hints_topk,
)}

_EDGES = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS type, 1.0::DOUBLE AS confidence FROM nation UNION ALL
SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier_of', round(0.5 + (s_suppkey % 50) / 100.0, 2)::DOUBLE FROM supplier UNION ALL
SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer_of', round(0.5 + (c_custkey % 50) / 100.0, 2)::DOUBLE FROM customer)"""
_NODES = _EDGES + """, nodes AS (SELECT id, id[1] AS type, CASE WHEN id[1] = 'c' AND id[2:]::BIGINT % 10 = 3 THEN 'staged' ELSE 'curated' END AS source_layer FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"""
_PAPERS = """refs AS (SELECT DISTINCT l_orderkey::VARCHAR AS id, l_partkey::VARCHAR AS ref FROM lineitem), corpus AS (SELECT DISTINCT o_orderkey::VARCHAR AS id, o_orderpriority AS venue, o_custkey::VARCHAR AS author FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), cut AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ref) AS n FROM refs)"""
_ENT = """e AS (SELECT 'p' || p_partkey AS id, 'Method' AS type, p_type || CASE WHEN p_partkey % 5 = 0 THEN ' (PT)' ELSE '' END AS name FROM part UNION ALL SELECT 's' || s_suppkey, 'Dataset', CASE WHEN s_suppkey % 4 = 0 THEN 'SUP' WHEN s_suppkey % 4 = 1 THEN 'Supplier Unit (SUP)' ELSE s_name END FROM supplier),
b AS (SELECT id, type, trim(regexp_replace(lower(regexp_replace(name, '\\s*\\(([A-Z][A-Za-z0-9\\-]{1,9})s?\\)\\s*$', '')), '[^a-z0-9]+', ' ', 'g')) AS norm, upper(nullif(regexp_extract(name, '\\(([A-Z][A-Za-z0-9\\-]{1,9})s?\\)\\s*$', 1), '')) AS acro, upper(trim(name)) AS bare FROM e),
h AS (SELECT type, norm, min(id) AS to_id FROM b WHERE norm <> '' GROUP BY ALL), u AS (SELECT acro, min(norm) AS norm FROM b WHERE acro IS NOT NULL GROUP BY acro HAVING count(DISTINCT norm) = 1),
m AS (SELECT b.id, to_id, 'name' AS rule, 1 AS prio FROM b JOIN h USING (type, norm) WHERE b.id <> to_id UNION ALL SELECT b.id, to_id, 'acronym', 2 FROM b JOIN u ON b.bare = u.acro AND b.acro IS NULL JOIN h ON h.type = b.type AND h.norm = u.norm WHERE b.id <> to_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, to_id) AS n FROM m), em AS (SELECT id AS from_id, to_id, rule FROM r WHERE n = 1)"""
_PAY = "p AS (SELECT user_id AS unit, event_id AS ord, event_type || ':' || event_id AS id, event_type AS type, event_type || ' ' || (event_id % 13) AS name, round((event_id % 100) / 100.0, 2)::DOUBLE AS confidence FROM events)"


def _hop(front: str, reached: str, ways: str, hop: int) -> str:
    return f"SELECT qid, dst AS id, {hop} AS hop, arg_max(type, struct_pack(c := confidence, t := type)) AS via, max(confidence) AS conf FROM {front} f JOIN {ways} w ON f.id = w.src WHERE NOT EXISTS (SELECT 1 FROM {reached} x WHERE x.qid = f.qid AND x.id = w.dst) GROUP BY qid, dst"


def _bfs(seeds: str, cap: int) -> str:
    top = "SELECT qid, id, hop, via, conf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, conf DESC, id) AS n FROM {}) WHERE n <= " + str(cap)
    return f"s0 AS (SELECT qid, id, 0 AS hop, NULL::VARCHAR AS via, 2.0::DOUBLE AS conf FROM ({seeds})), h1 AS ({_hop('s0', 's0', 'ways', 1)}), a1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM h1), r1 AS ({top.format('a1')}), f1 AS (SELECT * FROM r1 WHERE hop = 1), h2 AS ({_hop('f1', 'r1', 'ways', 2)}), a2 AS (SELECT * FROM r1 UNION ALL SELECT * FROM h2), r2 AS ({top.format('a2')})"


def _ways(edges: str) -> str:
    return f"ways AS (SELECT src, dst, type, confidence FROM {edges} UNION ALL SELECT dst, src, type, confidence FROM {edges})"


ORACLE_SQL = {
    "bfs_two_hop_undirected": f"WITH {_EDGES}, e2 AS (SELECT * FROM edges WHERE type <> 'customer_of'), {_ways('e2')}, {_bfs('''SELECT s_suppkey AS qid, 's' || s_suppkey AS id FROM supplier''', 1000000)} SELECT qid, id, hop::BIGINT AS hop, via FROM r2",
    "bfs_cap_by_confidence": f"WITH {_NODES}, {_ways('edges').replace('ways AS', 'w0 AS')}, ways AS (SELECT w0.* FROM w0 JOIN nodes ON dst = id WHERE source_layer = 'curated'), {_bfs('''SELECT r_regionkey AS qid, 'r' || r_regionkey AS id FROM region''', 40)} SELECT qid, id, hop::BIGINT AS hop, via FROM r2",
    "cites_bfs_cap": f"WITH e2 AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'cites' AS type, max(round(1 - l_discount, 2)) AS confidence FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL), {_ways('e2')}, {_bfs('''SELECT p_partkey AS qid, 'p' || p_partkey AS id FROM part''', 30)} SELECT qid, id, hop::BIGINT AS hop FROM r2",
    "degree_top10": f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 10",
    "induced_subgraph": f"WITH {_EDGES} SELECT src, dst, type FROM edges WHERE src[1] IN ('n', 'r') AND dst[1] IN ('n', 'r')",
    "graph_type_counts": f"WITH {_NODES} SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "layer_separation_invariant": f"WITH {_NODES} SELECT count(*) AS total, count(*) FILTER (source_layer = 'curated') AS curated, count(*) FILTER (source_layer = 'staged') AS staged FROM nodes",
    "promote_staged": f"WITH {_NODES} SELECT type, count(*) AS curated, 0::BIGINT AS staged FROM nodes GROUP BY type",
    "upsert_last_writer": "WITH r AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, l_returnflag, l_quantity FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, l_returnflag DESC, l_quantity DESC) AS n FROM r) SELECT id, seq, l_returnflag, l_quantity FROM k WHERE n = 1",
    "edge_merge_drop_dangling": "WITH r AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS seq, l_discount FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier)), k AS (SELECT *, row_number() OVER (PARTITION BY src, type, dst ORDER BY seq DESC, l_discount DESC) AS n FROM r) SELECT src, dst, type, seq, l_discount FROM k WHERE n = 1",
    "tier_a_edges_union": f"WITH {_PAPERS} SELECT DISTINCT * FROM (SELECT 'paper:' || id AS src, 'venue:' || venue AS dst, 'published_in' AS type FROM corpus UNION ALL SELECT 'author:' || author, 'paper:' || id, 'authored_by' FROM corpus UNION ALL SELECT 'paper:' || cut.id, 'paper:' || ref, 'cites' FROM cut WHERE n <= 200 AND id IN (SELECT id FROM corpus) AND ref IN (SELECT id FROM corpus))",
    "tier_a_nodes": f"WITH {_PAPERS} SELECT 'Paper' AS type, count(DISTINCT id) AS n FROM corpus UNION ALL SELECT 'Author', count(DISTINCT author) FROM corpus UNION ALL SELECT 'Venue', count(DISTINCT venue) FROM corpus",
    "cites_in_corpus_semi": f"WITH {_PAPERS} SELECT 'paper:' || ref AS dst, count(DISTINCT cut.id) AS citers FROM cut WHERE n <= 200 AND id IN (SELECT id FROM corpus) AND ref IN (SELECT id FROM corpus) GROUP BY ref",
    "cocitation_hubs_anti": f"WITH {_PAPERS} SELECT ref, count(*) AS n FROM refs WHERE id IN (SELECT id FROM corpus) AND NOT EXISTS (SELECT 1 FROM corpus WHERE corpus.id = ref) GROUP BY ref HAVING count(*) >= 10",
    "citation_density_report": f"WITH {_PAPERS}, x AS (SELECT refs.id, count(*) AS n, count(c2.id) AS inside FROM refs JOIN corpus c1 ON refs.id = c1.id LEFT JOIN corpus c2 ON refs.ref = c2.id GROUP BY refs.id), t AS (SELECT sum(n)::BIGINT AS refs, sum(inside)::BIGINT AS inside, count(*) AS papers, count(*) FILTER (inside > 0) AS linked FROM x) SELECT refs, inside, round(inside / refs, 6) AS share, round(inside / papers, 6) AS out_degree, linked, round(inside / papers + (inside / papers) * (inside / papers), 6) AS two_hop_reach, inside / papers >= 2.5 AS dense FROM t",
    "connected_components_min": """WITH RECURSIVE s AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS raw FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY raw DESC, y) AS n FROM s), p AS (SELECT x, y FROM r WHERE n <= 5 AND raw >= 0.3 UNION SELECT y, x FROM r WHERE n <= 5 AND raw >= 0.3),
c(node, root) AS (SELECT DISTINCT x, x FROM p UNION SELECT p.y, c.root FROM c JOIN p ON c.node = p.x) SELECT node, min(root) AS root FROM c GROUP BY node""",
    "entity_map_canonical": f"WITH {_ENT} SELECT from_id, to_id, rule FROM em",
    "merge_log_by_rule": f"WITH {_ENT} SELECT rule, count(*) AS n, count(DISTINCT to_id) AS targets FROM em GROUP BY rule",
    "remap_edges_drop_selfloops": "WITH l AS (SELECT l_partkey AS a, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem), k AS (SELECT CASE WHEN a IN (SELECT p_partkey FROM part) THEN a - a % 10 + 1 ELSE a END AS a, CASE WHEN b IN (SELECT p_partkey FROM part) THEN b - b % 10 + 1 ELSE b END AS b FROM l WHERE b IS NOT NULL) SELECT 'p' || a AS src, 'p' || b AS dst, count(*) AS n FROM k WHERE a <> b GROUP BY ALL",
    "attrs_json_parse": "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n FROM events",
    "confidence_clamp": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.5::DOUBLE ELSE round(least(greatest(value / 50, 0.0::DOUBLE), 1.0::DOUBLE), 6) END AS confidence FROM events",
    "confidence_gate_edges": f"WITH {_PAY}, n AS (SELECT * FROM p WHERE confidence >= 0.65), m AS (SELECT unit, lower(name) AS k, arg_max(id, ord) AS id FROM n GROUP BY ALL), e AS (SELECT unit, name AS s, type || ' ' || (ord % 11) AS t, round((ord % 37) / 37.0, 2)::DOUBLE AS confidence, ord FROM p) SELECT ord, a.id AS src_id, b.id AS dst_id, e.confidence FROM e JOIN m a ON a.unit = e.unit AND a.k = lower(e.s) JOIN m b ON b.unit = e.unit AND b.k = lower(e.t) WHERE e.confidence >= 0.5 AND a.id <> b.id",
    "node_dedup_max_conf": f"WITH {_PAY}, k AS (SELECT *, row_number() OVER (PARTITION BY unit, name ORDER BY confidence DESC, ord) AS n FROM p WHERE confidence >= 0.65) SELECT unit, name, id, confidence FROM k WHERE n = 1",
    "routing_join": "SELECT 'other' AS section_type, true AS hint, count(*) AS n, 5::BIGINT AS asked FROM documents",
    "planner_hints_topk": """WITH h AS (SELECT 'method ' || (vec_id % 97) AS name, round(0.5 + (vec_id % 50) / 100.0, 2)::DOUBLE AS confidence, min(vec_id) AS id FROM embeddings WHERE label <> 3 GROUP BY ALL), t AS (SELECT * FROM h ORDER BY confidence DESC, name LIMIT 200),
s AS (SELECT q.vec_id AS qid, t.*, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS raw FROM embeddings q, t JOIN embeddings v ON v.vec_id = t.id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS rank FROM s)
SELECT qid, name, confidence, round(raw, 6) AS sim, rank FROM r WHERE rank <= 8""",
}
