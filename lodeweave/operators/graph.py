"""The property graph: nodes and edges as tables, their upserts, traversal and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import parts_of, written

CURATED, STAGED = "curated", "staged"


def curated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source_layer") == CURATED)


def last_writer(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: all columns of the row written last."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(seq, *[c for c in rest if c != seq])).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.`{c}`").alias(c) for c in rest]).select(*rows.columns)


def merge_edges(edges: DataFrame, nodes: DataFrame, seq: str) -> DataFrame:
    """Edges with both ends among the nodes, the last written one per (src, type, dst)."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return last_writer(kept.select(*edges.columns), ["src", "type", "dst"], seq)


def promote(nodes: DataFrame, ids: list[str] | None = None, *, approved: bool = False) -> tuple[DataFrame, int]:
    """Staged nodes (all or those named) become curated; nothing happens without approval."""
    if not approved:
        raise PermissionError("promotion needs approved=True")
    moved = F.col("source_layer") == STAGED
    if ids is not None:
        moved = moved & F.col("id").isin(ids)
    count = nodes.filter(moved).count()
    return nodes.withColumn("source_layer", F.when(moved, CURATED).otherwise(F.col("source_layer"))), count


def layer_counts(nodes: DataFrame) -> DataFrame:
    """total, curated and staged: the first is the sum of the others."""
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source_layer") == CURATED).alias("curated"), F.count_if(F.col("source_layer") == STAGED).alias("staged"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s"))


#: Neighbours of a node are kept in blocks of so many; a query that has met at most ``FEW`` nodes carries them along.
BLOCK, FEW = 256, 64
#: Rows that one task of a walk takes in; a front of so many nodes is sent to the edges, a larger one meets all of them in a shuffle.
TASK_ROWS, SENT_NODES = 1 << 20, 50_000


def _neighbours(edges: DataFrame, node_filter: DataFrame | None, front: DataFrame | None = None) -> DataFrame:
    """(src, block, met): neighbours of every node, or of those of a small front (src), over its best edge to each, in written blocks of (id, conf, via)."""
    ways = both_ways(edges.select("src", "dst", "type", "confidence"))
    if front is not None:
        ways = ways.join(F.broadcast(front), "src").select(*ways.columns)
    if node_filter is not None and front is None:
        ways = ways.join(node_filter.select(F.col("id").alias("dst")), "dst", "left_semi")
    elif node_filter is not None:
        ways = written(ways, "touched")
        met = written(ways.select("dst").distinct(), "met")
        few = met.count() <= SENT_NODES
        known = node_filter.select(F.col("id").alias("dst")).join(F.broadcast(met) if few else met, "dst").distinct()
        ways = ways.join(F.broadcast(known) if few else known, "dst", "left_semi")
    dealt = ways.filter("src is not null").repartition(parts_of(edges), "src") if front is None else ways
    best = dealt.groupBy("src", "dst").agg(F.max(F.struct("confidence", "type")).alias("e"))
    block = F.floor((F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1) / BLOCK)
    met = F.struct(F.col("dst").alias("id"), F.col("e.confidence").alias("conf"), F.col("e.type").alias("via"))
    return written(best.withColumn("block", block).groupBy("src", "block").agg(F.collect_list(met).alias("met")), "ways")


def _tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (each >> 6) + 1), -(-rows // each))


def _pairs(front: DataFrame, near: DataFrame) -> int:
    """How many (query, neighbour) rows the front (src) meets."""
    degree = near.groupBy("src").agg(F.sum(F.size("met")).alias("d"))
    return front.groupBy("src").agg(F.count(F.lit(1)).alias("f")).join(degree, "src").agg(F.sum(F.col("f") * F.col("d"))).first()[0] or 0


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, cap: int = 150, node_filter: DataFrame | None = None) -> DataFrame:
    """Undirected bounded walk from seeds (qid, id): (qid, id, hop, via).

    Hop by hop the unvisited neighbours are taken in the order of edge confidence, then id; a node met
    by several edges keeps the best one's type. Seeds count towards ``cap``. ``edges`` has src, dst,
    type and confidence and is expected to hold curated rows only.

    Queries that are full walk no further. The others' neighbours and what they have reached meet in one
    shuffle by query, in tasks of about ``TASK_ROWS``. In the last hop a query with one front node that the
    cap cannot touch needs no such meeting: blocks of queries and of neighbours are paired, the pairs dealt
    out and unfolded where the rows are used, so that a result quadratic in the input takes no memory.
    """
    spark = seeds.sparkSession
    whole = None
    row = ["qid", "id", "hop", "via", "conf"]
    every = Window.partitionBy("qid")
    reached = seeds.select("qid", "id").distinct().withColumns({"hop": F.lit(0), "via": F.lit(None).cast("string"), "conf": F.lit(2.0)})
    reached = written(reached.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("f", F.col("n")), "reached")
    for hop in range(1, hops + 1):
        last = hop == hops
        goes = (F.col("f") > 0) & (F.col("n") < cap)
        nodes = reached.filter(goes & (F.col("hop") == hop - 1)).select(F.col("id").alias("src")).distinct()
        if whole is None and nodes.count() <= SENT_NODES:
            near = _neighbours(edges, node_filter, nodes)
        else:
            near = whole = whole or _neighbours(edges, node_filter)
        most = near.groupBy("src").agg(F.sum(F.size("met")).alias("d")).agg(F.max("d")).first()[0] or 0 if last else cap
        alone = goes & (F.col("f") == 1) & (F.col("n") <= FEW) & (F.col("n") + most <= cap) if last else F.lit(False)
        meets = ((goes & ~alone) | (F.col("n") > cap))
        live = reached.filter(meets)
        front = live.filter((F.col("hop") == hop - 1) & (F.col("n") < cap)).select("qid", F.col("id").alias("src"))
        met = front.join(near, "src").select("qid", F.explode("met").alias("m")).select("qid", "m.id", F.lit(hop).alias("hop"), "m.via", "m.conf")
        dealt = live.select(*row).unionByName(met).repartition(_tasks(spark, _pairs(front, near) + live.count()), "qid")
        best = dealt.groupBy("qid", "id").agg(F.max(F.struct((-F.col("hop")).alias("back"), "conf", "via")).alias("e"))
        best = best.select("qid", "id", (-F.col("e.back")).alias("hop"), "e.via", "e.conf")
        kept = best.withColumn("_n", F.row_number().over(every.orderBy("hop", F.desc("conf"), "id"))).filter(F.col("_n") <= cap).select(*row)
        rest = reached.filter(~meets)
        if last:
            return kept.unionByName(rest.select(*row)).unionByName(_unfolded(rest.filter(alone), near, hop)).select("qid", "id", "hop", "via")
        kept = kept.withColumns({"n": F.count(F.lit(1)).over(every), "f": F.count_if(F.col("hop") == hop).over(every)})
        reached = written(kept.unionByName(rest.withColumn("f", F.lit(0).cast("bigint"))), "reached")
    return reached.select("qid", "id", "hop", "via")


def _unfolded(alone: DataFrame, near: DataFrame, hop: int) -> DataFrame:
    """New neighbours (qid, id, hop, via, conf) of queries with one front node: pairs of blocks, dealt out before they become rows."""
    one = alone.groupBy("qid").agg(F.max(F.when(F.col("hop") == hop - 1, F.col("id"))).alias("src"), F.collect_list("id").alias("gone"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("qid"))
    asked = one.withColumn("part", F.floor((nth - 1) / BLOCK)).groupBy("src", "part").agg(F.collect_list(F.struct("qid", "gone")).alias("asked"))
    rows = _pairs(one, near)
    pairs = asked.join(near, "src").repartition(_tasks(alone.sparkSession, rows, 4 * TASK_ROWS), "src", "part", "block")
    out = pairs.select(F.explode("asked").alias("q"), "met").select("q", F.explode("met").alias("m")).filter(~F.array_contains("q.gone", F.col("m.id")))
    return out.select("q.qid", "m.id", F.lit(hop).alias("hop"), "m.via", "m.conf")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node's least reachable node, by propagation with pointer jumping.

    Labels are written to the shared folder each round, so lineage stays short and a lost executor
    costs a re-read. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    ways = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "ways")
    label = written(ways.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        around = ways.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        hooked = label.join(around, F.col("node") == F.col("u")).select("node", F.least("root", "near").alias("root"))
        jumped = hooked.alias("x").join(hooked.alias("y"), F.col("x.root") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.coalesce("y.root", "x.root").alias("root"))
        after = written(jumped, "labels")
        if not after.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count():
            return after
        label = after


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) over both directions."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def metadata_graph(papers: DataFrame, most_references: int = 200) -> tuple[DataFrame, DataFrame]:
    """Papers (id, title, venue, authors array, references array) -> nodes (id, type, name) and edges (src, dst, type).

    ``cites`` considers the first ``most_references`` references and keeps those in the corpus; the
    first row per id wins.
    """
    papers = papers.withColumns({"authors": F.coalesce("authors", F.array().cast("array<string>")), "references": F.coalesce("references", F.array().cast("array<string>"))})
    parts = parts_of(papers)  # shuffles as wide as the input is large, so that a task's share stays the same
    authors = papers.select("id", F.explode("authors").alias("author"))
    venues = papers.filter(F.trim("venue") != "").select("id", "venue")
    nodes = papers.select(F.concat(F.lit("paper:"), "id").alias("id"), F.lit("Paper").alias("type"), F.col("title").alias("name"))
    named = lambda df, c, kind: df.select(c).distinct().select(F.concat(F.lit(f"{c}:"), c).alias("id"), F.lit(kind).alias("type"), F.col(c).alias("name"))
    nodes = nodes.unionByName(named(authors, "author", "Author")).unionByName(named(venues, "venue", "Venue"))  # distinct first: a venue has many papers
    nodes = nodes.repartition(parts, "id").groupBy("id").agg(F.first("type").alias("type"), F.min("name").alias("name"))
    cited = papers.select("id", F.explode_outer(F.slice("references", 1, most_references)).alias("ref")).filter("ref is not null")
    cited = cited.repartition(parts, "ref").join(papers.select(F.col("id").alias("ref")).repartition(parts, "ref"), "ref", "left_semi")
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    paper: Column = F.concat(F.lit("paper:"), F.col("id"))
    edges = edge(venues, paper, F.concat(F.lit("venue:"), F.col("venue")), "published_in")
    edges = edges.unionByName(edge(authors, F.concat(F.lit("author:"), F.col("author")), paper, "authored_by"))
    edges = edges.unionByName(edge(cited, paper, F.concat(F.lit("paper:"), F.col("ref")), "cites"))
    return nodes, edges.repartition(parts, "src").distinct()  # by source: a venue is the target of many


def cocitation_hubs(papers: DataFrame, least: int = 10, limit: int | None = None) -> DataFrame:
    """References outside the corpus, counted by entries, at least ``least`` times; most cited first."""
    refs = papers.select(F.explode("references").alias("ref")).join(papers.select(F.col("id").alias("ref")), "ref", "left_anti")
    hubs = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return hubs.orderBy(F.desc("n"), "ref").limit(limit) if limit else hubs
