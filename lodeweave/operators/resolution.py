"""Entity resolution: canonical ids by name and acronym, remapping, merge maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph


def entity_map(nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, rule) for nodes (id, type, name).

    Rule ``name``: nodes of a type whose normalised names (without an acronym's gloss) are equal go to
    the least id. Rule ``acronym``: a bare acronym goes to the least id of its expansion, if the corpus
    gives it exactly one. The name rule wins.
    """
    base = nodes.select("id", "type", T.plain_name(T.without_gloss(F.col("name"))).alias("norm"), T.acronym_of(F.col("name")).alias("acro"), F.upper(F.trim("name")).alias("bare"))
    heads = base.filter("norm <> ''").groupBy("type", "norm").agg(F.min("id").alias("to_id"))
    named = base.join(heads, ["type", "norm"]).filter("id <> to_id").select("id", "to_id", F.lit("name").alias("rule"), F.lit(1).alias("prio"))
    sure = base.filter("acro is not null").groupBy("acro").agg(F.collect_set("norm").alias("s")).filter(F.size("s") == 1).select("acro", F.col("s")[0].alias("norm"))
    bare = base.filter("acro is null").select("id", "type", F.col("bare").alias("acro"))
    glossed = bare.join(sure, "acro").join(heads, ["type", "norm"]).filter("id <> to_id").select("id", "to_id", F.lit("acronym").alias("rule"), F.lit(2).alias("prio"))
    best = named.unionByName(glossed).groupBy("id").agg(F.min(F.struct("prio", "to_id", "rule")).alias("m"))
    return best.select(F.col("id").alias("from_id"), F.col("m.to_id").alias("to_id"), F.col("m.rule").alias("rule"))


def merge_map(pairs: DataFrame) -> DataFrame:
    """(from_id, to_id): accepted pairs (a, b) as components, each node to its component's least id."""
    found = graph.components(pairs, "a", "b")
    return found.filter("node <> root").select(F.col("node").alias("from_id"), F.col("root").alias("to_id"))


def remap_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("from_id").alias("id"), "to_id")
    return nodes.join(m, "id", "left").withColumn("id", F.coalesce("to_id", "id")).select(*nodes.columns)


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends mapped; loops that a merge makes are dropped."""
    s = mapping.select(F.col("from_id").alias("src"), F.col("to_id").alias("_s"))
    t = mapping.select(F.col("from_id").alias("dst"), F.col("to_id").alias("_t"))
    out = edges.join(s, "src", "left").join(t, "dst", "left").withColumn("src", F.coalesce("_s", "src")).withColumn("dst", F.coalesce("_t", "dst"))
    return out.filter("src <> dst").select(*edges.columns)
