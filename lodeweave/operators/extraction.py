"""Extraction payloads: parsing, gates, endpoint resolution, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

NODE_GATE, EDGE_GATE = 0.65, 0.5
#: What each section type is asked for: node types; edge types.
ROUTING = {
    "abstract": ("Method, Problem, Claim, Hardware, ReproducibilityArtifact", "addresses, requires, provides"),
    "introduction": ("Problem, Method, Claim", "addresses, builds_on"),
    "related_work": ("Method, Claim", "builds_on, refutes, undercuts"),
    "method": ("Method, Software, Hardware, ReproducibilityArtifact", "builds_on, addresses, uses, requires, provides"),
    "results": ("Dataset, Method, Claim, Hardware, ReproducibilityArtifact", "evaluated_on, requires, provides"),
    "discussion": ("Claim, Limitation", "refutes, undercuts"),
    "limitations": ("Limitation", ""),
    "conclusion": ("Claim, Limitation, Problem, ReproducibilityArtifact", "addresses, provides"),
    "availability": ("ReproducibilityArtifact, Software, Dataset, Hardware", "provides, uses, evaluated_on, requires"),
    "appendix": ("Hardware, Software, ReproducibilityArtifact, Dataset", "requires, uses, provides, evaluated_on"),
    "other": ("Method, Problem, Claim, Limitation, ReproducibilityArtifact", "addresses, builds_on, provides"),
}


def routing(spark: SparkSession) -> DataFrame:
    """The routing dimension: section_type, node_types, edge_types, hint."""
    rows = [(k, n.split(", "), e.split(", ") if e else [], "Hardware" in n or "ReproducibilityArtifact" in n) for k, (n, e) in ROUTING.items()]
    return spark.createDataFrame(rows, "section_type string, node_types array<string>, edge_types array<string>, hint boolean")


def prompts(sections: DataFrame) -> DataFrame:
    """Every section with what it is to be asked for; section types without a row take ``other``."""
    route = routing(sections.sparkSession)
    known = F.when(F.col("section_type").isin(list(ROUTING)), F.col("section_type")).otherwise("other")
    joined = sections.withColumn("_route", known).join(F.broadcast(route.withColumnRenamed("section_type", "_route")), "_route")
    hint = F.when(F.col("hint"), "\nNote hardware and artefacts.").otherwise("")
    prompt = F.concat(F.lit("Nodes: "), F.array_join("node_types", ", "), F.lit("\nEdges: "), F.array_join("edge_types", ", "), hint, F.lit("\n\n"), F.col("text"))
    return joined.withColumn("prompt", prompt).drop("_route")


def gate_nodes(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Named nodes of known types at or over the confidence gate; confidence coerced to [0, 1]."""
    out = nodes.withColumn("confidence", T.confidence(F.col("confidence").cast("string"))).filter((F.trim("name") != "") & (F.col("confidence") >= NODE_GATE))
    return out.filter(F.col("type").isin(types)) if types else out


def gate_edges(edges: DataFrame, nodes: DataFrame, unit: str) -> DataFrame:
    """Edges over their gate whose ends resolve, by lower-cased name within the unit, to kept nodes; loops go.

    Of several nodes with one name the last in ``ord`` wins.
    """
    names = nodes.groupBy(unit, F.lower(F.trim("name")).alias("_n")).agg(F.max_by("id", "ord").alias("_id"))
    kept = edges.withColumn("confidence", T.confidence(F.col("confidence").cast("string"))).filter(F.col("confidence") >= EDGE_GATE)
    for end in ("src", "dst"):
        by = names.select(unit, F.col("_n").alias(f"_{end}"), F.col("_id").alias(f"{end}_id"))
        kept = kept.withColumn(f"_{end}", F.lower(F.trim(f"{end}_name"))).join(by, [unit, f"_{end}"])
    return kept.filter("src_id <> dst_id").drop("_src", "_dst")


def best_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One node per key: the greatest confidence, the first in ``ord`` on a tie."""
    by = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "ord")
    return nodes.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
