"""Reproducibility facts: candidates of an extraction per field, and their score against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluation

#: Fields, and for each the node types and attributes it is read from, best first; no attribute is the name.
FIELDS = ["quantum_vendor", "device_name", "qubit_count", "gpu_type", "gpu_count", "code_url", "dataset_access"]
SOURCES = [
    ("quantum_vendor", "Hardware", "quantum_vendor"),
    ("quantum_vendor", "Hardware", "vendor"),
    ("device_name", "Hardware", None),
    ("qubit_count", "Hardware", "qubit_count"),
    ("qubit_count", "Dataset", "qubit_count"),
    ("gpu_type", "Hardware", "gpu_type"),
    ("gpu_count", "Hardware", "gpu_count"),
    ("code_url", "ReproducibilityArtifact", "code_url"),
    ("code_url", "Software", "url"),
    ("code_url", "Dataset", "access_url"),
    ("dataset_access", "ReproducibilityArtifact", "dataset_access"),
    ("dataset_access", "Dataset", "access_type"),
]
#: Fixed value: gold says so where a paper does not state a field.
NOT_REPORTED = "not_reported"
GOLD = "paper string, " + ", ".join(f"{f} string" for f in FIELDS) + ", note string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row per paper; numbers become text, missing fields null."""
    return spark.read.schema(GOLD).option("mode", "FAILFAST").option("primitivesAsString", "true").json(path)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, t, a, i) for i, (f, t, a) in enumerate(SOURCES)], "field string, type string, attr string, pref int")


def candidates(nodes: DataFrame) -> DataFrame:
    """(paper, field, value, place): the values that nodes (paper, type, name, attrs, ord) offer, each once, in order of source and node."""
    offered = nodes.join(F.broadcast(sources(nodes.sparkSession)), "type")
    value = F.when(F.col("attr").isNull(), F.col("name")).otherwise(F.expr("try_element_at(attrs, attr)"))
    kept = offered.withColumn("value", value).filter(~T.is_silent(F.col("value")))
    return kept.groupBy("paper", "field", "value").agg(F.min(F.struct("pref", "ord")).alias("place"))


def long_gold(gold: DataFrame) -> DataFrame:
    """(paper, field, gold), a row for every field."""
    return gold.unpivot(["paper"], FIELDS, "field", "gold")


def reported(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(paper, field, gold, reported, matched): the first candidate that fits the gold value, else the first."""
    fits = F.coalesce((F.col("gold") != NOT_REPORTED) & T.token_contained(F.col("gold"), F.col("value")), F.lit(False))
    met = gold.join(found, ["paper", "field"], "left")
    out = met.groupBy("paper", "field", "gold").agg(F.min(F.when(F.col("value").isNotNull(), F.struct((~fits).alias("other"), "place", "value"))).alias("b"))
    return out.select("paper", "field", "gold", F.col("b.value").alias("reported"), F.coalesce(~F.col("b.other"), F.lit(False)).alias("matched"))


def outcome(gold: Column, said: Column, matched: Column) -> Column:
    """As for a single value, but a contained candidate is correct."""
    strict = evaluation.repro_outcome(gold, said)
    return F.when((strict == "wrong") & matched, "correct").otherwise(strict)


def score_papers(gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper, field, outcome) for gold (paper, fields) and extracted nodes."""
    r = reported(long_gold(gold), candidates(nodes))
    return r.select("paper", "field", outcome(F.col("gold"), F.col("reported"), F.col("matched")).alias("outcome"))


def summary(scores: DataFrame) -> DataFrame:
    """Outcome counts and accuracy overall (field null) and per field."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "missed", "correct_absence", "hallucinated", "skipped")]
    right = F.count_if(F.col("outcome").isin("correct", "correct_absence"))
    return scores.groupingSets([["field"], []], "field").agg(*counts, F.round(right / F.nullif(F.count_if(F.col("outcome") != "skipped"), F.lit(0)), 6).alias("accuracy"))
