"""Stores: nodes, edges and chunks as Parquet tables, and gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

NODES = "id string, type string, name string, aliases array<string>, attrs map<string,string>, confidence double, evidence array<string>, from_paper string, source_layer string"
EDGES = "src string, dst string, type string, attrs map<string,string>, confidence double, evidence array<string>, source_layer string"
GOLD = "qid string, query string, query_type string, facets array<string>, must_cite array<string>, key_claims array<struct<text: string, papers: array<string>>>, known_refutations array<struct<a: string, b: string>>, grade map<string, int>, notes string"


class GraphStore:
    """Two tables partitioned by layer; a rebuild overwrites, an append adds staged rows only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def init(self) -> None:
        for name, schema in (("nodes", NODES), ("edges", EDGES)):
            self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy("source_layer").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(NODES if name == "nodes" else EDGES).parquet(f"{self.path}/{name}")

    def rebuild(self, nodes: DataFrame, edges: DataFrame) -> None:
        nodes.write.mode("overwrite").partitionBy("source_layer").parquet(f"{self.path}/nodes")
        edges.write.mode("overwrite").partitionBy("source_layer").parquet(f"{self.path}/edges")

    def stage(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Append staged rows; one row of another layer stops the whole write."""
        for df in (nodes, edges):
            if df.filter(F.coalesce(F.col("source_layer"), F.lit("")) != graph.STAGED).limit(1).count():
                raise ValueError("only staged rows may be appended")
        nodes.write.mode("append").partitionBy("source_layer").parquet(f"{self.path}/nodes")
        edges.write.mode("append").partitionBy("source_layer").parquet(f"{self.path}/edges")
        return nodes.count()

    def query(self, text: str) -> DataFrame:
        """SQL over the views nodes, edges, nodes_curated and edges_curated."""
        for name in ("nodes", "edges"):
            self.read(name).createOrReplaceTempView(name)
            graph.curated(self.read(name)).createOrReplaceTempView(f"{name}_curated")
        return self.spark.sql(text)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)


def resolve_gold(spark: SparkSession, pattern: str, qids: list[str]) -> str:
    """The smallest gold file that holds all qids; malformed lines do not count."""
    rows = spark.read.schema(GOLD).option("mode", "DROPMALFORMED").json(pattern).select(F.input_file_name().alias("file"), "qid")
    per = rows.filter("qid is not null").groupBy("file").agg(F.collect_set("qid").alias("have"), F.count(F.lit(1)).alias("n"))
    fit = per.filter(F.size(F.array_except(F.array(*[F.lit(q) for q in qids]), "have")) == 0).orderBy("n", "file").select("file").first()
    if fit is None:
        raise FileNotFoundError("no gold file covers these questions")
    return fit.file


def write_run(path: str, answers: DataFrame, scores: DataFrame, violations: DataFrame) -> None:
    """A run's artefacts as JSON lines."""
    for name, df in (("answers", answers), ("scores", scores), ("violations", violations)):
        df.write.mode("overwrite").json(f"{path}/{name}")
