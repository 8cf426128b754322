"""The vector store: chunks with their unit vectors as one Parquet table, partitioned by corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import retrieval

COLUMNS = "id string, paper string, text string, section_type string, n_chars long, vector array<double>, corpus string"


class VectorStore:
    """Vector and metadata stand in one row, so nothing depends on the order of rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, chunks: DataFrame) -> None:
        """Append chunks (id, paper, text, section_type, vector, corpus) whose ids are not there yet; vectors become unit vectors."""
        self._write(chunks.dropDuplicates(["id"]).join(self.load().select("id"), "id", "left_anti"))

    def _write(self, chunks: DataFrame) -> None:
        rows = chunks.withColumn("vector", V.l2_normalize(F.col("vector"))).withColumn("n_chars", F.char_length("text").cast("bigint"))
        rows.select("id", "paper", "text", "section_type", "n_chars", "vector", "corpus").write.mode("append").partitionBy("corpus").parquet(self.path)

    def load(self) -> DataFrame:
        self.spark.createDataFrame([], COLUMNS).write.mode("ignore").partitionBy("corpus").parquet(self.path)
        return self.spark.read.schema(COLUMNS).parquet(self.path)

    def persist(self, path: str) -> VectorStore:
        """Write the rows, compacted, under another path; readers of this one are not disturbed."""
        self.load().repartition("corpus").write.partitionBy("corpus").parquet(path)
        return VectorStore(self.spark, path)

    def search(self, queries: DataFrame, k: int, corpus: str = "fulltext", damping: int = 800) -> DataFrame:
        """The k best chunks of a corpus for every query (qid, vector), short ones damped."""
        return retrieval.search(queries, self.load(), k, corpus, damping)


def build_vectors(chunks: DataFrame, embed: Callable[[Column], Column], path: str) -> VectorStore:
    """Embed chunks (id, paper, text, section_type, corpus) and store them."""
    store = VectorStore(chunks.sparkSession, path)
    embedded = chunks.withColumn("vector", embed(F.col("text")))
    if not store.load().isEmpty():
        store.add(embedded)
        return store
    store._write(embedded)  # a new store takes the rows where they are; only their ids move to tell if one came twice
    if store.load().groupBy("id").count().filter("count > 1").isEmpty():
        return store
    once = VectorStore(store.spark, f"{path}-once")
    store.load().dropDuplicates(["id"]).write.partitionBy("corpus").parquet(once.path)
    return once
