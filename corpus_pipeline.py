"""The corpus pipeline over ``documents``: quality rules, near duplicates, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's ``docs``; all but the last return the columns of ``documents``. Null and empty texts fail
the quality rules; rows with a null id are kept or dropped together and have no near copies; repeated
rows stay repeated until the mixture; extra columns ride along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import bpe, mixing, ngram_join, quality_rules
from lodeweave.llm.common import P, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judge(docs.select("doc_id", "lang", "text"), labels, "doc_id", "text", stratum="lang")
    # A row is known by its id; should ids repeat, one kept row keeps them all, so that nothing clean is lost.
    bad = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias(P + "id"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(P + "id")), "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at a Jaccard of 0.8 or more, the document with the least id."""
    found = ngram_join.jaccard_components(docs, "doc_id", "text", k=5, num=80, den=100)
    drop = found.filter("component_id < doc_id").select(F.col("doc_id").alias(P + "id"))
    return docs.join(drop, F.col("doc_id") == F.col(P + "id"), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources (weights 1, 2, 3 in turn) takes it."""
    size, copies = P + "size", P + "copies"
    narrow = docs.select("doc_id", "source", mixing.word_count("text").alias(size))
    drawn = mixing.mix_counts(narrow, "source", size, "doc_id", weights=[1, 2, 3])
    # Repeated ids share what their rows drew; ids are unique, so this is each row's own number.
    drawn = drawn.groupBy(F.col("doc_id").alias(P + "id")).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(P + "n")).filter(f"{copies} > 0")
    times = F.expr(f"cast(({copies} + {P}n - 1) div {P}n as int)")
    mixed = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col(P + "id"))).withColumn(P + "copy", F.explode(F.sequence(F.lit(1), times)))
    return mixed.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, and digests that show the round trip."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", keep_good), ("ngram_join", drop_near_copies), ("mix_sources", mix), ("bpe", tokenize)]

#: Certified thresholds, components and the automaton have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
