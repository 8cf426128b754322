"""Sampling: proportional and equal quotas, seeded by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(sizes: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota): ``total`` shared in proportion to n, remainders to the largest fractions."""
    every = Window.partitionBy(F.lit(0))
    exact = F.col("n") * total / F.sum("n").over(every)
    q = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    q = q.withColumn("_left", F.lit(total) - F.sum("_floor").over(every)).withColumn("_nth", F.row_number().over(every.orderBy(F.round(F.col("_floor") - F.col("_exact"), 9), stratum)))
    return q.select(stratum, F.least(F.col("n"), F.col("_floor") + (F.col("_nth") <= F.col("_left")).cast("bigint")).alias("quota"))


def seeded(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """About ``total`` rows, each stratum in its share; the same seed gives the same rows."""
    quotas = largest_remainder(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum, total)
    by = Window.partitionBy(stratum).orderBy(seeded(seed, key), key)
    return rows.join(quotas, stratum).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def equal(rows: DataFrame, stratum: str, key: str, each: int = 20, seed: int = 0) -> DataFrame:
    """``each`` rows per stratum, or all it has."""
    by = Window.partitionBy(stratum).orderBy(seeded(seed, key), key)
    return rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= each).drop("_n")


def banded(nodes: DataFrame, band: str, special: Column, key: str, each: int = 20, share: float = 1 / 3, seed: int = 0) -> DataFrame:
    """``each`` rows per band, a share of them reserved for special rows; what one kind lacks the other fills."""
    by = Window.partitionBy(band, "_s").orderBy(seeded(seed, key), key)
    reserved = round(each * share)
    q = nodes.withColumn("_s", special).withColumn("_n", F.row_number().over(by))
    first = (F.col("_s") & (F.col("_n") <= reserved)) | (~F.col("_s") & (F.col("_n") <= each - reserved))
    q = q.withColumn("_o", F.row_number().over(Window.partitionBy(band).orderBy(F.when(first, 0).otherwise(1), seeded(seed, key), key)))
    return q.filter(F.col("_o") <= each).drop("_s", "_n", "_o")
