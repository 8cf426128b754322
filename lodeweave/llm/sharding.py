"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; the fractional rank
(rank + 1/2) / (rows of the source) merges the sources so that every stretch of the merged order
holds each source in proportion; the order is then cut into shards whose row counts differ by at
most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, ranked


def interleave_shards(docs: DataFrame, source: str, key: str, shards: int, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` plus ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard).

    Law ``rows``: shard counts differ by at most one, and each shard holds every source in its share
    to within about one row. A null source is a source of its own; a null key is ordered by its hash;
    empty texts are rows like others; repeated rows are placed one by one; no rows give no rows. Other
    columns are kept, but input columns named ``shard`` or ``slot`` are replaced. Two range shuffles of what ``docs``
    holds, so pass narrow rows and join the texts when they are written.
    """
    docs = docs.drop(*(c for c in ("shard", "slot") if c not in (source, key)))
    tie, rank, n, frac, at, total = (P + x for x in ("tie", "srank", "scount", "frac", "at", "total"))
    shuffled = docs.withColumn(tie, F.xxhash64(F.lit(seed), F.col(key)))
    placed = ranked(shuffled, [source], [tie, key], rank, n)
    placed = placed.withColumn(frac, (F.col(rank) * 2 + 1) / (F.col(n) * 2).cast("double")).drop(rank, n)
    merged = ranked(placed, [], [frac, source, tie, key], at, total)
    # shard = floor(at * shards / total), and its first position is ceil(shard * total / shards), in whole numbers
    shard = F.expr(f"({at} * {shards}) div {total}")
    first = F.expr(f"({P}shard * {total} + {shards - 1}) div {shards}")
    out = merged.withColumn(P + "shard", shard).withColumn("slot", (F.col(at) - first).cast("long"))
    return out.withColumn("shard", F.col(P + "shard").cast("int")).drop(tie, frac, at, total, P + "shard")
