"""Pair verdicts with a cache: merges (same or different) and contradictions (refutes, undercuts, neither)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "␟"
MERGE, CONTRADICTION = ["same", "different"], ["refutes", "undercuts", "neither"]


def cache_key(version: str, a, b, ordered: bool):
    """Prompt version and the two texts; for merges the pair has no order."""
    x, y = (a, b) if ordered else (F.least(a, b), F.greatest(a, b))
    return F.concat_ws(SEPARATOR, F.lit(version), x, y)


def adjudicate(pairs: DataFrame, cache: DataFrame, judge: Callable[[str, str], tuple[str, str]], verdicts: list[str], version: str, ordered: bool) -> DataFrame:
    """Pairs (a_text, b_text, ...) with verdict and reason: from the cache (key, verdict, reason), else from ``judge``.

    A call that fails or says something else counts as the last, cautious verdict. ``fresh`` marks
    rows that the cache should take.
    """
    safe = verdicts[-1]

    @F.pandas_udf("verdict string, reason string")
    def ask(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            try:
                verdict, reason = judge(x, y)
            except Exception as e:  # a model may be out of reach
                verdict, reason = safe, f"error: {type(e).__name__}"
            rows.append((verdict if verdict in verdicts else safe, (reason or "")[:120]))
        return pd.DataFrame(rows, columns=["verdict", "reason"])

    keyed = pairs.withColumn("key", cache_key(version, F.col("a_text"), F.col("b_text"), ordered))
    known = keyed.join(cache.select("key", "verdict", "reason"), "key").withColumn("fresh", F.lit(False))
    new = keyed.join(cache.select("key"), "key", "left_anti").withColumn("_v", ask("a_text", "b_text"))
    new = new.select(*keyed.columns, "_v.verdict", "_v.reason").withColumn("fresh", F.lit(True))
    return known.unionByName(new)


#: Node types that state something.
CLAIM_TYPES = ["Claim", "Limitation"]


def is_comparable(kind: Column, name: Column) -> Column:
    """If a node can take part in a contradiction: it states something and has a name."""
    return F.coalesce(kind.isin(CLAIM_TYPES) & (F.trim(name) != ""), F.lit(False))


def can_conflict(a_id: Column, a_paper: Column, b_id: Column, b_paper: Column) -> Column:
    """If two statements may be in tension: different nodes of different papers, both known."""
    return F.coalesce((a_id != b_id) & (a_paper != b_paper), F.lit(False))


def contradiction_edges(found: DataFrame) -> DataFrame:
    """Accepted verdicts as edges; the similarity is their confidence, the reason their evidence."""
    kept = found.filter(F.col("verdict").isin("refutes", "undercuts"))
    return kept.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("verdict").alias("type"), F.round("similarity", 3).alias("confidence"), F.array("reason").alias("evidence"))
