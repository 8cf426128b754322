"""Sections and chunks: classification, folding, retyping, packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_CHUNK, FRAGMENT, CONCLUSION = 80, 200, 400
RUN, ENTRIES = 12, 3


def fold_fragments(sections: DataFrame, key: str, pos: str, text: str, kind: str) -> DataFrame:
    """Fold untyped sections of under 200 characters into the last kept section before them.

    Islands: a kept section opens a new one, fragments join it. A fragment stays on its own where
    nothing precedes it or the section it would join is of a dropped type.
    """
    by = Window.partitionBy(key).orderBy(pos)
    small = (F.col(kind) == "other") & (F.char_length(F.trim(F.col(text))) < FRAGMENT)
    marked = sections.withColumn("_small", small)
    last = F.last(F.when(~F.col("_small"), F.col(kind)), ignorenulls=True).over(by)
    opens = ~F.col("_small") | last.isNull() | last.isin(T.DROPPED_TYPES)
    # the first fragments have no kept section before them: the first of them is kept and opens
    marked = marked.withColumn("_opens", opens & (~F.col("_small") | last.isNotNull() | (F.row_number().over(by) == 1)))
    marked = marked.withColumn("_island", F.sum(F.col("_opens").cast("int")).over(by))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    firsts = F.min(F.struct(F.col(pos).alias("p"), F.col(kind).alias("k")))
    out = marked.groupBy(key, "_island").agg(firsts.alias("f"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias(text), F.count(F.lit(1)).alias("n_parts"))
    return out.select(key, F.col("f.p").alias(pos), F.col("f.k").alias(kind), text, "n_parts")


def retype(sections: DataFrame, key: str, pos: str, text: str, kind: str) -> DataFrame:
    """The first untyped section is the introduction; without a section on limitations, the last section that is not tail matter becomes the conclusion if it is untyped and of 400 characters or more."""
    all_ = Window.partitionBy(key)
    first = F.min(F.when(F.col(kind) == "other", F.col(pos))).over(all_)
    out = sections.withColumn("_kind", F.when((F.col(kind) == "other") & (F.col(pos) == first), "introduction").otherwise(F.col(kind)))
    has = F.max(F.col("_kind").isin(T.LIMITATION_TYPES).cast("int")).over(all_)
    last = F.max(F.when(~F.col("_kind").isin(T.TAIL_TYPES), F.col(pos))).over(all_)
    out = out.withColumn("_has", has).withColumn("_last", last)
    ends = (F.col("_has") == 0) & (F.col(pos) == F.col("_last")) & (F.col("_kind") == "other") & (F.char_length(F.trim(F.col(text))) >= CONCLUSION)
    return out.withColumn(kind, F.when(ends, "conclusion").otherwise(F.col("_kind"))).drop("_kind", "_has", "_last")


def bibliography_start(lines: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, start): the first ``[n]`` line that begins a run, three or more such lines among it and the eleven after it."""
    entry = F.col(text).rlike(r"^\s*\[\d{1,3}\]")
    ahead = Window.partitionBy(key).orderBy(pos).rowsBetween(0, RUN - 1)
    near = F.sum(F.when(entry, 1).otherwise(0)).over(ahead)
    return lines.withColumn("_near", near).filter(entry & (F.col("_near") >= ENTRIES)).groupBy(key).agg(F.min(pos).alias("start"))


def _bounds(counts: list[int], target: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first, end, tokens) of the chunks of sentences with these tokens."""
    out, first, held = [], 0, 0
    for i, n in enumerate(counts):
        if i > first and held + n > target:
            out.append((first, i, held))
            first, held = i, 0
            while first > out[-1][0] and held + counts[first - 1] <= overlap:
                first -= 1
                held += counts[first]
        held += n
    return [*out, (first, len(counts), held)] if counts else []


def chunks(sections: DataFrame, target: int = 512, overlap: int = 64) -> DataFrame:
    """Greedy packing of sentences into chunks, section by section.

    ``sections`` has paper, section_index, section_type and text; the fold runs inside one row, so
    nothing is shuffled, and over numbers of tokens alone: a fold of arrays in SQL copies them at every
    sentence. A sentence joins while the tokens stay within the target; then the chunk is closed and
    trailing sentences of at most ``overlap`` tokens open the next one. A sentence over the target alone
    is a chunk of its own. Chunks of under 80 characters are dropped.
    """

    @F.arrow_udf("array<struct<first:int,end:int,tokens:bigint>>")
    def bounds(counts: pa.Array) -> pa.Array:
        found = [[dict(zip(("first", "end", "tokens"), b, strict=True)) for b in _bounds(c or [], target, overlap)] for c in counts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("tokens", pa.int64())])))

    kept = sections.filter(~F.col("section_type").isin(T.DROPPED_TYPES)).select("paper", "section_index", "section_type", T.sentences(F.col("text")).alias("s"))
    cut = kept.withColumn("b", bounds(F.transform("s", T.approx_tokens)))
    text = lambda b: F.trim(F.array_join(F.slice("s", b["first"] + 1, b["end"] - b["first"]), " "))
    packed = F.transform("b", lambda b: F.struct(text(b).alias("text"), b["tokens"].alias("tokens")))
    # outer: for a plain explode Spark infers a filter on the array, which would build it again
    rows = cut.select("paper", "section_index", "section_type", F.posexplode_outer(packed).alias("n", "c")).filter("n is not null").select("paper", "section_index", "section_type", "n", "c.text", "c.tokens")
    rows = rows.filter(F.char_length("text") >= MIN_CHUNK)
    return rows.withColumn("id", F.concat_ws("::", F.col("paper").cast("string"), F.col("section_index").cast("string"), "section_type", F.col("n").cast("string")))
