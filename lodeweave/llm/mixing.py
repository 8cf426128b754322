"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. Its documents are put in an order, every document's
expected copies (target / source size) are prefix-summed along it, one random offset per source is
added, and a document is emitted once per integer boundary its interval crosses. Sums are whole numbers,
so no boundary is lost to rounding. The order is by size, then by a seeded hash, so the words taken
differ from the target by no more than about the source's largest document; whatever the order, a
document's expected number of copies is target / source size.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, ranked

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[int], total: int, most: int) -> list[Fraction]:
    """Share ``total`` by weight; a target stops at ``most`` times its size and the excess is shared again among the others.

    Exact rational arithmetic, so a capped target is exactly ``most * size``. If every source is
    capped, the rest of ``total`` stays unshared.
    """
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    open_ = set(range(len(sizes)))
    left = Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > most * sizes[i] * weight]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            open_.discard(i)
        left -= sum(out[i] for i in over)
    return out


def source_targets(docs: DataFrame, source: str, size: str, weights: list[int], share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target, and target / source_size as num / den): one row per source.

    Sources in code-point order, null last, take the weights in turn. What reaches the driver is one
    row per source of the mixture, which somebody has to weigh; it does not grow with the documents.
    """
    spark = docs.sparkSession
    rows = docs.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n")).collect()
    rows.sort(key=lambda r: (r.s is None, (r.s or "").encode("utf-32-be")))
    sizes = [int(r.n or 0) for r in rows]
    total = int(Fraction(share) * sum(sizes))
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], total, most)
    rates = [t / n if n else Fraction(0) for n, t in zip(sizes, targets, strict=True)]
    data = [(r.s, n, float(t), Decimal(x.numerator), Decimal(x.denominator)) for r, n, t, x in zip(rows, sizes, targets, rates, strict=True)]
    return spark.createDataFrame(data, f"{P}source string, source_size long, target double, {P}num decimal(19,0), {P}den decimal(19,0)")


def mix_counts(docs: DataFrame, source: str, size: str, key: str, weights: list[int], share: float = 1.0, most: int = 3, seed: int = 11) -> DataFrame:
    """Every row of ``docs`` plus source_size, target and ``copies`` (how often the mixture holds it).

    Nulls: a null source is a source of its own, a null size counts 0 and a null key is ordered by
    its hash. Empty texts ride along with size 0. Repeated rows are separate documents. A table
    without rows gives no rows. Other columns are kept, but input columns named ``source_size``,
    ``target`` or ``copies`` are replaced. The same input and seed give the same mixture.
    """
    docs = docs.drop(*(c for c in ("source_size", "target", "copies") if c not in (source, size, key)))
    tie, rank = P + "tie", P + "rank0"
    docs = docs.withColumn(tie, F.xxhash64(F.lit(seed), F.col(key)))
    placed = ranked(docs, [source], [size, tie, key], rank)
    goals = source_targets(placed, source, size, weights, share, most)
    joined = placed.join(F.broadcast(goals), F.col(source).eqNullSafe(F.col(P + "source")), "left").drop(P + "source")
    # The offset: a whole number of den-ths in [0, den), from the seed and the source's name.
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(source)), F.lit(1 << 40))
    joined = joined.withColumn(P + "draw", draw).withColumn(P + "offset", F.expr(f"cast((cast({P}draw as decimal(13,0)) * {P}den) div {1 << 40} as decimal(19,0))"))

    def boundaries(n: str) -> Column:
        """Integer boundaries that the first ``n`` documents of the source cross."""
        return F.expr(f"(cast({n} as decimal(18,0)) * {P}num + {P}offset) div {P}den")

    joined = joined.withColumn("copies", boundaries(f"{rank} + 1") - boundaries(rank))
    return joined.drop(tie, rank, P + "num", P + "den", P + "offset", P + "draw")


def mixed(docs: DataFrame, source: str, size: str, key: str, weights: list[int], **options) -> DataFrame:
    """The mixture itself: every document as many times as it was drawn, with the columns of ``docs``.

    Nulls, empty texts, repeated rows, empty tables and clashing columns are as in ``mix_counts``.
    """
    drawn = mix_counts(docs, source, size, key, weights, **options)
    times = F.sequence(F.lit(1), F.col("copies"))
    return drawn.filter("copies > 0").withColumn(P + "copy", F.explode(times)).select(*[c for c in docs.columns if c in drawn.columns])
