"""Pieces the operators share: written tables, distributed ranks, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_dir, written

__all__ = ["P", "finish", "join_counted", "mapped", "parallelism", "ranked", "release", "shared_dir", "shingles_of", "texts_of", "words_of", "written"]

#: Internal columns start with this; caller columns must not.
P = "__lw_"


def parallelism(spark: SparkSession) -> int:
    """Partitions a shuffle gets; the deployer scales this with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Text that one Arrow batch holds at most (a single longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches bounded by bytes, so that long texts do not add up; a worker gives back what a partition took."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, f"{1 << 26}b").rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Freed memory goes back to the system where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ranked(df: DataFrame, group: list[str], order: list[str | Column], rank: str, count: str | None = None) -> DataFrame:
    """Add the 0-based ``rank`` of each row in its group (all rows if ``group`` is empty), and the group's ``count``.

    One range shuffle on (group, order), so a group of any size spreads over many tasks; what meets
    in one task is a row per (task, group). The rows are written first, because a range shuffle reads
    its input twice (it samples), and the ranked rows are written before the offsets are counted,
    because a range shuffle that runs twice may cut elsewhere. Rows equal in ``order`` (null keys, say)
    are told apart by their place in the written rows, so they spread as well; which of them comes
    first is not fixed. Pass narrow rows.
    """
    spark = df.sparkSession
    pid, seq, base, n, lo, place = (P + x for x in ("pid", "seq", "base", "n", "lo", "place"))
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(place)]
    columns, df = df.columns, written(df, "narrow").withColumn(place, F.monotonically_increasing_id())
    dealt = df.repartitionByRange(parallelism(spark), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop(place).withColumn(pid, F.spark_partition_id()).withColumn(seq, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "rank")
    sums = dealt.groupBy(pid, *group).agg(F.count(F.lit(1)).alias(n), F.min(seq).alias(lo))
    from pyspark.sql import Window

    part = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    before = part.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(lo))
    if count:
        sums = sums.withColumn(count, F.sum(n).over(part))
    a, b = dealt.alias("a"), sums.drop(n, lo).alias("b")
    same = F.col(f"a.{pid}") == F.col(f"b.{pid}")
    for c in group:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    kept = [F.col(f"a.`{c}`") for c in columns]
    out = [*kept, (F.col(seq) + F.col(base)).alias(rank)] + ([F.col(f"b.{count}")] if count else [])
    return a.join(b, same, "inner").select(*out)


def join_counted(rows: DataFrame, table: DataFrame, key: str, of: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key, ``of``: how many of the rows have it) without a hot key in one task.

    Keys that hold more than an eighth of a partition's share are fewer than eight per partition whatever
    the data, so they are broadcast; the others meet in a shuffle join. ``table`` should be written.
    """
    most = 8 * parallelism(rows.sparkSession)
    total = table.agg(F.sum(of)).first()[0] or 0
    hot = F.col(of) > total // most
    near = rows.join(F.broadcast(table.filter(hot)), key)
    far = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti").join(table.filter(~hot), key)
    return near.unionByName(far)


# Word hashes ---------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19
_tables: dict = {}


def finish(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of ``x`` moves every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _tables.get("pow")
    if have is None or len(have[0]) < n:
        n = max(n, _CHUNK)
        base, inverse = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
        up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        up[1:], down[1:] = base, inverse
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n <= 16 * _CHUNK:
            _tables["pow"] = have
    return have


def _byte_table(lower: bool) -> np.ndarray:
    if lower not in _tables:
        t = finish(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        if lower:
            t[65:91] = t[97:123]
        _tables[lower] = t
    return _tables[lower]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, n + 1 offsets of words by text).

    With ``lower``, A-Z count as a-z. Works on the bytes of a whole batch at once; memory is a few
    bytes per byte of text plus fixed-size chunks.
    """
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < at[1:]]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = cut[1:] - 1
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    table, out = _byte_table(lower), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[raw[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = finish((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out, np.searchsorted(starts, at)


def shingles_of(words: np.ndarray, by: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its k-word shingles; fewer than k words count as one shingle, none as an empty set."""
    n = len(words)
    mult = [np.uint64((_ODD * (2 * j + 3)) & (2**64 - 1) | 1) for j in range(k)]
    grams = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        grams += words[j : j + len(grams)] * mult[j]
    grams = finish(grams)
    out = []
    for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            if len(g) > 1:
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                g = g[keep]
            out.append(g)
        elif b > a:
            own = np.uint64(b - a)
            one = np.zeros(1, np.uint64)
            for j in range(b - a):
                one += words[a + j : a + j + 1] * mult[j]
            out.append(finish(one + np.array([own]) * _M2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
