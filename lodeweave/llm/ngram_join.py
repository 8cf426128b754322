"""N-gram Jaccard join by vertical partitioning.

Documents are sets of k-word shingles. Shingles have a global order, which is cut into fragments;
what happens to a shingle happens in its fragment, and what a document or a pair needs from several
fragments is counted in each and summed:

1. Documents with equal sets form a class (copies are never paired).
2. Screening. A pair with Jaccard >= t shares at least ceil(t * n) shingles of either set, so a class
   may have at most n - ceil(t * n) shingles that no other class has. The first half of the hash
   order is cut into fragments; each counts the shared shingles of every class in it, the counts are
   summed, and classes that already have too many unshared shingles leave. Nothing linked is lost.
3. The classes left get the exact global order (number of classes that hold the shingle, then its
   hash). Linked classes share one of their first n - ceil(t * n) + 1 shingles; joining each
   with the least class of such a shingle gives clusters that hold every possible link.
4. Clusters are cut into blocks by set size. A task gets two blocks, cuts the order of their shingles
   into fragments, counts the partial overlaps of all pairs fragment by fragment as matrix products
   and sums them. It emits a spanning forest of the links, not the pairs.
5. Components of the forests are the answer.

Shingles are compared by 64-bit hash, classes told apart by 128 bits and joined by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, mapped, parallelism, ranked, release, shingles_of, texts_of, words_of, written

BLOCK = 256  # classes in a block; a task compares two blocks
COLUMNS = 4096  # shingles in a fragment of a task's order
SCREEN = 2  # one part in so many of the hash order is screened
BITS = 27  # 2**BITS bits (16 MB) mark the documents whose sets are needed; more documents cost spare sets, not memory
SLICE = 1024  # texts hashed at a time


def _need(n, num: int, den: int):
    """ceil(n * num / den): what a set of n must share with a partner."""
    return -(-n * num // den)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            raw, offsets = texts_of(part.column(1))
            words, by = words_of(raw, offsets, lower=True)
            yield part.column(0), shingles_of(words, by, k)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, n (set size), c1 and c2 (128-bit digest of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _sets(batches, k):
            n = np.array([len(s) for s in sets], np.int64)
            d = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(_signed(d[:, 0].copy())), pa.array(_signed(d[:, 1].copy()))], ["key", "n", "c1", "c2"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n long, c1 long, c2 long")


def _screened(docs: DataFrame, text: str, k: int, num: int, den: int) -> DataFrame:
    """c1: the classes that may have a partner, from the first part of the hash order."""
    spark = docs.sparkSession
    cuts = parallelism(spark)
    top = (1 << 64) // SCREEN
    width = -(-top // cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (route, classes, shingles): one per fragment, and credits for shingles that a batch itself shows to be shared."""
        for _, sets in _sets(batches, k):
            seen: dict[int, np.ndarray] = {}
            for s in sets:
                if len(s):
                    seen[xxhash.xxh3_128_intdigest(s.tobytes()) >> 64] = s
            if not seen:
                continue
            ids = np.fromiter(seen, np.uint64, len(seen))
            part = [s[: np.searchsorted(s, np.uint64(top))] for s in seen.values()]
            sizes = np.array([len(s) for s in seen.values()], np.int64)
            heads = np.array([len(p) for p in part], np.int64)
            # What a class may leave unshared in this part is told with its credits, as a negative count of its own.
            grams, owner = np.concatenate(part), np.repeat(np.arange(len(ids)), heads)
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = grams[1:] != grams[:-1]
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=0)[group] > 1 if len(grams) else np.zeros(0, bool)
            credit = np.bincount(owner[many], minlength=len(ids))
            spare = sizes - _need(sizes, num, den) - heads  # below zero: so many must turn out to be shared
            # A shingle that is shared here already goes on once, for the other batches, as class 0.
            send = ~many | new
            g, o, m = grams[send], owner[send], many[send]
            frag = (g // np.uint64(width)).astype(np.int64)
            rest = ((g - frag.astype(np.uint64) * np.uint64(width)) >> np.uint64(max(0, width.bit_length() - 32))).astype(np.uint32)
            # 32 bits tell a fragment's shingles apart; where two of this batch clash, their classes get the benefit.
            clash = np.flatnonzero((g[1:] != g[:-1]) & (rest[1:] == rest[:-1]) & (frag[1:] == frag[:-1]))
            np.add.at(credit, np.r_[o[clash], o[clash + 1]], 1)
            # Row by row: a fragment's classes, how many shingles each has there, and the shingles.
            who = np.where(m, -1, o)
            order = np.lexsort((who, frag))
            frag, who, rest = frag[order], who[order], rest[order]
            run = np.ones(len(frag), bool)
            run[1:] = (frag[1:] != frag[:-1]) | (who[1:] != who[:-1])
            at = np.flatnonzero(run)
            size = np.diff(np.r_[at, len(frag)]).astype(np.uint32)
            name = np.where(who[at] < 0, np.uint64(0), ids[np.maximum(who[at], 0)])
            edge = np.flatnonzero(np.diff(frag[at], prepend=-1, append=1 << 40))
            routes, classes, sizes_, payload = [], [], [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                routes.append(int(frag[at[a]]))
                classes.append(name[a:b].tobytes())
                sizes_.append(size[a:b].tobytes())
                payload.append(rest[at[a] : at[b] if b < len(at) else len(rest)].tobytes())
            balance = (spare + credit).astype(np.int64)
            routes.append(-1 - int(ids[0] % np.uint64(cuts)))
            classes.append(ids.tobytes())
            sizes_.append(b"")
            payload.append(balance.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), *(pa.array(x, pa.binary()) for x in (classes, sizes_, payload))], ["route", "classes", "sizes", "shingles"])

    def count(table: pa.Table) -> pa.Table:
        """In one fragment: how many of a class's shingles some other class has. Balances pass through."""
        route = table.column("route")[0].as_py()
        who = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.uint64)
        if route < 0:
            return _counts(who, np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.int64), np.ones(len(who), bool))
        who = np.repeat(who, np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.uint32))
        grams = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint32)
        order = np.lexsort((who, grams))
        grams, who = grams[order], who[order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        low, high = who[start], who[np.r_[start[1:], len(who)] - 1]
        shared = (low != high) | (low == 0)
        first = np.ones(len(who), bool)  # a class counts once for a shingle, however many batches held it
        first[1:] = new[1:] | (who[1:] != who[:-1])
        hit = shared[group] & (who != 0) & first
        ids, n = np.unique(who[hit], return_counts=True)
        release()
        return _counts(ids, n.astype(np.int64), np.zeros(len(ids), bool))

    def _counts(ids: np.ndarray, n: np.ndarray, own: np.ndarray) -> pa.Table:
        return pa.table({"c1": pa.array(_signed(ids)), "shared": pa.array(np.where(own, 0, n)), "balance": pa.array(np.where(own, n, np.iinfo(np.int64).min))})

    packed = mapped(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), cut, "route long, classes binary, sizes binary, shingles binary")
    counted = packed.groupBy("route").applyInArrow(count, "c1 long, shared long, balance long")
    # A class seen in several batches keeps its best balance; what other batches counted comes from the fragments.
    return counted.groupBy("c1").agg(F.sum("shared").alias("shared"), F.max("balance").alias("balance")).filter("shared + balance >= 0").select("c1")


def _with_sets(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """c1 and the shingles (array<bigint>) of the documents whose keys are in ``wanted``, and of a few others.

    A bitmap of fixed size marks the wanted keys' hashes; it is built by Spark in 4 KB parts and
    broadcast, so that no text is shuffled. A key that only looks wanted brings a spare set.
    """
    spark = docs.sparkSession
    mask = (1 << BITS) - 1
    spots = wanted.select(F.xxhash64("key").alias("h")).select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", BITS).bitwiseAND(mask))).alias("spot"))
    spot = F.col("spot") + 1  # Spark counts bits from 1
    parts = spots.groupBy(F.bitmap_bucket_number(spot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for part in parts:
        bits[(part.n - 1) * 4096 : part.n * 4096] = np.frombuffer(bytes(part.bits), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value

        def marked(h: np.ndarray) -> np.ndarray:
            return (marks[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1

        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            keep = marked((h & np.uint64(mask)).astype(np.int64)) & marked(((h >> np.uint64(BITS)) & np.uint64(mask)).astype(np.int64))
            for _, sets in _sets([b.filter(pa.array(keep))], k):
                at = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=at[1:])
                flat = pa.array(_signed(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))
                names = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) >> 64 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(names)), pa.ListArray.from_arrays(pa.array(at), flat)], ["c1", "grams"])

    return mapped(docs.select(F.xxhash64(key).alias("h"), F.col(text).alias("text")), run, "c1 long, grams array<bigint>")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes that have an edge.

    Alternates large-star and small-star steps: every step links nodes to smaller ones of the same
    component, and after a logarithmic number of rounds each component is a star. Edges are written
    after each round. Neighbourhood minima are partial aggregates, so no node's list meets in a task.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now = written(now, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(now)
    while True:
        # large star: the larger neighbours of a node link to the least node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours link to the least of these
        big = big.filter("u != v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.filter("u != v").distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among classes, by partial overlaps over fragments of the order."""
    n = len(ids)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    use = times[column] > 1
    column, owner = column[use], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    if len(column):
        column = np.cumsum(np.r_[0, np.diff(column) != 0])
    overlap = np.zeros((n, n), np.float32)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(column, column[at] + COLUMNS))
        part = np.zeros((n, int(column[stop - 1] - column[at]) + 1), np.float32)
        part[owner[at:stop], column[at:stop] - column[at]] = 1
        overlap += part @ part.T
        at = stop
    shared = overlap.astype(np.int64)
    linked = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((int(ids[i]), int(ids[j])))
    return out


def jaccard_components(docs: DataFrame, key: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """key, n_shingles, component_id for every row: two rows link when den * shared >= num * all.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; a set is the distinct k-word shingles, a text of
    fewer words is one shingle, and a text without words (or null) has an empty set and links with
    nothing: its component is its own key. component_id is the least key reachable by links. Rows
    with a null key get their size and a null component and link nothing. Repeated rows, and rows
    with equal keys and other texts, are rows of their own; an empty table gives no rows; other
    columns are not read.
    """
    sig = written(signatures(docs, key, text, k), "sig")
    real = F.col("key").isNotNull() & (F.col("n") > 0)
    classes = written(sig.filter(real).groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.first("n").alias("n")), "classes")
    left = written(classes.join(_screened(docs.filter(F.col(key).isNotNull()), text, k, num, den), "c1", "left_semi").select("c1", "rep", "n"), "left")
    sets = _with_sets(docs.filter(F.col(key).isNotNull()), key, text, k, left.select(F.col("rep").alias("key")))
    sets = written(sets.withColumn("n", F.size("grams").cast("long")).withColumn("row", F.monotonically_increasing_id()).filter("n > 0"), "sets")
    # A spare set may be a copy of another one: of equal sets the first row stays.
    firsts = sets.groupBy("c1").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("of")).filter("of > 1")
    spare = written(sets.select("c1", "row").join(firsts, "c1").filter("row > first").select("row"), "spare")
    if spare.limit(1).count():
        sets = sets.join(spare, "row", "left_anti")

    # Exact order: how many of these classes hold a shingle, then its hash. Shingles of one class alone link nothing.
    posts = sets.select("c1", "n", F.explode("grams").alias("g"))
    held = written(posts.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "held")
    # One number carries the order: 16 bits of the count, 48 of the hash; what falls together here only adds candidates.
    place = F.shiftleft(F.least(F.col("df"), F.lit(32767)), 48).bitwiseOR(F.shiftrightunsigned("g", 16))
    kept = join_counted(posts, held, "g", "df").groupBy("c1", "n").agg(F.sort_array(F.collect_list(place)).alias("order"))
    need = F.expr(f"(n * {num} + {den - 1}) div {den}")
    # The first n - need + 1 of the order, less the n - size(order) shingles that come first and are the class's alone.
    first = F.expr("size(order)") - need + 1
    lead = kept.filter(first > 0).select("c1", F.explode(F.slice("order", F.lit(1), first.cast("int"))).alias("g"))
    lead = written(lead, "lead")
    least = written(lead.groupBy("g").agg(F.min("c1").alias("m"), F.count(F.lit(1)).alias("of")).filter("of > 1"), "least")
    near = join_counted(lead, least, "g", "of").filter("c1 != m").select("c1", "m").distinct()
    cluster = connected(near, "c1", "m")

    # Blocks of a cluster by set size; two blocks meet only if their sizes allow a link.
    member = cluster.withColumnRenamed("node", "c1").join(sets.select("c1", "n"), "c1")
    member = ranked(member, ["root"], ["n", "c1"], "at").withColumn("block", F.expr(f"at div {BLOCK}")).drop("at")
    member = written(member, "member")
    ranges = member.groupBy("root", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, two = ranges.alias("one"), ranges.alias("two")
    meets = (F.col("one.root") == F.col("two.root")) & (F.col("one.block") <= F.col("two.block")) & (F.col("one.hi") * den >= F.col("two.lo") * num)
    tasks = one.join(two, meets).select(F.col("one.root").alias("root"), F.col("one.block").alias("i"), F.col("two.block").alias("j"))
    places = tasks.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = places.join(member, ["root", "block"]).join(sets.select("c1", "grams"), "c1").select("root", "i", "j", "c1", "n", "grams")

    def link(table: pa.Table) -> pa.Table:
        ids, sizes = table.column("c1").to_numpy(), table.column("n").to_numpy()
        grams = table.column("grams").combine_chunks()
        at, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        found = forest(ids, sizes, [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], num, den)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    links = dealt.groupBy("root", "i", "j").applyInArrow(link, "a long, b long")
    joined = connected(links, "a", "b")
    lowest = joined.join(left.select(F.col("c1").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = joined.join(lowest, "root").select(F.col("node").alias("c1"), "component_id")
    named = classes.join(joined, "c1", "left").select("c1", "c2", F.coalesce("component_id", "rep").alias("component_id"))
    out = sig.filter(real).join(named, ["c1", "c2"]).select("key", "n", "component_id")
    none = sig.filter(~real).select("key", "n", F.col("key").alias("component_id"))
    return out.unionByName(none).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
