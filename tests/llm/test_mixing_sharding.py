import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import mixing, sharding
from lodeweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001/documents.parquet"


def sized(df):
    return df.select("doc_id", "source", mixing.word_count("text").alias("size"), "rank")


def test_targets_fill_up_to_the_cap():
    got = mixing.fill_targets([10, 100, 1000], [1, 2, 3], 1110, 3)
    assert got[0] == 30 and got[1] == 300 and got[2] == 780
    assert sum(mixing.fill_targets([5, 5], [1, 1], 10, 3)) == 10
    assert mixing.fill_targets([0, 4], [1, 2], 4, 3) == [0, 4]
    assert mixing.fill_targets([], [], 0, 3) == [] and mixing.fill_targets([1], [1], 30, 3) == [Fraction(3)]


def test_mix_is_near_its_targets_and_stable(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "source", mixing.word_count("text").alias("size"))
    mix = lambda: {r.doc_id: r for r in mixing.mix_counts(docs, "source", "size", "doc_id", [1, 2, 3]).collect()}
    rows = mix()
    assert {k: r.copies for k, r in rows.items()} == {k: r.copies for k, r in mix().items()}
    assert len(rows) == docs.count() and max(r.copies for r in rows.values()) <= 3
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows.values():
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for r in rows.values():
        assert abs(taken[r.source] - r.target) <= largest[r.source]
    sizes = Counter()
    for r in rows.values():
        sizes[r.source] += r.size
    want = mixing.fill_targets([sizes[s] for s in sorted(sizes)], [[1, 2, 3][i % 3] for i in range(len(sizes))], sum(sizes.values()), 3)
    assert {r.source: r.target for r in rows.values()} == {s: float(t) for s, t in zip(sorted(sizes), want, strict=True)}


def ties(spark, df, seed):
    """doc_id -> the seeded hash that orders equal rows."""
    return {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).collect()}


def sort_key(value):
    return (value is not None, value or "")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_equals_brute_force(spark, sf):
    """Sort, prefix-sum and count boundaries in exact fractions; one offset per source."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(r.doc_id, r.source, len(word.findall(r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    tie = ties(spark, docs, 11)
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    draw = {r.source: r.d for r in docs.select("source").distinct().withColumn("d", F.pmod(F.xxhash64(F.lit(11), "source"), F.lit(1 << 40))).collect()}
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    left, targets, open_ = Fraction(sum(size.values())), {}, list(sources)
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    while open_:  # water filling, one pass for every round of caps
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * size[s]]
        for s in over or open_:
            targets[s] = Fraction(3 * size[s]) if over else share * weight[s]
        left -= sum(targets[s] for s in over)
        open_ = [s for s in open_ if s not in targets]
    want = {}
    for s in sources:
        rate = targets[s] / size[s]
        at = Fraction(math.floor(Fraction(draw[s] * rate.denominator, 1 << 40)), rate.denominator)
        for k, _, n in sorted((x for x in rows if x[1] == s), key=lambda x: (x[2], tie[x[0]], x[0])):
            want[k] = (n, size[s], float(targets[s]), n * (math.floor(at + rate) - math.floor(at)))
            at += rate
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in QUERIES["op1_mix_sources"](spark, f"/root/testdata/{sf}").collect()}
    assert got == want


def test_inclusion_is_unbiased(spark):
    """Over many seeds the mean number of copies of every document is target / source size."""
    docs = spark.createDataFrame([(i, "s" if i % 3 else "t", i + 1) for i in range(12)], "doc_id long, source string, size long").cache()
    total, seeds = Counter(), 16
    for seed in range(seeds):
        for r in mixing.mix_counts(docs, "source", "size", "doc_id", [1, 2], seed=seed).collect():
            total[r.doc_id] += (r.copies - r.target / r.source_size) / seeds
    assert all(abs(x) < 0.5 for x in total.values()) and abs(sum(total.values())) < 1.5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.source, r.doc_id) for r in docs.select("source", "doc_id").collect()]
    tie, of, seen, order = ties(spark, docs, 7), Counter(s for s, _ in rows), Counter(), []
    for s, k in sorted(rows, key=lambda x: (sort_key(x[0]), tie[x[1]], x[1])):
        order.append((Fraction(2 * seen[s] + 1, 2 * of[s]), sort_key(s), tie[k], k))
        seen[s] += 1
    want, slots = {}, Counter()
    for i, (_, _, _, k) in enumerate(sorted(order)):
        shard = i * 8 // len(order)
        want[k] = (shard, slots[shard])
        slots[shard] += 1
    got = {r.doc_id: (r.shard, r.slot) for r in QUERIES["op3_shards"](spark, f"/root/testdata/{sf}").collect()}
    assert got == want


def test_rows_without_keys_spread_and_are_all_placed(spark):
    docs = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"))
    rows = sharding.interleave_shards(docs, "source", "doc_id", 3).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted((r.shard, r.n, r.m) for r in rows) == [(0, 300, 299), (1, 300, 299), (2, 300, 299)]
    assert mixing.mix_counts(docs, "source", "size", "doc_id", [1]).filter("copies = 1").count() == 900


def test_copies_follow_the_prefix_sum(spark):
    """Each source takes floor(n * rate + offset) - floor(offset) documents in all."""
    docs = spark.createDataFrame([(i, "s" if i % 3 else "t", 10) for i in range(300)], "doc_id long, source string, size long")
    rows = mixing.mix_counts(docs, "source", "size", "doc_id", [1, 2]).collect()
    for s, n in (("s", 200), ("t", 100)):
        copies = [r.copies for r in rows if r.source == s]
        rate = next(r.target / r.source_size for r in rows if r.source == s)
        assert len(copies) == n and abs(sum(copies) - n * rate) <= 1 and set(copies) <= {int(rate), int(rate) + 1}


def test_mix_of_odd_rows(docs, no_docs):
    rows = mixing.mix_counts(sized(docs), "source", "size", "doc_id", [1, 2, 3]).collect()
    assert len(rows) == docs.count() and any(r.source is None for r in rows) and all(r.copies <= 3 for r in rows)
    assert mixing.mix_counts(sized(no_docs), "source", "size", "doc_id", [1]).count() == 0
    clash = mixing.mix_counts(sized(docs).withColumnRenamed("rank", "target"), "source", "size", "doc_id", [1])
    assert clash.columns.count("target") == 1 and dict(clash.dtypes)["target"] == "double" and clash.count() == len(rows)
    drawn = sum(r.copies for r in rows)
    assert mixing.mixed(sized(docs), "source", "size", "doc_id", [1, 2, 3]).count() == drawn


def test_shards_are_level_gapless_and_proportional(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "source")
    rows = sharding.interleave_shards(docs, "source", "doc_id", 8).collect()
    n, by = Counter(r.shard for r in rows), defaultdict(list)
    assert len(rows) == docs.count() and set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    share = Counter(r.source for r in rows)
    for r in rows:
        by[r.shard].append(r)
    for shard, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for s, c in Counter(r.source for r in own).items():
            assert abs(c - share[s] / 8) <= 2, (shard, s)


def test_shards_of_odd_rows(docs, no_docs):
    rows = sharding.interleave_shards(docs.select("doc_id", "source", "rank"), "source", "doc_id", 3).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(n.values()) - min(n.values()) <= 1
    assert sharding.interleave_shards(no_docs.select("doc_id", "source"), "source", "doc_id", 3).count() == 0
    clash = sharding.interleave_shards(docs.withColumnRenamed("rank", "slot"), "source", "doc_id", 3)
    assert clash.columns.count("slot") == 1 and clash.count() == len(rows)
