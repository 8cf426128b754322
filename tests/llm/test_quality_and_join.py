import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import ngram_join, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, hit, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit.update(range(i, i + 5))
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures(docs, no_docs, spark):
    for df in (docs.select("doc_id", "lang", "rank", "text"), spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")):
        text = {r.doc_id: r.text for r in df.collect()}
        rows = quality_rules.measures(df, "text").collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text[r.doc_id]), r.doc_id
    assert quality_rules.measures(no_docs.select("doc_id", "text"), "text").count() == 0


def test_bounds_are_exact():
    import math

    for k, n, level in ((0, 100, 0.05), (3, 50, 0.01), (40, 1000, 0.001), (7, 8, 0.1)):
        p = quality_rules.upper_bound(k, n, level)
        below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert below == pytest.approx(level, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_stop_at_the_first_failure():
    rules = {"r": ("x", [30, 20, 10])}
    f = lambda over, good=5000: quality_rules.certified_cutoffs({("s", "r"): (good, over)}, ["s"], 0.01, 0.05, rules)["s", "r"]
    assert f([0, 1, 4000]) == 20 and f([4000, 0, 0]) is None and f([0, 0, 0], 20) is None and f([0, 0, 0]) == 10


def test_rules_learn_from_labels_and_spare_good_documents(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, words + (" ###" * 15 if i % 10 == 0 else ""), "en") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    got = quality_rules.judge(df, labels, "doc_id", "text", "lang").groupBy((F.col("doc_id") % 10 == 0).alias("bad")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert {r.bad: r.k for r in got} == {True: 0.0, False: 1.0}


def test_small_languages_get_cutoffs(spark):
    """No certificate existed below some 1,642 good documents a language."""
    words = " ".join(f"w{i}" for i in range(40))
    sizes = {"en": 1300, "fr": 498, "de": 493, "es": 320, "it": 20, None: 10}
    rows = [(i, lang, words + (" ###" * 15 if bad else "")) for i, (lang, bad) in enumerate((lang, bad) for lang, n in sizes.items() for bad in [False] * n + [True] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = df.select("doc_id", F.when(F.col("text").contains("#"), 0).otherwise(1).alias("quality"))
    got = quality_rules.judge(df, labels, "doc_id", "text", "lang").join(labels, "doc_id")
    assert got.filter("kept <> (quality = 1)").count() == 0 and got.count() == len(rows)


def test_policies_bound_the_joint_rejection():
    rules = {"a": ("x", [30, 20, 10]), "b": ("y", [2, 1])}
    f = lambda seen: quality_rules.certified_policies({s: Counter(c) for s, c in seen.items()}, 0.01, 0.05, rules)
    few = {(0, 0): 500, (1, 0): 9}
    assert f({"s": few}) == {("s", "a"): 20, ("s", "b"): None}  # a chain stops at its first failure
    many = {(0, 0): 20_000, (1, 0): 900, (0, 1): 90, (0, 2): 20}
    assert f({"s": many}) == {("s", "a"): 20, ("s", "b"): 1}  # a walk goes on with the next rule
    assert f({"s": {(0, 0): 20_000, (2, 0): 120, (0, 1): 120}}) == {("s", "a"): 10, ("s", "b"): 2}  # 120 fit, 240 do not
    assert set(f({"s": {(0, 0): 297}}).values()) == {None} and f({"s": {(0, 0): 150}, "t": {(0, 0): 149}})["t", "b"] == 1
    assert f({}) == {}


def test_lent_level_certifies_the_smallest():
    counts = {(s, "r"): (n, [0]) for s, n in (("a", 500), ("b", 500), ("c", 310))}
    rules = {"r": ("x", [5])}
    assert set(quality_rules.certified_cutoffs(counts, ["a", "b", "c"], 0.01, 0.05, rules).values()) == {5}
    counts["a", "r"] = (500, [9])
    assert quality_rules.certified_cutoffs(counts, ["a", "b", "c"], 0.01, 0.05, rules) == {("a", "r"): None, ("b", "r"): 5, ("c", "r"): None}


def test_judge_odd_rows(docs, no_docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    own = docs.select("doc_id", "lang", "text", "rank", F.lit("x").alias("kept"), F.lit("y").alias("n_words"))
    rows = quality_rules.judge(own, labels, "doc_id", "text", "lang").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality_rules.judge(no_docs.select("doc_id", "lang", "text"), labels.limit(0), "doc_id", "text", "lang").count() == 0


def brute(rows, k, num, den):
    sets = []
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((key, frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    groups = {}
    for i, (key, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(key)
    return sorted((str(key), len(s), str(None if key is None else min(g for g in groups[find(i)] if g is not None))) for i, (key, s) in enumerate(sets))


def joined(df, k, num, den):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(df, "doc_id", "text", k, num, den).collect())


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_join_equals_all_pairs(spark, k, num, den):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    base_words = [f"w{i}" for i in range(120)]
    for i in range(60):  # near copies about the threshold, in chains
        w = list(base_words)
        for j in range(i % 7):
            w[(i * 17 + j * 31) % 120] = f"x{i}_{j}"
        rows.append((100_000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(df, k, num, den) == brute(rows, k, num, den)


def test_join_odd_rows(docs, no_docs):
    assert joined(docs, 4, 85, 100) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)
    assert joined(no_docs, 4, 85, 100) == []


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    w = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(w[:i] + [f"z{i}"] + w[i + 1 :])) for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_components_of_long_paths(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(900, 901), (901, 902), (902, 900), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.connected(pairs, "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {900: 900, 901: 900, 902: 900}
