import base64
import hashlib
import struct

import pytest
import xxhash

from lodeweave.llm import fingerprints as fp


SINGLE = [(0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def symbols(text):
    """Symbols letter by letter."""
    out, last = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            kind = "space"
        elif any(a <= ord(c) <= b for a, b in SINGLE):
            kind = "single"
        else:
            kind = "digit" if c in "0123456789" else "capital" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "small"
        goes_on = kind == last != "single" or (last == "capital" and kind == "small")
        if kind != "space":
            if goes_on:
                out[-1] += c
            else:
                out.append(c)
        last = kind
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    """Spark's hash of several long values."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_anchors(text, k, s):
    """(place, hash) of every k-mer whose least s-mer lies at an edge, by definition."""
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in symbols(text)]
    smers = [chain(h[i : i + s]) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        inner = smers[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(h[i : i + k])))
    return out


def plain_likeness(a, b):
    """Matches of first anchors, in the order of a, that move on in b, over all."""
    first = lambda x: {h: p for p, h in reversed(x)}
    a, b = first(a), first(b)
    places = [b[h] for h, _ in sorted(a.items(), key=lambda x: x[1]) if h in b]
    n = sum(i == 0 or places[i - 1] < p for i, p in enumerate(places))
    return n / (len(a) + len(b) - n) if a or b else 1.0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_anchors_and_likeness_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r for r in fp.fingerprint_edits(docs, "doc_id", "text").collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    assert len(got) == len(rows)
    size = chars = 0
    for i, (key, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (plain_anchors(x, fp.K, fp.S) for x in (t, e, nxt))
        size, chars = size + len(got[key].fingerprint), chars + len(t)
        if not (a and b and c):
            continue  # one anchor stands for the whole text
        assert base64.b64decode(got[key].fingerprint) == b"".join(struct.pack(">I", h & 0xFFFFFFFF) for _, h in a), key
        assert base64.b64decode(got[key].edited_fingerprint) == b"".join(struct.pack(">I", h & 0xFFFFFFFF) for _, h in b), key
        assert got[key].near_edited == pytest.approx(plain_likeness(a, b)) and got[key].near_next == pytest.approx(plain_likeness(a, c)), key
    assert size < chars / 7


def test_symbols_are_context_free(spark):
    texts = ["Hello wORLD don't", "aGVsbG8gd29ybGQ123abc45", "ภาษาไทย ລາວ 漢字かな한글", "\U00020000\U00020001x", "a\u00a0b\u2003c", "", " \t\x0b", "HTML5 x1y2 ÉCOLE été"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("t", fp.F.regexp_extract_all("t", fp.F.lit(fp.SYMBOL), fp.F.lit(0)).alias("w")).collect():
        assert r.w == symbols(r.t), r.t


def test_order_counts(spark):
    """The same anchors the other way round are less alike than in order."""
    parts = [" ".join(f"p{i}w{j * 7 % 53}" for j in range(40)) for i in range(6)]
    df = spark.createDataFrame([(" ".join(parts), " ".join(parts[::-1]), "before " + " ".join(parts))], "a string, b string, c string")
    d = lambda c: fp.distinct_anchors(fp.anchors(fp.F.col(c)))
    r = df.select(fp.likeness(d("a"), d("a")).alias("same"), fp.likeness(d("a"), d("b")).alias("back"), fp.likeness(d("a"), d("c")).alias("moved")).first()
    assert r.same == 1.0 and r.moved > 0.8 and r.back < r.moved


def test_far_and_repeated_keys_do_not_meet_in_one_cell(spark):
    """One far key, and one key with half of the rows: the next rows are right."""
    rows = [(i, f"text {i} " * (i % 9 + 1)) for i in range(150)] + [(1 << 62, "far")] + [(70, f"copy {i}") for i in range(150)] + [(71, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fp.fingerprint_edits(df, "doc_id", "text").collect()
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42)) >> 1
    rows.sort(key=lambda r: (r[0], tie(r[1])))
    want = [(k, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for i, (k, t) in enumerate(rows)]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def edits(rows):
    """(key, text) rows -> (text, edited, next) in key order, the last followed by the first."""
    rows = sorted(((k, t or "") for k, t in rows if k is not None), key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1].encode(), 42) >> 1))
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        yield k, t, t[: len(t) - half] + nxt[:half], nxt


def check(df, got):
    want = sorted((k, len(t), hashlib.sha256(e.encode()).hexdigest()) for k, t, e, _ in edits([(r.doc_id, r.text) for r in df.collect()]))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want


def test_odd_rows(docs, no_docs):
    got = fp.fingerprint_edits(docs, "doc_id", "text").collect()
    assert len(got) == docs.count()
    check(docs, got)
    by = {}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        assert by.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[""] == "" and fp.fingerprint_edits(no_docs, "doc_id", "text").count() == 0


def test_sparse_keys_and_a_single_row(spark):
    df = spark.createDataFrame([(i * i * 1_000_003, f"text number {i} of a few words " * (i % 5)) for i in range(-20, 60)], "doc_id long, text string").dropDuplicates(["doc_id"])
    check(df, fp.fingerprint_edits(df, "doc_id", "text").collect())
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    r = fp.fingerprint_edits(one, "doc_id", "text").first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


def test_half_edited_is_nearer_than_the_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in fp.fingerprint_edits(docs, "doc_id", "text").collect() if r.n_chars >= 200]
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.99 * len(rows)


def test_anchors_are_context_free(spark):
    """The anchors of a piece are found again, moved, when other text stands before and after it; here two k-mers of three are anchors."""
    piece = " ".join(f"w{i * 37 % 101}" for i in range(60))
    both = spark.createDataFrame([(piece, "some other words first " + piece + " and some after")], "a string, b string")
    r = both.select(fp.anchors(both.a, 4, 2).alias("a"), fp.anchors(both.b, 4, 2).alias("b")).first()
    assert {(x.pos + 4, x.hash) for x in r.a} <= {(x.pos, x.hash) for x in r.b} and len(r.a) > 20
