import hashlib
import random
import struct

import pytest

from lodeweave.llm import bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
PARTS = [*"abc thé ÉΣİ'ſ<>|endoftx  \n\t\r\x0b\x1c\x85\u3000sdrem0123½²三語ก์é́😀ß‿", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "aaaaaaa", "     ", "THE", "\u0301", "\u0378"]


def texts(n=250):
    r = random.Random(5)
    return ["", "   ", *("".join(r.choice(PARTS) for _ in range(r.randint(1, 50))) for _ in range(n))]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_and_text_equal_the_library(path):
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.encoder(path)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_every_prefix_count_equals_the_library():
    lib, own = tokenizers.Tokenizer.from_file(BYTES), bpe.encoder(BYTES)
    for t in texts(60):
        assert own.prefix_counts(t) == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], repr(t)


def test_longest_prefix_within_a_limit_equals_the_library():
    lib, own = tokenizers.Tokenizer.from_file(BYTES), bpe.encoder(BYTES)
    for t in texts(120):
        counts = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        for limit in {0, 1, 2, 3, 5, 8, counts[-1] // 2, max(0, counts[-1] - 1), counts[-1]}:
            total, fits = bpe.count_tokens(t, BYTES, limit)
            assert total == counts[-1] and fits == max(i for i, c in enumerate(counts) if c <= limit), (t, limit)
    assert own.prefix_counts("") == [0] and bpe.count_tokens("", BYTES, 3) == (0, 0)


def test_prefix_counts_are_linear():
    import time

    own, began = bpe.encoder(BYTES), time.time()
    for t in ("don't we'll <|endoftext|> x" * 4000, "it's" * 20_000, "a" * 50_000, "word " * 20_000, "<|endoftext|>" * 4000):
        found = own.prefix_counts(t)
        assert len(found) == len(t) + 1 and found[-1] == sum(bpe.count_tokens(t, BYTES, 1)[:1])
    assert time.time() - began < 60


def test_memos_are_bounded_and_forget_nothing_they_need(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 60)
    calls = []
    memo = bpe.Memo(lambda k: calls.append(k) or len(k))
    for i in range(5000):
        assert memo[f"key {i}"] == len(f"key {i}") and memo["often"] == 5
    assert calls.count("often") == 1 and len(memo) + len(memo.old) < 200 and memo["x" * 1000] == 1000 and "x" * 1000 not in memo


def test_automaton_accepts_what_merging_gives():
    """All short words over a small alphabet, merged pair by pair in rank order."""
    import itertools

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "aab"), ("ab", "ab"), ("aa", "aa")]
    vocab = {t: i for i, t in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in merges)])}
    own = bpe.Automaton(vocab, merges)
    merges = [m for i, m in enumerate(merges)]

    def merged(word):
        parts = list(word)
        while True:
            pairs = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not pairs:
                return [vocab[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    for n in range(1, 9):
        for w in itertools.product("ab", repeat=n):
            assert own.path("".join(w)) == merged("".join(w)), w


def test_counts_of_odd_rows(docs, no_docs):
    lib = tokenizers.Tokenizer.from_file(BYTES)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    rows = bpe.token_counts(docs, "doc_id", "text", BYTES, limit=1024).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    by = {r.doc_id: r for r in rows}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for k, r in by.items():
        assert len(lib.encode(text[k][: r.fits_chars], add_special_tokens=False).ids) <= 1024
        assert r.over_limit or r.fits_chars == len(text[k])
    assert bpe.token_counts(no_docs, "doc_id", "text", BYTES).count() == 0


def test_codes_of_odd_rows(docs, no_docs):
    lib = tokenizers.Tokenizer.from_file(WORDS)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode_decode(docs, "doc_id", "text", WORDS, digests=True).collect()
    full = {r.doc_id: r for r in bpe.encode_decode(docs, "doc_id", "text", WORDS).collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, full[r.doc_id].ids, full[r.doc_id].decoded) == (len(ids), ids, said)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.encode_decode(no_docs, "doc_id", "text", WORDS).count() == 0


def whole(texts):
    """Ids and decoded text of each text, as ``op5_bpe`` gets them."""
    ids, stops, said = bpe.code_texts(texts, WORDS)
    return [(ids[a:b].tolist(), s) for a, b, s in zip(stops[:-1], stops[1:], said, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_texts_read_together_equal_the_library(small, monkeypatch):
    """With little room, rows are dropped and words read in many blocks."""
    if small:
        for name, value in {"ROWS": 50, "BLOCK": 40, "SHORT": 6, "MEMO_KEY": 8, "ARC_BITS": 4}.items():
            monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(bpe, "_encoders", {})
    lib, given = tokenizers.Tokenizer.from_file(WORDS), texts(600)
    given += ["İstanbul İ", "Straße ŉ ſ ÀÉ'S don't WE'LL x'sy \"'re\"", "á é ΑΣ Σ", "\x85a\x1cb　c", "x" * 500, "漢字" * 90 + " Ünïcode" * 9, "<|endoftext|>a<|endoftext|><|startoftext|>", "\0 \n\n a\0b \x7f"]
    for low in range(0, len(given), 40):
        part = given[low : low + 40]
        want = [lib.encode(t, add_special_tokens=False).ids for t in part]
        assert whole(part) == [(ids, lib.decode(ids, skip_special_tokens=False)) for ids in want]
    assert bpe.encoder(WORDS).rows.row.keys() and (not small or len(bpe.encoder(WORDS).rows.said) < 2000)


def test_words_read_together_equal_words_read_alone():
    """All short words over a small alphabet, whose merges overlap, with and without a mark of the end."""
    import itertools

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "aab"), ("ab", "ab"), ("aa", "aa")]
    atoms, made = ["a", "b"], [x + y for x, y in merges]
    words = ["".join(w) for n in range(1, 9) for w in itertools.product("ab", repeat=n)]
    marked = [("a", "a"), ("a", "b."), ("aa", "b."), ("b", "a"), ("ba", "a."), ("a", "a.")]
    for own in (
        bpe.Automaton({t: i for i, t in enumerate([*atoms, *made])}, merges),
        bpe.Automaton({t: i for i, t in enumerate([*atoms, "a.", "b.", *dict.fromkeys(x + y for x, y in marked)])}, marked, "."),
    ):
        ids, ends = bpe.Columns(own).paths([w.encode() for w in words])
        found = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert found == [own.path(w) for w in words]


def test_new_short_words_are_not_read_one_by_one(monkeypatch):
    """Words met once make most of the work, and no memory of words helps there; only the long one is read alone."""
    alone, path = [], bpe.Automaton.path
    monkeypatch.setattr(bpe, "_encoders", {})
    monkeypatch.setattr(bpe.Automaton, "path", lambda self, word: alone.append(word) or path(self, word))
    r = random.Random(9)
    words = ["".join(r.choices(["ein", "lich", "zu", "ver", "pf", "tion", "\u00fc", "\u00df"], k=5)) for _ in range(3000)] + ["x" * 1000]
    lib, docs = tokenizers.Tokenizer.from_file(WORDS), [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    assert [ids for ids, _ in whole(docs)] == [lib.encode(t, add_special_tokens=False).ids for t in docs]
    assert alone == ["x" * 1000]
