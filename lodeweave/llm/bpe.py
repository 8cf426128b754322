"""BPE by a tokenization automaton; token counts at every prefix.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It
starts as one that reads atoms (single bytes, or a byte with the end-of-word mark) in any order.
Each merge a + b -> ab, in rank order, adds one gadget: the state after a loses its arc b; a new
arc ab leaves every state that still has an arc a; and the state after ab starts with the arcs the
state after b has at that moment. There is one state per token, so a gadget is stored as its rank
and its two parts, and an arc is settled by walking back through the gadgets that made its ends;
settled arcs stay in the transition table.

A word's encoding is the one accepted path that spells it. Every prefix of a word has one such path
too, and a prefix's path is the path of a shorter prefix plus one arc, so a left-to-right table
over prefixes finds it in one pass and holds the token count of every prefix on the way. The labels
that end at each letter come from a matcher over all labels, compiled once per worker. Many short
words are read at once: their tables are filled side by side, column by column, by array operations.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

MARK = "\ue000"  # stands for the end-of-word suffix while a word is being read
MEMO = 80_000  # entries in one generation of a worker's memo
MEMO_KEY = 256  # longer keys are not remembered, so that entries bound bytes
ARCS = 200_000  # settled arcs a worker remembers
SHIFT = 1 << 20
ARC_BITS = 18  # bits of a settled arc's place in the table that many words share
BLOCK = 150_000  # letters of the words read at once, so that their matches take some 20 MB
SHORT = 128  # longer words, in bytes, are read one by one
GROUP = 1 << 20  # bytes of text whose new words are read together
ROWS = 160_000  # pieces whose ids and labels a worker keeps


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Memo(dict):
    """A function's results, remembered for two generations of ``MEMO`` entries: what is used again stays."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function, self.old = function, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.function(key)
            if len(key) > MEMO_KEY:
                return found
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """Whole numbers by distinct keys, for many keys at a time: -1 where a key is unknown."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        place = _places(keys, self.bits)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]  # of those with one place the last stays, the others go on
            own = self.keys[place] == keys
            self.values[place[own]] = values[own]
            keys, values, place = keys[~own], values[~own], (place[~own] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = _places(keys, self.bits)
        held = self.keys[place]
        other = held != keys
        out = self.values[place]
        out[other] = -1
        todo = np.flatnonzero(other & (held >= 0))
        place = place[todo]
        while len(todo):
            place = (place + 1) & (len(self.keys) - 1)
            held = self.keys[place]
            own = held == keys[todo]
            out[todo[own]] = self.values[place[own]]
            more = ~own & (held >= 0)
            todo, place = todo[more], place[more]
        return out


class Columns:
    """The automaton for many words at a time: a trie of the tokens' bytes, and its gadgets as arrays.

    A symbol is a byte; the last byte of a word has 256 added where the file marks the ends of words,
    and ``STOP`` follows every word.
    """

    STOP, SYMBOLS = 512, 513

    def __init__(self, automaton: Automaton) -> None:
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.marked = bool(automaton.end)
        nodes: dict[int, int] = {}
        token = [-1]
        for t, i in automaton.tokens():
            at, letters = 0, [byte_of.get(c, -1) for c in t.removesuffix(MARK)]
            if -1 in letters or not letters:  # no word has such a letter
                continue
            if t.endswith(MARK):
                letters[-1] += 256
            for x in letters:
                key = at * self.SYMBOLS + x
                at = nodes.get(key, 0)
                if not at:
                    at = nodes[key] = len(token)
                    token.append(-1)
            token[at] = i
        self.token = np.array(token, np.int32)
        self.next = Lookup(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.first = np.array([nodes.get(x, -1) for x in range(self.SYMBOLS)], np.int32)
        self.made, self.left, self.right = (np.array(x, np.int32) for x in (automaton.made, automaton.left, automaton.right))
        cut = automaton.cut
        self.cut = Lookup(np.fromiter((u * SHIFT + v for u, v in cut), np.int64, len(cut)), np.fromiter(cut.values(), np.int32, len(cut)))
        self.none = len(self.made) + len(cut)
        self.settled = np.full(1 << ARC_BITS, -1, np.int64)  # 2 * (u, v) + arc, the latest at its place

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """If each v may follow its u."""
        key = u.astype(np.int64) * SHIFT + v
        place = _places(key, ARC_BITS)
        held = self.settled[place]
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            held[new] = found = 2 * key[new] + self._settle(u[new], v[new])
            self.settled[place[new]] = found
        return (held & 1).astype(bool)

    def _settle(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``Automaton._settle`` for many arcs."""
        out, todo, limit = np.zeros(len(u), bool), np.arange(len(u)), np.full(len(u), self.none, np.int32)
        while len(todo):
            rank = self.cut.get(u.astype(np.int64) * SHIFT + v)
            a, b = self.made[u], self.made[v]
            begun, kept = a > b, (rank < 0) | (rank >= limit)
            out[todo[kept & ~begun & (b < 0)]] = True
            on = kept & (begun | (b >= 0))
            todo, u, v, a, b, begun = todo[on], u[on], v[on], a[on], b[on], begun[on]
            limit = np.where(begun, a, b + 1)
            u, v = np.where(begun, self.right[u], u), np.where(begun, v, self.left[v])
        return out

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (none empty), one word after another, and where each word's ids end."""
        symbol = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        symbol[stop] = self.STOP
        if self.marked:
            symbol[stop - 1] += 256
        offset = (np.arange(len(symbol)) - np.repeat(stop - size, size + 1)).astype(np.uint16)

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # matches: start, end, token
        at = np.flatnonzero(symbol != self.STOP).astype(np.int32)
        node, depth = self.first[symbol[at]], 0
        while True:
            on = node >= 0
            at, node, depth = at[on], node[on], depth + 1
            if not len(at):
                break
            token = self.token[node]
            hit = token >= 0
            found.append((at[hit], at[hit] + depth, token[hit]))
            node = self.next.get(node.astype(np.int64) * self.SYMBOLS + symbol[at + depth])
        start, end, token = (np.concatenate(x) for x in zip(*found, strict=True))
        column = offset[start]
        order = np.argsort(column, kind="stable")
        start, end, token = start[order], end[order], token[order]
        bounds = np.cumsum(np.bincount(column)).tolist()

        last, back = np.full(len(symbol), -1, np.int32), np.zeros(len(symbol), np.int32)
        low = 0
        for high in bounds:  # an earlier column has the longer tokens, and one token at most may end at a letter
            s, e, t = start[low:high], end[low:high], token[low:high]
            if low:
                u = last[s]
                on = np.flatnonzero((last[e] < 0) & (u >= 0))
                s, e, t, u = s[on], e[on], t[on], u[on]
                on = np.flatnonzero(self.arcs(u, t))
                s, e, t = s[on], e[on], t[on]
            last[e], back[e] = t, s
            low = high
        if (last[stop] < 0).any():
            raise ValueError(f"no token path spells {words[int(np.argmax(last[stop] < 0))]!r}")
        taken, ends, begin = np.zeros(len(symbol), bool), stop, stop - size
        while len(ends):
            taken[ends] = True
            ends = back[ends]
            on = ends > begin
            ends, begin = ends[on], begin[on]
        return last[taken], np.cumsum(taken)[stop]


class Automaton:
    """Tokens as states; ``arc(u, v)`` says if v may follow u."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.end = MARK if suffix else ""

        def own(token: str) -> str:
            return token[: -len(suffix)] + self.end if suffix and token.endswith(suffix) and token != suffix else token

        self.ids = {own(t): i for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.made, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.cut: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, self.ids[own(a)], self.ids[own(b)], self.ids[own(a + b)])
        self.table: dict[tuple[int, int], bool] = {}
        self.labels = {i: t for t, i in vocab.items()}

    @cached_property
    def reader(self) -> ahocorasick.Automaton:
        """Finds every token that ends at a letter, the longest first."""
        out = ahocorasick.Automaton()
        for t, i in self.tokens():
            out.add_word(t, (i, len(t)))
        out.make_automaton()
        return out

    def tokens(self) -> list[tuple[str, int]]:
        """Atoms and what merges make, with their ids."""
        return [(t, i) for t, i in self.ids.items() if self.made[i] >= 0 or len(t) == 1 + t.endswith(MARK)]

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        self.cut[a, b] = rank
        self.made[ab], self.left[ab], self.right[ab] = rank, a, b

    def arc(self, u: int, v: int) -> bool:
        found = self.table.get(u * SHIFT + v)
        return self._fill(u, v) if found is None else found

    def _fill(self, u: int, v: int) -> bool:
        if len(self.table) > ARCS:
            self.table.clear()
        found = self.table[u * SHIFT + v] = self._settle(u, v)
        return found

    def _settle(self, u: int, v: int) -> bool:
        cut, made = self.cut, self.made
        limit = len(made) + len(cut)
        while True:
            if cut.get((u, v), limit) < limit:
                return False
            if made[u] > made[v]:  # u's state began with the arcs its right part had before u's gadget
                limit, u = made[u], self.right[u]
            elif made[v] >= 0:  # an arc v left u only if u kept the arc of v's left part after v's gadget
                limit, v = made[v] + 1, self.left[v]
            else:
                return True

    def prefixes(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """For every prefix length of ``word``: its token count (-1 if no path), last token and that token's start.

        One token at most may end a prefix after the path of the prefix before it, so the tokens that end
        at a letter are tried until one may, and the time is linear in the word's length.
        """
        n, known, fill = len(word), self.table.get, self._fill
        count, last, start = [-1] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        count[0] = settled = 0
        for i, (t, size) in self.reader.iter(word):
            i += 1
            if i == settled:
                continue
            j = i - size
            if j:
                if count[j] < 0:
                    continue
                u = last[j]
                ok = known(u * SHIFT + t)
                if ok is None:
                    ok = fill(u, t)
                if not ok:
                    continue
            count[i], last[i], start[i], settled = count[j] + 1, t, j, i
        return count, last, start

    def path(self, word: str) -> list[int]:
        """Token ids of a word whose atoms are all in the vocabulary, read back from its prefix table."""
        whole = word + self.end
        count, last, start = self.prefixes(whole)
        at = len(whole)
        if count[at] < 0:
            raise ValueError(f"no token path spells {word!r}")
        out = []
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]


#: White space of the files' patterns; Latin letters with marks, which most European text keeps to.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = r"\xc0-\xd6\xd8-\xf6\xf8-\u017f"
#: Letters and numbers of Unicode 16 that Python's own tables (15.1) do not have yet.
LETTERS_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Capitals whose small letter Python's tables lack: first, last, small letter of the first.
CAPITALS = "1c89 1c89 1c8a, a7cb a7cb 264, a7cc a7cc a7cd, a7ce a7ce a7cf, a7d2 a7d2 a7d3, a7d4 a7d4 a7d5, a7da a7da a7db, a7dc a7dc 19b, 10d50 10d65 10d70, 16ea0 16eb8 16ebb"


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{x:08x}-\U{y:08x}" for x, y in out)


def _class(name: str, more: str) -> str:
    """Unicode 16's letters or numbers as a character class, whatever version the regex module has."""
    added = {c for x in more.split() for c in range(int(x[:-1].split("-")[0], 16), int(x.split("-")[1], 16) + 1)}
    unknown = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
    later = sorted({ord(c) for c in regex.findall(rf"\p{{{name}}}", unknown)} - added)
    inside = rf"\p{{{name}}}{_ranges(sorted(added))}"
    return f"[[{inside}]--[{_ranges(later)}]]" if later else f"[{inside}]"


_CAPITALS = {i: int(c, 16) + i - int(a, 16) for a, b, c in (x.split() for x in CAPITALS.split(", ")) for i in range(int(a, 16), int(b, 16) + 1)} | {ord("Σ"): "σ"}


def small_letters(text: str) -> str:
    """Lower case letter by letter, without regard to the place in the word."""
    return text.lower() if text.isascii() else text.translate(_CAPITALS).lower()


class Encoder:
    """A tokenizer file's whole path from text to ids and back, for byte-level BPE files.

    ``chunks`` are spans no token crosses; they are encoded once and remembered.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE files are read")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self._paths = Memo(lambda piece: tuple(self.automaton.path(self.spelled(piece))))
        self._counts = Memo(lambda piece: self.automaton.prefixes(self.spelled(piece) + self.automaton.end)[0][-1])
        self.counted = Memo(self.count)
        self._pieces = Memo(lambda chunk: self.pieces(chunk.decode()))
        self.letters = byte_letters()
        self.letter_of = {b: c for b, c in enumerate(self.letters) if chr(b) != c}
        self.labels = self.automaton.labels | {a["id"]: a["content"] for a in added}
        self.special = {a["content"]: a["id"] for a in added}
        self._specials = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        letter, number = _class("L", LETTERS_16), _class("N", NUMBERS_16)
        space = SPACE
        other = rf"(?:(?!{letter}|{number})[^{space}])+"
        self.words = bool(spec["normalizer"])
        if self.words:  # normalised, lower case, white space dropped; a chunk is what stands between ASCII white space
            self._piece = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}")
            self._common = re.compile(rf"[a-z{LATIN}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^{space}a-z0-9{LATIN}]+")
        else:  # a chunk is an optional space and what follows up to white space, or white space
            self._chunk = re.compile(rf" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+")
            self._piece = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}|[{space}]+(?![^{space}])|[{space}]+")
            self._common = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^{space}A-Za-z0-9{LATIN}]+|[{space}]+(?![^{space}])|[{space}]+")
        self._usual = re.compile(rf"[\x00-\x7f{LATIN}]*").fullmatch

    @cached_property
    def rows(self) -> Rows:
        return Rows(self)

    def split(self, text: str) -> list[str]:
        """Chunks of a stretch without special tokens."""
        return [c.decode() for c in text.encode().split()] if self.words else self._chunk.findall(text)

    def pieces(self, chunk: str) -> list[str]:
        if self.words:
            chunk = small_letters(chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk))
        return (self._common if self._usual(chunk) else self._piece).findall(chunk)

    def ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(chunk):
            out += self._paths[piece]
        return out

    def count(self, chunk: str) -> int:
        """Tokens of a chunk, from the last entries of its pieces' prefix tables."""
        return sum([self._counts[piece] for piece in self.pieces(chunk)])

    def spelled(self, piece: str) -> str:
        """The letters of a piece's bytes."""
        return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letter_of)

    def cut(self, text: str) -> list[str]:
        """Pieces of a stretch without special tokens, for a word-level file."""
        if self._usual(text) and "İ" not in text:  # letters that are composed already and stay usual in lower case
            return self._common.findall(text.lower())
        return [piece for chunk in text.encode().split() for piece in self._pieces[chunk]]

    def parts(self, text: str) -> list[tuple[str, int]]:
        """(stretch, -1) and (special token, its id), in order."""
        if self._specials is None or not any(s in text for s in self.special):
            return [(text, -1)]
        return [(x, self.special.get(x, -1)) for x in self._specials.split(text) if x]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the tokenizers library gives them without added special tokens."""
        out: list[int] = []
        for stretch, special in self.parts(text):
            if special >= 0:
                out.append(special)
            else:
                for chunk in self.split(stretch):
                    out += self.ids(chunk)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs taken, joined as the file's decoder joins them."""
        if self.words:
            return " ".join([self.labels[i] for i in ids])
        back = {c: b for b, c in enumerate(self.letters)}
        return b"".join(bytes([back[c] for c in self.labels[i]]) if i in self.automaton.labels else self.labels[i].encode() for i in ids).decode("utf-8", "replace")

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of every prefix of ``text`` by code points (length + 1 numbers); byte-level files.

        Whole pieces are summed and the automaton's prefix table of a piece answers inside it. What a cut
        changes in how the text before it splits is local: one that ends in white space makes that run
        one piece, which has a table of its own; one inside a contraction leaves its first letters, which
        are encoded by themselves; one inside a special token's string leaves letters that belong to the
        last chunks before it, which are encoded with them. So the time grows with the text.
        """
        table, space = self._table, re.compile(rf"[{SPACE}]+")
        out, base, pos = [0], 0, 0
        tail, before = "", 0  # the last chunks before a special token, and the count before them
        for stretch, special in self.parts(text):
            if special >= 0:
                out += [before + len(self.encode(tail + stretch[:n])) for n in range(1, len(stretch))]
                base += 1
                pos += len(stretch)
                out.append(base)
                tail, before = "", base
                continue
            counts = [base]
            chunks = self.split(stretch)
            for chunk in chunks:
                for piece in self.pieces(chunk):
                    if piece[0] == "'" and len(piece) > 1:
                        out += [base + len(self.ids(piece[:n])) for n in range(1, len(piece))] + [base + table(piece)[-1]]
                    else:
                        out += [base + c for c in table(piece)[1:]]
                    base = out[-1]
                counts.append(base)
            for run in space.finditer(stretch):
                a, own = pos + run.start(), table(run[0])
                out[a + 1 : a + 1 + len(run[0])] = [out[a] + c for c in own[1:]]
            pos += len(stretch)
            tail, before = "".join(chunks[-2:]), counts[-3] if len(chunks) > 1 else counts[0]
        return out

    def _table(self, piece: str) -> list[int]:
        """Token counts of a piece's prefixes by code points."""
        by_byte = self.automaton.prefixes(self.spelled(piece))[0]
        out, at = [0], 0
        for c in piece:
            at += len(c.encode())
            out.append(by_byte[at])
        return out


class Rows:
    """Ids and labels of pieces in numbered rows, for a word-level file; a special token's id stands for its piece.

    Beyond ``ROWS`` pieces room is made: those of the group at hand stay. Only one group with more pieces than that takes more.
    """

    def __init__(self, enc: Encoder) -> None:
        self.enc, self.columns = enc, Columns(enc.automaton)
        self.row: dict[str | int, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.said: list[str] = []

    def of(self, pieces: list[str | int]) -> np.ndarray:
        """The row of each piece, good until the next call."""
        now = set(pieces)
        new = now.difference(self.row)
        if len(self.said) + len(new) > ROWS or len(self.ids) > 8 * ROWS:
            self._keep(list(now - new))
        if new:
            self._learn(new)
        found = np.fromiter(map(self.row.__getitem__, pieces), np.int64, len(pieces))
        for p in [p for p in new if isinstance(p, str) and len(p) > MEMO_KEY]:
            del self.row[p]
        return found

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one after another, and where each row's ids end."""
        size = self.size[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[rows] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], ends

    def _keep(self, pieces: list[str | int]) -> None:
        rows = np.fromiter(map(self.row.__getitem__, pieces), np.int64, len(pieces))
        self.row, self.said = dict(zip(pieces, range(len(pieces)), strict=True)), [self.said[i] for i in rows.tolist()]
        (self.ids, ends), self.size = self.spread(rows), self.size[rows]
        self.begin = ends - self.size

    def _learn(self, pieces: set[str | int]) -> None:
        short: list[tuple[str, bytes]] = []
        single: dict[str | int, list[int]] = {}
        for p in pieces:
            if isinstance(p, int):
                single[p] = [p]
            elif len(word := p.encode()) > SHORT:
                single[p] = self.enc.automaton.path(self.enc.spelled(p))
            else:
                short.append((p, word))
        if single:
            self._add(list(single), np.array([i for x in single.values() for i in x], np.int32), np.cumsum([len(x) for x in single.values()]))
        ends = np.cumsum([len(x) for _, x in short])
        low = 0
        while low < len(short):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, "right")))
            self._add([p for p, _ in short[low:high]], *self.columns.paths([x for _, x in short[low:high]]))
            low = high

    def _add(self, pieces: list[str | int], ids: np.ndarray, ends: np.ndarray) -> None:
        labels, a, n = [self.enc.labels[i] for i in ids.tolist()], 0, len(self.said)
        for b in ends.tolist():
            self.said.append(" ".join(labels[a:b]))
            a = b
        begin = np.concatenate([[0], ends[:-1]])
        self.row.update(zip(pieces, range(n, len(self.said)), strict=True))
        self.begin, self.size = np.concatenate([self.begin, begin + len(self.ids)]), np.concatenate([self.size, ends - begin])
        self.ids = np.concatenate([self.ids, ids])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The file's encoder, made once per worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def count_tokens(text: str, path: str, limit: int) -> tuple[int, int]:
    """(tokens of the whole text, code points of its longest prefix of at most ``limit`` tokens).

    No token crosses a chunk's end, so that prefix ends in the chunk that goes over the limit or in a
    special token's string; the prefix table of the chunks around answers inside them.
    """
    enc = encoder(path)
    total, at, fits = 0, 0, -1
    last: list[tuple[int, int]] = [(0, 0)]  # (code points, tokens) before the last chunks and here
    for stretch, special in enc.parts(text):
        chunks = [stretch] if special >= 0 else enc.split(stretch)
        counts = [1] if special >= 0 else [enc.counted[c] for c in chunks]
        n = sum(counts)
        if fits < 0 and total + n <= limit:
            rear = [(at + len(stretch) - sum(map(len, chunks[i:])), total + n - sum(counts[i:])) for i in (-2, -1) if special < 0 and len(chunks) >= -i]
            last = (last + rear)[-3:] + [(at + len(stretch), total + n)]
        elif fits < 0:
            sums = list(accumulate(counts, initial=total))
            over = bisect_right(sums, limit) - 1  # the chunk that goes over
            ends = list(accumulate(map(len, chunks[: over + 1]), initial=at))
            last = (last[-3:] + list(zip(ends, sums, strict=False))[max(1, over - 3) : over + 1])[-4:]
            start, before = last[max(0, len(last) - 3)]
            inside = enc.prefix_counts(text[start : ends[-1]])
            fits = start + max(i for i, x in enumerate(inside) if before + x <= limit)
        total += n
        at += len(stretch)
    return total, fits if fits >= 0 else at


def token_counts(docs: DataFrame, key: str, text: str, path: str, limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit and fits_chars per row; counts are of whole texts.

    ``fits_chars`` is the length of the longest prefix of at most ``limit`` tokens, from the prefix tables.
    Null texts count as empty (0 tokens); repeated rows and null keys pass through; an empty table
    gives no rows; other columns are not read. ``path`` names a byte-level BPE file that every
    worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            found = [count_tokens(t.as_py() or "", path, limit) for t in texts]
            n = pa.array([x[0] for x in found], pa.int64())
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, n, pa.compute.greater(n, limit), pa.array([x[1] for x in found], pa.int64())], ["key", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    kind = docs.schema[key].dataType.simpleString()
    out = mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
    return out.withColumnRenamed("key", key)


def code_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ids of all texts, one text after another; where each text's begin, and the end; decoded texts. For a word-level file."""
    enc = encoder(path)
    pieces: list[str | int] = []
    stops = [0]
    for text in texts:
        for stretch, special in enc.parts(text):
            if special >= 0:
                pieces.append(special)
            else:
                pieces += enc.cut(stretch)
        stops.append(len(pieces))
    rows = enc.rows.of(pieces)
    ids, ends = enc.rows.spread(rows)
    said = list(map(enc.rows.said.__getitem__, rows.tolist()))
    return ids, np.concatenate([[0], ends])[stops], [" ".join(said[a:b]) for a, b in pairwise(stops)]


def groups(texts: pa.Array) -> Iterator[slice]:
    """Neighbouring rows of about ``GROUP`` bytes of text; a longer text is a group of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GROUP, "right")))
        yield slice(low, min(high, low + 4096))
        low = min(high, low + 4096)


def encode_decode(docs: DataFrame, key: str, text: str, path: str, digests: bool = False) -> DataFrame:
    """Encode every whole text with a word-level BPE file and decode it again.

    Returns key, n_tokens, ids (array<int>) and decoded; with ``digests`` the last two are replaced by
    ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8). Null texts
    count as empty: no ids, empty decoded text. Repeated rows and null keys pass through; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in groups(b.column(1)):
                part = b.slice(rows.start, rows.stop - rows.start)
                ids, stops, said = code_texts([t.as_py() or "" for t in part.column(1)], path)
                n = pa.array(np.diff(stops), pa.int64())
                if digests:
                    own = ids.astype("<u4", copy=False)
                    more = [pa.array([hashlib.sha256(own[a:b]).hexdigest() for a, b in pairwise(stops.tolist())], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string())]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    more = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32())), pa.array(said, pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), n, *more], ["key", "n_tokens", *names])

    kind = docs.schema[key].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n_tokens long, {tail}")
    return out.withColumnRenamed("key", key)
