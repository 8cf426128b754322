"""Embedders as Arrow UDFs: signed feature hashing now, any model behind the same interface."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(text: str | None, dim: int) -> list[float]:
    """Every lower-cased word adds plus or minus one at a place its digest names; unit length, zero for no words."""
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        d = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "little") % dim] += 1.0 if d[4] % 2 == 0 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


class _Places(dict):
    """Word -> twice its place, one more if its sign is minus; found by digest once and kept, up to ``MOST_WORDS`` of up to 64 letters."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, w: str) -> int:
        d = hashlib.blake2b(w.encode(), digest_size=8).digest()
        place = int.from_bytes(d[:4], "little") % self.dim * 2 + d[4] % 2
        if len(w) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[w] = place
        return place


MOST_WORDS, TEXTS = 200_000, 256
_places: dict[int, _Places] = {}  # a worker keeps them from task to task


def hash_vectors(texts: pa.Array, dim: int) -> pa.Array:
    """``hash_vector`` of every text; a few texts at a time become Python objects."""
    places = _places.setdefault(dim, _Places(dim))
    out = np.zeros((len(texts), dim))
    for start in range(0, len(texts), TEXTS):
        for i, t in enumerate(texts.slice(start, TEXTS).to_pylist(), start):
            if t:
                words = t.lower().split()
                n = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=2 * dim)
                out[i] = n[::2] - n[1::2]
    length = np.sqrt((out * out).sum(1, keepdims=True))
    out /= np.where(length == 0, 1.0, length)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * np.int32(dim)), pa.array(out.ravel()))


def hash_embed(text: Column, dim: int = 64) -> Column:
    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield hash_vectors(texts, dim)

    return embed(text)


def folded_name(name: Column) -> Column:
    """Compatibility-decomposed, lower case, other than a-z and 0-9 become single spaces: for names with accents and ligatures."""
    import re

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", n).lower() if not unicodedata.combining(c))).strip())

    return fold(name)
