"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is a sequence of symbols: runs of small letters that a capital may begin, runs of digits, and
single letters of scripts that put no space between words. Where a symbol ends depends on the
characters around that place alone. A k-mer of symbols is kept when the least hash among its inner
s-mers lies at its first or last place. That depends on nothing outside the k-mer, so an edit changes
only the anchors that touch it and the others keep matching, wherever they have moved to. With k = 17
and s = 2 one k-mer in eight is kept, some 40 characters of text for an anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, parallelism

#: Letters that are symbols of their own: Thai, Lao, Tibetan, Burmese, Khmer, ideographs, kana, hangul.
_SINGLE = r"\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\x{20000}-\x{3ffff}"
_END = rf"\x20\x09-\x0D0-9A-Z{_SINGLE}"
SYMBOL = rf"[{_SINGLE}]|[0-9]+|[A-Z]+[^{_END}]*|[^{_END}]+"
K, S = 17, 2
CELLS = 16  # cells of neighbouring keys for every shuffle partition


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos int, hash bigint>>: the closed syncmers of a text, in order.

    Fewer than k symbols, or none of their k-mers kept, make one anchor of them all; no symbols (or
    null) make none.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def smers(h: Column) -> Column:
        if s == 1:
            return h
        return F.transform(F.slice(h, 1, F.size(h) - (s - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

    def closed(h: Column) -> Column:
        last = k - s

        def pick(g: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                rest = [F.get(g, i + j) for j in range(1, last + 1)]
                least = F.least(x, *rest) if rest else x
                whole = F.xxhash64(*[F.get(h, i + j) for j in range(k)])
                return F.when((x == least) | (rest[-1] == least if rest else F.lit(True)), F.struct(i.cast("int").alias("pos"), whole.alias("hash")))

            return F.filter(F.transform(F.slice(g, 1, F.size(g) - last), one), lambda a: a.isNotNull())

        return _let(smers(h), pick)

    def whole(h: Column) -> Column:
        few = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h, F.lit(k)).alias("hash")))
        some = F.when(F.size(h) > 0, few).otherwise(F.slice(few, 1, 0))
        return F.when(F.size(h) >= k, _let(closed(h), lambda c: F.when(F.size(c) > 0, c).otherwise(some))).otherwise(some)

    return _let(hashes, whole)


def distinct_anchors(found: Column) -> Column:
    """Of anchors with equal hashes the first, in the order of the hashes."""
    new = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["hash"] != x["hash"]))
    return _let(F.array_sort(F.transform(found, lambda a: F.struct(a["hash"].alias("hash"), a["pos"].alias("pos")))), new)


def likeness(a: Column, b: Column) -> Column:
    """Anchors that match in order over all anchors, 0 to 1, of two arrays from ``distinct_anchors``.

    Equal hashes are matched, matches are taken in the order of ``a``, and one counts if its place in
    ``b`` lies behind that of the match before it. Two texts without anchors are alike (1).
    """
    side = lambda x, n: F.transform(x, lambda e: F.struct(e["hash"].alias("hash"), F.lit(n).alias("side"), e["pos"].alias("pos")))

    def pairs(s: Column) -> Column:
        both = F.filter(F.transform(s, lambda x, i: F.struct(x["hash"].alias("hash"), x["pos"].alias("a"), F.get(s, i + 1).alias("n"))), lambda x: x["n"]["hash"] == x["hash"])
        return F.array_sort(F.transform(both, lambda x: F.struct(x["a"].alias("a"), x["n"]["pos"].alias("b"))))

    ordered = lambda m: F.size(F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["b"] < x["b"])))
    shared = _let(_let(F.array_sort(F.concat(side(a, 0), side(b, 1))), pairs), ordered)
    every = F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(_let(shared, lambda n: n / (every - n))).cast("double")


def as_string(found: Column) -> Column:
    """Anchors in order as text: base64 of 32 bits of each."""
    return F.base64(F.unhex(F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a["hash"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")))


def _before(bounds: Column, many: int, value: Column, equal: bool) -> Column:
    """How many of ``many`` sorted bounds lie before ``value`` (or are equal to it), looking at about twice the root of their number."""
    block = max(1, int(many**0.5))
    less = (lambda x: x <= value) if equal else (lambda x: x < value)
    heads = F.expr(f"sequence(1, {many}, {block})")
    at = F.size(F.filter(F.transform(heads, lambda i: F.element_at(bounds, i)), less))
    return F.when(at == 0, F.lit(0)).otherwise(_let(at, lambda n: (n - 1) * block + F.size(F.filter(F.slice(bounds, (n - 1) * block + 1, F.lit(block)), less))))


def with_next(docs: DataFrame, key: str, text: str, add: dict[str, object], prefix: str = P + "n_") -> DataFrame:
    """Add the columns of ``add`` (name -> function of the text) and, for these and the text, ``prefix`` columns with those of the next row.

    Rows are in the order of ``key`` (a number), equal keys in that of a hash of the text; after the last
    comes the first. Quantiles of the keys cut the order into cells of about equal size, whatever the
    keys are like, and a key that fills several cells is spread over them by the hash. The texts are
    shuffled once, by cell; the first row of every cell is found by a scan and joins the last row of the
    cell before it. Rows with a null key have no place in the order and get nulls.
    """
    spark = docs.sparkSession
    cell, tie, has, to = (P + x for x in ("cell", "tie", "has", "to"))
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key), F.col(text))
    names = [text, *add]
    nothing = own.filter(F.col(key).isNull()).withColumns({n: f(F.col(text)) for n, f in add.items()})
    nothing = nothing.select(key, *names, *[F.lit(None).cast(nothing.schema[n].dataType).alias(prefix + n) for n in names])
    many = CELLS * parallelism(spark)
    shares = ",".join(f"{(i + 1) / (many + 1):.12f}D" for i in range(many))
    bounds = docs.agg(F.expr(f"percentile_approx(`{key}`, array({shares}), {4 * many})")).first()[0]
    if bounds is None:
        return nothing
    cuts = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<{kind}>)")
    keyed = own.filter(F.col(key).isNotNull()).withColumn(tie, F.shiftrightunsigned(F.xxhash64(text), 1))
    low, high = _before(cuts, many, F.col(key), False), _before(cuts, many, F.col(key), True)
    keyed = keyed.withColumn(cell, _let(low, lambda n: n + F.floor(F.col(tie) / float(1 << 63) * (high - n + 1)).cast("int")))

    # The first row of every cell, and the cell that it follows: a narrow row per cell.
    firsts = keyed.groupBy(cell).agg(F.min(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("m"))
    order = Window.orderBy(cell)
    firsts = firsts.select(F.col(cell).alias(to), "m.k", "m.t", F.coalesce(F.lag(cell).over(order), F.max(cell).over(Window.partitionBy(F.lit(0)))).alias(P + "from"))
    heads = keyed.join(F.broadcast(firsts), (F.col(cell) == F.col(to)) & (F.col(key) == F.col("k")) & (F.col(tie) == F.col("t")))
    heads = heads.groupBy(P + "from").agg(F.first(text).alias(P + "head"))

    placed = keyed.repartition(parallelism(spark), cell).withColumns({n: f(F.col(text)) for n, f in add.items()})
    by = Window.partitionBy(cell).orderBy(key, tie)
    placed = placed.withColumns({prefix + n: F.lead(n).over(by) for n in names} | {has: F.lead(F.lit(True)).over(by)})
    met = placed.join(heads.withColumnRenamed(P + "from", to), (F.col(cell) == F.col(to)) & F.col(has).isNull(), "left")
    follow = {prefix + text: F.coalesce(prefix + text, P + "head")} | {prefix + n: F.when(F.col(has), F.col(prefix + n)).otherwise(f(F.col(P + "head"))) for n, f in add.items()}
    return met.withColumns(follow).select(key, *names, *[prefix + n for n in names]).unionByName(nothing)


def edited_text(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by as many first ones (or all) of ``other``; null counts as empty."""
    a, b = F.coalesce(text, F.lit("")), F.coalesce(other, F.lit(""))
    n = F.char_length(a)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(a, F.lit(1), n - half), F.substring(b, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, key: str, text: str, k: int = K, s: int = S) -> DataFrame:
    """Fingerprint every text and its edited form, and compare with both the edited form and the next text.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_anchors. Null texts count as empty; texts of under k symbols have one anchor; equal texts have
    equal fingerprints; repeated rows follow each other; a row with a null key is compared with an
    empty text; a single row is its own next; an empty table gives no rows. Other columns are not read.
    """
    t, n = P + "t", P + "n_"
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(t))
    both = with_next(own, key, t, {P + "a": lambda x: anchors(x, k, s)}, prefix=n)
    both = both.withColumn(P + "e", edited_text(F.col(t), F.col(n + t))).withColumn(P + "b", anchors(F.col(P + "e"), k, s))
    nothing = F.array().cast("array<struct<hash:bigint,pos:int>>")
    a, b = F.col(P + "a"), F.col(P + "b")
    both = both.select(
        F.col(key), F.char_length(t).cast("long").alias("n_chars"), F.sha2(F.encode(F.col(P + "e"), "UTF-8"), 256).alias("edited_sha256"), as_string(a).alias("fingerprint"), as_string(b).alias("edited_fingerprint"),
        F.size(a).cast("long").alias("n_anchors"), distinct_anchors(a).alias(P + "x"), distinct_anchors(b).alias(P + "y"), F.coalesce(distinct_anchors(F.col(n + P + "a")), nothing).alias(P + "z"),
    )
    x, y, z = F.col(P + "x"), F.col(P + "y"), F.col(P + "z")
    return both.select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(x, y).alias("near_edited"), likeness(x, z).alias("near_next"), "n_anchors")
