"""Quality rules whose cutoffs are certified on labelled holdouts.

Fixed base rules reject first. Further rules reject documents whose measure exceeds a cutoff, tried on
a fixed grid from the mildest to the strictest. A policy (a cutoff or none for every rule) is certified
while the exact (Clopper-Pearson) upper bound on the share of good documents that its rules reject
together stays within the allowed rate. Only the number of good documents decides how a stratum is
tested, never what is rejected among them:

* Large strata walk the lattice of policies, rule by rule, and a failure stops only its own rule.
  Counts grow with strictness, so a wrong certificate needs one at a least strict wrong policy. Those
  form an antichain, and the level is divided by the most that an antichain can hold.
* Smaller strata go through the rules in order, at the whole of their level: the first failure stops
  them. Who is through with a rule lends its level to those who are not (Holm); the next rule starts
  when all are through.
* Strata too small for any certificate share one on their pooled good documents, or on those of the
  whole holdout if the pool is too small as well. It bounds the pool's loss, not that of each stratum.

So, with the stated confidence, no stratum of the first two kinds loses more than the allowed rate of
its good documents to these rules, and no pool does.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, mapped, texts_of, words_of, written

WINDOW = 5
MIN_WORDS = 10
#: The part of the level for strata that are not large, where there are both kinds.
SMALL_PART = 0.9
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Rules: measure in thousandths, and the cutoffs tried, mildest first.
RULES = {
    "symbols_per_char": ("1000 * n_symbols / greatest(word_chars, 1)", [500, 400, 300, 250, 200, 150, 100, 80, 60, 40, 30, 20, 10]),
    "dup_lines_per_word": ("1000 * n_dup_lines / greatest(n_words, 1)", [500, 300, 200, 150, 100, 80, 60, 40, 30, 20, 10]),
    "repeats_per_word": ("1000 * n_repeat_words / greatest(n_words, 1)", [190, 180, 160, 140, 120, 100, 80, 60, 40, 20]),
}


def _dup_lines(raw: np.ndarray, at: np.ndarray) -> list[int]:
    """Per text, the lines with a word that equal an earlier line."""
    out = []
    data = raw.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        text = data[a:b]
        if b"\n" not in text:
            out.append(0)
            continue
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        out.append(len(lines) - len(set(lines)))
    return out


def _repeat_words(words: np.ndarray, by: np.ndarray) -> list[int]:
    """Per text, the words that lie in a 5-word window found twice or more in the text."""
    n = max(0, len(words) - WINDOW + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        grams ^= grams >> np.uint64(29)
    out = []
    for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
        if b - a <= WINDOW:
            out.append(0)
            continue
        own = grams[a : b - WINDOW + 1]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            out.append(0)
            continue
        hit = np.zeros(len(own), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edge = np.zeros(b - a + 1, np.int32)
        where = np.flatnonzero(hit)
        np.add.at(edge, where, 1)
        np.add.at(edge, where + WINDOW, -1)
        out.append(int((np.cumsum(edge)[: b - a] > 0).sum()))
    return out


def measures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without its text, plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text has none of anything. Input columns of these names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*(c for c in names if c != text))
    others = [c for c in docs.columns if c != text]
    is_symbol, is_space = np.zeros(256, bool), np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    is_space[[32, *range(9, 14)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                raw, at = texts_of(part.column(part.num_columns - 1))
                words, by = words_of(raw, at, lower=False)

                def per_text(mask: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                    total = np.zeros(len(mask) + 1, np.int64)
                    np.cumsum(mask, out=total[1:])
                    return total[at[1:]] - total[at[:-1]]

                counts = [np.diff(by), per_text(((raw & 0xC0) != 0x80) & ~is_space[raw]), per_text(is_symbol[raw]), _dup_lines(raw, at), _repeat_words(words, by)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(np.asarray(c, np.int64)) for c in counts)], [*part.schema.names[:-1], *names])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} long" for c in names])
    return mapped(docs.select(*[F.col(f"`{c}`") for c in others], F.col(text)), run, schema)


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or 1e-300)
            c = (1 + t / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def upper_bound(rejected: int, tried: int, level: float) -> float:
    """The exact binomial (Clopper-Pearson) upper bound, at confidence 1 - level, on a rate seen ``rejected`` of ``tried`` times."""
    if rejected >= tried:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if 1 - _beta_cdf(mid, rejected + 1, tried - rejected) > level:
            lo = mid
        else:
            hi = mid
    return hi


def certified_cutoffs(counts: dict[tuple, tuple[int, list[int]]], strata: list, allowed: float, level: float, rules: dict) -> dict[tuple, int | None]:
    """(stratum, rule) -> strictest certified cutoff, or None, by fixed sequences that lend their level.

    ``counts`` has, for every stratum and rule, the good holdout documents and how many of them are
    rejected at each cutoff of the rule's grid, with all earlier rules at their strictest.
    """
    out: dict[tuple, int | None] = {(s, r): None for s in strata for r in rules}
    for r, (_, grid) in rules.items():
        at = dict.fromkeys(strata, 0)
        share = dict.fromkeys(strata, level / max(1, len(strata)))
        while True:
            for s in strata:
                good, over = counts.get((s, r), (0, [0] * len(grid)))
                while good and at[s] < len(grid) and upper_bound(over[at[s]], good, share[s]) <= allowed:
                    out[s, r] = grid[at[s]]
                    at[s] += 1
            waiting = [s for s in strata if at[s] < len(grid)]
            lent = sum(share[s] for s in strata if at[s] == len(grid))
            if not waiting or not lent:
                break
            share = {s: share[s] + lent / len(waiting) if s in waiting else 0.0 for s in strata}
        if waiting:
            break  # the whole level has gone into these tests
    return out


def _rejected(seen: Counter, policy: list[int], rules: dict) -> int:
    """Documents that a policy (per rule, how many of its cutoffs from the mildest on are in force) rejects; ``seen`` counts them by how many cutoffs of each rule they exceed."""
    least = [len(grid) - n for n, (_, grid) in zip(policy, rules.values(), strict=True)]
    return sum(n for over, n in seen.items() if any(x > y for x, y in zip(over, least, strict=True)))


def _width(rules: dict) -> int:
    """A bound on the antichains of policies: their members differ in the rules other than the longest."""
    sizes = [len(grid) + 1 for _, grid in rules.values()]
    return math.prod(sizes) // max(sizes)


def certified_policies(seen: dict[object, Counter], allowed: float, level: float, rules: dict) -> dict[tuple, int | None]:
    """(stratum, rule) -> strictest certified cutoff, or None. ``seen`` counts a stratum's good holdout documents by how many cutoffs of each rule they exceed."""
    out: dict[tuple, int | None] = {(s, r): None for s in seen for r in rules}
    needs = lambda c: (1 - allowed) ** c.total()  # noqa: E731  the least level at which anything is certified
    large = [s for s, c in seen.items() if needs(c) <= (1 - SMALL_PART) * level / (len(seen) * _width(rules))]
    small_level = SMALL_PART * level if large else level
    alone = [s for s in seen if s not in large and needs(seen[s]) <= small_level]
    rest = [s for s in seen if s not in large and s not in alone]
    groups = [([s], seen[s]) for s in alone]
    for pool in (rest, list(seen)):
        both = sum((seen[s] for s in pool), Counter())
        if rest and needs(both) <= small_level:
            groups.append((rest, both))
            break

    walk_level = (level - small_level if groups else level) / (max(1, len(large)) * _width(rules))
    for s in large:
        policy = [0] * len(rules)
        for i, (r, (_, grid)) in enumerate(rules.items()):
            for cutoff in grid:
                policy[i] += 1
                if upper_bound(_rejected(seen[s], policy, rules), seen[s].total(), walk_level) > allowed:
                    policy[i] -= 1
                    break
                out[s, r] = cutoff

    counts = {}
    for g, (_, c) in enumerate(groups):
        policy = [0] * len(rules)
        for i, (r, (_, grid)) in enumerate(rules.items()):
            over = []
            for policy[i] in range(1, len(grid) + 1):
                over.append(_rejected(c, policy, rules))
            counts[g, r] = (c.total(), over)
    for (g, r), cutoff in certified_cutoffs(counts, list(range(len(groups))), allowed, small_level, rules).items():
        out.update({(s, r): cutoff for s in groups[g][0]})
    return out


def judge(docs: DataFrame, labels: DataFrame, key: str, text: str, stratum: str, allowed: float = 0.01, level: float = 0.05, rules: dict | None = None) -> DataFrame:
    """Every row of ``docs`` without its text, plus the measures, base_failed and kept.

    ``labels`` has ``key`` and ``quality`` (1: good); all labelled good documents that pass the base
    rules are the holdout. What reaches the driver is a count per stratum (language) and combination of
    cutoffs exceeded, 1,848 a stratum at most for ``RULES``. A null text counts as empty and fails the base rules; a null stratum is a stratum
    of its own; a null or unlabelled key is judged, not used as holdout; several labels of one key
    count as good if one is; repeated rows are judged alike; without labels no further rule rejects;
    input columns of the result's names are replaced; an empty table gives no rows.
    """
    rules = rules or RULES
    docs = docs.drop(*(c for c in ("base_failed", "kept") if c not in (key, text, stratum)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = written(measures(docs, text).withColumn("base_failed", failed), "measures")
    good = labels.filter("quality = 1").select(F.col(key)).filter(F.col(key).isNotNull()).distinct()
    over = [F.expr(" + ".join(f"cast({measure} > {cut} as int)" for cut in grid)).alias(P + r) for r, (measure, grid) in rules.items()]
    marks = [P + r for r in rules]
    rows = found.filter(~F.col("base_failed")).join(good, key, "left_semi").select(F.col(stratum).alias(P + "s"), *over).groupBy(P + "s", *marks).agg(F.count(F.lit(1)).alias(P + "n")).collect()
    seen: dict[object, Counter] = {}
    for row in rows:
        seen.setdefault(row[P + "s"], Counter())[tuple(row[m] for m in marks)] = row[P + "n"]
    cutoffs = certified_policies(seen, allowed, level, rules)
    reject = F.lit(False)
    for (s, r), cut in cutoffs.items():
        if cut is not None:
            reject = reject | (F.col(stratum).eqNullSafe(F.lit(s)) & F.expr(f"{rules[r][0]} > {cut}"))
    return found.withColumn("kept", ~F.col("base_failed") & ~reject)
