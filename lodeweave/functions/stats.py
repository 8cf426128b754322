"""Statistics that SQL lacks: exact signed-rank p values, t tail probabilities, rank correlation tests."""

from __future__ import annotations

import math

MIN_PAIRS = 6


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (even, odd):
            d = 1 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return scale * total


def t_two_sided(t: float, df: int) -> float:
    """P(|T| >= |t|) of Student's t."""
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def spearman_p(rho: float, n: int) -> float | None:
    """Two-sided p of a rank correlation by the t approximation."""
    if n < 3 or rho is None:
        return None
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def normal_two_sided(z: float) -> float:
    """P(|Z| >= |z|) of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def average_ranks(values: list[float]) -> list[float]:
    order = sorted(range(len(values)), key=values.__getitem__)
    out = [0.0] * len(values)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and values[order[j]] == values[order[i]]:
            j += 1
        for k in range(i, j):
            out[order[k]] = (i + j + 1) / 2
        i = j
    return out


def signed_rank_p(diffs: list[float], exact_up_to: int = 50) -> float | None:
    """Two-sided Wilcoxon signed-rank p; zeros are left out, fewer than six pairs give None.

    Exact by counting the subsets of (doubled, so whole) ranks with each sum; beyond ``exact_up_to``
    pairs by the normal approximation with tie correction.
    """
    kept = [d for d in diffs if d]
    n = len(kept)
    if n < MIN_PAIRS:
        return None
    ranks = average_ranks([round(abs(d), 12) for d in kept])
    plus = sum(r for r, d in zip(ranks, kept, strict=True) if d > 0)
    low = min(plus, n * (n + 1) / 2 - plus)
    if n > exact_up_to:
        counts: dict[float, int] = {}
        for r in ranks:
            counts[r] = counts.get(r, 0) + 1
        var = n * (n + 1) * (2 * n + 1) / 24 - sum(c**3 - c for c in counts.values()) / 48
        return math.erfc((n * (n + 1) / 4 - low) / math.sqrt(2 * var))
    ways = [1]
    for r in (round(2 * r) for r in ranks):
        longer = ways + [0] * r
        for s, w in enumerate(ways):
            longer[s + r] += w
        ways = longer
    return min(1.0, 2 * sum(ways[: round(2 * low) + 1]) / 2**n)
