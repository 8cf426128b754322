import itertools

import pytest

from lodeweave.functions import stats


def test_six_rising_differences():
    assert stats.signed_rank_p([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) == pytest.approx(2 / 2**6)


def test_symmetric_differences_are_no_evidence():
    assert stats.signed_rank_p([1, 1, 1, -1, -1, -1]) == 1.0


def test_too_few_pairs_give_no_p():
    assert stats.signed_rank_p([1, 2, 3, 0, 0, 0, 0]) is None


def test_exact_p_equals_enumeration():
    d = [0.3, -0.1, 0.4, 0.4, -0.2, 0.7, 0.05]
    ranks = stats.average_ranks([abs(x) for x in d])
    total, plus = sum(ranks), sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    low = min(plus, total - plus)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    assert stats.signed_rank_p(d) == pytest.approx(min(1, 2 * sum(s <= low + 1e-9 for s in sums) / len(sums)))


def test_t_tail():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.spearman_p(0.4, 34) == pytest.approx(0.0191, abs=1e-3)
