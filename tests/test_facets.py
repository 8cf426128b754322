import numpy as np
import pytest

from lodeweave.plans import registry

from .conftest import DATA, canonical

GRID = [0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


@pytest.fixture(scope="module")
def best(spark):
    """(label, facet) -> best similarity by plan, over all vectors."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    unit = lambda r: np.array(r.embedding, np.float64) / np.linalg.norm(np.array(r.embedding, np.float64))
    subs = {}
    for r in rows:
        if r.vec_id % 2 == 0:
            subs.setdefault(r.label, []).append(unit(r))
    found = {(r.label, r.vec_id): {p: round(float(max(np.array(s) @ unit(r))), 9) for p, s in subs.items()} for r in rows if r.vec_id % 2}
    assert len(found) + sum(map(len, subs.values())) == len(rows)
    return found


def shares(best, test):
    out = {}
    for (label, _), sims in best.items():
        out.setdefault(label, []).append(test(label, sims))
    return {k: (len(v), round(sum(v) / len(v), 6)) for k, v in out.items()}


def test_coverage_of_all_vectors(spark, best):
    cover = lambda t: shares(best, lambda own, sims: sims.get(own, -2.0) >= t)
    got = registry.QUERIES["facet_coverage"](spark, DATA).select("qid", "coverage").collect()
    assert canonical(got) == canonical((q, c) for q, (_, c) in cover(0.6).items())
    got = registry.QUERIES["coverage_sensitivity"](spark, DATA).select("qid", "threshold", "coverage").collect()
    assert canonical(got) == canonical((q, t, c) for t in GRID for q, (_, c) in cover(t).items())


def test_specificity_of_all_vectors(spark, best):
    want = shares(best, lambda own, sims: sims[own] > max(x for p, x in sims.items() if p != own))
    got = registry.QUERIES["specificity_vs_rivals"](spark, DATA).select("qid", "n", "specificity").collect()
    assert canonical(got) == canonical((q, n, x) for q, (n, x) in want.items())
    assert sum(r.n for r in got) == len(best)
