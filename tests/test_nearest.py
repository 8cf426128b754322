import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import retrieval
from lodeweave.plans import registry

from .conftest import DATA


def vectors(spark, n, groups):
    v = np.random.default_rng(n).integers(-1, 2, (n, 4)).astype(float)
    df = spark.createDataFrame([(f"v{i:03}", x.tolist(), i % groups) for i, x in enumerate(v)], "id string, vector array<double>, g int").repartition(3)
    unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
    return df, np.round(unit @ unit.T, 9)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("within", ["g", None])
def test_few_and_many_queries_find_the_same(spark, monkeypatch, few, within):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 1 << 20 if few else 0)
    for name, value in (("QUERY_STRIPE", 40), ("ITEM_STRIPE", 60), ("WORTH", 30)):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    df, sims = vectors(spark, 200, 3)
    got = retrieval.nearest(df.withColumnRenamed("id", "qid"), df, 6, within=within, skip_self=True).collect()
    meet = lambda i, j: i != j and (within is None or i % 3 == j % 3)
    want = {(f"v{i:03}", f"v{j:03}"): n + 1 for i in range(200) for n, j in enumerate(sorted((j for j in range(200) if meet(i, j)), key=lambda j: (-sims[i, j], j))[:6])}
    assert {(r.qid, r.id): r.rank for r in got} == want and len(got) == len(want)


def test_many_queries_do_not_pass_the_driver(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("rows at the driver")

    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    monkeypatch.setattr(DataFrame, "collect", refuse)
    df, _ = vectors(spark, 100, 2)
    assert retrieval.nearest(df.withColumnRenamed("id", "qid"), df, 3, within="g").count() == 300
    retrieval.nearest(df.withColumnRenamed("id", "qid"), df, 3).count()
    registry.QUERIES["specificity_vs_rivals"](spark, DATA).count()


def test_the_best_are_kept_over_all_batches():
    """A task sends on k rows of a query, not k of every batch; ties go to the least id wherever it comes."""
    rng = np.random.default_rng(3)
    q, v, ids = rng.integers(-1, 2, (30, 5)).astype(float), rng.integers(-1, 2, (900, 5)).astype(float), rng.permutation(900)
    top = retrieval._Top(30, 7)
    top.most = 300
    for at in range(0, 900, 50):
        top.meet(retrieval._unit(q), np.arange(30), ids[at : at + 50], pa.array(v[at : at + 50].tolist()), False)
    got = pa.Table.from_batches(top.batches(np.arange(30))).to_pylist()
    sims = np.round(retrieval._unit(q) @ retrieval._unit(v).T, 9)
    assert [(r["qid"], r["id"]) for r in got] == [(i, ids[j]) for i in range(30) for j in sorted(range(900), key=lambda j: (-sims[i, j], ids[j]))[:7]]
