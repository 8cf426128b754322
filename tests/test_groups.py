import numpy as np

from lodeweave.operators import graph, retrieval


def test_groups_meet_only_themselves(spark, monkeypatch):
    """Near pairs within groups: every cell holds one group, so the work is that of the groups' own pairs."""
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    v = np.random.default_rng(5).normal(size=(400, 4))
    df = spark.createDataFrame([(i, x.tolist(), i % 20) for i, x in enumerate(v)], "id long, vector array<double>, g int")
    dealt = {}
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (dealt.setdefault("rows", self), plain(self, *a, **k))[1])
    found = retrieval.nearest(df.withColumnRenamed("id", "qid"), df, 5, within="g", skip_self=True)
    cells = {}
    for r in dealt["rows"].select("cell", "side", "qid", "id").toLocalIterator():
        cells.setdefault(r.cell, ([], []))[r.side].append(r.qid if r.side == 0 else r.id)
    assert len(cells) == 20 and sum(len(q) * len(i) for q, i in cells.values()) == 400 * 20
    assert all(len({x % 20 for x in q + i}) == 1 for q, i in cells.values())
    assert found.count() == 400 * 5 and graph.components(found.filter("rank = 1"), "qid", "id").count() == 400
