import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import graph

EDGE = "src string, dst string, type string, confidence double"


def walk(seeds, edges, hops, cap):
    ways, out = {}, set()
    for a, b, t, c in edges:
        for x, y in ((a, b), (b, a)):
            ways.setdefault(x, {})[y] = max(ways.get(x, {}).get(y, (0.0, "")), (c, t))
    for q in {q for q, _ in seeds}:
        got = {i: (0, -2.0, i, None) for p, i in seeds if p == q}
        for hop in range(1, hops + 1):
            best = {}
            for x in [i for i, r in got.items() if r[0] == hop - 1]:
                for y, e in ways.get(x, {}).items():
                    if y not in got:
                        best[y] = max(best.get(y, (0.0, "")), e)
            got |= {y: (hop, -c, y, t) for y, (c, t) in best.items()}
            got = {r[2]: r for r in sorted(got.values(), key=lambda r: r[:3])[:cap]}
        out |= {(q, i, r[0], r[3]) for i, r in got.items()}
    return out


@pytest.mark.parametrize(("hops", "cap"), [(1, 3), (2, 4), (2, 12), (3, 9), (3, 1000)])
def test_walk_equals_a_plain_one(spark, hops, cap):
    rng = random.Random(hops * 100 + cap)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice("xyz"), rng.randrange(10) / 10) for _ in range(60)]
    seeds = [(q, f"n{rng.randrange(33)}") for q in range(12) for _ in range(1 + 5 * (q == 3))]
    got = graph.expand(spark.createDataFrame(seeds, "qid long, id string"), spark.createDataFrame(edges, EDGE), hops, cap).collect()
    assert {tuple(r) for r in got} == walk(seeds, edges, hops, cap) and len({(r.qid, r.id) for r in got}) == len(got)


def test_neighbours_of_a_hub_are_dealt_out(spark, monkeypatch):
    """All leaves meet all leaves through one node: no task may hold more than its share of the pairs."""
    monkeypatch.setattr(graph, "TASK_ROWS", 1 << 14, raising=False)
    monkeypatch.setattr(graph, "BLOCK", 32, raising=False)
    leaves = spark.range(1000).select(F.concat(F.lit("l"), "id").alias("src"))
    edges = leaves.select("src", F.lit("hub").alias("dst"), F.lit("in").alias("type"), F.lit(0.5).alias("confidence"))
    out = graph.expand(leaves.select(F.col("src").alias("qid"), F.col("src").alias("id")), edges, 2, 1_000_000)
    rows = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 1000 + 1000 + 1000 * 999 and max(rows) < 150_000
