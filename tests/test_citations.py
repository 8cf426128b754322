from lodeweave.plans import registry

from .conftest import DATA


def test_citations_are_walked_from_and_through_all_parts(spark):
    conf, ways = {}, {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_discount").collect():
        e = f"o{r.l_orderkey}", f"p{r.l_partkey}"
        conf[e] = max(conf.get(e, 0), round(1 - r.l_discount, 2))
    for (a, b), c in conf.items():
        ways.setdefault(a, []).append((b, c))
        ways.setdefault(b, []).append((a, c))
    want = set()
    parts = [r.p_partkey for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    for q in parts:
        hops = {f"p{q}": 0}
        front = list(hops)
        for hop in (1, 2):
            best = {}
            for x in front:
                for y, c in ways.get(x, []):
                    if y not in hops:
                        best[y] = max(c, best.get(y, 0))
            front = sorted(best, key=lambda y: (-best[y], y))[: 30 - len(hops)]
            hops |= dict.fromkeys(front, hop)
        want |= {(q, x, h) for x, h in hops.items()}
    got = registry.QUERIES["cites_bfs_cap"](spark, DATA).collect()
    assert {(r.qid, r.id, r.hop) for r in got} == want and len(got) == len(want)
    assert {r.qid for r in got} == set(parts)
