from lodeweave.operators import graph


def test_shuffles_are_as_wide_as_the_input(spark, monkeypatch):
    monkeypatch.setattr(graph, "parts_of", lambda df: 7, raising=False)
    rows = [(f"{i}", f"t{i}", "v" if i % 3 else " ", [f"a{i % 4}", "a0"], [f"{j}" for j in range(i, i + 4)] + [f"{i}"]) for i in range(20)] + [("x", "t", None, None, None)]
    nodes, edges = graph.metadata_graph(spark.createDataFrame(rows, "id string, title string, venue string, authors array<string>, references array<string>"))
    assert nodes.rdd.getNumPartitions() == edges.rdd.getNumPartitions() == 7
    want = {(f"paper:{i}", "venue:v", "published_in") for i in range(20) if i % 3} | {(f"author:{a}", f"paper:{i}", "authored_by") for i in range(20) for a in (f"a{i % 4}", "a0")}
    want |= {(f"paper:{i}", f"paper:{j}", "cites") for i in range(20) for j in range(i, min(i + 4, 20))}
    assert {tuple(r) for r in edges.collect()} == want and edges.count() == len(want)
    assert sorted(r.type for r in nodes.collect()) == ["Author"] * 4 + ["Paper"] * 21 + ["Venue"]
