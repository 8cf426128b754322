import pytest
from pyspark.sql import functions as F

from lodeweave.operators import arms, chunking, graph, resolution
from lodeweave.sources.store import GraphStore


def test_walk_counts_seeds_and_keeps_best_edge(spark):
    edges = spark.createDataFrame([("a", "b", "x", 0.9), ("b", "a", "y", 0.95), ("b", "c", "x", 0.5), ("c", "d", "x", 1.0)], "src string, dst string, type string, confidence double")
    seeds = spark.createDataFrame([("q", "a")], "qid string, id string")
    got = {(r.id, r.hop, r.via) for r in graph.expand(seeds, edges, 2, 150).collect()}
    assert got == {("a", 0, None), ("b", 1, "y"), ("c", 2, "x")}
    assert graph.expand(seeds, edges, 2, 2).count() == 2


def test_components_take_the_least_node(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(pairs, "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


def test_staged_write_is_guarded(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.init()
    node = lambda i, layer: (i, "Problem", "n", [], {}, 0.5, [], None, layer)
    schema = store.read("nodes").schema
    none = store.read("edges").limit(0)
    assert store.stage(spark.createDataFrame([node("s1", "staged")], schema), none) == 1
    with pytest.raises(ValueError):
        store.stage(spark.createDataFrame([node("s2", "curated")], schema), none)
    with pytest.raises(PermissionError):
        graph.promote(store.read("nodes"))
    moved, n = graph.promote(store.read("nodes"), approved=True)
    assert n == 1 and graph.curated(moved).count() == 1
    assert store.query("SELECT count(*) AS n FROM nodes_curated").first().n == 0


def test_names_and_acronyms_resolve(spark):
    rows = [("b", "Method", "Error  Mitigation"), ("a", "Method", "error-mitigation"), ("c", "Method", "Variational Solver (VS)"), ("d", "Method", "VS"), ("e", "Dataset", "VS")]
    got = {(r.from_id, r.to_id, r.rule) for r in resolution.entity_map(spark.createDataFrame(rows, "id string, type string, name string")).collect()}
    assert got == {("b", "a", "name"), ("d", "c", "acronym")}


def test_chunks_are_unique_and_within_target(spark):
    text = " ".join(f"Sentence number {i} has some seven words here." for i in range(300))
    s = spark.createDataFrame([(1, 0, "other", text), (1, 1, "other", text), (1, 2, "references", text)], "paper int, section_index int, section_type string, text string")
    rows = chunking.chunks(s).collect()
    assert len({r.id for r in rows}) == len(rows) and {r.section_index for r in rows} == {0, 1} and max(r.tokens for r in rows) <= 512


def test_handles_resolve_and_unknown_ones_vanish(spark):
    df = spark.createDataFrame([("q", "See [P1, P3] and [P9] .", {"P1": "x", "P3": "y"})], "qid string, raw string, handles map<string,string>")
    r = arms.resolve_handles(df).first()
    assert r.text == "See [paper:x][paper:y] and." and r.cited == ["x", "y"]
    assert spark.range(1).select(F.lit(1)).count() == 1
