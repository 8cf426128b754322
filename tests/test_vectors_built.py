from pyspark.sql import functions as F

from lodeweave.functions import embedding
from lodeweave.functions import vectors as V
from lodeweave.operators import chunking
from lodeweave.sources import vectors


def test_new_store_takes_an_id_once(spark, tmp_path):
    rows = [(f"c{i % 30}", "p", f"word{i % 30} text", "method", "fulltext" if i % 2 else "abstract") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, paper string, text string, section_type string, corpus string")
    for n, some in ((30, chunks), (9, chunks.limit(9))):
        store = vectors.build_vectors(some, embedding.hash_embed, str(tmp_path / f"v{n}"))
        assert store.load().count() == store.load().select("id").distinct().count() == n
    assert vectors.build_vectors(chunks, embedding.hash_embed, str(tmp_path / "v9")).load().count() == 30


def test_length_is_named_once(spark):
    """Named inside the function of the elements it was summed for each of them."""
    plan = spark.createDataFrame([([3.0, 4.0],), ([0.0],)], "v array<double>").select(V.l2_normalize(F.col("v")).alias("u"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 1
    assert [r.u for r in plan.collect()] == [[0.6, 0.8], [0.0]]


def test_bounds_of_chunks():
    assert chunking._bounds([], 10, 3) == [] and chunking._bounds([50], 10, 3) == [(0, 1, 50)]
    assert chunking._bounds([4, 4, 2, 1, 9], 10, 3) == [(0, 3, 10), (2, 4, 3), (2, 5, 12)]
