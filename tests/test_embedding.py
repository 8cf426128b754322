import pyarrow as pa
from pyspark.sql import functions as F

from lodeweave.functions import embedding


def test_embedding_by_batch_equals_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MOST_WORDS", 5, raising=False)
    texts = [None, "", "  ", "One two two", "É é ß " * 9, "a b c d e f g h i " * 3, "x" * 100 + " one"] * 50
    got = embedding.hash_vectors(pa.array(texts), 16).to_pylist()
    assert got == [embedding.hash_vector(t, 16) for t in texts] and len(embedding._places[16]) <= 5
    embedding._places.clear()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", embedding.hash_embed(F.col("t"), 8).alias("v")).collect()
    assert all(r.v == embedding.hash_vector(texts[r.i], 8) for r in rows)
