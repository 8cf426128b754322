from pyspark.sql import functions as F

from lodeweave.functions import embedding
from lodeweave.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_titles(spark):
    for title, kind in (("4. Experiments and Results", "results"), ("Limitations and Threats to Validity", "limitations"), ("Appendix B: Hardware Details", "appendix"), ("Overview", "other"), (None, "other")):
        assert one(spark, T.classify_section(F.lit(title).cast("string"))) == kind


def test_damping(spark):
    assert one(spark, T.length_damping(F.lit(400), 800)) == 0.5
    assert one(spark, T.length_damping(F.lit(900), 800)) == 1.0
    assert one(spark, T.length_damping(F.lit(10), 0)) == 1.0


def test_containment(spark):
    assert one(spark, T.token_contained(F.lit("A100"), F.lit("NVIDIA A100-SXM-80GB")))
    assert not one(spark, T.token_contained(F.lit("4"), F.lit("24 qubits")))


def test_silence(spark):
    for w in ("unknown", "n/a", "", "none", "Not Reported", None):
        assert one(spark, T.is_silent(F.lit(w).cast("string")))
    assert not one(spark, T.is_silent(F.lit("IBM")))


def test_confidence(spark):
    for raw, want in (("0.7", 0.7), ("high", 0.5), ("-3", 0.0), ("7", 1.0)):
        assert one(spark, T.confidence(F.lit(raw))) == want


def test_hash_vectors_are_unit_or_zero():
    v = embedding.hash_vector("quantum error mitigation", 32)
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and embedding.hash_vector(None, 32) == [0.0] * 32
