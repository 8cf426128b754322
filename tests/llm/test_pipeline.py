from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.keep_good(spark, docs, d).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < len(before)
    single = corpus_pipeline.drop_near_copies(spark, kept, d).cache()
    assert single.columns == docs.columns and single.count() < kept.count()
    assert single.select("text").distinct().count() == single.count()
    mixed = corpus_pipeline.mix(spark, single, d).cache()
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r.text for r in single.collect()}
    ids = corpus_pipeline.tokenize(spark, mixed, d)
    assert ids.count() == mixed.count() and ids.filter("n_tokens <> size(ids)").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "mix_sources", "bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_every_stage(spark, docs, no_docs):
    d = "/root/testdata/sf0.001"
    odd = docs.withColumns({"n_chars": F.length("text").cast("long"), "copies": F.lit(1), "kept": F.lit("no")})
    for rows in (odd, odd.filter("false")):
        kept = corpus_pipeline.keep_good(spark, rows, d)
        single = corpus_pipeline.drop_near_copies(spark, kept, d)
        mixed = corpus_pipeline.mix(spark, single, d)
        assert kept.columns == single.columns == mixed.columns == odd.columns
        ids = corpus_pipeline.tokenize(spark, mixed, d)
        assert ids.count() <= 3 * rows.count()
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, corpus_pipeline.keep_good(spark, odd, d), d).collect()}
    assert 1 in got and not got & {2, 5, 6, 7, 8, 10, 11}
