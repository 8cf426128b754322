import re
import unicodedata

from pyspark.sql import functions as F

from lodeweave.plans import arm_queries, registry

from .conftest import DATA


def test_names_are_folded_to_their_end(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.QUERIES["folded_names"](spark, DATA).collect()
    assert len(got) == len(text)
    for r in got:
        plain = "".join(c for c in unicodedata.normalize("NFKD", text[r.doc_id]).lower() if not unicodedata.combining(c))
        assert r.name == re.sub("[^a-z0-9]+", " ", plain).strip()


def test_every_word_is_in_a_claim_and_a_chunk(spark):
    text = {str(r.doc_id): r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    lib = arm_queries._library(spark, DATA)
    claims, chunks = {}, {}
    for r in lib.nodes.filter("type = 'Claim'").select("id", "from_paper", "name", "quote").collect():
        claims.setdefault(r.from_paper, []).append((int(r.id.split(":")[2]), r.quote))
        assert r.name == r.quote and 0 < len(r.quote) <= 600
    for r in lib.chunks.select("paper", "text").collect():
        chunks.setdefault(r.paper, []).append(r.text)
    assert any(len(c) > 1 for c in chunks.values()) and set(chunks) == set(text)
    for paper, t in text.items():
        assert "".join("".join(q for _, q in sorted(claims.get(paper, []))).split()) == "".join(t.split()), paper
        assert len("".join(chunks[paper])) >= 0.9 * len(" ".join(t.split())) - 80
    ids = lib.nodes.select("id")
    ends = lib.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    assert ids.count() == ids.distinct().count() and ends.join(ids, "id", "left_anti").count() == 0
