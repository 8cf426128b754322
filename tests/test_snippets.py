import re

import pytest

from lodeweave.functions import text as T
from lodeweave.operators import retrieval


@pytest.mark.parametrize("table", [1 << 20, 0])
def test_best_lines_equal_a_plain_count(spark, monkeypatch, table):
    monkeypatch.setattr(retrieval, "TERM_TABLE", table, raising=False)
    terms = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 2 and w not in T.STOP_WORDS}
    lines = [(d, p, " ".join(f"word{(d * 7 + p * k) % 11}" for k in range(p % 5)) + " Other") for d in range(20) for p in range(12)] + [(99, 0, ""), (99, 1, None), (99, 3, "word1")]
    queries = [(q, f"Word{q} word{q + 3}, word{q} other{q}") for q in range(9)] + [(50, "a the"), (51, None), (52, "other")]
    want = {}
    for q, text in queries:
        for d, p, line in lines:
            n = len(terms(text) & terms(line))
            if n and (n, -p) > want.get((q, d), (0, 0)):
                want[q, d] = (n, -p)
    chunks = spark.createDataFrame(lines, "id long, pos long, text string").repartition(5)
    found = retrieval.best_snippets(chunks, spark.createDataFrame(queries, "qid long, text string"))
    assert {(r.qid, r.id): (r.hits, -r.pos) for r in found.collect()} == want
    assert table == 0 or "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row per query, line and term
