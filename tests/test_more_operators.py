"""Operators of parsing, calibration, models and stores against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave import config, models
from lodeweave.functions import embedding, stats
from lodeweave.operators import adjudication, calibration, chunking, parsing, retrieval, trajectories
from lodeweave.sources import vectors

from .conftest import DATA


class Offline:
    """A model that answers by rule and fails on some inputs."""

    model = "offline"

    def json(self, system, user, schema=None, temperature=None):
        if "fail" in user:
            raise OSError("out of reach")
        if "Grade" in system:
            return {c: {"score": 7 if "long" in user else 3, "why": "by rule"} for c in calibration.CRITERIA}
        if "label" in system:
            return {"label": "neither" if "x" in user else "odd"}
        return {"nodes": [{"type": "Method", "name": "Alpha", "confidence": "0.9", "attrs": '{"k": 1}'}, {"type": "Method", "name": "Beta", "confidence": 0.7}, {"type": "Claim", "name": "weak", "confidence": 0.1}], "edges": [{"src": "alpha", "dst": "Beta", "type": "builds_on", "confidence": 0.8}, {"src": "alpha", "dst": "weak", "type": "uses", "confidence": 0.8}]}

    def text(self, system, user, temperature=None):
        return user


def test_extraction_isolates_failures_and_resolves_ends(spark):
    rows = [("p1", 0, "method", "some text"), ("p1", 1, "results", "fail here"), ("p2", 0, "method", "more"), ("p3", 0, "method", "done before")]
    sections = spark.createDataFrame(rows, "paper string, section_index int, section_type string, text string")
    raw = {(r.paper, r.section_index): r for r in models.extract_sections(sections, Offline()).collect()}
    assert raw["p1", 1].error == "OSError" and raw["p1", 1].nodes == [] and raw["p1", 0].error is None and len(raw["p1", 0].nodes) == 3
    nodes, edges = models.extract_papers(sections, Offline(), done=sections.filter("paper = 'p3'"), wanted=sections)
    assert sorted((r.paper, r.id, r.attrs.get("k")) for r in nodes.collect()) == [(p, i, k) for p in ("p1", "p2") for i, k in (("method:alpha", "1"), ("method:beta", None))]
    assert sorted((r.paper, r.src_id, r.dst_id) for r in edges.collect()) == [(p, "method:alpha", "method:beta") for p in ("p1", "p2")]
    assert models.extract_sections(sections.limit(0), Offline()).count() == 0


def test_judgements_and_blind_labels(spark):
    answers = spark.createDataFrame([("a", "q", "{}", "long text", None), ("b", "q", "{}", "fail", "e"), ("c", "q", "{}", "short", "e")], "qid string, query string, spec string, text string, evidence string")
    got = {r.qid: r for r in models.judge_answers(answers, Offline()).collect()}
    assert got["a"].scores == dict.fromkeys(calibration.CRITERIA, 5) and got["c"].scores["coverage"] == 3 and got["b"].scores is None and got["b"].error == "OSError"
    pairs = spark.createDataFrame([(1, "x", "y"), (2, "a", "b"), (3, "fail", "x")], "sample int, a_text string, b_text string")
    assert [(r.sample, r.label) for r in models.label_pairs(pairs, Offline(), adjudication.CONTRADICTION).collect()] == [(1, "neither")]


def test_http_adapters_speak_both_protocols_and_count():
    sent = []

    def send(url, headers, body):
        sent.append((url, headers, body))
        if "messages" in url:
            return {"content": [{"type": "thinking"}, {"type": "text", "text": '{"a": 1}'}], "usage": {"input_tokens": 5, "output_tokens": 2}}
        return {"choices": [{"message": {"content": '{"a": 2}'}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 4}}}

    usage = models.UsageTracker()
    one, two = models.HttpChat("claude-x", "k", usage=usage, send=send), models.HttpChat("gpt-x", "k", usage=usage, send=send)
    assert one.json("s", "u", {"type": "object"}) == {"a": 1} and two.json("s", "u", temperature=0.0) == {"a": 2} and two.text("s", "u") == '{"a": 2}'
    assert sent[1][2]["temperature"] == 0.0 and "temperature" not in sent[0][2] and sent[0][1]["x-api-key"] == "k"
    assert usage.snapshot()["gpt-x"] == {"calls": 2, "tokens_in": 14, "tokens_out": 6, "cached": 8}
    assert "total" not in usage.summary({"gpt-x": (1.0, 2.0)}) and usage.summary({"gpt-x": (1.0, 2.0), "claude-x": (1e5, 0)}).endswith("total $0.5000")
    usage.reset()
    assert usage.snapshot() == {} and models.local_chat("any", "http://h/v1/").url == "http://h/v1/chat/completions"
    with pytest.raises(ValueError):
        models.provider_of("unheard-of")


def test_p_values_by_numerical_integration(spark):
    def t_tail(t, df):
        c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
        xs = np.linspace(0, abs(t), 200_001)
        return 1 - 2 * float(np.trapezoid(c * (1 + xs * xs / df) ** (-(df + 1) / 2), xs))

    r = random.Random(3)
    rows = [(g, i, r.randint(1, 5), r.randint(1, 5) if g == "x" else None) for g in "xy" for i in range(30)]
    rows = [(g, i, a, a if b is None and i % 3 else b or r.randint(1, 5)) for g, i, a, b in rows]
    pairs = spark.createDataFrame(rows, "criterion string, qid int, a int, b int")
    for row in calibration.calibrate(pairs, ["criterion"], "a", "b").collect():
        t = row.rho * math.sqrt((row.n - 2) / (1 - row.rho**2))
        assert row.p == pytest.approx(t_tail(t, row.n - 2), abs=1e-4) and row.trusted == (row.kappa >= 0.6)
    flat = spark.createDataFrame([("z", 1, 3, 3), ("z", 2, 3, 4)], "criterion string, qid int, a int, b int")
    assert calibration.calibrate(flat, ["criterion"], "a", "b").select("rho", "p", "trusted").first() == (0.0, 1.0, False)
    scores = spark.createDataFrame([("c", 100 * i, i + (i % 2)) for i in range(12)] + [("d", 5, 1), ("d", 5, 2), ("d", 5, 3)], "criterion string, chars int, score int")
    bias = {x.criterion: x for x in calibration.length_bias(scores, "criterion", "chars", "score").collect()}
    assert bias["c"].biased and bias["c"].slope == pytest.approx(1, abs=0.05) and (bias["d"].slope, bias["d"].p, bias["d"].biased) == (0.0, 1.0, False)
    text = calibration.report(calibration.calibrate(pairs, ["criterion"], "a", "b"), calibration.length_bias(scores, "criterion", "chars", "score"))
    assert "UNTRUSTED: " in text and "length bias on c" in text


def test_signed_rank_test_exact_and_approximate(spark):
    r = random.Random(4)
    for n in (4, 12, 400):
        diffs = [r.randint(-6, 9) / 4 for _ in range(n)]
        got = calibration.signed_rank_test(spark.createDataFrame([(x,) for x in diffs], "diff double")).first()
        assert got.p == pytest.approx(stats.signed_rank_p(diffs)) if got.p is not None else n == 4


def test_tei_and_lines_become_sections(spark):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><profileDesc><abstract><p>Short <b>abstract</b>.</p></abstract></profileDesc></teiHeader><text><body><div><head>2 Methods</head><p>One.</p><p>Two <ref>x</ref>.</p></div><div><p>No head.</p></div><div><head>Empty</head></div></body></text></TEI>'
    docs = spark.createDataFrame([("a", tei), ("b", "<broken"), ("c", None), ("d", "<TEI/>")], "doc string, xml string")
    got = parsing.tei_sections(docs, "doc", "xml").collect()
    assert [(r.title, r.section_type, r.text) for r in sorted(got, key=lambda r: r.pos) if r.doc == "a"] == [("Abstract", "abstract", "Short abstract ."), ("2 Methods", "method", "One.\nTwo x ."), ("Section", "other", "No head.")]
    assert {r.doc: (r.error or "")[:6] for r in got if r.doc != "a"} == {"b": "no XML", "c": "no XML", "d": "no sec"}
    heads = {"Introduction", "References", "John Smith", "Appendix A"}
    lines = ["Title of it all", "Introduction", "Body one is long enough to be body text here, in lower size.", "[1] A. B.", "[2] C. D.", "[3] E. F.", "References", "[4] entry", "John Smith", "[5] entry", "Appendix A", "More body text follows after the references of the paper."]
    df = spark.createDataFrame([("b", i, t, 10.0, t in heads) for i, t in enumerate(lines)], "doc string, pos int, text string, size double, bold boolean")
    out = [(r.title, r.section_type, r.text) for r in parsing.split_sections(df, "doc").orderBy("pos").collect()]
    assert out == [("Front Matter", "other", lines[0]), ("Introduction", "introduction", lines[2]), ("References", "references", "\n".join(lines[3:6])), ("References", "references", "[4] entry\nJohn Smith\n[5] entry"), ("Appendix A", "appendix", lines[11])]
    both = parsing.parse_documents(docs, df, "doc", "xml").collect()
    assert {r.doc for r in both} == {"a", "b"}
    ids = spark.createDataFrame([("arXiv:1", True), ("a" * 40, True), ("A title", False)], "x string, want boolean")
    assert ids.filter(parsing.looks_like_id(F.col("x")) != F.col("want")).count() == 0 and ids.select(parsing.file_safe(F.lit("a/b"))).first()[0] == "a_b"


def plain_chunks(text, target=512, overlap=64):
    """Greedy packing, sentence by sentence."""
    tokens = lambda s: math.floor(len(s.split()) / 0.75 + 0.5)
    out, cur = [], []
    for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z(\[])", text):
        if cur and sum(map(tokens, cur)) + tokens(s) > target:
            out.append(cur)
            tail = []
            for x in reversed(cur):
                if sum(map(tokens, tail)) + tokens(x) > overlap:
                    break
                tail.insert(0, x)
            cur = [*tail, s]
        else:
            cur.append(s)
    out.append(cur)
    return [t for t in (" ".join(c).strip(" ") for c in out) if len(t) >= 80]


def test_chunks_equal_plain_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    sections = docs.select(F.col("doc_id").alias("paper"), F.lit(0).alias("section_index"), F.lit("other").alias("section_type"), "text")
    for target, overlap in ((512, 64), (60, 20)):
        got = {}
        for r in chunking.chunks(sections, target, overlap).collect():
            got.setdefault(r.paper, []).append((r.n, r.text))
        for r in docs.collect():
            if all(ord(c) < 0x2000 for c in r.text):  # Python's white space is wider
                assert [t for _, t in sorted(got.get(r.doc_id, []))] == plain_chunks(r.text, target, overlap), r.doc_id


def test_nearest_breaks_ties_by_id_in_every_block(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.integers(-1, 2, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, vector array<double>, g int").repartition(5)
    unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
    sims = np.round(unit @ unit.T, 9)
    for size in (retrieval.QUERY_BYTES, 2000):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        got = retrieval.nearest(df.withColumnRenamed("id", "qid"), df, 7, within="g", skip_self=True).collect()
        want = {(i, j): n + 1 for i in range(300) for n, j in enumerate(sorted((j for j in range(i % 3, 300, 3) if j != i), key=lambda j: (-sims[i, j], j))[:7])}
        assert {(x.qid, x.id): x.rank for x in got} == want


def test_vector_store_adds_once_and_searches(spark, tmp_path):
    rows = [(f"c{i}", f"p{i % 3}", f"word{i % 7} text of chunk {i} " * 30, "method", "fulltext" if i % 4 else "abstract") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, paper string, text string, section_type string, corpus string")
    store = vectors.build_vectors(chunks, embedding.hash_embed, str(tmp_path / "v"))
    store.add(chunks.withColumn("vector", embedding.hash_embed(F.col("text"))))
    assert store.load().count() == 40 and store.persist(str(tmp_path / "w")).load().count() == 40
    q = chunks.limit(5).select(F.col("id").alias("qid"), embedding.hash_embed(F.col("text")).alias("vector"))
    hits = store.search(q, 3).collect()
    assert hits and all(int(h.id[1:]) % 4 for h in hits) and max(h.rank for h in hits) <= 3


def test_thresholds_that_separate_nothing_are_not_valid(spark):
    rows = [("a", f, p, s) for f, p, s in (("f1", "a", 0.9), ("f1", "b", 0.2), ("f2", "a", 0.82), ("f2", "b", 0.3))]
    df = spark.createDataFrame(rows, "qid string, facet string, plan string, sim double")
    assert trajectories.absolute_coverage_is_valid(df) is True
    rates = {r.threshold: (r.matched_kept, r.null_admitted) for r in trajectories.threshold_rates(df).collect()}
    assert rates[0.85] == (0.5, 0.0) and rates[0.6] == (1.0, 0.0)
    assert trajectories.absolute_coverage_is_valid(df.withColumn("sim", F.lit(0.9))) is False and trajectories.absolute_coverage_is_valid(df.filter("plan = 'a'")) is None
    t = spark.createDataFrame([("a", ["1"], ["1", "2"], 4, False, True)], "qid string, papers_before array<string>, papers_after array<string>, used long, planner_failed boolean, critique_ran boolean")
    gold = spark.createDataFrame([("a", "survey", ["paper:2", "paper:9"])], "qid string, query_type string, must_cite array<string>")
    s = trajectories.scores(t, gold, df)
    r = s.first()
    assert (r.decomposition_coverage, r.decomposition_specificity, r.facets_total, r.retrieval_efficiency, r.required_found, r.critique_added_required, r.critique_added_any) == (1.0, 1.0, 2, 0.25, 1, 1, 1)
    assert {x.query_type: x.n for x in trajectories.summary(s).collect()} == {None: 1, "survey": 1}


def test_settings_file_then_environment(tmp_path, monkeypatch):
    f = tmp_path / "s.toml"
    f.write_text("[chunking]\ntarget_tokens = 100\n[eval.calibration]\nmin_quadratic_kappa = 0.7\n")
    monkeypatch.setenv("LODEWEAVE__CHUNKING__OVERLAP_TOKENS", "7")
    config.get_settings.cache_clear()
    s = config.get_settings(str(f))
    assert (s.chunking.target_tokens, s.chunking.overlap_tokens, s.eval.calibration.min_quadratic_kappa, s.embeddings.dim) == (100, 7, 0.7, 64)
    assert s.paths.resolved("/r").gold == "/r/eval/gold" and config.read_file(str(tmp_path / "none.json")) == {}
    with pytest.raises(ValueError):
        config.overlaid(s, {"chunks": 1})
