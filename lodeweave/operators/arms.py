"""Retrieval arms and the budgeted agent loop, for whole batches of questions at once.

Model calls sit behind ``Chat``; the offline ``ExtractiveChat`` answers from its evidence, so every arm
runs without a network. Each stage of the loop is one batched retrieval for all questions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as T
from ..functions.storage import written
from . import graph, retrieval

MAX_RETRIEVALS, TOP_K, MAX_GAPS, DRAFT_CHARS = 6, 20, 2, 24_000
NO_EVIDENCE = "No evidence was found for this question."


class Chat(Protocol):
    """What an arm needs of a model."""

    model: str

    def answer(self, question: str, evidence: str) -> str: ...

    def plan(self, question: str) -> list[str]: ...

    def gaps(self, question: str, evidence: str) -> list[str]: ...


@dataclass
class ExtractiveChat:
    """Deterministic stand-in: quotes the first sentence of the first blocks, plans by clause, misses terms that the evidence lacks."""

    model: str = "extractive"
    blocks: int = 3

    def answer(self, question: str, evidence: str) -> str:
        out = []
        for block in evidence.split("\n\n")[: self.blocks]:
            handle, _, body = block.partition("] ")
            out.append(body.split(". ")[0].strip().rstrip(".") + f" {handle}].")
        return " ".join(out)

    def plan(self, question: str) -> list[str]:
        return [c.strip() for c in question.replace(";", ".").split(".") if len(c.split()) >= 3]

    def gaps(self, question: str, evidence: str) -> list[str]:
        seen = set(evidence.lower().split())
        missing = [w for w in dict.fromkeys(question.lower().split()) if len(w) > 3 and w not in seen]
        return missing[:MAX_GAPS]


@dataclass
class Library:
    """The tables an arm reads: chunks (id, paper, text, vector, corpus, section_type, n_chars), and the graph's nodes and edges."""

    chunks: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    dim: int = 64
    chat: Chat = field(default_factory=ExtractiveChat)

    def embed(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("vector", embedding.hash_embed(F.col("text"), self.dim))


def resolve_handles(answers: DataFrame) -> DataFrame:
    """text and cited from raw (``[P1, P3]`` handles) and handles (map handle -> paper); unknown handles vanish."""

    @F.pandas_udf("text string, cited array<string>")
    def resolve(raw: pd.Series, handles: pd.Series) -> pd.DataFrame:
        import re

        rows = []
        for text, known in zip(raw, handles, strict=True):
            known = dict(known) if known is not None else {}
            cited: set[str] = set()

            def one(m: re.Match, known: dict = known, cited: set = cited) -> str:
                got = [known[h] for h in re.split(r"\s*,\s*", m[1]) if h in known]
                cited.update(got)
                return "".join(f"[paper:{p}]" for p in got)

            text = re.sub(r"\[(P\d+(?:\s*,\s*P\d+)*)\]", one, text or "")
            rows.append((re.sub(r"\s+([.,;:!?])", r"\1", text), sorted(cited)))
        return pd.DataFrame(rows, columns=["text", "cited"])

    return answers.withColumn("_r", resolve("raw", "handles")).select(*[c for c in answers.columns if c not in ("raw", "handles", "text")], "_r.text", "_r.cited")


def synthesize(lib: Library, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, text, cited, n_papers): evidence of ranked hits (qid, id, paper, rank, text), answered and its handles resolved."""
    chat = lib.chat

    @F.pandas_udf("string")
    def ask(question: pd.Series, evidence: pd.Series) -> pd.Series:
        return pd.Series([NO_EVIDENCE if e is None else chat.answer(q, e) for q, e in zip(question, evidence, strict=True)])

    named = retrieval.with_handles(hits)
    handles = named.select("qid", "handle", "paper").distinct().groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("handle", F.col("paper").cast("string")))).alias("handles"))
    full = queries.select("qid", F.col("text").alias("question")).join(retrieval.evidence(named), "qid", "left").join(handles, "qid", "left")
    asked = full.select("qid", ask("question", "evidence").alias("raw"), F.coalesce("handles", F.create_map().cast("map<string,string>")).alias("handles"), F.coalesce("n_papers", F.lit(0)).alias("n_papers"))
    return resolve_handles(asked)


def _text(lib: Library, hits: DataFrame) -> DataFrame:
    return retrieval.met_by(hits, lib.chunks.select("id", "paper", "text"))


def vector_arm(lib: Library, queries: DataFrame, corpus: str = "fulltext", top_k: int = 60) -> DataFrame:
    hits = retrieval.search(lib.embed(queries), lib.chunks, top_k, corpus)
    return synthesize(lib, queries, _text(lib, hits))


def _papers_to_chunks(lib: Library, queries: DataFrame, papers: DataFrame, pool: int = 600) -> DataFrame:
    hits = _text(lib, retrieval.search(lib.embed(queries), lib.chunks, pool, "fulltext"))
    return retrieval.route_chunks(hits, papers)


def _seeds(lib: Library, queries: DataFrame, types: list[str], k: int = 12) -> DataFrame:
    nodes = graph.curated(lib.nodes).filter(F.col("type").isin(types)).withColumn("vector", embedding.hash_embed(F.col("name"), lib.dim))
    return retrieval.nearest(lib.embed(queries), nodes, k).select("qid", "id")


SEEDABLE = ["Method", "Problem", "Claim", "Limitation", "Dataset", "Hardware", "Software"]


def typed_graph_arm(lib: Library, queries: DataFrame, chunks: bool = True, hops: int = 2, cap: int = 150) -> DataFrame:
    """Seeds by node name, typed walk, then either quotes of the nodes reached or chunks of their papers."""
    reached = graph.expand(_seeds(lib, queries, SEEDABLE), graph.curated(lib.edges), hops, cap, graph.curated(lib.nodes))
    met = retrieval.met_by(reached, lib.nodes.select("id", F.col("from_paper").alias("paper"), *([] if chunks else ["quote"]))).filter("paper is not null")
    if chunks:
        return synthesize(lib, queries, _papers_to_chunks(lib, queries, met))
    by = Window.partitionBy("qid").orderBy("hop", "id")
    quotes = met.filter(F.trim("quote") != "").withColumn("rank", F.row_number().over(by)).withColumn("text", F.substring("quote", 1, 600))
    return synthesize(lib, queries, quotes)


def citation_arm(lib: Library, queries: DataFrame, seed_from: str = "title", hops: int = 2, cap: int = 30) -> DataFrame:
    """Walk over citations from papers found by title or by chunk, then chunks of the papers reached."""
    if seed_from == "title":
        seeds = _seeds(lib, queries, ["Paper"])
    else:
        hits = _text(lib, retrieval.search(lib.embed(queries), lib.chunks, 200, "fulltext")).groupBy("qid", "paper").agg(F.min("rank").alias("first"))
        by = Window.partitionBy("qid").orderBy("first", "paper")
        seeds = hits.withColumn("n", F.row_number().over(by)).filter("n <= 12").select("qid", F.concat(F.lit("paper:"), F.col("paper").cast("string")).alias("id"))
    papers = graph.curated(lib.nodes).filter("type = 'Paper'")
    reached = graph.expand(seeds, graph.curated(lib.edges).filter("type = 'cites'"), hops, cap, papers)
    return synthesize(lib, queries, _papers_to_chunks(lib, queries, reached.select("qid", T.bare_paper(F.col("id")).alias("paper"))))


def agentic_arm(lib: Library, queries: DataFrame, budget: int = MAX_RETRIEVALS, top_k: int = TOP_K, anchor: bool = True, critique: bool = True) -> DataFrame:
    """Plan, anchor, sub-retrievals, critique, further retrievals, answer; with the trajectory of every question.

    A plan that is empty falls back to the question itself (planner_failed). Retrievals beyond the
    budget are refused and counted.
    """
    chat = lib.chat

    @F.pandas_udf("array<string>")
    def plan(q: pd.Series) -> pd.Series:
        return q.map(lambda t: chat.plan(t or ""))

    @F.pandas_udf("array<string>")
    def gaps(q: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([chat.gaps(a or "", (b or "")[:DRAFT_CHARS])[:MAX_GAPS] for a, b in zip(q, e, strict=True)])

    most = max(1, budget - 1 - int(anchor))
    planned = queries.withColumn("_p", plan("text")).withColumn("planner_failed", F.size("_p") == 0)
    planned = planned.withColumn("sub_questions", F.when(F.col("planner_failed"), F.array("text")).otherwise(F.slice("_p", 1, most))).drop("_p")
    first = F.array("text") if anchor else F.array().cast("array<string>")
    steps = planned.select("qid", F.posexplode(F.concat(first, "sub_questions")).alias("batch", "text")).filter(F.col("batch") < budget)

    def run(steps: DataFrame) -> DataFrame:
        asked = lib.embed(steps.select(F.struct("qid", "batch").alias("key"), "text")).withColumn("qid", F.concat_ws("#", F.col("key.qid").cast("string"), F.col("key.batch").cast("string")))
        hits = retrieval.search(asked.select("qid", "vector"), lib.chunks, top_k, "fulltext")
        return asked.select("key", "qid").join(hits, "qid").select("key.qid", "key.batch", "id", "rank")

    steps = written(steps, "steps")
    before = written(run(steps), "before")  # retrievals are read several times below
    found = before
    drafts = retrieval.evidence(retrieval.with_handles(_text(lib, retrieval.merge_hits(before)))).select("qid", "evidence")
    used = steps.groupBy("qid").agg(F.count(F.lit(1)).alias("used"))
    state = planned.join(used, "qid").join(drafts, "qid", "left")
    wanted = F.array().cast("array<string>")
    if critique:
        state = written(state.withColumn("gaps", gaps("text", "evidence")), "state")
        left = F.greatest(F.lit(0), F.lit(budget) - F.col("used"))
        wanted = F.slice("gaps", F.lit(1), left)
        state = state.withColumn("refused", F.greatest(F.lit(0), F.size("gaps") - left))
        more = state.select("qid", F.posexplode(wanted).alias("n", "text")).select("qid", (F.col("n") + 100).alias("batch"), "text")
        found = written(before.unionByName(run(more)), "found")
    else:
        state = state.withColumns({"gaps": wanted, "refused": F.lit(0)})
    merged = written(_text(lib, retrieval.merge_hits(found)), "merged")
    answers = synthesize(lib, queries, merged)
    papers = lambda h, name: _text(lib, h).groupBy("qid").agg(F.array_sort(F.collect_set("paper")).alias(name))
    trace = state.join(papers(before, "papers_before"), "qid", "left").join(papers(found, "papers_after"), "qid", "left")
    trace = trace.select("qid", "sub_questions", "planner_failed", "gaps", F.least(F.lit(budget), F.col("used") + F.size("gaps") - F.col("refused")).cast("bigint").alias("used"), F.col("refused").cast("bigint").alias("refused"), F.array_sort(F.array_except("papers_after", "papers_before")).alias("added"))
    return answers.join(trace, "qid")


def staged_plan(trace: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans as staged Problem nodes and addresses edges, confidence 0.5; nothing where the planner failed."""
    asked = queries.select("qid", F.col("text").alias("question"))
    rows = trace.filter(~F.col("planner_failed")).join(asked, "qid").select("question", F.explode("sub_questions").alias("sub"))
    node = lambda c: (T.staged_id("problem", F.col(c)).alias("id"), F.lit("Problem").alias("type"), F.col(c).alias("name"))
    layer = (F.lit(graph.STAGED).alias("source_layer"), F.lit(0.5).alias("confidence"))
    nodes = rows.select(*node("question"), *layer).unionByName(rows.select(*node("sub"), *layer)).dropDuplicates(["id"])
    edges = rows.select(T.staged_id("problem", F.col("sub")).alias("src"), T.staged_id("problem", F.col("question")).alias("dst"), F.lit("addresses").alias("type"), *layer).filter("src <> dst").distinct()
    return nodes, edges


ARMS = {
    "vector_abstract": lambda lib, q: vector_arm(lib, q, "abstract"),
    "vector_fulltext": vector_arm,
    "typed_graph": lambda lib, q: typed_graph_arm(lib, q, chunks=False),
    "typed_graph_chunks": typed_graph_arm,
    "citation_graph": citation_arm,
    "citation_graph_seeded": lambda lib, q: citation_arm(lib, q, "chunks"),
    "agentic": agentic_arm,
    "agentic_no_critique": lambda lib, q: agentic_arm(lib, q, critique=False),
}


def build_arm(name: str):
    """An arm by name: (library, queries) -> answers."""
    if name not in ARMS:
        raise ValueError(f"no arm {name}; there are {', '.join(ARMS)}")
    return ARMS[name]
