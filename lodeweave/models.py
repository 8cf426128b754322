"""Model calls: one interface, HTTP adapters, usage counters, and the operators that ask a model.

A call happens inside an Arrow function, a row at a time; a call that fails costs its row, never the
batch. Offline, any object with ``json`` and ``text`` serves.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import calibration, extraction

ATTEMPTS = 3
#: How a provider's model names begin.
PREFIXES = {"anthropic": ("claude-",), "openai": ("gpt-", "o1", "o3", "o4")}
URLS = {"openai": "https://api.openai.com/v1/chat/completions", "anthropic": "https://api.anthropic.com/v1/messages"}


class ChatClient(Protocol):
    """What the operators need of a model."""

    model: str

    def json(self, system: str, user: str, schema: dict | None = None, temperature: float | None = None) -> dict: ...

    def text(self, system: str, user: str, temperature: float | None = None) -> str: ...


class UsageTracker:
    """Calls and tokens per model, counted in one process; rows of it sum with ``usage_rows``."""

    def __init__(self) -> None:
        self._lock, self._counts = threading.Lock(), Counter()

    def __getstate__(self) -> dict:
        return {"_counts": self._counts}  # a worker counts for itself

    def __setstate__(self, state: dict) -> None:
        self._lock, self._counts = threading.Lock(), Counter(state["_counts"])

    def record(self, model: str, tokens_in: int, tokens_out: int, cached: int = 0) -> None:
        with self._lock:
            for name, n in (("calls", 1), ("tokens_in", tokens_in), ("tokens_out", tokens_out), ("cached", cached)):
                self._counts[model, name] += n

    def snapshot(self) -> dict[str, dict[str, int]]:
        with self._lock:
            out: dict[str, dict[str, int]] = {}
            for (model, name), n in self._counts.items():
                out.setdefault(model, {})[name] = n
            return out

    def reset(self) -> None:
        with self._lock:
            self._counts.clear()

    def summary(self, prices: dict[str, tuple[float, float]] | None = None) -> str:
        """A line per model; a cost where a price per million tokens in and out is known, a total only if all are."""
        prices, lines, total, known = prices or {}, [], 0.0, True
        for model, c in sorted(self.snapshot().items()):
            line = f"{model}: {c['calls']} calls, {c['tokens_in']} in ({c['cached']} cached), {c['tokens_out']} out"
            if model in prices:
                cost = c["tokens_in"] / 1e6 * prices[model][0] + c["tokens_out"] / 1e6 * prices[model][1]
                total, line = total + cost, line + f", ${cost:.4f}"
            else:
                known = False
            lines.append(line)
        return "\n".join(lines + [f"total ${total:.4f}"] * (known and bool(lines)))


def provider_of(model: str) -> str:
    for provider, starts in PREFIXES.items():
        if model.startswith(starts):
            return provider
    raise ValueError(f"no provider is known for {model}; name one")


class HttpChat:
    """Chat over HTTP in the style of a provider; ``send`` (url, headers, body) -> answer can be replaced, as in tests."""

    def __init__(self, model: str, key: str = "", provider: str | None = None, url: str | None = None, usage: UsageTracker | None = None, send: Callable | None = None) -> None:
        self.model, self.key, self.provider = model, key, provider or provider_of(model)
        self.url, self.usage, self.send = url or URLS[self.provider], usage or UsageTracker(), send or _post

    def text(self, system: str, user: str, temperature: float | None = None) -> str:
        return self._complete(system, user, None, temperature)

    def json(self, system: str, user: str, schema: dict | None = None, temperature: float | None = None) -> dict:
        found = json.loads(self._complete(system, user, schema or {"type": "object"}, temperature))
        if not isinstance(found, dict):
            raise ValueError("the answer is no object")
        return found

    def _complete(self, system: str, user: str, schema: dict | None, temperature: float | None) -> str:
        body: dict = {"model": self.model, "messages": [{"role": "user", "content": user}]}
        if temperature is not None:
            body["temperature"] = temperature
        if self.provider == "anthropic":
            headers = {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
            body |= {"system": system + (f"\nAnswer with one JSON object of this schema: {json.dumps(schema)}" if schema else ""), "max_tokens": 4096}
            got = self.send(self.url, headers, body)
            u = got.get("usage", {})
            self.usage.record(self.model, u.get("input_tokens", 0), u.get("output_tokens", 0), u.get("cache_read_input_tokens", 0))
            return next((part["text"] for part in got["content"] if part.get("type") == "text"), "")
        body["messages"].insert(0, {"role": "system", "content": system})
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}
        got = self.send(self.url, {"Authorization": f"Bearer {self.key}"}, body)
        u = got.get("usage", {})
        self.usage.record(self.model, u.get("prompt_tokens", 0), u.get("completion_tokens", 0), (u.get("prompt_tokens_details") or {}).get("cached_tokens", 0))
        return got["choices"][0]["message"]["content"] or ""


def _post(url: str, headers: dict, body: dict) -> dict:
    for attempt in range(ATTEMPTS):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
            with urllib.request.urlopen(request, timeout=120) as r:
                return json.load(r)
        except OSError:
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(2**attempt)
    return {}


def local_chat(model: str, base_url: str | None) -> HttpChat:
    """A server of one's own that speaks the common protocol."""
    if not base_url:
        raise ValueError("a local model needs its base URL")
    return HttpChat(model, provider="openai", url=f"{base_url.rstrip('/')}/chat/completions")


EXTRACTED = "paper string, nodes array<struct<id: string, type: string, name: string, attrs: map<string, string>, confidence: double, ord: int>>, edges array<struct<src_name: string, dst_name: string, type: string, confidence: double, ord: int>>, error string"


def extract_sections(sections: DataFrame, client: ChatClient) -> DataFrame:
    """(paper, section_index, nodes, edges, error): the raw payload of every section (paper, section_index, section_type, text).

    A call or payload that fails leaves empty lists and the error's name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, index, prompt in zip(b["paper"], b["section_index"], b["prompt"], strict=True):
                nodes, edges, error = [], [], None
                try:
                    raw = client.json("Extract typed nodes and edges. Output JSON only.", prompt, temperature=0.0)
                    nodes = [_node(x, i) for i, x in enumerate(raw.get("nodes") or [])]
                    edges = [_edge(x, i) for i, x in enumerate(raw.get("edges") or [])]
                except Exception as e:  # one section must not stop the rest
                    nodes, edges, error = [], [], type(e).__name__
                rows.append((paper, index, nodes, edges, error))
            yield pd.DataFrame(rows, columns=["paper", "section_index", "nodes", "edges", "error"])

    asked = extraction.prompts(sections).select("paper", "section_index", "prompt")
    return asked.mapInPandas(run, EXTRACTED.replace("paper string,", "paper string, section_index int,"))


def _number(value: object) -> float:
    try:
        return min(1.0, max(0.0, float(value)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.5


def _node(x: dict, i: int) -> dict:
    attrs = x.get("attrs")
    if isinstance(attrs, str):
        try:
            attrs = json.loads(attrs)
        except ValueError:
            attrs = None
    return {"id": None, "type": str(x.get("type", "")), "name": str(x.get("name", "")), "attrs": {str(k): str(v) for k, v in attrs.items()} if isinstance(attrs, dict) else {}, "confidence": _number(x.get("confidence")), "ord": i}


def _edge(x: dict, i: int) -> dict:
    return {"src_name": str(x.get("src", "")), "dst_name": str(x.get("dst", "")), "type": str(x.get("type", "")), "confidence": _number(x.get("confidence")), "ord": i}


def extract_papers(sections: DataFrame, client: ChatClient, done: DataFrame | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers that are wanted and not done: gated, ends resolved within the paper, one node per id."""
    from .functions import text as T

    if wanted is not None:
        sections = sections.join(wanted.select("paper").distinct(), "paper", "left_semi")
    if done is not None:
        sections = sections.join(done.select("paper").distinct(), "paper", "left_anti")
    raw = extract_sections(sections, client)
    nodes = raw.select("paper", F.explode("nodes").alias("n"), "section_index").select("paper", "n.type", "n.name", "n.attrs", "n.confidence", (F.col("section_index") * 100_000 + F.col("n.ord")).alias("ord"))
    nodes = extraction.gate_nodes(nodes).withColumn("id", T.node_id(F.col("type"), F.col("name")))
    edges = raw.select("paper", F.explode("edges").alias("e"), "section_index").select("paper", "e.src_name", "e.dst_name", "e.type", "e.confidence", (F.col("section_index") * 100_000 + F.col("e.ord")).alias("ord"))
    return extraction.best_nodes(nodes, ["paper", "id"]), extraction.gate_edges(edges, nodes, "paper")


def judge_answers(answers: DataFrame, client: ChatClient, version: str = "v1", criteria: list[str] = calibration.CRITERIA) -> DataFrame:
    """(qid, scores, justifications, prompt_version, error) for answers (qid, query, spec, text, evidence); grades are 1 to 5."""

    @F.pandas_udf("scores map<string,int>, justifications map<string,string>, error string")
    def ask(query: pd.Series, spec: pd.Series, text: pd.Series, evidence: pd.Series) -> pd.DataFrame:
        rows = []
        for q, s, t, e in zip(query, spec, text, evidence, strict=True):
            try:
                raw = client.json("Grade strictly. Output JSON only.", f"Criteria: {', '.join(criteria)}; grades 1 to 5.\nQUERY: {q}\nGOLD: {s}\nEVIDENCE: {e or '(not provided)'}\nANSWER: {t}", temperature=0.0)
                given = {c: min(5, max(1, int(raw[c]["score"]))) for c in criteria}
                rows.append((given, {c: str(raw[c].get("why", "")) for c in criteria}, None))
            except Exception as x:  # a judgement that fails is no judgement
                rows.append((None, None, type(x).__name__))
        return pd.DataFrame(rows, columns=["scores", "justifications", "error"])

    out = answers.withColumn("_j", ask("query", "spec", "text", "evidence"))
    return out.select("qid", "_j.scores", "_j.justifications", F.lit(version).alias("prompt_version"), "_j.error")


def label_pairs(samples: DataFrame, client: ChatClient, labels: list[str]) -> DataFrame:
    """(sample, label) for samples (sample, a_text, b_text), labelled blind to any verdict; failures are left out."""

    @F.pandas_udf("string")
    def ask(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                said = client.json(f"Answer with a label of {', '.join(labels)}. Output JSON only.", f"A: {x}\nB: {y}", temperature=0.0).get("label")
            except Exception:  # excluded from the audit
                said = None
            out.append(said if said in labels else None)
        return pd.Series(out)

    return samples.select("sample", ask("a_text", "b_text").alias("label")).filter("label is not null")
