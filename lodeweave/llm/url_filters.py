"""URL filters: a trie over reversed host labels and path segments, broadcast to the workers.

A rule (verdict, host, path) fits a url whose host is the rule's host or a subdomain of it and whose
path starts with the rule's path. Of the rules that fit, the one with the most characters in host
and path wins; if an allow and a block entry are equal, block does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Rules are broadcast as one trie; beyond so many characters in all they must go through ``judge_by_join``.
MOST_RULE_CHARS = 32 << 20
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ``://`` with A-Z lowered, the path up to ``?`` or ``#``; both empty without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:stop]


def parse_rule(rule: str) -> tuple[str, str]:
    """``example.com/en/`` -> (``example.com``, ``/en/``)."""
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Host labels from the right, then path segments; the last, possibly partial segment is matched as a prefix."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.root: dict = {}
        self.size = sum(len(r) for _, r in rules)
        for verdict, rule in rules:
            host, path = parse_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("paths", {}).setdefault(segment, {})
            entry = (verdict, host + path)
            old = node.setdefault("tails", {}).get(tail)
            if old is None or verdict == "block":
                node["tails"][tail] = entry

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The (verdict, rule) of the longest rule that fits, or None."""
        best: tuple[str, str] | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            at = node
            for segment in segments:
                for tail, entry in at.get("tails", {}).items() if len(at.get("tails", ())) <= len(segment) + 1 else ((segment[:n], at["tails"].get(segment[:n])) for n in range(len(segment) + 1)):
                    if entry and segment.startswith(tail) and (best is None or len(entry[1]) > len(best[1])):
                        best = entry
                at = at.get("paths", {}).get(segment)
                if at is None:
                    break
        return best


def judge_urls(pages: DataFrame, key: str, url: str, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict per row; no rule fits: rule null, verdict ``default``.

    ``rules`` are (verdict, ``host/path``) with verdict allow or block. Null urls and urls without
    ``://`` have an empty host and path, which no rule fits; long urls cost one pass; repeated rows and
    null keys pass through; an empty table gives no rows; other columns are not read. The trie holds
    at most ``MOST_RULE_CHARS`` characters of rules; more raise.
    """
    if any(v not in ("allow", "block") or not parse_rule(r)[0] for v, r in rules):
        raise ValueError("a rule is (allow or block, host/path)")
    trie = UrlTrie(rules)
    if trie.size > MOST_RULE_CHARS:
        raise ValueError("too many rules to broadcast; use judge_by_join")
    shared = pages.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [find(*p) for p in parts]
            text = [[p[0] for p in parts], [p[1] for p in parts], [f and f[1] for f in found], [f[0] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in text)], ["key", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    out = mapped(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), run, f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)


def judge_by_join(pages: DataFrame, key: str, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same judgement for rule tables (verdict, host, path) too large to broadcast.

    Distinct (host, path) pairs are judged once. Each is expanded to its host suffixes and path
    prefixes (bounded by the url's own length), which meet the rules in an equi-join.
    """
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select(F.col(key), F.translate(host, upper, lower).alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = parts.select("host", "path").distinct().withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
    ruled = rules.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("v"))
    fit = pairs.join(ruled, ["h", "p"]).groupBy("host", "path").agg(F.max(F.struct(F.char_length(F.concat("h", "p")).alias("n"), F.concat("h", "p").alias("rule"), "v")).alias("best"))
    out = parts.join(fit, ["host", "path"], "left")
    return out.select(F.col(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
