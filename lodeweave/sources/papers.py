"""Paper metadata: one schema, JSON lines, and a paged source with pushdown.

``papers`` is a Python data source. It reads result pages ({"data": [...], "next": n}) from saved
files (option ``path``) or over HTTP (option ``url``), with a rate limit per reader and retries; a
year filter and a limit are folded into the request.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

SCHEMA = "paperId string, title string, abstract string, year int, venue string, authors array<struct<authorId: string, name: string>>, references array<struct<paperId: string>>, openAccessPdf struct<url: string>, externalIds map<string, string>"
PAGE, ATTEMPTS = 100, 5


def with_defaults(papers: DataFrame) -> DataFrame:
    """Null lists and maps become empty; arxiv_id without its version; pdf_url."""
    empty = {"authors": "array<struct<authorId: string, name: string>>", "references": "array<struct<paperId: string>>"}
    out = papers.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()} | {"externalIds": F.coalesce("externalIds", F.create_map().cast("map<string,string>"))})
    arxiv = F.regexp_replace(F.col("externalIds")["ArXiv"], r"v\d+$", "")
    return out.withColumns({"arxiv_id": arxiv, "pdf_url": F.coalesce(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv), F.col("openAccessPdf.url"))})


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path))


def append_new(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched papers that are not there yet, each once."""
    return fetched.dropDuplicates(["paperId"]).join(existing.select("paperId"), "paperId", "left_anti")


def usable_pdfs(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source that hold a PDF of at least 1024 bytes."""
    return files.filter((F.col("length") >= 1024) & (F.substring(F.hex(F.substring("content", 1, 4)), 1, 8) == "25504446"))


class PapersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PapersReader(dict(self.options))


class PapersReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.year = options, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("year",):
                self.year = f.value
            yield f  # Spark checks all filters again

    def partitions(self) -> list[InputPartition]:
        if "path" in self.options:
            from glob import glob

            return [InputPartition(p) for p in sorted(glob(self.options["path"]))] or [InputPartition(None)]
        return [InputPartition(self.options.get("query", ""))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        if "path" in self.options:
            with open(partition.value, encoding="utf-8") as f:
                yield from map(_row, json.load(f)["data"])
            return
        offset, left = 0, int(self.options.get("limit", PAGE))
        while left > 0:
            page = self._get({"query": partition.value, "offset": offset, "limit": min(PAGE, left)} | ({"year": f"{self.year}-"} if self.year else {}))
            yield from map(_row, page.get("data", [])[:left])
            left -= len(page.get("data", []))
            offset = page.get("next")
            if not page.get("data") or offset is None:
                return

    def _get(self, params: dict) -> dict:
        for attempt in range(ATTEMPTS):
            time.sleep(float(self.options.get("interval", "1.1")))
            try:
                with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(params)}", timeout=30) as r:
                    return json.load(r)
            except OSError:
                if attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(min(30, 2 ** (attempt + 1)))
        return {}


def _row(p: dict) -> tuple:
    return (
        p.get("paperId"), p.get("title"), p.get("abstract"), p.get("year"), p.get("venue"),
        [(a.get("authorId"), a.get("name")) for a in p.get("authors") or []], [(r.get("paperId"),) for r in p.get("references") or []],
        ((p["openAccessPdf"] or {}).get("url"),) if p.get("openAccessPdf") else None, {k: str(v) for k, v in (p.get("externalIds") or {}).items()},
    )
