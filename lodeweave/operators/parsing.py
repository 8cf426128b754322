"""Document parsing: spans to lines, typographic headings, sections of lines, sections of TEI.

Spans and lines are tables in reading order; a document's state machine is a window over its lines, so
no document is a Python loop. TEI is read per row by an Arrow function, because a section's paragraphs
have no fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking

BOLD_BIT = 16
HEADING_CHARS, HEADING_WORDS, HEADING_LETTERS, LARGER = 90, 12, 3, 0.5
#: How captions of figures and tables begin; how identifiers begin.
CAPTION = r"(?i)^\s*(fig(ure)?|tab(le)?)\b\.?\s*\d"
IDENTIFIER = r"(?i)^(arxiv|doi|corpusid|mag|acl|pmid|pmcid|url):"
LINE = ["page", "block", "line"]


def lines_of(spans: DataFrame, key: str) -> DataFrame:
    """(key, page, block, line, text, size, bold) from spans (key, page, block, kind, line, span, text, size, flags).

    Blocks of another kind than 0 (images) are left out. A line's text is that of all its spans, trimmed;
    its size is the largest and it is bold if all are, of the spans that show something. Lines without
    such spans go.
    """
    inked = F.trim("text") != ""
    parts = F.array_sort(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("t"))))
    out = spans.filter("kind = 0").groupBy(key, *LINE).agg(
        F.trim(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("text"),
        F.round(F.max(F.when(inked, F.col("size"))), 1).alias("size"),
        F.bool_and(F.when(inked, F.col("flags").bitwiseAND(BOLD_BIT) != 0)).alias("bold"),
    )
    return out.filter(F.col("size").isNotNull())


def body_size(lines: DataFrame, key: str) -> DataFrame:
    """(key, body): the size that most characters have, the smallest on a tie."""
    per = lines.groupBy(key, "size").agg(F.sum(F.char_length("text")).alias("n"))
    return per.groupBy(key).agg(F.max(F.struct("n", (-F.col("size")).alias("s"))).alias("m")).select(key, (-F.col("m.s")).alias("body"))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Short, no caption, mostly letters, and bold or larger than the body."""
    letters, chars = F.regexp_count(text, F.lit(r"\p{L}")), F.char_length(text)
    short = (chars <= HEADING_CHARS) & (F.size(T.words(text)) <= HEADING_WORDS)
    return short & ~text.rlike(CAPTION) & (letters >= HEADING_LETTERS) & (letters * 2 >= chars) & (bold | (size >= body + LARGER))


def split_sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, pos, title, section_type, text) from lines (key, pos, text, size, bold).

    A heading opens a section. After a heading of references only one of another known type does, so
    names in a bibliography do not. What precedes the first heading is front matter; a bibliography
    that runs on inside a section is cut off as references. Sections without text are left out.
    """
    by = Window.partitionBy(key).orderBy("pos")
    marked = lines.join(body_size(lines, key), key).withColumn("_h", is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")))
    marked = marked.withColumn("_t", F.when(F.col("_h"), T.classify_section(F.col("text"))))
    mode = F.last(F.when(F.col("_t") != "other", F.col("_t")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    held = (F.coalesce(mode, F.lit("")) == "references") & F.col("_t").isin("other", "references")
    marked = marked.withColumn("_opens", F.col("_h") & ~held)
    marked = marked.withColumn("_sec", F.sum(F.col("_opens").cast("int")).over(by)).withColumn("_u", F.struct(F.col(key).alias("k"), F.col("_sec").alias("s")))
    titles = marked.filter("_opens").select(F.col("_u").alias("_v"), F.col("text").alias("title"), F.col("_t").alias("kind"), F.col("pos").alias("head"))
    body = marked.filter("not _opens").select("_u", "pos", "text")
    cut = chunking.bibliography_start(body, "_u", "pos", "text")
    body = body.join(cut, "_u", "left").withColumn("_refs", F.coalesce(F.col("pos") >= F.col("start"), F.lit(False)))
    listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    parts = body.groupBy("_u", "_refs").agg(F.trim(F.array_join(F.transform(listed, lambda x: x["text"]), "\n")).alias("text"), F.min("pos").alias("first"))
    out = parts.join(titles, F.col("_u") == F.col("_v"), "left").filter("text <> ''")
    title = F.when(F.col("_refs"), "References").otherwise(F.coalesce("title", F.lit("Front Matter")))
    kind = F.when(F.col("_refs"), "references").otherwise(F.coalesce("kind", F.lit("other")))
    return out.select(F.col("_u.k").alias(key), F.col("first").alias("pos"), title.alias("title"), kind.alias("section_type"), "text")


def tei_sections(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, title, section_type, text, error): the abstract and the body's divisions of a TEI document.

    What is no XML, or has no section, gives one row with ``error`` and nothing else, so one bad
    document does not stop the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        tei = "{http://www.tei-c.org/ns/1.0}"
        joined = lambda e: " ".join(s.strip() for s in e.itertext() if s.strip())
        for batch in batches:
            rows = []
            for k, source in zip(batch["key"], batch["xml"], strict=True):
                found, error = [], None
                try:
                    root = ElementTree.fromstring(source or "")
                    for a in root.iterfind(f".//{tei}profileDesc//{tei}abstract"):
                        found.append(("Abstract", joined(a)))
                        break
                    for div in root.iterfind(f".//{tei}body//{tei}div"):
                        head = div.find(f"{tei}head")
                        title = "Section" if head is None else "".join(head.itertext()).strip()
                        found.append((title, "\n".join(filter(None, map(joined, div.findall(f"{tei}p"))))))
                except ElementTree.ParseError as e:
                    error = f"no XML: {e}"
                kept = [(k, i, t, s, None) for i, (t, s) in enumerate((t, s) for t, s in found if s)]
                rows += kept or [(k, 0, None, None, error or "no sections")]
            yield pd.DataFrame(rows, columns=["key", "pos", "title", "text", "error"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(xml).alias("xml")).mapInPandas(run, f"key {kind}, pos int, title string, text string, error string")
    return out.select(F.col("key").alias(key), "pos", "title", F.when(F.col("error").isNull(), T.classify_section(F.col("title"))).alias("section_type"), "text", "error")


def parse_documents(tei: DataFrame, lines: DataFrame, key: str, xml: str) -> DataFrame:
    """Sections of every document: of its TEI where that has any, else of its lines; small ones folded, types refined."""
    first = tei_sections(tei, key, xml).filter("error is null").drop("error")
    rest = split_sections(lines.join(first.select(key).distinct(), key, "left_anti"), key)
    both = first.unionByName(rest).select(key, "pos", F.col("section_type").alias("kind"), "text", "title")
    folded = chunking.fold_fragments(both, key, "pos", "text", "kind").drop("n_parts")
    return chunking.retype(folded, key, "pos", "text", "kind").join(both.select(key, "pos", "title"), [key, "pos"])


def looks_like_id(line: Column) -> Column:
    """A paper's identifier rather than its title."""
    return line.rlike(IDENTIFIER) | line.rlike(r"^[0-9a-f]{40}$")


def file_safe(ident: Column) -> Column:
    return F.translate(ident, "/", "_")
