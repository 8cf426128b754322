"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered section rules, first match wins; word starts only, case ignored.
SECTION_RULES = [
    ("abstract", r"\babstract"),
    ("introduction", r"\b(introduction|background)"),
    ("related_work", r"\b(related work|prior work)"),
    ("method", r"\b(method|approach|model|architecture|algorithm|setup)"),
    ("results", r"\b(experiment|result|evaluation|ablation|benchmark|simulation|numerical)"),
    ("limitations", r"\b(limitation|threats to validity|future work)"),
    ("discussion", r"\b(discussion|analysis)"),
    ("conclusion", r"\b(conclusion|summary|outlook)"),
    ("availability", r"\b(data|code|software)\s+availability|\bavailability\s+of\s+(data|code)"),
    ("acknowledgments", r"\backnowledg"),
    ("appendix", r"\b(appendix|supplement)"),
    ("references", r"\b(references|bibliography)"),
]
#: Section types that are not indexed, that carry limitations, and that end a paper.
DROPPED_TYPES = ["references", "acknowledgments"]
LIMITATION_TYPES = ["conclusion", "discussion", "limitations"]
TAIL_TYPES = ["references", "appendix", "acknowledgments", "availability"]
#: Words that mean a field is not reported.
SILENT_WORDS = ["unknown", "n/a", "na", "none", "null", "not reported", "not specified", ""]


def classify_section(title: Column) -> Column:
    """Section type of a title; null and unmatched titles are ``other``."""
    out = F.lit("other")
    for kind, pattern in reversed(SECTION_RULES):
        out = F.when(title.rlike(f"(?i){pattern}"), F.lit(kind)).otherwise(out)
    return out


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """Words over 0.75, rounded."""
    return F.round(F.size(words(text)) / 0.75).cast("long")


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space, before a capital or an opening bracket."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z(\[])")


def slug(name: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 become one hyphen, at most 80 characters."""
    bare = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(bare, "^-+|-+$", ""), 1, 80)


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), slug(name))


def plain_name(name: Column) -> Column:
    """ASCII path of name normalisation: lower case, other characters become single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def acronym_of(name: Column) -> Column:
    """The acronym a name ends with in brackets, in capitals; null without one."""
    found = F.regexp_extract(name, r"\(([A-Z][A-Za-z0-9\-]{1,9})s?\)\s*$", 1)
    return F.when(found != "", F.upper(found))


def without_gloss(name: Column) -> Column:
    return F.regexp_replace(name, r"\s*\(([A-Z][A-Za-z0-9\-]{1,9})s?\)\s*$", "")


def confidence(raw: Column) -> Column:
    """A double in [0, 1]; what is no number counts 0.5."""
    return F.least(F.greatest(F.coalesce(raw.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def flat_attrs(raw: Column) -> Column:
    """A JSON object as map<string,string>; anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(raw, "map<string,string>"), empty)


def bare_paper(ref: Column) -> Column:
    return F.regexp_replace(ref, "^paper:", "")


def staged_id(prefix: str, text: Column) -> Column:
    """Content-addressed id of a staged node."""
    return F.concat(F.lit(f"staged:{prefix}:"), F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 16))


def cited_papers(text: Column, fallback: Column) -> Column:
    """Distinct ``[paper:...]`` references in order, or the fallback list."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(paper:[^\]]+)\]"), F.lit(1))))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def papers_in(text: Column) -> Column:
    """Distinct tokens that hold a colon, after trimming punctuation."""
    bare = F.transform(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+"), lambda x: F.btrim(x, F.lit(".;()[]")))
    return F.array_distinct(F.filter(bare, lambda x: F.instr(x, ":") > 0))


def is_silent(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(SILENT_WORDS)


def token_contained(a: Column, b: Column) -> Column:
    """Either value holds the other as a run of whole tokens; empty values hold nothing."""
    x, y = plain_name(a), plain_name(b)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (x != "") & (y != "") & (F.contains(pad(x), pad(y)) | F.contains(pad(y), pad(x)))


def band_of(value: Column) -> Column:
    """Half-open confidence bands; null outside."""
    return F.when((value >= 0.65) & (value < 0.75), "0.65-0.75").when((value >= 0.75) & (value < 0.85), "0.75-0.85").when((value >= 0.85) & (value < 1.01), "0.85-1.00")


def length_damping(n_chars: Column, reference: int = 800) -> Column:
    """min(1, length / reference); no damping without a positive reference."""
    if reference <= 0:
        return F.lit(1.0)
    return F.least(F.lit(1.0), n_chars / F.lit(float(reference)))


#: Words that search terms leave out.
STOP_WORDS = "the a an of for in on with using based and or to is are be as by from that this it at we our their its can may which such been has have not but they than then between".split()


def search_terms(text: Column) -> Column:
    """``[a-z0-9]+`` of the lower-cased text, over two characters, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def provider_of(model: Column) -> Column:
    """The provider whose model names start so; null for unknown ones."""
    return F.when(model.startswith("claude-"), "anthropic").when(model.startswith("gpt-") | model.rlike("^o[134]"), "openai")
