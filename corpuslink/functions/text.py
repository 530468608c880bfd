"""Column functions on text. A null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_TOKENS = regex.compile(TOKEN_PATTERN.replace(r"\s", " \t\n\x0b\f\r"))  # white space as Spark takes it
HEADING = r"^#{1,6}\s+"


def token_count(text: Column) -> Column:
    """Words and single punctuation marks; the default counter wherever a budget of tokens is meant."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0))


class TokenCounter(NamedTuple):
    """One way to count tokens, for columns and for single strings; both give the same number."""

    column: Callable[[Column], Column]
    plain: Callable[[str], int]


def _count_words(text: str) -> int:
    return len(_TOKENS.findall(text))


WORDS = TokenCounter(token_count, _count_words)


def normalize_text(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case (casefold differs for a few letters such as the sharp s)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def preview(text: Column, n: int = 180) -> Column:
    """White space collapsed; if longer than n, its first n - 1 characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def markdown_preview(text: Column, n: int = 500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def strip_code_fences(text: Column) -> Column:
    """Without a leading ``` or ```json and a trailing ```."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def normalize_markdown(text: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), r"^\s+|\s+$", "")


def is_heading_only(text: Column) -> Column:
    """At least one line that isn't blank, and all of those are headings."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: F.trim(x).rlike(HEADING))


def simple_terms(text: Column) -> Column:
    """The `simple` analyzer: lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


# Frequent English words that a full-text index leaves out.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()


def english_terms(text: Column) -> Column:
    """The `english` analyzer: simple terms without stop words, with common endings taken off."""
    kept = F.filter(simple_terms(text), lambda x: ~x.isin(ENGLISH_STOP_WORDS))
    return F.transform(kept, lambda x: F.when(F.length(x) > 4, F.regexp_replace(x, r"(?:ies|ing|edly|ed|es|ly|s)$", "")).otherwise(x))


ANALYZERS = {"simple": simple_terms, "english": english_terms}


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 if either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def parse_vector(text: Column) -> Column:
    """`[1, 2]` to an array of floats."""
    return F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",").cast("array<float>")
