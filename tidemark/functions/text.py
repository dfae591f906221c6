"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.stopwords import ENGLISH

# The cleaning patterns, in the order they apply.
LINE_BREAKS = r"[\r\n]+"
MARKDOWN_LINK = r"\[(.*?)\]\(.*?\)"
URL = r"http\S+"

# Unicode word characters; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col: Column | str) -> Column:
    """Line breaks to a space, links to their label, URLs dropped, outer spaces trimmed."""
    flat = F.regexp_replace(_c(col), LINE_BREAKS, " ")
    labelled = F.regexp_replace(flat, MARKDOWN_LINK, "$1")
    return F.trim(F.regexp_replace(labelled, URL, ""))


def strip(col: Column | str) -> Column:
    """Remove all outer white space, including tabs and line breaks."""
    return F.regexp_replace(_c(col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normalise_subject(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit("subject"), F.lit(""))


def chunk_from_path(col: Column | str) -> Column:
    """The digits after "chunk" in a path, any case; "Unknown" without them."""
    digits = F.regexp_extract(_c(col), r"(?i)chunk(\d+)", 1)
    return F.when(digits == "", F.lit("Unknown")).otherwise(digits)


def text_length(col: Column | str) -> Column:
    return F.length(_c(col))


def word_count(col: Column | str) -> Column:
    return F.regexp_count(_c(col), F.lit(WORD))


def preview(col: Column | str, length: int = 100, always_dots: bool = False) -> Column:
    """The first characters, with dots when cut (or always, as the cluster plot shows them)."""
    c = _c(col)
    cut = F.concat(F.left(c, F.lit(length)), F.lit("..."))
    return cut if always_dots else F.when(F.length(c) > length, cut).otherwise(c)


def terms(col: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-case tokens of two or more word characters without stop words, in text order."""
    stops = ENGLISH if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(_c(col)), F.lit(TERM), F.lit(0))
    if not stops:
        return found
    return F.filter(found, lambda t: ~t.isin(list(stops)))


def topic_words(name: Column | str) -> Column:
    """The words of a topic name `id_w1_w2_w3`; a name without underscore is its own words."""
    c = _c(name)
    return F.when(F.instr(c, "_") > 0, F.replace(F.regexp_replace(c, "^[^_]*_", ""), F.lit("_"), F.lit(" "))).otherwise(c)


def criterion_label(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit("_"), F.lit(" "))


def two_decimals(col: Column | str) -> Column:
    """A number with two decimals, rounding its exact binary value half to even."""
    return F.call_function("format_number", _c(col), F.lit("0.00"))
