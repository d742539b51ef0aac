"""Text functions of ingestion: normalisation, keys, abstracts, tokens, markup."""

from __future__ import annotations

import html

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word in Java, RE2 and Python alike; their own \w differ outside ASCII.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-cased words of at least ``least`` characters; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """HTML entities as characters: Spark has no function for it."""
    return text.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def normalize_block(text: Column) -> Column:
    """Null as empty, NBSP and control characters as spaces, blanks collapsed, at most one empty line, stripped."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(text, F.lit(" \t\n\r"))


def normalize_text(text: Column) -> Column:
    """``normalize_block`` after HTML entities are resolved."""
    return normalize_block(unescape_html(text))


def clean_text(text: Column) -> Column:
    """Control characters and all runs of white space as one space, stripped."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x20\x7f ]+", " "))


def short_abstract(text: Column, limit: int = 300) -> Column:
    """A text over ``limit`` as its first limit-1 characters, right-stripped, and three dots."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("..."))).otherwise(text)


def truncate_middle(text: Column, limit: int, marker: str = "\n...\n") -> Column:
    """A text over ``limit`` as 70 % head and the rest tail around a marker."""
    room = max(0, limit - len(marker))
    head = int(room * 0.7)
    tail = room - head
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


def document_key(name: Column) -> Column:
    """A file name as a key: no ``.pdf``, runs of other characters as one underscore, never empty."""
    base = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.btrim(base, F.lit("._")), F.lit("")), F.lit("document"))


def slug(text: Column, size: int = 120) -> Column:
    """Runs of other characters as one underscore; the last ``size`` characters."""
    return F.right(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit(size))


def escape_xml(text: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quote else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_block(tag: str, text: Column, **attributes: Column) -> Column:
    """An element with escaped text and attributes."""
    if not tag.replace("_", "a").replace("-", "a").isalnum() or tag[0].isdigit():
        raise ValueError(f"not a tag: {tag}")
    attrs = [x for k, v in attributes.items() for x in (F.lit(f' {k}="'), escape_xml(v.cast("string"), True), F.lit('"'))]
    return F.concat(F.lit(f"<{tag}"), *attrs, F.lit(">"), escape_xml(text), F.lit(f"</{tag}>"))


def cdata(text: Column) -> Column:
    """A CDATA section; its end mark inside the text is divided between two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def occurrences(text: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a term that isn't empty."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def page_numbers(names: Column) -> Column:
    """Numbers of ``..._<n>.<ext>`` image names, distinct, in the order first seen; others are skipped."""
    found = F.transform(names, lambda n: F.regexp_extract(n, r"_(\d+)\.[A-Za-z0-9]+$", 1))
    return F.array_distinct(F.transform(F.filter(found, lambda s: s != ""), lambda s: s.cast("int")))


#: Fixed value: what stands for the middle that was cut out of a prompt.
PROMPT_MARKER = "\n...[truncated to fit context window]...\n"


def cut_middle(text: str, limit: int, marker: str = PROMPT_MARKER) -> str:
    """At most ``limit`` characters: 70 % of what the marker leaves from the start and the rest from the end; a limit
    that has no room for the marker gives the start alone."""
    if limit >= len(text):
        return text
    if limit <= len(marker) + 2:
        return text[: max(0, limit)]
    room = limit - len(marker)
    head = max(1, int(room * 0.7))
    return text[:head].rstrip() + marker + text[-max(1, room - head) :].lstrip()


def longest_fit(text: str, budget: int, pattern: str = r"\w+|[^\w\s]", marker: str = PROMPT_MARKER) -> tuple[str, int]:
    """The longest cut of a text with at most ``budget`` tokens (matches of the pattern), and its number of tokens.

    The text is cut into tokens once; the tokens of a head or a tail are known from the places where tokens start and end, so a step of the
    search takes two lookups instead of a count of the whole text.
    """
    import re
    from bisect import bisect_left, bisect_right

    found = [m.span() for m in re.finditer(pattern, text)]
    if len(found) <= budget:
        return text, len(found)
    starts, ends = [a for a, _ in found], [b for _, b in found]
    between = len(re.findall(pattern, marker))

    def tokens(limit: int) -> int:
        if limit >= len(text):
            return len(found)
        if limit <= len(marker) + 2:
            return bisect_left(starts, max(0, limit))
        room = limit - len(marker)
        head = max(1, int(room * 0.7))
        return bisect_left(starts, head) + between + len(ends) - bisect_right(ends, len(text) - max(1, room - head))

    low, high, best = 0, len(text), 0
    while low <= high:
        middle = (low + high) // 2
        if tokens(middle) <= budget:
            best, low = middle, middle + 1
        else:
            high = middle - 1
    return cut_middle(text, best, marker), tokens(best)


@F.arrow_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("truncated", T.BooleanType())]))
def fitted_prompt(text: pa.Array, budget: pa.Array) -> pa.Array:
    """``longest_fit`` of each text to its budget; null stays null. One text at a time is a Python object."""
    columns: tuple[list, list, list] = ([], [], [])
    for t, b in zip(text, budget, strict=True):
        whole, room = t.as_py(), b.as_py()
        content, n = (None, None) if whole is None or room is None else longest_fit(whole, max(0, int(room)))
        for column, value in zip(columns, (content, n, None if whole is None else content != whole), strict=True):
            column.append(value)
    return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_())], names=["content", "n_tokens", "truncated"])
