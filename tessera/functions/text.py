"""Lines, validation, templates and small scalar functions (FN-1, 2, 7, 17, 19, 23; FIL-4, 5, 18, 26)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line separator of Python's str.splitlines.
SEPARATORS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
TRUNCATED = "... (truncated)"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final separator adds none, empty text has none."""
    parts = F.split(text, SEPARATORS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(split_lines(text))


def truncate(line: Column, limit: int | None) -> Column:
    if limit is None:
        return line
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit(TRUNCATED))).otherwise(line)


def looks_like_regex(pattern: str) -> bool:
    """The auto-detection table: groups, classes, anchors and alternatives are expressions unless a nested repeat shows;
    a lone quantifier is one only in a few usual shapes."""
    if any(bad in pattern for bad in ("(.+)+", "(.*)*", "(.{0,})+")):
        return False
    if re.search(r"[|()\[\]^$]", pattern):
        return True
    return bool(re.search(r"[.*+?]", pattern) and re.search(r"\.\*|\.\+|\.\w\*|\*\.|\w\.\*", pattern))


def validate_search(pattern: str, regex: bool) -> str:
    """The pattern, or ValueError: empty, not compilable, or a repeat around a look-around or repeat."""
    if not pattern or not pattern.strip():
        raise ValueError("the search pattern is empty")
    if regex:
        if re.search(r"\((?:\?[=!<][^)]*|[^()]*[*+])\)[*+]", pattern):
            raise ValueError(f"the expression may take exponential time: {pattern}")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"not a regular expression: {e}") from e
    return pattern


def validate_glob(pattern: str) -> str:
    if not pattern or pattern.startswith(("/", "\\")) or ".." in pattern.split("/"):
        raise ValueError(f"not a glob inside the project: {pattern!r}")
    return pattern


def word_boundary(pattern: str) -> str:
    """A word that begins or ends with the text, or for fewer than three characters is the text."""
    p = re.escape(pattern)
    return rf"\b{p}|{p}\b" if len(pattern) >= 3 else rf"\b{p}\b"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def index_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def embedding_text(path: Column, language: Column, chunk_type: Column, name: Column, docstring: Column, imports: Column, content: Column) -> Column:
    """The text that is embedded for a chunk; absent and empty parts are skipped."""
    kind = F.concat(F.upper(F.substring(chunk_type, 1, 1)), F.lower(F.substring(chunk_type, 2, 1_000_000)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        F.concat(F.lit("Language: "), language),
        F.when(name != "", F.concat(kind, F.lit(": "), name)),
        F.when(docstring != "", F.concat(F.lit("Description: "), docstring)),
        F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "), F.array_join(F.slice(imports, 1, 5), ", "))),
        F.lit("\nCode:"),
        content,
    )


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def vector_literal(vector: Column) -> Column:
    """``[x,y,...]``, the text form of a vector column."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def api_key(key: Column, prefix: str = "ci_") -> Column:
    """Whether a key has the form of an issued one; null is none."""
    return F.coalesce(key.startswith(prefix), F.lit(False))


def bearer(header: Column) -> Column:
    """The token of an Authorization header, null for another kind."""
    return F.when(header.startswith("Bearer "), F.trim(F.substring(header, 8, 1_000_000)))


def seconds_between(start: Column, end: Column) -> Column:
    """Duration in seconds, null while one end is missing."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters start (from 0) to end of a text, trimmed; empty where the range lies outside."""
    return F.trim(F.substring(F.coalesce(text, F.lit("")), F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0))))


def line_range(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))
