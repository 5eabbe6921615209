"""Line search over text collections (FIL-1..6, 17, 18; WIN-3; D7)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths, text


def line_array(content: str) -> Column:
    """The lines of a text column: they end at "\\n", a trailing "\\r" is cut off."""
    body = F.when(F.col(content).endswith("\n"), F.expr(f"substring({content}, 1, length({content}) - 1)")).otherwise(F.col(content))
    return F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no from 1, line); null and empty contents give no row."""
    rows = files.where(F.col(content).isNotNull() & (F.col(content) != "")).select(F.col(path).alias("path"), F.posexplode(line_array(content)).alias("pos", "line"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def predicate(line: Column, pattern: str, case_sensitive: bool = True, fuzzy: bool = False, regex: bool | None = None) -> Column:
    """The line test of a search: literal, word boundary or regular expression; regex None lets the pattern decide."""
    as_regex = text.looks_like_regex(pattern) if regex is None else regex
    text.validate_search(pattern, as_regex)
    if not as_regex and not fuzzy:  # no expression engine for plain text
        return line.contains(pattern) if case_sensitive else F.lower(line).contains(pattern.lower())
    rx = pattern if as_regex else text.word_boundary(pattern)
    return line.rlike(rx if case_sensitive else f"(?iu){rx}")


def search(files: DataFrame, pattern: str, case_sensitive: bool = True, context_lines: int = 0, file_pattern: str | None = None, fuzzy: bool = False, regex: bool | None = None, max_line_length: int | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no, line[, is_match]): hits, with merged context windows where asked for. ValueError for a bad pattern.

    A plain pattern, and an expression without look-arounds, is also tested on the whole text first, so files without it are never split into lines.
    """
    rx = text.looks_like_regex(pattern) if regex is None else regex
    src = files.where(paths.file_pattern(F.col(path), file_pattern))
    if rx and not re.search(r"\(\?|\\[AzZG]|[*+?}]\+", pattern):
        # without look-arounds and possessive repeats, a match in a line is one in the whole text, line by line
        src = src.where(F.col(content).rlike(f"(?m{'' if case_sensitive else 'iu'})(?:{pattern})"))
    elif not rx and not fuzzy:
        src = src.where(predicate(F.col(content), pattern, case_sensitive, fuzzy, regex))
    out = text.truncate(F.col("line"), max_line_length).alias("line")
    if context_lines <= 0:
        return lines(src, path, content).where(predicate(F.col("line"), pattern, case_sensitive, fuzzy, regex)).select("path", "line_no", out)
    # the lines of a text are in one row already: mark the hits in the array and look around them, nothing is shuffled
    whole = src.where(F.col(content).isNotNull() & (F.col(content) != "")).select(F.col(path).alias("path"), line_array(content).alias("ls"))
    marked = whole.withColumn("hits", F.transform("ls", lambda x: F.coalesce(predicate(x, pattern, case_sensitive, fuzzy, regex), F.lit(False)))).where(F.exists("hits", lambda h: h))
    rows = marked.select("path", "hits", F.posexplode("ls").alias("pos", "line"))
    first = F.greatest(F.col("pos") + 1 - context_lines, F.lit(1))
    near = F.array_contains(F.slice("hits", first, F.col("pos") + 2 + context_lines - first), True)
    return rows.where(near).select("path", (F.col("pos") + 1).alias("line_no"), out, F.get("hits", F.col("pos")).alias("is_match"))


def approximate(files: DataFrame, word: str, distance: int = 1, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no, line) of lines that hold a token within an edit distance of the word, ignoring case."""
    tokens = F.filter(F.split(F.lower("line"), r"[^\p{L}\p{N}_]+"), lambda t: (t != "") & (F.abs(F.length(t) - len(word)) <= distance))
    return lines(files, path, content).where(F.exists(tokens, lambda t: F.levenshtein(t, F.lit(word.lower())) <= distance))


def hits_per_file(hits: DataFrame) -> DataFrame:
    """(path, n_hits, first_line, last_line)."""
    return hits.groupBy("path").agg(F.count("*").alias("n_hits"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def grouped(hits: DataFrame) -> DataFrame:
    """(path, matches): the nested form, an array of (line_no, line) in line order."""
    return hits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("matches"))


def tool_output(raw: DataFrame, column: str = "value") -> DataFrame:
    """(path, line_no, line) of ``path:line:text`` and ``path-line-text`` output; a leading ``./`` is cut off."""
    rx = r"^(?:\./)?(.+?)[:-](\d+)[:-](.*)$"
    ok = raw.where(F.col(column).rlike(rx))
    return ok.select(F.regexp_extract(column, rx, 1).alias("path"), F.regexp_extract(column, rx, 2).cast("int").alias("line_no"), F.regexp_extract(column, rx, 3).alias("line"))


def all_of(conditions: list[Column]) -> Column:
    """Optional filters: the given ones joined by AND, true for none."""
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def is_plain_suffix(pattern: str) -> bool:
    return bool(re.fullmatch(r"\*\.[^*?\[\]]+", pattern))
