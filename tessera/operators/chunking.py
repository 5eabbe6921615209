"""Chunkers (UDF-10..13, 20..22; WIN-4, 6)."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.session import union_all

MAX_CHUNK_SIZE, OVERLAP_LINES = 8000, 3
CHUNK_COLUMNS = ["file_path", "chunk_type", "chunk_name", "line_start", "line_end", "language", "content", "symbols"]
CHUNK_SCHEMA = "file_path string, chunk_type string, chunk_name string, line_start int, line_end int, language string, content string, symbols string"


def file_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file (path, content): its stem, lines 1..n."""
    n = text.line_count(F.col("content"))
    symbols = F.to_json(F.struct(F.lit("file").alias("type"), paths.basename(F.col("path")).alias("file_name"), n.alias("line_count")))
    cols = [F.col("path").alias("file_path"), F.lit("file").alias("chunk_type"), paths.stem(F.col("path")).alias("chunk_name"), F.lit(1).alias("line_start"), n.alias("line_end"), paths.language(F.col("path")).alias("language"), F.col("content"), symbols.alias("symbols")]
    return files.where("content is not null").select(*cols)


def pack_lines(lines: list[str], limit: int) -> list[tuple[int, int]]:
    """Greedy packing: (first, last) line numbers of the blocks; a line costs its length and one, an over-long line stands alone."""
    out, start, size = [], 1, 0
    for i, line in enumerate(lines, 1):
        cost = len(line) + 1
        if size + cost > limit and i > start:
            out.append((start, i - 1))
            start, size = i, 0
        size += cost
    if lines:
        out.append((start, len(lines)))
    return out


def block_chunks(files: DataFrame, limit: int = MAX_CHUNK_SIZE) -> DataFrame:
    """Whole files up to ``limit`` characters, larger ones as blocks of whole lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, lang, body in zip(batch["path"], batch["language"], batch["content"]):
                ls = body.splitlines()
                for a, b in pack_lines(ls, limit):
                    rows.append((path, "block", f"block_{a}_{b}", a, b, lang, "\n".join(ls[a - 1 : b]), "{}"))
            if rows:
                yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    big = files.where(F.length("content") > limit).select("path", paths.language(F.col("path")).alias("language"), "content")
    return file_chunks(files.where(F.length("content") <= limit)).unionByName(big.mapInPandas(run, CHUNK_SCHEMA))


def sections(files: DataFrame, header: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """Header-delimited sections of texts; text before the first header is the introduction, a text without one is the content.

    The lines of a text stay in its row: headers are found in the array of lines and sections are slices of it, no line is
    shuffled and no text is walked in Python.
    """
    f = files.where("content is not null and content <> ''").select(F.col("path").alias("file_path"), text.split_lines(F.col("content")).alias("ls"))
    # a line starts a section if it is a header or the first
    starts = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(header) | (i == 0), i + 1)), lambda i: i.isNotNull())
    s = f.select("file_path", "ls", starts.alias("starts"))
    s = s.select("file_path", "ls", "starts", F.posexplode("starts").alias("k", "line_start"))
    s = s.withColumn("has", (F.size("starts") > 1) | F.get("ls", F.lit(0)).rlike(header)).withColumns({"line_end": F.coalesce(F.get("starts", F.col("k") + 1) - 1, F.size("ls")), "head": F.get("ls", F.col("line_start") - 1)})
    s = s.withColumn("is_head", F.col("head").rlike(header))
    title = F.when(F.col("is_head"), F.regexp_extract("head", header, 2))
    level = F.when(F.col("is_head"), F.length(F.regexp_extract("head", header, 1))).otherwise(0)
    name = F.when(F.col("is_head"), title).when(F.col("has"), "Introduction").otherwise("Content")
    body = F.array_join(F.slice("ls", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    symbols = F.to_json(F.struct(title.alias("header"), level.alias("level"), F.lit("markdown_section").alias("type")))
    return s.select("file_path", F.lit("section").alias("chunk_type"), name.alias("chunk_name"), "line_start", "line_end", paths.language(F.col("file_path")).alias("language"), body.alias("content"), symbols.alias("symbols"))


def _call_names(node: ast.AST) -> list[str]:
    out = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.add(f.id)
            elif isinstance(f, ast.Attribute):
                out.add(f.attr)
    return sorted(out)


def python_spans(source: str) -> list[tuple[str, str, int, int, dict]]:
    """(chunk_type, name, first line, last line, symbols) of every function and class at any depth, breadth first.

    Coroutines have no chunk; a source that does not parse has none at all.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {f"{n.module}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module for a in n.names})
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef):
            s = {"function_name": n.name, "parameters": [a.arg for a in n.args.args], "decorators": [ast.unparse(d) for d in n.decorator_list], "imports": imports, "docstring": ast.get_docstring(n), "calls": _call_names(n)}
            if n.returns is not None:
                s["return_type"] = ast.unparse(n.returns)
            out.append(("function", n.name, n.lineno, n.end_lineno, s))
        elif isinstance(n, ast.ClassDef):
            methods = [m.name for m in n.body if isinstance(m, ast.FunctionDef)]
            out.append(("class", n.name, n.lineno, n.end_lineno, {"class_name": n.name, "base_classes": [ast.unparse(b) for b in n.bases], "methods": methods, "decorators": [ast.unparse(d) for d in n.decorator_list], "imports": imports, "docstring": ast.get_docstring(n)}))
    return out


def python_chunks(files: DataFrame) -> DataFrame:
    """Function and class chunks of Python files; a file without any (or that does not parse) is one file chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, body in zip(batch["path"], batch["content"]):
                ls = body.splitlines()
                spans = python_spans(body)
                for kind, name, a, b, symbols in spans:
                    rows.append((path, kind, name, a, b, "python", "\n".join(ls[a - 1 : b]), json.dumps(symbols)))
                if not spans:
                    base = path.rsplit("/", 1)[-1]
                    rows.append((path, "file", base.rsplit(".", 1)[0] or base, 1, len(ls), "python", body, json.dumps({"type": "file", "file_name": base, "line_count": len(ls)})))
            if rows:
                yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    return files.where("content is not null").select("path", "content").mapInPandas(run, CHUNK_SCHEMA)


def chunk_files(files: DataFrame, strategy: str = "function") -> DataFrame:
    """Chunks of (path, content) by language: Python by definitions, scripts whole, Markdown by sections, the rest packed.

    ``strategy`` "file" gives one chunk per file.
    """
    if strategy == "file":
        return file_chunks(files)
    lang = paths.language(F.col("path"))
    parts = [
        python_chunks(files.where(lang == "python")),
        file_chunks(files.where(lang.isin("javascript", "typescript"))),
        sections(files.where(lang == "markdown")),
        block_chunks(files.where(~lang.isin("python", "javascript", "typescript", "markdown"))),
    ]
    return union_all([p.select(*CHUNK_COLUMNS) for p in parts]).withColumn("content_hash", text.content_hash(F.col("content")))


def with_overlap(chunks: DataFrame, files: DataFrame, n: int = OVERLAP_LINES) -> DataFrame:
    """``context_before`` and ``context_after``: the n lines around each chunk, null where there are none."""
    ls = files.select(F.col("path").alias("file_path"), text.split_lines(F.col("content")).alias("_lines"))
    before = F.array_join(F.slice("_lines", F.greatest(F.lit(1), F.col("line_start") - n), F.least(F.lit(n), F.col("line_start") - 1)), "\n")
    rest = F.greatest(F.lit(0), F.least(F.lit(n), F.size("_lines") - F.col("line_end")))
    after = F.array_join(F.slice("_lines", F.col("line_end") + 1, rest), "\n")
    j = chunks.join(ls, "file_path")
    return j.withColumns({"context_before": F.when(F.col("line_start") > 1, before), "context_after": F.when(rest > 0, after)}).drop("_lines")
