"""Symbols, call graph, file summary and index statistics (UDF-1..9; AGG-9, 10, 13, 17; JOIN-10, 11).

Python is parsed exactly. The other languages are read by line patterns: declarations are found, nesting is approximate.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths, text

SYMBOL_COLUMNS = ["symbol_id", "file", "type", "name", "line", "signature", "docstring", "called_by"]
SYMBOL_SCHEMA = "symbol_id string, file string, type string, name string, line int, signature string, docstring string, called_by array<string>"

#: Declarations by language: (symbol type, expression with the name as group 1), first match wins.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
        ("method", r"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::[^={]+)?\{\s*$"),
    ],
    "java": [
        ("class", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
        ("method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s+)?[\w<>\[\],.? ]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{?\s*$"),
    ],
    "go": [
        ("method", r"^func\s+\([^)]*\)\s+([A-Za-z_]\w*)\s*\("),
        ("function", r"^func\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\("),
        ("struct", r"^type\s+([A-Za-z_]\w*)\s+struct\b"),
        ("interface", r"^type\s+([A-Za-z_]\w*)\s+interface\b"),
    ],
    "objective-c": [
        ("class", r"^@(?:interface|implementation)\s+([A-Za-z_]\w*)"),
        ("method", r"^\s*[-+]\s*\([^)]*\)\s*([A-Za-z_]\w*)"),
        ("function", r"^(?:static\s+|inline\s+)*[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*\{"),
    ],
    "zig": [
        ("function", r"^\s*(?:pub\s+)?(?:export\s+|inline\s+)*fn\s+([A-Za-z_]\w*)\s*\("),
        ("struct", r"^\s*(?:pub\s+)?const\s+([A-Za-z_]\w*)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)\b"),
        ("enum", r"^\s*(?:pub\s+)?const\s+([A-Za-z_]\w*)\s*=\s*enum\b"),
    ],
}
DECLARATIONS["typescript"] = [("interface", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"), *DECLARATIONS["javascript"]]
DOCUMENT_LANGUAGES = ("markdown", "text", "restructuredtext", "yaml", "json", "toml", "xml", "html")


def python_symbols(path: str, source: str) -> list[tuple]:
    """Functions, classes and methods of a Python file; ``called_by`` names callers in the same file.

    A call resolves to what its name meant last among the symbols met before it: a method is known by its own name, too, and
    hides an earlier function of that name. Coroutines, and functions inside methods, are no symbols; classes have no callers.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: dict[str, dict] = {}
    meant: dict[str, dict] = {}

    def add(name: str, kind: str, node, signature: str | None) -> str:
        key = f"{path}::{name}"
        found[key] = {"type": kind, "name": name, "line": node.lineno, "signature": signature, "docstring": ast.get_docstring(node), "called_by": []}
        meant[name] = meant[name.rsplit(".", 1)[-1]] = found[key]
        return key

    def resolve(call: str, caller: str) -> None:
        target = meant.get(call)
        if target is not None and target["type"] != "class" and caller not in target["called_by"]:
            target["called_by"].append(caller)

    def calls(node, caller: str) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    resolve(name, caller)

    def signature(n) -> str:
        return f"def {n.name}({', '.join([a.arg for a in n.args.args] + (['*' + n.args.vararg.arg] if n.args.vararg else []) + (['**' + n.args.kwarg.arg] if n.args.kwarg else []))}):"

    def visit(body, owner: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                add(n.name, "class", n, None)
                visit(n.body, n.name)
            elif isinstance(n, ast.FunctionDef):
                key = add(f"{owner}.{n.name}" if owner else n.name, "method" if owner else "function", n, signature(n))
                calls(n, key)
                if not owner:
                    visit(n.body, None)

    visit(tree.body, None)
    return [(k, path, s["type"], s["name"], s["line"], s["signature"], s["docstring"], s["called_by"]) for k, s in found.items()]


_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*(?:`|$)", re.S)


def quiet(source: str) -> str:
    """The source with comments and literals blanked; lines keep their number, and their length."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), source)


def declared_symbols(path: str, source: str, language: str) -> list[tuple]:
    """Symbols of a non-Python file by line patterns, with callers by exact callee name; ids carry the full path.

    Brackets are counted outside comments and literals: a type owns the methods inside its braces, and a function the calls
    inside its own, however deep they are nested. Objective-C types end at @end.
    """
    rules = [(k, re.compile(rx)) for k, rx in DECLARATIONS[language]]
    call = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\(")
    rows: dict[str, list] = {}
    uses: list[tuple[str, str]] = []
    depth = 0
    owners: list[tuple[int, str]] = []  # types and functions that are open, with the depth they stand at
    inside: list[tuple[int, str]] = []
    plain = source.splitlines()
    blank = quiet("\n".join(plain)).split("\n")
    for no, (line, code) in enumerate(zip(plain, blank), 1):
        owner = owners[-1][1] if owners else None
        hit = None if not code.strip() else next(((k, m) for k, rx in rules if (m := rx.match(line))), None)
        if hit:
            kind, m = hit
            name = m.group(1)
            is_type = kind in ("class", "struct", "interface", "enum")
            full = f"{owner}.{name}" if kind == "method" and owner and language != "go" else name
            key = f"{path}::{full}"
            rows.setdefault(key, [key, path, kind, full, no, line.strip() if kind in ("function", "method") else None, None, []])
            if is_type:
                owners.append((depth, name))
            else:
                inside.append((depth, key))
            rest = " " * m.end() + code[m.end() :]
        else:
            rest = code
        if inside:
            uses += [(inside[-1][1], c) for c in call.findall(rest)]
        opened = "{" in code
        depth = max(0, depth + code.count("{") - code.count("}"))
        ended = code.strip().startswith("@end")
        if "}" in code or ";" in code and hit and not opened:  # what stands no deeper than its own line has ended
            inside = [x for x in inside if x[0] < depth]
            if language != "objective-c":
                owners = [x for x in owners if x[0] < depth]
        if ended:
            owners, inside, depth = [], [], 0
    by_name: dict[str, list[str]] = {}
    for key, r in rows.items():
        by_name.setdefault(r[3].rsplit(".", 1)[-1], []).append(key)
    for caller, callee in uses:
        for key in by_name.get(callee, [])[:1]:
            if rows[key][2] != "class" and key != caller and caller not in rows[key][7]:
                rows[key][7].append(caller)
    return [tuple(r) for r in rows.values()]


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, content) files, one row each; documents are one symbol of type file, unknown files none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, lang, body in zip(batch["path"], batch["language"], batch["content"]):
                if lang == "python":
                    rows += python_symbols(path, body)
                elif lang in DECLARATIONS:
                    rows += declared_symbols(path, body, lang)
                elif lang in DOCUMENT_LANGUAGES:
                    base = path.rsplit("/", 1)[-1]
                    rows.append((f"{path}::{base}", path, "file", base, 1, None, None, []))
            if rows:
                yield pd.DataFrame(rows, columns=SYMBOL_COLUMNS)

    return files.where("content is not null").select("path", paths.language(F.col("path")).alias("language"), "content").mapInPandas(run, SYMBOL_SCHEMA)


def calls(syms: DataFrame) -> DataFrame:
    """The call graph as edges (caller, callee)."""
    return syms.select(F.explode("called_by").alias("caller"), F.col("symbol_id").alias("callee")).distinct()


def file_summary(syms: DataFrame) -> DataFrame:
    """Per file, its functions, classes and methods in line order; other types are left out and not counted."""
    kept = syms.where(F.col("type").isin("function", "class", "method"))

    def bucket(kind: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("line", "name"))))
        return F.transform(rows, lambda r: r["name"])

    return kept.groupBy("file").agg(F.count("*").alias("symbol_count"), bucket("function").alias("functions"), bucket("class").alias("classes"), bucket("method").alias("methods"))


def index_stats(files: DataFrame, syms: DataFrame) -> DataFrame:
    """One row: files, symbols, sorted languages, files of parsed and of other languages."""
    lang = paths.language(F.col("path"))
    f = files.agg(F.count("*").alias("n_files"), F.array_sort(F.collect_set(lang)).alias("languages"), F.count_if(lang.isin("python", *DECLARATIONS)).alias("parsed_files"))
    return f.crossJoin(syms.agg(F.count("*").alias("n_symbols"))).withColumn("other_files", F.col("n_files") - F.col("parsed_files"))


def type_counts(syms: DataFrame) -> DataFrame:
    return syms.groupBy("type").agg(F.count("*").alias("n"))


#: Import, export and package statements by language: expressions with the name (or the statement) as group 1.
STATEMENTS = {
    "javascript": {"imports": r"(?m)^\s*(import\b[^;{\n]*(?:\{[^}]*\}[^;\n]*)?;?)|(?:=|^|\s)(require\(\s*['\"][^'\"]+['\"]\s*\))", "exports": r"(?m)^\s*(export\b[^\n]*)"},
    "java": {"imports": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "package": r"(?m)^\s*package\s+([\w.]+)\s*;"},
    "go": {"imports": r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", "package": r"(?m)^package\s+(\w+)"},
    "objective-c": {"imports": r"(?m)^\s*#import\s+[<\"]([^>\"]+)[>\"]"},
    "zig": {"imports": r"@import\(\"([^\"]+)\"\)"},
}
STATEMENTS["typescript"] = STATEMENTS["javascript"]
_GO_BLOCK = r"(?m)^import\s*\(([^)]*)\)"


def python_imports(sources: pd.Series) -> pd.Series:
    """Imported names in the order met, ``module.name`` for those taken from a module; none where the source does not parse."""

    def one(body: str | None) -> list[str]:
        try:
            tree = ast.parse(body or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
        out: list[str] = []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out += [a.name for a in n.names]
            elif isinstance(n, ast.ImportFrom) and n.module:
                out += [f"{n.module}.{a.name}" for a in n.names]
        return out

    return pd.Series([one(b) for b in sources], dtype=object)


def file_details(files: DataFrame) -> DataFrame:
    """(path, language, line_count, imports, exports, package) of (path, content) files.

    Python imports come from its own parser; the other languages' statements are found in the JVM. JavaScript and TypeScript
    give whole statements, the others names. Languages without such statements have empty lists and no package.
    """
    lang = paths.parser_language(F.col("path"))
    none = F.array().cast("array<string>")

    def of(what: str) -> Column:
        out = F.when(F.lit(False), none)
        for name, rules in STATEMENTS.items():
            if what in rules:
                got = F.regexp_extract_all("content", F.lit(rules[what]), 1)
                if name == "go":
                    got = F.concat(got, F.regexp_extract_all(F.regexp_extract("content", _GO_BLOCK, 1), F.lit(r"\"([^\"]+)\""), 1))
                elif name in ("javascript", "typescript") and what == "imports":
                    got = F.concat(got, F.regexp_extract_all("content", F.lit(rules[what]), 2))
                out = out.when(F.col("language") == name, F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x != ""))
        return out

    f = files.select("path", lang.alias("language"), "content")
    first = F.get(of("package"), F.lit(0))
    parsed = F.pandas_udf(python_imports, "array<string>")(F.when(F.col("language") == "python", F.col("content")))
    return f.select(
        "path", "language", F.coalesce(text.line_count(F.col("content")), F.lit(0)).alias("line_count"),
        F.when(F.col("language") == "python", parsed).otherwise(F.coalesce(of("imports"), none)).alias("imports"), F.coalesce(of("exports"), none).alias("exports"), first.alias("package"),
    )


def parsing_statistics() -> dict:
    """Which languages and extensions have a parser, which a fallback, and the extensions of each."""
    parsers: dict[str, list[str]] = {}
    for ext, name in paths.PARSER_LANGUAGES.items():
        parsers.setdefault(name, []).append(ext)
    fallback = {name: exts.split() for name, exts in paths.FALLBACK_EXTENSIONS.items()}
    n = sum(map(len, fallback.values()))
    return {
        "total_strategies": len(parsers) + len(fallback), "specialized_languages": list(parsers), "fallback_languages": list(fallback), "total_extensions": len(paths.PARSER_LANGUAGES) + n,
        "specialized_extensions": len(paths.PARSER_LANGUAGES), "fallback_extensions": n, "strategy_details": parsers | {f"fallback_{k}": v for k, v in fallback.items()},
    }


def rebuild_status(root: str | None, files: DataFrame | None, syms: DataFrame | None) -> dict:
    """not_initialized without a root, needs_rebuild without an index, else ready; with the index statistics."""
    if not root:
        return {"status": "not_initialized", "message": "Project not initialized", "is_rebuilding": False}
    if files is None or syms is None:
        return {"status": "needs_rebuild", "index_available": False, "is_rebuilding": False, "project_path": root, "file_count": 0, "total_symbols": 0, "symbol_types": {}, "languages": []}
    s = index_stats(files, syms).collect()[0]
    kinds = {r.type: r.n for r in type_counts(syms).collect()}
    return {"status": "ready", "index_available": True, "is_rebuilding": False, "project_path": root, "file_count": s.n_files, "total_symbols": s.n_symbols, "symbol_types": kinds, "languages": s.languages}


def file_info(files: DataFrame) -> DataFrame:
    """(path, language, line_count)."""
    return files.select("path", paths.language(F.col("path")).alias("language"), F.coalesce(text.line_count(F.col("content")), F.lit(0)).alias("line_count"))
