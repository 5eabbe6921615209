"""Path algebra as Column expressions, glob compilers and extension tables (FIL-7..16, 20, 28; FN-3..6, 15, 20, 21)."""

from __future__ import annotations

import mimetypes
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, file patterns, extensions and languages that decide what is indexed.
EXCLUDED_DIRECTORIES = (
    ".git", ".svn", ".hg", ".bzr", "node_modules", "__pycache__", ".venv", "venv", "vendor", "bower_components", "dist", "build", "target", "out", "bin", "obj",
    ".idea", ".vscode", ".vs", ".sublime-workspace", ".pytest_cache", ".coverage", ".tox", ".nyc_output", "coverage", "htmlcov", ".DS_Store", "Thumbs.db", "desktop.ini",
)
EXCLUDED_FILES = ("*.tmp", "*.temp", "*.swp", "*.swo", "*.bak", "*~", "*.orig", "*.log", "package-lock.json", "yarn.lock", "Pipfile.lock")
SUPPORTED_EXTENSIONS = (
    ".py", ".pyw", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".c", ".cpp", ".h", ".hpp", ".cxx", ".cc", ".hxx", ".hh", ".cs", ".go", ".m", ".mm", ".rb", ".php", ".swift",
    ".kt", ".kts", ".rs", ".scala", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".r", ".R", ".pl", ".pm", ".lua", ".dart", ".hs", ".ml", ".mli", ".fs", ".fsx", ".clj", ".cljs", ".vim",
    ".zig", ".zon", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".stylus", ".styl", ".md", ".mdx", ".json", ".jsonc", ".xml", ".yml", ".yaml", ".vue", ".svelte", ".astro", ".hbs",
    ".handlebars", ".ejs", ".pug", ".sql", ".ddl", ".dml", ".mysql", ".postgresql", ".psql", ".sqlite", ".mssql", ".oracle", ".ora", ".db2", ".proc", ".procedure", ".func", ".function",
    ".view", ".trigger", ".index", ".migration", ".seed", ".fixture", ".schema", ".cql", ".cypher", ".sparql", ".gql", ".liquibase", ".flyway",
)
CHUNK_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".m": "objective-c", ".zig": "zig", ".md": "markdown", ".txt": "text", ".rst": "restructuredtext", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
}
#: Languages of the file tools.
FILE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".hxx": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".m": "objc", ".mm": "objc", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss",
    ".sass": "sass", ".less": "less", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".txt": "text", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell", ".ps1": "powershell",
    ".bat": "batch", ".cmd": "batch",
}
#: Extensions with a parser of their own.
PARSER_LANGUAGES = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".m": "objective-c", ".mm": "objective-c",
    ".zig": "zig", ".zon": "zig",
}
#: Languages of the files without one, by language.
FALLBACK_EXTENSIONS = {
    "html": ".html .htm", "css": ".css .scss .sass .less .stylus .styl", "markdown": ".md .mdx", "json": ".json .jsonc", "xml": ".xml", "yaml": ".yml .yaml", "vue": ".vue", "svelte": ".svelte", "astro": ".astro",
    "handlebars": ".hbs .handlebars", "ejs": ".ejs", "pug": ".pug",
    "sql": ".sql .ddl .dml .mysql .postgresql .psql .sqlite .mssql .oracle .ora .db2 .proc .procedure .func .function .view .trigger .index .migration .seed .fixture .schema .cql .cypher .sparql .liquibase .flyway",
    "graphql": ".gql", "text": ".txt", "config": ".ini .cfg .conf .toml .properties .env .gitignore .dockerignore .editorconfig", "c": ".c", "cpp": ".cpp .cxx .cc", "h": ".h", "hpp": ".hpp .hxx .hh", "csharp": ".cs", "ruby": ".rb",
    "php": ".php", "swift": ".swift", "kotlin": ".kt .kts", "rust": ".rs", "scala": ".scala", "shell": ".sh .bash .zsh", "powershell": ".ps1", "batch": ".bat .cmd", "r": ".r .R", "perl": ".pl .pm", "lua": ".lua", "dart": ".dart",
    "haskell": ".hs", "ocaml": ".ml .mli", "fsharp": ".fs .fsx", "clojure": ".clj .cljs", "vim": ".vim",
}
INGEST_PATTERNS = ("*.py", "*.js", "*.ts", "*.java", "*.go")
SIZE_LIMITS = ((1024, "tiny"), (10 * 1024, "small"), (100 * 1024, "medium"), (1024 * 1024, "large"))


def any_of(conditions: list[Column]) -> Column:
    """Disjunction; false for an empty list."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def normalise(path: Column) -> Column:
    """Slashes for backslashes, no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Directory of a path, empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def glob_regex(pattern: str) -> str:
    """Anchored expression of a glob over whole paths: ``*`` stays inside a component, ``**`` crosses, ``?`` is one character.

    Everything else is literal, brackets too.
    """
    out = []
    for piece in re.split(r"(\*\*|\*|\?)", pattern):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece)))
    return "^" + "".join(out) + "$"


def fnmatch_regex(pattern: str) -> str:
    """Anchored expression of a shell pattern in which ``*`` and ``?`` cross slashes and ``[...]`` is a class."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    """find_files: a lone ``*`` takes everything."""
    return F.lit(True) if pattern == "*" else path.rlike(glob_regex(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Some pattern fits the whole path or the plain name; no pattern fits nothing."""
    return any_of([path.rlike(fnmatch_regex(p)) | basename(path).rlike(fnmatch_regex(p)) for p in patterns])


def file_pattern(path: Column, pattern: str | None) -> Column:
    """Search filter on the plain name: ``*.ext`` as a suffix test, else a shell pattern; none takes all."""
    if not pattern:
        return F.lit(True)
    if re.fullmatch(r"\*\.[^*?\[\]]+", pattern):
        return basename(path).endswith(pattern[1:])
    return basename(path).rlike(fnmatch_regex(pattern))


def excluded_directory(name: Column, extra: tuple[str, ...] = ()) -> Column:
    hidden = name.startswith(".") & ~name.isin(".env", ".gitignore")
    return hidden | name.isin(*EXCLUDED_DIRECTORIES, *extra)


def excluded_file(path: Column) -> Column:
    name = basename(path)
    return ~supported(path) | (name.startswith(".") & ~name.isin(".env", ".gitignore")) | any_of([name.rlike(fnmatch_regex(p)) for p in EXCLUDED_FILES])


def admitted(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Every directory and the file itself pass; absolute and climbing paths don't."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: excluded_directory(d, extra)) & ~excluded_file(path) & ~path.startswith("/") & ~F.array_contains(dirs, "..")


def temporary(path: Column) -> Column:
    return basename(path).rlike(r"(\.(tmp|temp|swp|swo|bak|orig)|~)$")


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """A small fixed table as a map literal."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def language(path: Column) -> Column:
    return lookup(extension(path), CHUNK_LANGUAGES, "unknown")


def file_language(path: Column) -> Column:
    """The language the file tools name."""
    return lookup(extension(path), FILE_LANGUAGES, "unknown")


def parser_language(path: Column) -> Column:
    """The language whose parser reads the file, else its fallback language, else unknown."""
    fallback = {e: name for name, all_ in FALLBACK_EXTENSIONS.items() for e in all_.split()}
    return lookup(extension(path), fallback | PARSER_LANGUAGES, "unknown")


def supported(path: Column) -> Column:
    """The lower-cased extension is one of the supported ones, nothing else counts."""
    return extension(path).isin(*sorted({e.lower() for e in SUPPORTED_EXTENSIONS}))


def of_language(language: Column, names: list[str]) -> Column:
    """Membership ignoring case; an empty list takes all."""
    return F.lower(language).isin(*[n.lower() for n in names]) if names else F.lit(True)


def in_directories(path: Column, patterns: list[str]) -> Column:
    """Some shell pattern fits the parent directory ("." at the root); an empty list takes all."""
    folder = F.when(parent(path) == "", ".").otherwise(parent(path))
    return any_of([folder.rlike(fnmatch_regex(p)) for p in patterns]) if patterns else F.lit(True)


def not_matching(path: Column, patterns: list[str]) -> Column:
    """No pattern fits the whole path or the plain name."""
    return ~matches_any(path, patterns)


def content_type(path: Column) -> Column:
    """Media type by extension from Python's own table, application/octet-stream for the rest."""
    known = {e.lower(): t for e in (*SUPPORTED_EXTENSIONS, *FILE_LANGUAGES) if (t := mimetypes.guess_type(f"x{e}")[0])}
    return lookup(extension(path), known, "application/octet-stream")


def namespaced(path: Column, user: Column, project: Column) -> Column:
    """users/{user}/{project}/{path}; leading slashes of the path are cut off."""
    return F.concat(F.lit("users/"), user, F.lit("/"), project, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def namespace_user(path: Column) -> Column:
    """The user of a namespaced path, null for another path."""
    return F.when(path.rlike("^users/[^/]+"), F.split(path, "/")[1])


def exclude_summary(extra: tuple[str, ...] = ()) -> dict:
    """What the admission rules leave out, sorted, with counts."""
    directories = sorted({*EXCLUDED_DIRECTORIES, *extra})
    return {"exclude_directories_count": len(directories), "exclude_files_count": len(EXCLUDED_FILES), "supported_extensions_count": len(SUPPORTED_EXTENSIONS), "exclude_directories": directories, "exclude_files": sorted(EXCLUDED_FILES)}


def size_category(length: Column) -> Column:
    out = F
    for limit, name in SIZE_LIMITS:
        out = out.when(length < limit, name)
    return out.otherwise("very_large")


def relevance(path: Column, query: str) -> Column:
    """100 for the exact name, 50 for a prefix, 25 for a part, and up to 10 for a shallow path; case counts, and stars of the
    query are left out but for the exact name."""
    name, q = basename(path), query.replace("*", "")
    score = F.when(name == query, 100).when(name.startswith(q), 50).when(name.contains(q), 25).otherwise(0)
    return score + F.greatest(F.lit(0), F.lit(10) - depth(path))


def qualified_name(path: Column, *names: Column) -> Column:
    """a/b.py with names x, y is a.b.x.y."""
    return F.concat_ws(".", F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit(".")), *names)


def rooted(path: Column) -> Column:
    """The path from its first ``test``, else its first ``src`` component, else the plain name."""
    parts = F.split(path, "/")
    at = F.when(F.array_position(parts, "test") > 0, F.array_position(parts, "test")).otherwise(F.array_position(parts, "src"))
    return F.when(at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")).otherwise(basename(path))
