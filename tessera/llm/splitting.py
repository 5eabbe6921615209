"""Problem 5: oversized items cut at natural boundaries, by packing a structure tree.

A text's lines form a tree: in prose, headings by level (underlined ones, too) and below them list items and paragraphs by
indentation; in markup, elements by the nesting of their tags; in code, every line by its indentation, closing brackets with
what they close. The tree is packed from its leaves up: the subtrees of one parent are merged in order while they fit the
limit, and only a subtree that exceeds it is opened; its pieces stay its own, but for a heading or opening line, which goes
with what follows it. A single line that exceeds the limit is cut at the last statement end, else sentence end, else white
space or comma.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, SLACK = 8000, 200, 50
PROSE = ("markdown", "text", "rst")
MARKUP = ("html", "xml", "vue", "svelte", "svg")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_HEADING = re.compile(r"(#{1,6})\s")
_UNDERLINE = re.compile(r"(=|-)\1{2,}$")
_BULLET = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>")
#: Elements without an end; fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUTS = (re.compile(r"[;{}]\s*"), re.compile(r"[.!?]['\")\]]*\s+|[。！？]"), re.compile(r"[\s,]+"))
_DEPTH_BASE = 10


def line_levels(lines: list[str], kind: str) -> list[int | None]:
    """The level of each line; a greater level lies deeper, None joins the line before: blank lines, lines in a code fence, the
    line under an underlined heading, closing brackets."""
    out: list[int | None] = []
    fenced = False
    nested = 0
    for i, line in enumerate(lines):
        bare = line.strip()
        if kind == "prose" and bare.startswith(("```", "~~~")):
            out.append(None if fenced else _DEPTH_BASE)
            fenced = not fenced
        elif not bare or fenced:
            out.append(None)
        elif kind == "markup":
            tags = [m for m in _TAG.finditer(bare) if not m.group(4) and m.group(2).lower() not in _VOID]
            closes = bare.startswith("</")
            out.append(None if closes else _DEPTH_BASE + nested)
            nested = max(0, nested + sum(-1 if m.group(1) else 1 for m in tags))
        elif kind == "prose" and (m := _HEADING.match(bare)):
            out.append(len(m.group(1)))
        elif kind == "prose" and out and out[-1] is not None and out[-1] < _DEPTH_BASE and _UNDERLINE.match(bare):
            out.append(None)
        elif kind == "prose" and i + 1 < len(lines) and (m := _UNDERLINE.match(lines[i + 1].strip())) and not _BULLET.match(line) and (i == 0 or not lines[i - 1].strip()):
            out.append(1 if m.group(1) == "=" else 2)
        elif kind == "code" and bare[0] in "})]" and out:
            out.append(None)
        else:
            indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
            out.append(_DEPTH_BASE + indent + (1 if kind == "prose" and _BULLET.match(line) else 0))
    return out


def build_tree(text: str, kind: str) -> tuple[list[tuple[int, int]], list[int], list[list[int]]]:
    """(spans, ends, children): node i owns its line ``spans[i]`` and the text up to ``ends[i]``; node 0 is the root.

    Nodes are numbered in the order of the text, so children come after their parent.
    """
    lines = _LINE.findall(text)
    levels = line_levels(lines, kind)
    spans, ends, children = [(0, 0)], [len(text)], [[]]
    stack: list[tuple[int, int]] = [(-1, 0)]
    pos = 0
    for line, level in zip(lines, levels):
        if level is None and len(spans) > 1:
            if spans[-1][1] == pos:
                spans[-1] = (spans[-1][0], pos + len(line))
            pos += len(line)
            continue
        level = _DEPTH_BASE if level is None else level
        while stack[-1][0] >= level:
            ends[stack.pop()[1]] = pos
        node = len(spans)
        spans.append((pos, pos + len(line)))
        ends.append(len(text))
        children.append([])
        children[stack[-1][1]].append(node)
        stack.append((level, node))
        pos += len(line)
    while len(stack) > 1:
        ends[stack.pop()[1]] = len(text)
    return spans, ends, children


def cut_line(text: str, lo: int, hi: int, limit: int) -> list[int]:
    """Positions that cut [lo, hi) into parts of at most ``limit``, at the best kind of boundary in each part's second half."""
    out = []
    while hi - lo > limit:
        at = 0
        for rx in _CUTS:
            found = [m.end() for m in rx.finditer(text, lo + limit // 2, lo + limit)]
            if found:
                at = found[-1]
                break
        if not at:
            at = lo + limit
            if text[at - 1] == "\r" and text[at : at + 1] == "\n":
                at -= 1
        out.append(at)
        lo = at
    return out


def cut_points(text: str, kind: str, limit: int) -> list[int]:
    """Increasing end positions of the pieces' own text; the last is ``len(text)``."""
    spans, ends, children = build_tree(text, kind)
    packed: dict[int, list[int]] = {}  # ends of the pieces of each opened node
    for node in range(len(spans) - 1, -1, -1):
        lo, line_end = spans[node]
        if ends[node] - lo <= limit:
            continue
        done: list[int] = []  # ends of closed pieces
        start, end, joins = lo, lo, False  # the open piece, and whether a whole subtree may still join it
        heads = True  # the open piece is the node's own line alone
        if line_end - lo > limit:
            *done, end = cut_line(text, lo, line_end, limit) + [line_end]
            start = done[-1] if done else lo
            joins = True
        elif line_end > lo:
            end, joins = line_end, True
        for child in children[node]:
            inner = packed.pop(child, None)
            for n, to in enumerate(inner or [ends[child]]):
                if end > start and (to - start > limit or not joins or (inner and (n or not heads))):
                    done.append(end)
                    start = end
                end = to
                joins = inner is None
            heads = False
        if end > start:
            done.append(end)
        packed[node] = done
    return packed.get(0, [len(text)] if text else [])


def overlap_start(text: str, end: int, overlap: int = OVERLAP, slack: int = SLACK) -> int:
    """Where the repeated tail of the text before ``end`` begins: a line start near ``overlap`` characters back, else there."""
    want = end - overlap
    if want <= 0:
        return 0
    near = [i + 1 for i in range(max(0, want - slack - 1), min(end, want + slack)) if text[i] == "\n"]
    return min(near, key=lambda p: abs(p - want)) if near else want


def split_text(text: str, kind: str = "code", limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(overlap_from, start, end) of each piece; a piece's text is ``text[overlap_from:end]``, its own part ``text[start:end]``."""
    slack = min(SLACK, overlap // 4)
    out, start = [], 0
    for end in cut_points(text, kind, limit - overlap - slack):
        out.append((overlap_start(text, start, overlap, slack) if start else 0, start, end))
        start = end
    return out


def form(language: str | None, chunk_type: str | None, path: str | None) -> str:
    """How a chunk is read: prose, markup or code."""
    name, base = (language or "").strip().lower(), (path or "").lower()
    if name in MARKUP or base.endswith(tuple("." + m for m in MARKUP)):
        return "markup"
    return "prose" if name in PROSE or chunk_type == "section" or base.endswith((".md", ".rst", ".txt")) else "code"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks longer than ``limit`` code points, one row a piece.

    (chunk_id, piece_no from 1, n_pieces, chunk_type, line_start, line_end, overlap_chars, content). Shorter, null and empty
    contents give no row. Lines are numbered from the chunk's line_start, from 1 where it is null; line_end is counted, not
    taken from the chunk. A repeated row counts once. Concatenating the contents without their overlaps restores the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cid, kind, lang, path, first, text in zip(batch["chunk_id"], batch["chunk_type"], batch["language"], batch["file_path"], batch["line_start"], batch["content"]):
                pieces = split_text(text, form(lang, kind, path), limit, overlap)
                base = 1 if pd.isna(first) else int(first)
                line, at = base, 0
                for no, (over, start, end) in enumerate(pieces, 1):
                    line += text.count("\n", at, over) if over >= at else -text.count("\n", over, at)
                    at = over
                    last = line + text.count("\n", over, end) - (1 if text[end - 1] == "\n" else 0)
                    rows.append((cid, no, len(pieces), kind, line, last, start - over, text[over:end]))
            if rows:
                yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "n_pieces", "chunk_type", "line_start", "line_end", "overlap_chars", "content"])

    big = chunks.where(F.length("content") > limit).select("chunk_id", "chunk_type", "language", "file_path", "line_start", "content").dropDuplicates(["chunk_id"])
    return big.mapInPandas(run, "chunk_id string, piece_no int, n_pieces int, chunk_type string, line_start int, line_end int, overlap_chars int, content string")
