"""Queries over rows that their DuckDB statements leave out, against plain Python."""

import re

from tessera.operators.chunking import OVERLAP_LINES
from tessera.plans import catalog

TEXTS = ["a\rb\nc", "x\x0by\x0cz", "u\u2028v\u2029w\n", "# T\rbody\n## S\nend\x85more", "caf\u00e9 ledgers\r\nledger \u2192 x\nno", "ledgerss\nL\u00c9DGERS", "plain\n", "", None]


def near(a, b):
    """Edit distance of at most 1."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_documents(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_lines for r in run("line_stats")} == {i: len(t.splitlines()) for i, t in enumerate(TEXTS) if t is not None}
    assert {int(r.file_path) for r in run("chunk_sections")} == {i for i, t in enumerate(TEXTS) if t}
    want = {(str(i), n) for i, t in enumerate(TEXTS) for n, line in enumerate((t or "").split("\n"), 1) if any(near(w, "ledgers") for w in re.split(r"[^\w]+", line.lower()))}
    assert {(r.path, r.line_no) for r in run("lex_approximate")} == want and {("4", 1), ("4", 2), ("5", 1), ("5", 2)} <= want


def test_overlap(spark, tmp_path):
    long = "\r\n".join(f"def f{k}(x):\r\n    return x * {k} + len('{'y' * 60}')\r\n" for k in range(120))
    texts = {"crlf": long, "lf": long.replace("\r\n", "\n"), "few": "a\r\nb", "sep": "a\u2028b\x0cc\n", "empty": "", "null": None}
    spark.createDataFrame(list(texts.items()), "chunk_id string, content string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    got = catalog.queries()["chunk_overlap"](spark, str(tmp_path)).collect()
    assert {r.file_path for r in got} >= {"crlf", "lf", "few", "sep"} and sum(r.file_path == "crlf" for r in got) > 1
    for r in got:
        lines = texts[r.file_path].splitlines()
        before, after = lines[max(0, r.line_start - 1 - OVERLAP_LINES) : r.line_start - 1], lines[r.line_end : r.line_end + OVERLAP_LINES]
        assert r.context_before == ("\n".join(before) if r.line_start > 1 else None) and r.context_after == ("\n".join(after) if after else None)
