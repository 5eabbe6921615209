"""File selection, file details, ingestion, signed calls and other operators on small fixtures."""

import hashlib
import hmac
import time

import pytest
from pyspark.sql import functions as F

from tessera import engine, session
from tessera.functions import git, paths
from tessera.operators import embed, ingest, store, symbols, vector
from tessera.sources import files as sources
from tessera.streaming import events


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).collect()[0].r


def test_selection(spark):
    df = spark.createDataFrame([("a/b.PY",), ("src/x.tsx",), ("top.md",), ("src/test_x.py",), (None,)], "p string")
    p = F.col("p")
    pick = lambda c: sorted(r.p for r in df.where(c).collect() if r.p)
    assert pick(paths.of_language(paths.file_language(p), ["Python"])) == ["a/b.PY", "src/test_x.py"]
    assert len(pick(paths.of_language(paths.file_language(p), []))) == 4
    assert pick(paths.in_directories(p, ["."])) == ["top.md"] and pick(paths.in_directories(p, ["s*"])) == ["src/test_x.py", "src/x.tsx"]
    assert pick(paths.not_matching(p, ["test_*", "*.md"])) == ["a/b.PY", "src/x.tsx"]
    assert pick(paths.supported(p)) == ["a/b.PY", "src/test_x.py", "src/x.tsx", "top.md"]
    assert one(spark, paths.parser_language, "x.hh") == "hpp" and one(spark, paths.parser_language, "x.pyw") == "python" and one(spark, paths.parser_language, "x") == "unknown"
    assert one(spark, paths.content_type, "a.html") == "text/html" and one(spark, paths.content_type, "a.nothing") == "application/octet-stream"
    assert one(spark, lambda c: paths.namespaced(c, F.lit("u"), F.lit("p")), "//a/b") == "users/u/p/a/b" and one(spark, paths.namespace_user, "users/u/p/a") == "u" and one(spark, paths.namespace_user, "a/b") is None
    assert one(spark, lambda c: paths.relevance(c, "*Main.java"), "a/Main.java") == 58 and one(spark, lambda c: paths.relevance(c, "main.java"), "a/Main.java") == 8
    assert one(spark, lambda c: git.clone_path(c, "/w/"), "git@bitbucket.org:t/r.git") == "/w/bitbucket/t/r"
    s = paths.exclude_summary(("mine",))
    assert "mine" in s["exclude_directories"] and s["exclude_directories_count"] == len(s["exclude_directories"])


def test_file_details(spark):
    src = {
        "a.py": "import os, sys\nfrom a.b import c as d\nfrom . import e\n",
        "bad.py": "import os\ndef (",
        "b.ts": "import x from 'y';\nimport {\n  a,\n  b\n} from 'z';\nconst q = require('q');\nexport class A {}\nexport default f;\n",
        "C.java": "package a.b;\nimport java.util.List;\nimport static x.Y.*;\nclass C {}",
        "d.go": "package main\n\nimport \"fmt\"\nimport (\n  \"os\"\n  z \"a/b\"\n)\n",
        "e.m": "#import <A/B.h>\n#import \"c.h\"\n",
        "f.zig": "const s = @import(\"std\");",
        "g.md": "# x\n",
        "h.py": None,
    }
    r = {x.path: x for x in symbols.file_details(spark.createDataFrame(list(src.items()), "path string, content string")).collect()}
    assert r["a.py"].imports == ["os", "sys", "a.b.c"] and r["bad.py"].imports == [] and r["a.py"].line_count == 3
    assert sorted(r["b.ts"].imports) == sorted(["import x from 'y';", "import {\n  a,\n  b\n} from 'z';", "require('q')"]) and r["b.ts"].exports == ["export class A {}", "export default f;"]
    assert r["C.java"].imports == ["java.util.List", "x.Y.*"] and r["C.java"].package == "a.b"
    assert r["d.go"].imports == ["fmt", "os", "a/b"] and r["d.go"].package == "main"
    assert r["e.m"].imports == ["A/B.h", "c.h"] and r["f.zig"].imports == ["std"] and r["g.md"].imports == [] and r["g.md"].package is None
    assert r["h.py"].line_count == 0


def test_calls_take_the_last_meaning():
    code = "def run():\n    pass\nclass A:\n    def run(self):\n        pass\nclass B:\n    def run(self):\n        pass\ndef main():\n    x.run()\n"
    by = {r[3]: r[7] for r in symbols.python_symbols("p.py", code)}
    assert by["B.run"] == ["p.py::main"] and by["run"] == [] and by["A.run"] == []


def test_parsing_statistics():
    s = symbols.parsing_statistics()
    assert s["specialized_extensions"] == 14 and s["fallback_extensions"] == 96 and s["total_strategies"] == len(s["strategy_details"])


def test_index(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n\ndef f():\n    g()\n\ndef g():\n    pass\n")
    (tmp_path / "src" / "b.go").write_text("package b\n")
    ix = engine.CodeIndex(spark, str(tmp_path))
    assert ix.status()["status"] == "needs_rebuild" and engine.CodeIndex(spark, "").status()["status"] == "not_initialized"
    ix.build()
    assert ix.find_files("**") == ["src/a.py", "src/b.go"] and ix.find_files("**", 1) == ["src/a.py"]
    assert [r.path for r in ix.matching_files(languages=("GO",)).collect()] == ["src/b.go"]
    s = ix.get_file_summary("./src/a.py").collect()
    assert len(s) == 1 and s[0].imports == ["os"]
    s = ix.get_file_summary("src/a.py").collect()[0]
    assert s.functions == ["f", "g"] and s.line_count == 7 and s.language == "python"
    assert ix.status()["status"] == "ready" and ix.status()["symbol_types"]["function"] == 2
    ix.save(str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved" / "chunks")).count() == 3
    again = engine.CodeIndex(spark, str(tmp_path)).load(str(tmp_path / "saved"))
    assert again.get_file_summary("src/a.py").collect()[0].symbol_count == 2


def test_explicit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    got = {r.path: (r.content, r.error) for r in sources.explicit(spark, [str(tmp_path / n) for n in ("a.txt", "b.bin", "gone.txt")]).collect()}
    assert got == {"a.txt": ("x", None), "b.bin": (None, "not UTF-8")} and sources.explicit(spark, [str(tmp_path / "gone")]).count() == 0


def test_ingest(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return 1\n\ndef g():\n    return 2\n"), ("b.py", "def f():\n    return 1\n"), ("c.js", "x"), ("d.md", None), ("e.md", "")], "path string, content string")
    none = spark.createDataFrame([], "project_id string, content_hash string")
    first = ingest.ingest(files, none, "p")
    rows = first.collect()
    assert sorted((r.file_path, r.chunk_name) for r in rows) == [("a.py", "f"), ("a.py", "g"), ("c.js", "c")] and all(len(r.embedding) == 64 for r in rows)
    s = ingest.ingest_stats(files, none, first, "p").collect()[0]
    assert (s.files_processed, s.chunks_created, s.chunks_inserted, s.chunks_skipped, s.embeddings_generated) == (4, 4, 3, 1, 3)
    assert ingest.ingest(files, first, "p").count() == 0 and ingest.ingest(files, first, "q").count() == 3
    assert ingest.ingest(files.limit(0), none, "p").count() == 0


def test_null_keys_conflict_with_nothing(spark):
    new = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "i int, k string")
    old = spark.createDataFrame([("b",), (None,)], "k string")
    assert sorted(r.i for r in store.insert_if_absent(old, new, ["k"], ["i"]).collect()) == [1, 2, 3]


def test_signatures(spark):
    body, secret = b'{"a": 1}', "k" * 80
    good = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    assert events.signature_valid(body, good, secret) and not events.signature_valid(body, good[7:], secret) and events.signature_valid(body, good[7:], secret, "")
    assert not events.signature_valid(body, good, None) and not events.signature_valid(body, None, secret) and not events.signature_valid(body + b" ", good, secret)
    df = spark.createDataFrame([(body.decode(), good), (body.decode(), good[:-1] + "x"), (body.decode(), None), (None, good), ("", good)], "b string, h string")
    for s in (secret, "short"):
        want = [b is not None and events.signature_valid(b.encode(), h, s) for b, h in [(r.b, r.h) for r in df.collect()]]
        assert [r.ok for r in df.select(events.signed(F.col("b"), F.col("h"), s).alias("ok")).collect()] == want


def test_streams_start_again():
    class Query:
        def __init__(self, bad):
            self.bad = bad

        def awaitTermination(self):
            if self.bad:
                raise RuntimeError("lost")

    left = [Query(True), Query(True), Query(False)]
    assert events.restarting(lambda: left.pop(0)) is not None and not left
    with pytest.raises(RuntimeError):
        events.restarting(lambda: Query(True), 2)
    assert events.watcher_status(None, 1, 0.5) == {"active": False, "restarts": 1, "debounce_seconds": 0.5, "batches": 0}


def test_embed_waits(spark):
    calls = []

    def load():
        def model(texts):
            calls.append(time.monotonic())
            if len(calls) < 3:
                raise OSError("busy")
            return [[1.0]] * len(texts)

        return model

    df = spark.createDataFrame([("a",), (None,)], "content string").coalesce(1)
    assert [r.embedding for r in embed.embed(df, load, wait=0.01).collect()] == [[1.0], [1.0]]


def test_records(spark):
    rows = [(i, f"t{i}", "Accepted", "c" if i % 2 else "d", "x" * 300, ["s"] if i < 4 else None, [1.0, float(i)], None) for i in range(6)] + [(9, "n", None, "c", None, None, None, None)]
    a = spark.createDataFrame(rows, "adr_number int, title string, status string, decision_category string, content string, technology_stack array<string>, embedding array<float>, decided_at timestamp_ntz")
    got = vector.search_records(a, [1.0, 1.0], 3, category="c", technology="s").collect()
    assert [r.adr_number for r in got] == [1, 3] and len(got[0].content_preview) == 200
    assert vector.search_records(a, [0.0, 0.0]).count() == 0 and vector.search_records(a.limit(0), [1.0, 1.0]).count() == 0


def test_stages_are_cleared(spark):
    df = session.stage(spark.range(3), "t")
    assert df.count() == 3 and session.clear_stages(spark) >= 1 and session.clear_stages(spark) == 0


def test_brackets_give_owners():
    ts = "class A {\n  one() {\n    helper();\n  }\n}\nfunction helper() {\n  // } not a bracket\n  const s = '}';\n  two();\n}\nclass B\n{\n  two() {\n    this.one();\n  }\n}\nhelper();\n"
    by = {r[3]: (r[4], r[7]) for r in symbols.declared_symbols("x.ts", ts, "typescript")}
    assert set(by) == {"A", "A.one", "helper", "B", "B.two"}
    assert by["helper"] == (6, ["x.ts::A.one"]) and by["B.two"] == (13, ["x.ts::helper"]) and by["A.one"][1] == ["x.ts::B.two"]
    java = "public class A {\n  int[] x = {1, 2};\n  public void f() {\n    g();\n  }\n  static class B {\n    private int g() {\n      return 1;\n    }\n  }\n  public int h(int a) {\n    return g();\n  }\n}\n"
    by = {r[3]: r[7] for r in symbols.declared_symbols("A.java", java, "java")}
    assert set(by) == {"A", "A.f", "B", "B.g", "A.h"} and by["B.g"] == ["A.java::A.f", "A.java::A.h"]
    objc = "@implementation A\n- (void)f {\n  g();\n}\n@end\nvoid g(int a) {\n  h();\n}\n"
    by = {r[3]: r[7] for r in symbols.declared_symbols("a.m", objc, "objective-c")}
    assert by == {"A": [], "A.f": [], "g": ["a.m::A.f"]}
    go = "type S struct {\n\tx int\n}\nfunc (s S) Run() { help() }\nfunc help() {\n\t/* run() */\n}\n"
    by = {r[3]: r[7] for r in symbols.declared_symbols("s.go", go, "go")}
    assert by == {"S": [], "Run": [], "help": ["s.go::Run"]}


def test_expressions_on_whole_texts(spark):
    from tessera.operators import lexical

    df = spark.createDataFrame([("a", "x foo\r\nbar y\n"), ("b", "foo bar"), ("c", "foo\nbaz"), ("d", None)], "path string, content string")
    hits = lambda rx: sorted((r.path, r.line_no) for r in lexical.search(df, rx, regex=True).collect())
    assert hits("foo$") == [("a", 1), ("c", 1)] and hits(r"^ba[rz]") == [("a", 2), ("c", 2)] and hits(r"foo(?!\s*ba)") == [("a", 1), ("c", 1)]
    assert hits(r"foo[^q]*$") == [("a", 1), ("b", 1), ("c", 1)] and hits("zzz|qqq") == []


def test_small_functions(spark):
    from tessera.functions import text

    r = spark.sql("SELECT array(1.5f, 2f) v, 'ci_x' k, 'Bearer abc ' h, timestamp'2024-01-01 00:00:01' a, timestamp'2024-01-01 00:00:03.5' b, ' héllo ' t").select(
        text.vector_literal(F.col("v")), text.api_key(F.col("k")), text.bearer(F.col("h")), text.seconds_between(F.col("a"), F.col("b")), text.slice_text(F.col("t"), F.lit(0), F.lit(4)), text.slice_text(F.col("t"), F.lit(9), F.lit(12)), text.bearer(F.lit("Basic x"))
    ).collect()[0]
    assert list(r) == ["[1.5,2.0]", True, "abc", 2.5, "hél", "", None]


def test_ingest_into(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.js", "x")], "path string, content string")
    told = []
    stats = ingest.ingest_into(files, str(tmp_path / "chunks"), "p", progress=lambda m, s: told.append(m))
    assert stats["chunks_inserted"] == 2 and told == ["chunking", "embedded", "stored"]
    assert ingest.ingest_into(files, str(tmp_path / "chunks"), "p")["chunks_skipped"] == 2 and spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    best = spark.createDataFrame([("b.js", 0.5)], "file_path string, similarity_score double")
    assert vector.fetch(best, spark.read.parquet(str(tmp_path / "chunks")), "file_path").count() == 1


def test_reports(spark):
    from tessera.operators import reports

    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, None)], "i int, k string, m string")
    assert sorted(tuple(r) for r in reports.counts_beside(df, {"k": "nk", "m": "nm"}).select("i", "nk", "nm").collect()) == [(1, 2, 2), (2, 2, 1), (3, 1, 2)]
    assert reports.counts_beside(df.limit(0), {"k": "nk"}).count() == 0
    assert [r.i for r in reports.of_scalar(df, "i", spark.range(2, 3), "id").collect()] == [2] and reports.of_scalar(df, "i", spark.range(0), "id").count() == 0
    with pytest.raises(Exception, match="more than one row"):
        reports.of_scalar(df, "i", spark.range(2), "id").collect()
    t = spark.createDataFrame([("a/b/c/d.py", 3), ("a/b/c/e.py", 4), ("x.py", None)], "path string, length bigint")
    assert [tuple(r) for r in reports.project_tree(t).collect()] == [("a/b/c", 2, 7), ("x.py", 1, None)]
    c = spark.createDataFrame([("p", "Go"), ("p", "go"), ("q", None)], "project_id string, language string")
    assert {r.project_id: r.flags for r in reports.language_flags(c).collect()} == {"p": {"go": 1}, "q": {}}
