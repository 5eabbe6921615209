"""Edge cases of the core operators: nulls, ties, empty input, traps of the surveyed semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.engine import CodeIndex
from tessera.functions import git, paths, text
from tessera.operators import chunking, embed, lexical, references, store, symbols, vector
from tessera.sources import files
from tessera.streaming import events as ev


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths(spark):
    names = ["a.py", "src/a.py", "src/b/c.PY", "node_modules/x.js", ".env", ".git/x.py", "notes.txt", "package-lock.json", "src/.hidden.py", "/abs.py", "a~"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.p for r in df.where(paths.admitted(F.col("p"))).collect()] == ["a.py", "src/a.py", "src/b/c.PY"]
    assert [r.p for r in df.where(paths.glob_match(F.col("p"), "*.py")).collect()] == ["a.py"]
    assert [r.p for r in df.where(paths.glob_match(F.col("p"), "**/*.py")).collect()] == ["src/a.py", ".git/x.py", "src/.hidden.py", "/abs.py"]
    assert df.where(paths.glob_match(F.col("p"), "*")).count() == len(names)
    row = spark.range(1).select(paths.rooted(F.lit("x/test/y/a.js")), paths.rooted(F.lit("x/src/a.js")), paths.rooted(F.lit("x/a.js")), paths.extension(F.lit(".env")), paths.stem(F.lit("d/a.b.py"))).collect()[0]
    assert tuple(row) == ("test/y/a.js", "src/a.js", "a.js", "", "a.b")


def test_lines(spark):
    samples = ["", "a", "a\n", "a\r\nb", "a\n\nb", "a\fb", "a b", "\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.line_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(s.splitlines()) for i, s in enumerate(samples)}


def test_regex_table():
    yes = ["a|b", "^x", "[ab]", "(x)", "a.*b", ".+x"]
    no = ["plain", "a_b", "(.+)+", "(.*)*"]
    assert all(map(text.looks_like_regex, yes)) and not any(map(text.looks_like_regex, no))
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            text.validate_search(bad, False)
    with pytest.raises(ValueError):
        text.validate_search("(", True)


def test_search(spark):
    df = spark.createDataFrame([("a", "one\ntwo cat\r\nthree\nfour"), ("b", None), ("c", ""), ("d", "concat")], "path string, content string")
    assert values(lexical.search(df, "cat", regex=False).select("path", "line_no", "line")) == [("a", 2, "two cat"), ("d", 1, "concat")]
    assert values(lexical.search(df, "cat", context_lines=1, regex=False).where("path = 'a'").select("line_no", "is_match")) == [(1, False), (2, True), (3, False)]
    assert values(lexical.search(df, "xat", fuzzy=True, regex=False)) == []
    assert values(lexical.approximate(df, "cut").select("path")) == [("a",)]
    assert lexical.search(df.limit(0), "cat").count() == 0
    raw = spark.createDataFrame([("./src/a.py:12:x = 1",), ("src/a.py-13-y",), ("noise",)], "value string")
    assert values(lexical.tool_output(raw)) == [("src/a.py", 12, "x = 1"), ("src/a.py", 13, "y")]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert [r.vec_id for r in vector.top_k(df, [1.0, 0.0], 3).collect()] == [1, 2, 3]
    assert [r.vec_id for r in vector.top_k(df, [1.0, 0.0], 3, min_similarity=0.5).collect()] == [1, 2]
    assert [r.vec_id for r in vector.similar_to(df, "vec_id", 1, 1).collect()] == [2]
    with pytest.raises(ValueError):
        vector.similar_to(df, "vec_id", 5, 1)
    a, b = embed.hash_vector("x", 8), embed.hash_vector("x", 8)
    assert (a == b).all() and abs((a * a).sum() - 1) < 1e-5


def test_store(spark):
    old = spark.createDataFrame([(1, "a")], "id int, h string")
    new = spark.createDataFrame([(2, "a"), (3, "b"), (4, "b"), (5, None)], "id int, h string")
    assert values(store.insert_if_absent(old, new, ["h"], ["id"]).select("id")) == [(3,), (5,)]
    assert values(store.insert_counts(old, new, ["h"], ["id"])) == [(4, 2, 2)]
    d = spark.createDataFrame([("M\ta.py",), ("R090\tb.py\tc.py",), ("D\td.py",), ("T\te.py",)], "line string")
    ch = git.name_status(d)
    assert values(git.to_delete(ch)) == [("b.py",), ("d.py",)] and values(git.to_index(ch)) == [("a.py",), ("c.py",)]
    chunks = spark.createDataFrame([("a.py", 1), ("b.py", 1), ("z.py", 1)], "file_path string, v int")
    out = store.delta_sync(chunks, ch, lambda p: p.select(F.col("path").alias("file_path"), F.lit(2).alias("v")))
    assert values(out) == [("a.py", 2), ("c.py", 2), ("z.py", 1)]


def test_git_urls(spark):
    urls = ["https://github.com/o/r.git", "git@gitlab.com:o/r", " https://git.example/o/r/ ", "https://github.com/o", "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] and (r[0].host, r[0].owner, r[0].repo, r[0].platform) for r in df.select(git.parse_url(F.col("u"))).collect()]
    assert got == [("github.com", "o", "r", "github"), ("gitlab.com", "o", "r", "gitlab"), ("git.example", "o", "r", "gitea"), None, None]


PYTHON = '''import os

def first(a, *rest):
    """Doc."""
    return a

class Box(object):
    def put(self, x):
        return first(x)

async def later():
    first(1)

def second():
    later()
    return Box().put(first(2))
'''


def test_chunkers(spark):
    df = spark.createDataFrame([("m.py", PYTHON), ("bad.py", "def ("), ("r.md", "intro\n# A\ntext\n## B\nmore"), ("n.md", "plain"), ("x.yaml", "k: v\n" * 3000), ("y.js", "function f() {}")], "path string, content string")
    rows = {(r.file_path, r.chunk_type, r.chunk_name): (r.line_start, r.line_end) for r in chunking.chunk_files(df).collect()}
    assert rows[("m.py", "function", "put")] == (8, 9) and rows[("m.py", "class", "Box")] == (7, 9)
    assert ("m.py", "function", "later") not in rows and ("bad.py", "file", "bad") in rows
    assert rows[("r.md", "section", "Introduction")] == (1, 1) and rows[("r.md", "section", "B")] == (4, 5) and ("n.md", "section", "Content") in rows
    blocks = sorted(v for k, v in rows.items() if k[0] == "x.yaml")
    assert blocks[0][0] == 1 and blocks[-1][1] == 3000 and all(b[0] == a[1] + 1 for a, b in zip(blocks, blocks[1:]))
    assert chunking.pack_lines(["x" * 9000], 8000) == [(1, 1)] and chunking.pack_lines(["a" * 3999, "b" * 3999, "c"], 8000) == [(1, 2), (3, 3)]


def test_symbols(spark):
    go = "package p\n\ntype S struct {\n}\n\nfunc (s S) M() {\n}\n\nfunc F() {\n\tM()\n}\n"
    df = spark.createDataFrame([("m.py", PYTHON), ("a.go", go), ("r.md", "x"), ("z.bin", "x")], "path string, content string")
    s = symbols.symbols(df).cache()
    by = {r.symbol_id: r for r in s.collect()}
    assert by["m.py::first"].called_by == ["m.py::Box.put", "m.py::second"] and by["m.py::Box.put"].called_by == ["m.py::second"]
    assert "m.py::later" not in by and by["m.py::first"].signature == "def first(a, *rest):"
    assert by["a.go::M"].called_by == ["a.go::F"] and by["a.go::S"].type == "struct" and by["r.md::r.md"].type == "file"
    r = symbols.file_summary(s).where("file = 'm.py'").collect()[0]
    assert (r.functions, r.classes, r.methods, r.symbol_count) == (["first", "second"], ["Box"], ["Box.put"], 4)


def test_sources(spark, tmp_path):
    for name, body in {"src/a.py": PYTHON.encode(), "src/bad.py": b"x = '\xff'", "node_modules/m.js": b"x", "nul.py": b"a\x00b"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path: r.content for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "src/bad.py", "nul.py"} and got["src/bad.py"] == "x = ''"
    assert {r.path: r.error for r in files.read_patterns(spark, str(tmp_path)).collect()}["src/bad.py"] == "not UTF-8"
    sniff = {r.path: r.t for r in files.listing(spark, str(tmp_path)).select("path", files.is_text(F.col("content")).alias("t")).collect()}
    assert not sniff["nul.py"] and sniff["src/a.py"]
    assert files.one(spark, str(tmp_path), "src/bad.py") == "x = 'ÿ'"
    with pytest.raises(ValueError):
        files.one(spark, str(tmp_path), "../x")
    index = CodeIndex(spark, str(tmp_path)).build()
    assert index.find_files("src/*.py") == ["src/a.py", "src/bad.py"]
    index.save(str(tmp_path / "index"))
    assert CodeIndex(spark, str(tmp_path)).load(str(tmp_path / "index")).get_file_summary("src/a.py").count() == 1


def test_events(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 6, 12, 19, 49, 79])] + [(9, None, t0)]
    df = spark.createDataFrame(rows, "event_id bigint, repo int, ts timestamp")
    assert sorted(r.n_events for r in ev.debounce(df.where("repo = 1"), "repo", "ts", 6).collect()) == [1, 1, 1, 3]
    got = {r.event_id: r.accepted for r in ev.rate_limit(df, "repo", "ts", "event_id", 30).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True, 9: True}
    df.where("repo = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ev.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "repo", "ts", "event_id", 30)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.tie: r.accepted for r in spark.table("limited").collect()} == {k: v for k, v in got.items() if k != 9}
    s = ev.debounce_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "repo", "ts", 6, "1 second")
    q = s.writeStream.format("memory").queryName("bounced").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("bounced").count() >= 2
    fs = spark.createDataFrame([("moved", "a.py", "src/b.py", False), ("moved", "a.py", None, False), ("created", "x.tmp", None, False), ("created", "d", None, True)], "event_type string, src_path string, dest_path string, is_directory boolean")
    assert [r.path for r in ev.admitted_events(fs).collect()] == ["src/b.py"]


def test_orphans(spark):
    t = dt.datetime
    refs = "chunk_id string, project_id string, created_at timestamp_ntz, n int"
    chunks = spark.createDataFrame([("c1", " P1 ", t(2024, 1, 5), 1), ("c1", " P1 ", t(2024, 1, 5), 1), ("c2", "p2", t(2024, 1, 5), 1), ("c3", None, t(2024, 1, 5), 1), ("c4", "gone", t(2024, 2, 5), 1), ("c5", "late", t(2024, 1, 5), 1), ("c6", "late", t(2024, 3, 5), 1), ("c7", " ", t(2024, 1, 5), 1), ("c8", "p1", None, 1)], refs)
    adr = "id string, adr_number int, supersedes_adr int, related_adrs array<int>, created_at timestamp_ntz, ref_key string"
    adrs = spark.createDataFrame([("a1", 1, 0, [1, 2, 2, None, 0, 9], t(2024, 1, 1), "x"), ("a2", 2, 7, None, t(2024, 5, 1), "x")], adr)
    projects = spark.createDataFrame([("p1", t(2023, 1, 1)), ("LATE", t(2024, 2, 1)), ("LATE", t(2024, 2, 2))], "project_id string, created_at timestamp_ntz")
    log = spark.createDataFrame([("project", "gone", t(2024, 1, 1))], "entity string, entity_key string, deleted_at timestamp_ntz")
    got = values(references.index_orphans(chunks, adrs, projects, log).select("record_id", "field_name", "ref_key", "period", "reason"))
    assert got == [("a1", "related_adrs", "2", "2024-01", "late"), ("a1", "related_adrs", "9", "2024-01", "missing"), ("a2", "supersedes_adr", "7", "2024-05", "missing"), ("c2", "project_id", "p2", "2024-01", "missing"), ("c4", "project_id", "gone", "2024-02", "deleted"), ("c5", "project_id", "late", "2024-01", "late")]
    empty = references.index_orphans(chunks.limit(0), adrs.limit(0), projects.limit(0), log.limit(0))
    assert empty.count() == 0 and references.orphan_report(empty).count() == 0
