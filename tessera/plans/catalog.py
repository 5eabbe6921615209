"""The query catalogue: every operator over the driver tables, with the DuckDB statement it must agree with.

Roles: code_chunks, projects, users, adrs and ingest_runs stand for themselves; documents are files (doc_id as path);
embeddings are chunk vectors; events are watch and webhook events (user_id as repository); customer and orders, orders and
lineitem are wide parents and children for join shapes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import git, paths, text
from tessera.operators import chunking, lexical, references, reports, store, symbols, vector
from tessera.operators import ingest as ingesting
from tessera.session import norm_key, table
from tessera.streaming import events as ev

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Shared readings of the tables: documents as files, one row per project and chunk, keys trimmed and in lower case.
LATEST_PROJECTS = "(SELECT * FROM projects QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST, total_chunks DESC NULLS LAST, total_files DESC NULLS LAST) = 1)"
ONE_CHUNK = "(SELECT * REPLACE (nullif(lower(trim(project_id)), '') AS project_id) FROM code_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST) = 1)"
ONE_ADR = "(SELECT * FROM adrs QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
DOC_LINES = "(SELECT path, CAST(i AS INT) AS line_no, rtrim(l[i], chr(13)) AS raw, CASE WHEN suffix(l[i], chr(13)) THEN l[i][:-2] ELSE l[i] END AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND text <> '')))"

# the same with every line separator there is
ALL_LINES = "(SELECT path, CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(CASE WHEN suffix(t, chr(10)) THEN t[:-2] ELSE t END, chr(10)) AS l FROM (SELECT CAST(doc_id AS VARCHAR) AS path, regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL AND text <> ''))))"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id", "lang", "source")


def _projects(spark, d) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("total_chunks"), F.desc_nulls_last("total_files"))
    return table(spark, d, "projects").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, the latest update. Repeated rows differ in nothing else, so a map-side aggregate does."""
    rest = [c for c in columns if c not in (key, "updated_at")]
    return df.groupBy(key).agg(F.max("updated_at").alias("updated_at"), *[F.max_by(c, F.struct(F.col("updated_at").isNotNull(), "updated_at")).alias(c) for c in rest])


def _chunks(spark, d, *columns: str) -> DataFrame:
    """One row per chunk with the columns asked for; project ids trimmed and in lower case."""
    src = table(spark, d, "code_chunks").withColumn("project_id", norm_key(F.col("project_id")))
    return _latest(src.select("chunk_id", "updated_at", *columns), "chunk_id", list(columns))


def _adrs(spark, d) -> DataFrame:
    a = table(spark, d, "adrs").drop("embedding")
    return _latest(a, "id", a.columns)


def _q0(df: DataFrame) -> list[float]:
    return vector.lookup_vector(df, "vec_id", 0, "embedding")


SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


# ---- vector search -------------------------------------------------------------------------------------------------
@query(f"SELECT e.vec_id, round({SIM}, 4) AS score FROM embeddings e, {Q0} q ORDER BY {SIM} DESC, vec_id LIMIT 10")
def vec_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vector.top_k(e, _q0(e), 10).select("vec_id", F.round("similarity_score", 4).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({SIM}, 4) AS score FROM embeddings e, {Q0} q WHERE e.label = 3 ORDER BY {SIM} DESC, vec_id LIMIT 10")
def vec_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    return vector.top_k(e, _q0(e), 10, filters=F.col("label") == 3).select("vec_id", "label", F.round("similarity_score", 4).alias("score"))


@query(f"SELECT * FROM (SELECT e.vec_id, round({SIM}, 4) AS score FROM embeddings e, {Q0} q ORDER BY {SIM} DESC, vec_id LIMIT 20) WHERE score >= 0.35")
def vec_min_similarity_post_limit(spark, d):
    e = table(spark, d, "embeddings")
    return vector.top_k(e, _q0(e), 20).select("vec_id", F.round("similarity_score", 4).alias("score")).where("score >= 0.35")


@query(f"SELECT e.vec_id, round({SIM}, 4) AS score FROM embeddings e, {Q0} q WHERE 1 - {SIM} < 0.7 ORDER BY {SIM} DESC, vec_id LIMIT 15")
def vec_distance_threshold(spark, d):
    e = table(spark, d, "embeddings")
    return vector.top_k(e, _q0(e), 15, max_distance=0.7).select("vec_id", F.round("similarity_score", 4).alias("score"))


@query(f"SELECT e.vec_id, round({SIM}, 4) AS score FROM embeddings e, {Q0} q WHERE e.vec_id <> 0 ORDER BY {SIM} DESC, vec_id LIMIT 5")
def vec_similar_exclude_self(spark, d):
    return vector.similar_to(table(spark, d, "embeddings"), "vec_id", 0, 5).select("vec_id", F.round("similarity_score", 4).alias("score"))


@query(
    f"SELECT vec_id, round(least(1.0, s * 1.1), 4) AS score FROM (SELECT e.vec_id, d.text, d.source, {SIM} AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, {Q0} q ORDER BY s DESC, vec_id LIMIT 40) "
    "WHERE s >= 0 AND (contains(lower(coalesce(text, '')), 'index') OR contains(lower(coalesce(source, '')), 'index')) ORDER BY least(1.0, s * 1.1) DESC, vec_id LIMIT 20"
)
def vec_hybrid_keyword(spark, d):
    e = table(spark, d, "embeddings")
    j = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source"), "vec_id")
    return vector.hybrid(j, _q0(e), 20, "index", ["text", "source"]).select("vec_id", F.round("similarity_score", 4).alias("score"))


@query(
    f"SELECT chunk_id, chunk_name FROM (SELECT c.chunk_id, c.chunk_type, c.chunk_name, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM {ONE_CHUNK} c, {Q0} q "
    "WHERE len(c.embedding) = 64 AND list_sum(list_transform(c.embedding, lambda x: x * x)) > 0 AND NOT isnan(list_sum(c.embedding)) ORDER BY s DESC, chunk_id LIMIT 200) WHERE chunk_type = 'function' AND contains(lower(chunk_name), 're')"
)
def vec_by_name(spark, d):
    c = _chunks(spark, d, "chunk_type", "chunk_name", "embedding").where("size(embedding) = 64")
    return vector.by_name(c, _q0(table(spark, d, "embeddings")), "re", k=200).select("chunk_id", "chunk_name")


@query(f"SELECT label, vec_id, round(s, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT e.label, e.vec_id, {SIM} AS s, row_number() OVER (PARTITION BY label ORDER BY {SIM} DESC, vec_id) AS rank FROM embeddings e, {Q0} q) WHERE rank <= 3")
def vec_per_label_best(spark, d):
    e = table(spark, d, "embeddings")
    return vector.best_per_group(e, _q0(e), "label", 3).select("label", "vec_id", F.round("similarity_score", 4).alias("score"), "rank")


@query(
    f"SELECT c.chunk_id, p.project_name, CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) AS line_range, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score "
    f"FROM {ONE_CHUNK} c JOIN {LATEST_PROJECTS} p USING (project_id), {Q0} q WHERE p.user_id = (SELECT min(user_id) FROM projects) AND lower(c.language) = 'python' AND line_start IS NOT NULL AND line_end IS NOT NULL AND len(c.embedding) = 64 "
    "AND list_sum(list_transform(c.embedding, lambda x: x * x)) > 0 AND NOT isnan(list_sum(c.embedding)) ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, chunk_id LIMIT 10"
)
def semantic_search(spark, d):
    p = _projects(spark, d)
    user = p.agg(F.min("user_id")).collect()[0][0]
    mine = p.where(F.col("user_id") == user).select("project_id", "project_name")
    c = table(spark, d, "code_chunks").select("chunk_id", F.col("project_id").alias("raw_id"), norm_key(F.col("project_id")).alias("project_id"), "language", "line_start", "line_end", "embedding")
    c = c.where("lower(language) = 'python' and size(embedding) = 64 and line_start is not null and line_end is not null and raw_id is not null").join(mine, "project_id")
    # scored where they are read; then repeated rows, which differ in nothing shown here, are dropped without their vectors
    query_vector = _q0(table(spark, d, "embeddings"))
    scored = c.select("chunk_id", "project_name", "line_start", "line_end", vector.similarity("embedding", query_vector).alias("similarity_score")).where("similarity_score is not null and not isnan(similarity_score)")
    best = scored.dropDuplicates(["chunk_id"]).orderBy(F.desc("similarity_score"), "chunk_id").limit(10)
    return vector.shaped(best).select("chunk_id", "project_name", "line_range", F.col("similarity_score").alias("score"))


@query(f"SELECT a.adr_number, a.title, a.content[:200] AS content_preview, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score FROM {ONE_ADR} a, {Q0} q WHERE decision_category = 'performance' AND len(a.embedding) = 64 AND list_sum(list_transform(a.embedding, lambda x: x * x)) > 0 AND NOT isnan(list_sum(a.embedding)) ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, a.adr_number LIMIT 10")
def search_adrs(spark, d):
    a = _latest(table(spark, d, "adrs"), "id", table(spark, d, "adrs").columns)
    found = vector.search_records(a, _q0(table(spark, d, "embeddings")), category="performance")
    return found.select("adr_number", "title", "content_preview", F.round("similarity_score", 4).alias("score"))


USABLE_ADRS = f"(SELECT * FROM {ONE_ADR} WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 AND NOT isnan(list_sum(embedding)))"


@query(f"SELECT a.adr_number, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score FROM {USABLE_ADRS} a, (SELECT adr_number, embedding FROM {USABLE_ADRS} ORDER BY adr_number LIMIT 1) q WHERE a.adr_number <> q.adr_number ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, a.adr_number LIMIT 5")
def similar_adrs(spark, d):
    a = _latest(table(spark, d, "adrs").select("id", "adr_number", "embedding", "updated_at"), "id", ["adr_number", "embedding"])
    usable = a.where((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", F.isnan))
    first = usable.agg(F.min("adr_number")).collect()[0][0]
    return vector.similar_to(usable, "adr_number", first, 5).select("adr_number", F.round("similarity_score", 4).alias("score"))


# ---- lexical search ------------------------------------------------------------------------------------------------
@query(f"SELECT path, line_no, line FROM {DOC_LINES} WHERE contains(line, 'index')")
def lex_literal(spark, d):
    return lexical.search(_docs(spark, d), "index", regex=False)


@query(f"SELECT path, line_no, line FROM {DOC_LINES} WHERE contains(lower(line), 'release')")
def lex_literal_ci(spark, d):
    return lexical.search(_docs(spark, d), "RELEASE", case_sensitive=False, regex=False)


@query(f"SELECT path, line_no, line FROM {DOC_LINES} WHERE regexp_matches(line, '(retry|cache)[a-z]* (the|a|one) ')")
def lex_regex(spark, d):
    return lexical.search(_docs(spark, d), "(retry|cache)[a-z]* (the|a|one) ")


@query(f"SELECT path, line_no, line FROM {DOC_LINES} WHERE regexp_matches(line, '\\bsched|sched\\b')")
def lex_fuzzy(spark, d):
    return lexical.search(_docs(spark, d), "sched", fuzzy=True, regex=False)


@query(f"SELECT path, line_no, line FROM {DOC_LINES} WHERE regexp_matches(line, '\\bon\\b')")
def lex_fuzzy_short(spark, d):
    return lexical.search(_docs(spark, d), "on", fuzzy=True, regex=False)


@query(
    f"SELECT path, line_no, line, m AS is_match FROM (SELECT *, max(CAST(m AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM (SELECT *, contains(line, 'snapshot') AS m FROM {DOC_LINES})) WHERE near = 1"
)
def lex_context(spark, d):
    return lexical.search(_docs(spark, d), "snapshot", context_lines=2, regex=False)


@query(f"SELECT path, line_no, CASE WHEN length(line) > 40 THEN line[:40] || '... (truncated)' ELSE line END AS line FROM {DOC_LINES} WHERE contains(line, 'vector')")
def lex_truncate(spark, d):
    return lexical.search(_docs(spark, d), "vector", regex=False, max_line_length=40)


@query(f"SELECT path, count(*) AS n_hits, CAST(min(line_no) AS INT) AS first_line, CAST(max(line_no) AS INT) AS last_line FROM {DOC_LINES} WHERE contains(line, 'record') GROUP BY path")
def lex_hits_per_file(spark, d):
    return lexical.hits_per_file(lexical.search(_docs(spark, d), "record", regex=False))


@query("SELECT chunk_id, CAST(i AS INT) AS line_no FROM (SELECT chunk_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT chunk_id, file_path, string_split(content, chr(10)) AS l FROM code_chunks WHERE suffix(file_path, '.py'))) WHERE contains(l[i], 'return ')")
def lex_file_pattern(spark, d):
    c = table(spark, d, "code_chunks").where(paths.file_pattern(F.col("file_path"), "*.py")).select("chunk_id", "content").distinct()
    return lexical.search(c, "return ", regex=False, path="chunk_id").select(F.col("path").alias("chunk_id"), "line_no")


@query(f"SELECT path, line_no FROM {DOC_LINES} WHERE len(list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '' AND levenshtein(t, 'ledgers') <= 1)) > 0")
def lex_approximate(spark, d):
    return lexical.approximate(_docs(spark, d), "ledgers").select("path", "line_no")


@query(f"SELECT d.doc_id, coalesce(n, 0) AS n_lines FROM documents d LEFT JOIN (SELECT path, count(*) AS n FROM {ALL_LINES} GROUP BY 1) ON path = CAST(doc_id AS VARCHAR) WHERE text IS NOT NULL")
def line_stats(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


# ---- paths ---------------------------------------------------------------------------------------------------------
FILES = "(SELECT DISTINCT file_path FROM code_chunks)"


def _files(spark, d) -> DataFrame:
    return table(spark, d, "code_chunks").select("file_path").distinct()


@query(f"SELECT file_path FROM {FILES} WHERE regexp_full_match(file_path, '.*/tests/[^/]*\\.py')")
def glob_find(spark, d):
    return _files(spark, d).where(paths.glob_match(F.col("file_path"), "**/tests/*.py"))


@query(
    f"SELECT file_path FROM {FILES} WHERE regexp_matches(lower(split_part(file_path, '/', -1)), '^.+\\.(" + "|".join(sorted({e[1:].lower() for e in paths.SUPPORTED_EXTENSIONS})) + ")$') "
    "AND NOT starts_with(split_part(file_path, '/', -1), '.') AND NOT regexp_matches(split_part(file_path, '/', -1), '^(.*\\.(tmp|temp|swp|swo|bak|orig|log)|.*~|package-lock\\.json|yarn\\.lock|Pipfile\\.lock)$') "
    "AND len(list_filter(string_split(file_path, '/')[:-2], lambda x: (starts_with(x, '.') AND x NOT IN ('.env', '.gitignore')) OR x IN (" + ", ".join(f"'{x}'" for x in paths.EXCLUDED_DIRECTORIES) + "))) = 0"
)
def path_admission(spark, d):
    return _files(spark, d).where(paths.admitted(F.col("file_path")))


@query(f"SELECT CASE lower(regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.CHUNK_LANGUAGES.items()) + f" ELSE 'unknown' END AS language, count(*) AS n_files FROM {FILES} GROUP BY 1")
def language_from_ext(spark, d):
    return _files(spark, d).groupBy(paths.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n_files"))


@query("SELECT CASE WHEN octet_length(encode(text)) < 1024 THEN 'tiny' WHEN octet_length(encode(text)) < 10240 THEN 'small' WHEN octet_length(encode(text)) < 102400 THEN 'medium' WHEN octet_length(encode(text)) < 1048576 THEN 'large' ELSE 'very_large' END AS category, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def size_category(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(paths.size_category(F.octet_length("text")).alias("category")).agg(F.count("*").alias("n"))


@query(
    f"SELECT file_path, CAST(CASE WHEN b = 'pipeline.py' THEN 100 WHEN starts_with(b, 'pipeline.py') THEN 50 WHEN contains(b, 'pipeline.py') THEN 25 ELSE 0 END + greatest(0, 10 - len(string_split(file_path, '/'))) AS INT) AS score FROM (SELECT file_path, split_part(file_path, '/', -1) AS b FROM {FILES}) ORDER BY score DESC, file_path LIMIT 50"
)
def relevance_sort(spark, d):
    return _files(spark, d).withColumn("score", paths.relevance(F.col("file_path"), "pipeline.py")).orderBy(F.desc("score"), "file_path").limit(50)


@query(
    f"SELECT file_path, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS parent, CAST(len(string_split(file_path, '/')) AS INT) AS depth, replace(regexp_replace(file_path, '\\.[^./]*$', ''), '/', '.') || '.f' AS qualified FROM {FILES}"
)
def path_parts(spark, d):
    p = F.col("file_path")
    return _files(spark, d).select(p, paths.parent(p).alias("parent"), paths.depth(p).alias("depth"), paths.qualified_name(p, F.lit("f")).alias("qualified"))


@query(f"SELECT substr(file_path, 1, CASE WHEN len(string_split(file_path, '/')) > 3 THEN length(array_to_string(string_split(file_path, '/')[:3], '/')) ELSE length(file_path) END) AS prefix, count(*) AS n_files FROM {FILES} GROUP BY 1")
def project_tree(spark, d):
    return reports.project_tree(_files(spark, d), path="file_path").select("prefix", "n_files")


@query(
    "SELECT project_name, regexp_extract(u, '^https?://([^/]+)/([^/]+)/([^/]+?)(?:\\.git)?$', 3) AS repo, [ 'github', 'gitlab', 'bitbucket', 'gitea'][h + 1] AS platform "
    "FROM (SELECT DISTINCT project_name, length(project_name) % 4 AS h, 'https://host.example/team/' || project_name || '.git' AS u FROM projects)"
)
def parse_git_url(spark, d):
    hosts = F.array(*[F.lit(x) for x in ("git@github.com:team/", "https://token@gitlab.com/team/", "https://bitbucket.org/team/", "https://git.example/team/")])
    p = table(spark, d, "projects").select("project_name", F.concat(F.get(hosts, F.length("project_name") % 4), "project_name", F.lit(".git/ ")).alias("url")).distinct()
    u = git.parse_url(F.col("url"))
    return p.select("project_name", u["repo"].alias("repo"), u["platform"].alias("platform"))


@query(f"SELECT file_path FROM {FILES} WHERE lower(regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1)) IN ('.py', '.ts', '.tsx') AND regexp_matches(regexp_replace(file_path, '/[^/]*$', ''), '^.*/src.*$') AND NOT regexp_matches(split_part(file_path, '/', -1), '^test_.*$')")
def select_files(spark, d):
    """Language list, directory pattern and exclude pattern together."""
    p = F.col("file_path")
    return _files(spark, d).where(paths.of_language(paths.file_language(p), ["Python", "TypeScript"]) & paths.in_directories(p, ["*/src*"]) & paths.not_matching(p, ["test_*"]))


def _lang_sql(table_: dict[str, str]) -> str:
    return f"CASE lower(regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " ELSE 'unknown' END"


@query(f"SELECT {_lang_sql(paths.FILE_LANGUAGES)} AS file_language, {_lang_sql({e: n for n, all_ in paths.FALLBACK_EXTENSIONS.items() for e in all_.split()} | paths.PARSER_LANGUAGES)} AS parser_language, count(*) AS n_files FROM {FILES} GROUP BY 1, 2")
def file_languages(spark, d):
    p = F.col("file_path")
    return _files(spark, d).groupBy(paths.file_language(p).alias("file_language"), paths.parser_language(p).alias("parser_language")).agg(F.count("*").alias("n_files"))


@query(f"SELECT 'users/u1/demo/' || file_path AS path, 'u1' AS user_id FROM {FILES}")
def namespaced_paths(spark, d):
    f = _files(spark, d).select(paths.namespaced(F.concat(F.lit("//"), "file_path"), F.lit("u1"), F.lit("demo")).alias("path"))
    return f.select("path", paths.namespace_user(F.col("path")).alias("user_id"))


# ---- store ---------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def hash_content(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT chunk_id, lower(content_hash) <> sha256(content) AS is_stale FROM (SELECT DISTINCT chunk_id, content_hash, content FROM code_chunks)")
def stale_hashes(spark, d):
    c = table(spark, d, "code_chunks").select("chunk_id", "content_hash", F.sha2("content", 256).alias("h")).distinct()
    return c.select("chunk_id", (F.lower("content_hash") != F.col("h")).alias("is_stale"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first_wins(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("WITH n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lower(lang) IN ('de', 'fr', 'es') AND text IS NOT NULL), e AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE NOT coalesce(lower(lang) IN ('de', 'fr', 'es'), false) AND text IS NOT NULL) SELECT doc_id, h FROM n WHERE h NOT IN (SELECT h FROM e) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1")
def insert_if_absent(spark, d):
    new, old = _old_new(spark, d)
    return store.insert_if_absent(old, new, ["h"], ["doc_id"])


def _old_new(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower("lang").isin("de", "fr", "es").alias("fresh"), F.sha2("text", 256).alias("h"))
    return docs.where("fresh").drop("fresh"), docs.where("not coalesce(fresh, false)").drop("fresh")


@query("WITH n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lower(lang) IN ('de', 'fr', 'es') AND text IS NOT NULL), e AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE NOT coalesce(lower(lang) IN ('de', 'fr', 'es'), false) AND text IS NOT NULL), i AS (SELECT count(DISTINCT h) AS inserted FROM n WHERE h NOT IN (SELECT h FROM e)) SELECT (SELECT count(*) FROM n) AS offered, inserted, (SELECT count(*) FROM n) - inserted AS skipped FROM i")
def ingest_counters(spark, d):
    new, old = _old_new(spark, d)
    return store.insert_counts(old, new, ["h"], ["doc_id"])


CHANGES = "(SELECT file_path AS path, CASE WHEN starts_with(split_part(file_path, '/', -1), 'c') THEN 'D' WHEN starts_with(split_part(file_path, '/', -1), 'r') THEN 'R' ELSE 'M' END AS status FROM (SELECT DISTINCT file_path FROM code_chunks) WHERE left(split_part(file_path, '/', -1), 1) IN ('c', 'r', 'm'))"


@query(
    f"SELECT chunk_id, file_path FROM (SELECT DISTINCT chunk_id, file_path FROM code_chunks) WHERE file_path NOT IN (SELECT path FROM {CHANGES}) AND file_path NOT IN (SELECT 'new/' || path FROM {CHANGES} WHERE status = 'R') UNION ALL SELECT 'again' AS chunk_id, CASE WHEN status = 'R' THEN 'new/' || path ELSE path END FROM {CHANGES} WHERE status IN ('M', 'R')"
)
def delta_sync(spark, d):
    chunks = table(spark, d, "code_chunks").select("chunk_id", "file_path").distinct()
    first = F.substring(paths.basename(F.col("file_path")), 1, 1)
    status = F.when(first == "c", "D").when(first == "r", "R100").otherwise("M")
    lines = _files(spark, d).where(first.isin("c", "r", "m")).select(F.concat_ws("\t", status, "file_path", F.when(first == "r", F.concat(F.lit("new/"), "file_path"))).alias("line"))
    return store.delta_sync(chunks, git.name_status(lines), lambda p: p.select(F.lit("again").alias("chunk_id"), F.col("path").alias("file_path")))


@query("SELECT chunk_id FROM (SELECT DISTINCT chunk_id, language, commit_hash FROM code_chunks) WHERE NOT coalesce(lower(language) = 'go' AND commit_hash IS DISTINCT FROM (SELECT min(commit_hash) FROM code_chunks), false)")
def delete_is_distinct(spark, d):
    c = table(spark, d, "code_chunks").select("chunk_id", "language", "commit_hash").distinct()
    keep = c.agg(F.min("commit_hash")).collect()[0][0]
    return store.delete_where(c, store.stale(F.lower("language") == "go", F.col("commit_hash"), keep)).select("chunk_id")


@query("SELECT c.chunk_id FROM (SELECT DISTINCT chunk_id, user_id FROM code_chunks) c WHERE c.user_id IS NULL OR c.user_id IN (SELECT user_id FROM users WHERE is_active)")
def cascade_delete(spark, d):
    return store.cascade(table(spark, d, "users").where("is_active"), table(spark, d, "code_chunks").select("chunk_id", "user_id").distinct(), "user_id").select("chunk_id")


@query("SELECT chunk_id, count(*) AS n_rows FROM code_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1")
def unique_violations(spark, d):
    return store.duplicates(table(spark, d, "code_chunks"), ["chunk_id"])


@query("SELECT count(*) AS n_null, count(*) FILTER (WHERE content IS NOT NULL) AS n_filled FROM code_chunks WHERE embedding IS NULL")
def regenerate_nulls(spark, d):
    c = table(spark, d, "code_chunks").where("embedding is null").select("content", "embedding")
    filled = store.fill_vectors(c, lambda t: F.when(t.isNotNull(), text.zero_vector(64)))
    return filled.agg(F.count("*").alias("n_null"), F.count("embedding").alias("n_filled"))


@query(f"SELECT p.user_id, p.project_name, 'known' AS kind FROM (SELECT DISTINCT user_id, project_name FROM projects) p UNION ALL SELECT user_id, 'fresh', 'created' FROM (SELECT DISTINCT user_id FROM users)")
def get_or_create(spark, d):
    p = table(spark, d, "projects")
    wanted = p.select("user_id", "project_name").union(table(spark, d, "users").select("user_id", F.lit("fresh").alias("project_name")))
    return store.get_or_create(p, wanted).select("user_id", "project_name", F.when(F.col("created"), "created").otherwise("known").alias("kind"))


@query(f"SELECT p.project_id, CAST(coalesce(n.c, 0) AS INT) AS total_chunks, CAST(coalesce(n.f, 0) AS INT) AS total_files FROM {LATEST_PROJECTS} p LEFT JOIN (SELECT project_id, count(*) AS c, count(DISTINCT file_path) AS f FROM {ONE_CHUNK} GROUP BY 1) n USING (project_id)")
def refresh_project_stats(spark, d):
    return store.refresh_stats(_projects(spark, d), _chunks(spark, d, "project_id", "file_path"), F.lit(None).cast("timestamp_ntz")).select("project_id", "total_chunks", "total_files")


@query("SELECT count(*) AS n_rows FROM (SELECT DISTINCT chunk_id, project_id FROM code_chunks) WHERE project_id IN (SELECT project_id FROM projects WHERE user_id = (SELECT min(user_id) FROM projects))")
def rls_semi_join(spark, d):
    p = table(spark, d, "projects")
    user = p.agg(F.min("user_id")).collect()[0][0]
    return store.scoped(table(spark, d, "code_chunks").select("chunk_id", "project_id").distinct(), p, user).agg(F.count("*").alias("n_rows"))


# ---- chunkers ------------------------------------------------------------------------------------------------------
@query("SELECT CAST(doc_id AS VARCHAR) AS file_path, 'file' AS chunk_type, 1 AS line_start, length(text) AS n_chars, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def chunk_file(spark, d):
    return chunking.file_chunks(_docs(spark, d)).select("file_path", "chunk_type", "line_start", F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("h"))


def _files_by_chunk(spark, d) -> DataFrame:
    """Chunks as files of (path, content), repeated rows included: they are dropped from the narrow results, not from the texts."""
    return table(spark, d, "code_chunks").where("content is not null").select(F.col("chunk_id").alias("path"), "content")


# greedy packing of the lines of long texts, one line a step
CHUNK_LINES = "(SELECT path, content, CASE WHEN t = '' THEN [] ELSE string_split(CASE WHEN suffix(t, chr(10)) THEN t[:-2] ELSE t END, chr(10)) END AS l FROM (SELECT DISTINCT chunk_id AS path, content, regexp_replace(content, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g') AS t FROM code_chunks WHERE content IS NOT NULL))"
PACKED = f"""WITH RECURSIVE big AS MATERIALIZED (SELECT path, list_transform(l, lambda x: length(x) + 1) AS w FROM {CHUNK_LINES} WHERE length(content) > 8000),
r AS (SELECT path, 1 AS i, 1 AS s, w[1] AS size FROM big UNION ALL SELECT r.path, r.i + 1, CASE WHEN r.size + w[r.i + 1] > 8000 THEN r.i + 1 ELSE r.s END, CASE WHEN r.size + w[r.i + 1] > 8000 THEN w[r.i + 1] ELSE r.size + w[r.i + 1] END FROM r JOIN big ON big.path = r.path WHERE r.i < len(w)),
spans AS (SELECT path, s, max(i) AS e FROM r GROUP BY 1, 2),
packed AS (SELECT path AS file_path, 'block' AS chunk_type, 'block_' || s || '_' || e AS chunk_name, CAST(s AS INT) AS line_start, CAST(e AS INT) AS line_end FROM spans UNION ALL SELECT path, 'file', path, 1, CAST(len(l) AS INT) FROM {CHUNK_LINES} WHERE length(content) <= 8000)
"""


@query(PACKED + "SELECT * FROM packed")
def chunk_greedy(spark, d):
    return chunking.block_chunks(_files_by_chunk(spark, d)).select("file_path", "chunk_type", "chunk_name", "line_start", "line_end").distinct()


@query(
    f"SELECT path AS file_path, CAST(section AS BIGINT) AS section, CAST(min(line_no) AS INT) AS line_start, CAST(max(line_no) AS INT) AS line_end, coalesce(max(CASE WHEN m THEN regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2) END), CASE WHEN bool_or(h) THEN 'Introduction' ELSE 'Content' END) AS title FROM "
    f"(SELECT *, sum(CAST(m AS INT)) OVER (PARTITION BY path ORDER BY line_no) AS section, max(CAST(m AS INT)) OVER (PARTITION BY path) = 1 AS h FROM (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') AS m FROM {ALL_LINES})) GROUP BY path, section"
)
def chunk_sections(spark, d):
    s = chunking.sections(_docs(spark, d).where(F.col("content") != ""))
    w = Window.partitionBy("file_path").orderBy("line_start")
    first = F.min(F.when(F.col("chunk_name").isin("Introduction", "Content") & F.col("symbols").contains('"level":0'), 0).otherwise(1)).over(Window.partitionBy("file_path"))
    return s.select("file_path", (F.row_number().over(w) - 1 + first).cast("bigint").alias("section"), "line_start", "line_end", F.col("chunk_name").alias("title"))


@query(
    PACKED + "SELECT file_path, line_start, line_end, CASE WHEN line_start > 1 THEN array_to_string(l[greatest(1, line_start - 3):line_start - 1], chr(10)) END AS context_before, "
    f"CASE WHEN line_end < len(l) THEN array_to_string(l[line_end + 1:least(len(l), line_end + 3)], chr(10)) END AS context_after FROM packed JOIN {CHUNK_LINES} f ON f.path = packed.file_path"
)
def chunk_overlap(spark, d):
    files = _files_by_chunk(spark, d)
    spans = chunking.block_chunks(files).select("file_path", "line_start", "line_end").distinct()
    return chunking.with_overlap(spans, files.distinct()).select("file_path", "line_start", "line_end", "context_before", "context_after")


@query()
def python_chunks(spark, d):
    """Rows only: definitions found by Python's own parser."""
    c = table(spark, d, "code_chunks").where("lower(language) = 'python' and content is not null").select(F.col("chunk_id").alias("path"), "content")
    return chunking.python_chunks(c).select("file_path", "chunk_type", "chunk_name", "line_start", "line_end").distinct()


SECTIONS = f"(SELECT path, section, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS h FROM (SELECT *, sum(CAST(regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') AS INT)) OVER (PARTITION BY path ORDER BY line_no) AS section FROM {ALL_LINES}) GROUP BY 1, 2)"


@query(
    f"WITH s AS (SELECT s.*, coalesce(lower(lang) = 'en', false) AS old FROM {SECTIONS} s JOIN documents ON CAST(doc_id AS VARCHAR) = path), f AS (SELECT count(*) AS files_processed FROM documents WHERE text IS NOT NULL), "
    "i AS (SELECT count(DISTINCT h) AS chunks_inserted FROM s WHERE h NOT IN (SELECT h FROM s WHERE old)), c AS (SELECT count(*) AS chunks_created FROM s) "
    "SELECT files_processed, chunks_created, chunks_inserted, chunks_created - chunks_inserted AS chunks_skipped, chunks_inserted AS embeddings_generated FROM f, i, c"
)
def ingest(spark, d):
    """Every document as a Markdown file into a project that holds the English ones: chunk, insert if absent, embed, count."""
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), "lang")
    old = chunking.chunk_files(docs.where("lower(lang) = 'en'")).select(F.lit("p").alias("project_id"), "content_hash")
    files = docs.drop("lang")
    return ingesting.ingest_stats(files, old, ingesting.ingest(files, old, "p"), "p")


@query("SELECT 'File: ' || file_path || chr(10) || 'Language: ' || language || chr(10) || CASE WHEN coalesce(chunk_name, '') <> '' THEN upper(chunk_type[1]) || chunk_type[2:] || ': ' || chunk_name || chr(10) ELSE '' END || chr(10) || 'Code:' || chr(10) || content AS embedding_text FROM (SELECT DISTINCT chunk_id, file_path, language, chunk_name, chunk_type, content FROM code_chunks WHERE language IS NOT NULL)")
def embed_text_template(spark, d):
    c = table(spark, d, "code_chunks").where("language is not null").select("chunk_id", "file_path", "language", "chunk_name", "chunk_type", "content").distinct()
    none = F.lit(None).cast("string")
    return c.select(text.embedding_text(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("chunk_name"), none, F.array().cast("array<string>"), F.col("content")).alias("embedding_text"))


# ---- reports -------------------------------------------------------------------------------------------------------
@query("SELECT kind, value, count(*) AS n FROM (SELECT unnest(['language', 'chunk_type']) AS kind, unnest([language, chunk_type]) AS value FROM code_chunks) WHERE value IS NOT NULL GROUP BY 1, 2")
def project_stats(spark, d):
    return reports.counts_long(table(spark, d, "code_chunks"), ["language", "chunk_type"])


@query("SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, round(avg(length(content)), 4) AS avg_chunk_size, (SELECT count(DISTINCT language) FROM code_chunks) AS n_languages FROM code_chunks")
def project_stats_totals(spark, d):
    s = reports.project_stats(table(spark, d, "code_chunks"))
    return s.select("total_chunks", "total_files", F.round("avg_chunk_size", 4).alias("avg_chunk_size"), F.size("languages").cast("bigint").alias("n_languages"))


@query("SELECT nullif(lower(trim(project_id)), '') AS project_id, string_agg(DISTINCT lower(language), ',' ORDER BY lower(language)) AS flags FROM code_chunks WHERE language IS NOT NULL GROUP BY 1")
def project_stats_flags(spark, d):
    c = table(spark, d, "code_chunks").where("language is not null").select(norm_key(F.col("project_id")).alias("project_id"), "language")
    return reports.language_flags(c).select("project_id", F.array_join(F.map_keys("flags"), ",").alias("flags"))


@query(f"SELECT p.project_id, p.project_name, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_files, 0) AS n_files, coalesce(n_languages, 0) AS n_languages, last_update FROM {LATEST_PROJECTS} p LEFT JOIN (SELECT project_id, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, count(DISTINCT language) AS n_languages, max(updated_at) AS last_update FROM {ONE_CHUNK} GROUP BY 1) USING (project_id)")
def project_overview(spark, d):
    return reports.overview(_projects(spark, d), _chunks(spark, d, "project_id", "file_path", "language"))


@query(f"SELECT p.project_id, p.project_name, p.current_commit_hash, coalesce(n_commits, 0) AS n_commits, last_commit, coalesce(n_chunks, 0) AS n_chunks FROM {LATEST_PROJECTS} p LEFT JOIN (SELECT project_id, count(DISTINCT commit_hash) AS n_commits, max(commit_timestamp) AS last_commit, count(*) AS n_chunks FROM {ONE_CHUNK} GROUP BY 1) USING (project_id)")
def sync_status(spark, d):
    return reports.sync_status(_projects(spark, d), _chunks(spark, d, "project_id", "commit_hash", "commit_timestamp"))


@query(f"SELECT p.project_name, c.chunk_type, count(*) AS n_chunks, round(avg(line_end - line_start + 1), 4) AS avg_lines FROM {ONE_CHUNK} c JOIN {LATEST_PROJECTS} p USING (project_id) GROUP BY p.project_id, 1, 2")
def chunk_stats(spark, d):
    return reports.chunk_stats(_projects(spark, d), _chunks(spark, d, "project_id", "chunk_type", "line_start", "line_end"))


@query(f"SELECT project_id, count(*) AS n_chunks, coalesce(string_agg(DISTINCT lower(language), ', ' ORDER BY lower(language)), '') AS languages FROM {ONE_CHUNK} GROUP BY 1")
def languages_per_project(spark, d):
    return reports.languages_per_project(_chunks(spark, d, "project_id", "language"))


@query("SELECT lower(language) AS language, count(*) AS n_chunks FROM code_chunks GROUP BY 1 ORDER BY 2 DESC, 1")
def chunks_by_language(spark, d):
    return table(spark, d, "code_chunks").groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "language")


@query("SELECT file_path, commit_hash, count(*) AS n_chunks, max(commit_timestamp) AS last_commit FROM code_chunks GROUP BY 1, 2")
def files_by_commit(spark, d):
    return reports.files_by_commit(table(spark, d, "code_chunks"))


@query(f"SELECT c.project_id, file_path, count(*) AS n_chunks FROM {ONE_CHUNK} c JOIN {LATEST_PROJECTS} p USING (project_id) WHERE lower(c.commit_hash) IS DISTINCT FROM lower(p.current_commit_hash) GROUP BY 1, 2")
def files_needing_reindex(spark, d):
    return reports.needing_reindex(_chunks(spark, d, "project_id", "file_path", "commit_hash"), _projects(spark, d))


@query("SELECT DISTINCT commit_hash, commit_timestamp, count(*) OVER (PARTITION BY commit_hash) AS n_chunks FROM code_chunks WHERE commit_hash IS NOT NULL ORDER BY commit_timestamp DESC NULLS LAST, commit_hash LIMIT 25")
def distinct_with_window(spark, d):
    return reports.commit_counts(table(spark, d, "code_chunks"), 25)


@query("SELECT chunk_id, count(*) OVER (PARTITION BY language) AS by_language, count(*) OVER (PARTITION BY chunk_type) AS by_type FROM (SELECT DISTINCT chunk_id, language, chunk_type FROM code_chunks)")
def window_counts(spark, d):
    c = table(spark, d, "code_chunks").select("chunk_id", "language", "chunk_type").distinct()
    return reports.counts_beside(c, {"language": "by_language", "chunk_type": "by_type"}).select("chunk_id", "by_language", "by_type")


@query(
    "WITH c AS (SELECT DISTINCT chunk_id, nullif(lower(trim(project_id)), '') AS project_id, file_path, chunk_name, content, branch_name FROM code_chunks) SELECT a.chunk_id AS old_id, b.chunk_id AS new_id, a.content <> b.content AS changed FROM c a JOIN c b ON a.project_id = b.project_id AND a.file_path = b.file_path AND a.chunk_name = b.chunk_name WHERE a.branch_name = 'main' AND b.branch_name <> 'main'"
)
def commit_compare(spark, d):
    c = table(spark, d, "code_chunks").select("chunk_id", norm_key(F.col("project_id")).alias("project_id"), "file_path", "chunk_name", "content", "branch_name").distinct()
    return reports.commit_compare(c, F.col("branch_name") == "main", F.col("branch_name") != "main").select("old_id", "new_id", "changed")


@query(
    f"SELECT a.adr_number, b.adr_number AS other_number, CASE WHEN a.supersedes_adr = b.adr_number THEN 'supersedes' WHEN a.superseded_by_adr = b.adr_number THEN 'superseded_by' ELSE 'related_to' END AS relation FROM {ONE_ADR} a JOIN {ONE_ADR} b ON a.supersedes_adr = b.adr_number OR a.superseded_by_adr = b.adr_number OR list_contains(a.related_adrs, b.adr_number) WHERE a.adr_number <> b.adr_number"
)
def relationships(spark, d):
    return reports.relationships(_adrs(spark, d))


@query(f"SELECT adr_number, title, status, decided_at FROM {ONE_ADR} WHERE list_contains(impacted_services, 'signal-svc') AND lower(status) IN ('accepted', 'proposed')")
def impacted_adrs(spark, d):
    return reports.impacted(_adrs(spark, d), "signal-svc")


@query(f"SELECT adr_number, title, decision_category, decided_at FROM {ONE_ADR} WHERE decision_category = 'performance' ORDER BY decided_at DESC NULLS LAST, adr_number")
def history_nulls_last(spark, d):
    return reports.history(_adrs(spark, d), category="performance")


@query(f"SELECT adr_number FROM {ONE_ADR} WHERE list_contains(technology_stack, 'schema')")
def array_member_filter(spark, d):
    return _adrs(spark, d).where(F.array_contains("technology_stack", "schema")).select("adr_number")


@query("SELECT 'users' AS table_name, count(*) AS n_rows FROM users UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'code_chunks', count(*) FROM code_chunks UNION ALL SELECT 'adrs', count(*) FROM adrs")
def table_counts(spark, d):
    return reports.table_counts({n: table(spark, d, n) for n in ("users", "projects", "code_chunks", "adrs")})


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def join_left_aggregate(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("SELECT o_orderkey, o_orderdate, count(*) AS n_lines, round(avg(l_quantity), 4) AS avg_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def join_inner_aggregate(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"))
    return table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "n_lines", "avg_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)")
def scalar_subquery(spark, d):
    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(1)
    return reports.of_scalar(table(spark, d, "orders"), "o_custkey", top, "c_custkey").select("o_orderkey")


# ---- events --------------------------------------------------------------------------------------------------------
@query("SELECT user_id, min(ts) AS started, count(*) AS n_events FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s")
def debounce(spark, d):
    return ev.debounce(table(spark, d, "events"), "user_id", "ts", 21600).select("user_id", "started", "n_events")


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT user_id, event_id, rn, ts AS last, true AS accepted FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.ts - r.last >= INTERVAL 6 HOUR THEN o.ts ELSE r.last END, o.ts - r.last >= INTERVAL 6 HOUR FROM o JOIN r ON o.user_id = r.user_id AND o.rn = r.rn + 1) SELECT event_id, accepted FROM r"
)
def rate_limit_leading(spark, d):
    return ev.rate_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 21600).select("event_id", "accepted")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_type NOT IN ('click', 'view') THEN 'ignored' WHEN CAST(json_extract_string(props, '$.k') AS INT) < 10 THEN 'error' WHEN value > 50 THEN 'rate_limited' ELSE 'accepted' END AS status FROM events) GROUP BY 1")
def webhook_route(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "push").otherwise(F.col("event_type"))
    url = F.when(F.get_json_object("props", "$.k").cast("int") >= 10, "https://git.example/a/b.git")
    return e.groupBy(ev.route(kind, url, F.col("value") > 50).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_request_count(spark, d):
    return ev.trailing_count(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "in_window")


@query("SELECT user_id, max(ts) AS last_update, count(*) AS n_files, CAST(floor((epoch(TIMESTAMP '2024-02-05 00:00:00') - epoch(max(ts))) / 86400) AS BIGINT) AS idle_days FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 6 DAY")
def idle_projects(spark, d):
    return reports.idle(table(spark, d, "events"), "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-02-05 00:00:00")), 6)


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE m < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 6 DAY) AS idle, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS skipped FROM (SELECT max(ts) AS m FROM events GROUP BY user_id)")
def idle_report(spark, d):
    return reports.idle_report(table(spark, d, "events"), "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-02-05 00:00:00")), 6)


# ---- symbols -------------------------------------------------------------------------------------------------------
def _sources(spark, d) -> DataFrame:
    """Chunks as source files; repeated rows give repeated symbols, which are dropped after parsing."""
    return table(spark, d, "code_chunks").where("content is not null").select(F.concat_ws("/", "chunk_id", F.lower("file_path")).alias("path"), "content")


def _symbols(spark, d) -> DataFrame:
    return symbols.symbols(_sources(spark, d)).dropDuplicates(["symbol_id"])


@query()
def symbol_type_counts(spark, d):
    """Rows only: parsers are imperative; tests hold golden symbols."""
    return symbols.type_counts(_symbols(spark, d).select("symbol_id", "type"))


@query()
def file_summary(spark, d):
    """Rows only, as symbol_type_counts."""
    return symbols.file_summary(_symbols(spark, d)).select("file", "symbol_count", F.size("functions").alias("n_functions"), F.size("methods").alias("n_methods"))


@query()
def call_graph(spark, d):
    """Rows only, as symbol_type_counts. Files are put together from their chunks, in line order, one text a project and path."""
    c = table(spark, d, "code_chunks").where("content is not null").select("chunk_id", norm_key(F.col("project_id")).alias("project_id"), "file_path", "line_start", "content").dropDuplicates(["chunk_id"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("line_start", F.lit(0)).alias("line"), "chunk_id", "content"))), lambda x: x["content"]), "\n")
    files = c.groupBy("project_id", "file_path").agg(body.alias("content")).select(F.concat_ws("/", "project_id", F.lower("file_path")).alias("path"), "content")
    return symbols.calls(symbols.symbols(files))


PACKAGES = "regexp_extract(content, '(?m)^package\\s+(\\w+)', 1)"


@query(
    f"SELECT chunk_id, CAST(len(l) AS INT) AS line_count, CASE WHEN regexp_matches(content, '(?m)^package\\s+(\\w+)') THEN {PACKAGES} END AS package, "
    "len(regexp_extract_all(content, '(?m)^import\\s+(?:[\\w.]+\\s+)?\"([^\"]+)\"')) + len(regexp_extract_all(regexp_extract(content, '(?m)^import\\s*\\(([^)]*)\\)', 1), '\"[^\"]+\"')) AS n_imports "
    f"FROM (SELECT f.path AS chunk_id, f.l, f.content FROM {CHUNK_LINES} f JOIN (SELECT DISTINCT chunk_id FROM code_chunks WHERE suffix(lower(file_path), '.go')) g ON g.chunk_id = f.path)"
)
def go_file_details(spark, d):
    c = table(spark, d, "code_chunks").where(paths.extension(F.col("file_path")) == ".go").where("content is not null").select(F.concat("chunk_id", F.lit(".go")).alias("path"), "content")
    r = symbols.file_details(c).distinct()
    return r.select(paths.stem(F.col("path")).alias("chunk_id"), "line_count", "package", F.size("imports").cast("bigint").alias("n_imports"))


@query()
def file_details(spark, d):
    """Rows only: imports, exports and packages of every language; tests hold golden statements, go_file_details an oracle."""
    return symbols.file_details(_sources(spark, d)).select("path", "language", "line_count", F.size("imports").alias("n_imports"), F.size("exports").alias("n_exports"), "package").distinct()


@query(f"SELECT chunk_id, CASE WHEN starts_with(chunk_name, 'get') THEN 'g' ELSE 'o' END AS kind, regexp_extract(l, '^func\\s+([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\])?\\(', 1) AS name FROM (SELECT DISTINCT chunk_id, chunk_name, string_split(content, chr(10))[1] AS l FROM code_chunks WHERE suffix(file_path, '.go')) WHERE regexp_matches(l, '^func\\s+([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\])?\\(')")
def go_functions(spark, d):
    """The Go parser as pure column expressions over first lines."""
    rx = dict((k, r) for k, r in symbols.DECLARATIONS["go"])["function"]
    c = table(spark, d, "code_chunks").where(F.col("file_path").endswith(".go")).select("chunk_id", "chunk_name", F.split("content", "\n")[0].alias("l")).distinct()
    return c.where(F.col("l").rlike(rx)).select("chunk_id", F.when(F.col("chunk_name").startswith("get"), "g").otherwise("o").alias("kind"), F.regexp_extract("l", rx, 1).alias("name"))


# ---- references that lead nowhere ----------------------------------------------------------------------------------
ORPHANS = """
WITH p AS (SELECT lower(trim(project_id)) AS k, min(created_at) AS made FROM projects GROUP BY 1),
a AS (SELECT adr_number AS k, min(created_at) AS made FROM adrs GROUP BY 1),
c AS (SELECT chunk_id, nullif(lower(trim(project_id)), '') AS k, min(created_at) AS made FROM code_chunks WHERE project_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT id, 'supersedes_adr' AS f, supersedes_adr AS k, created_at AS made FROM adrs UNION SELECT id, 'related_adrs', unnest(related_adrs), created_at FROM adrs),
o AS (
SELECT 'code_chunks' AS table_name, chunk_id AS record_id, 'project_id' AS field_name, c.k AS ref_key, c.made FROM c LEFT JOIN p ON c.k = p.k WHERE c.k IS NOT NULL AND (p.k IS NULL OR p.made > c.made)
UNION ALL SELECT 'adrs', id, f, CAST(s.k AS VARCHAR), s.made FROM s LEFT JOIN a ON s.k = a.k WHERE s.k IS NOT NULL AND s.k <> 0 AND (a.k IS NULL OR a.made > s.made))
"""


def _orphans(spark, d) -> DataFrame:
    return references.index_orphans(*[table(spark, d, n) for n in ("code_chunks", "adrs", "projects", "cleanup_log")])


@query(ORPHANS + "SELECT table_name, record_id, field_name, ref_key, strftime(made, '%Y-%m') AS period FROM o")
def p3_found(spark, d):
    return _orphans(spark, d).select("table_name", "record_id", "field_name", "ref_key", "period")


@query(ORPHANS + "SELECT table_name, field_name, strftime(made, '%Y-%m') AS period, count(*) AS n_references FROM o GROUP BY ALL")
def p3_report(spark, d):
    r = references.orphan_report(_orphans(spark, d))
    return r.groupBy("table_name", "field_name", "period").agg(F.sum("n_references").alias("n_references"))


@query(
    ORPHANS.replace("AS ref_key, c.made FROM", "AS ref_key, c.made, p.k IS NULL AS gone FROM").replace("CAST(s.k AS VARCHAR), s.made FROM", "CAST(s.k AS VARCHAR), s.made, a.k IS NULL FROM")
    + ", r AS (SELECT o.*, CASE WHEN NOT gone THEN 'late' WHEN d.at IS NULL THEN 'missing' WHEN d.at >= made THEN 'deleted_later' ELSE 'deleted' END AS reason FROM o LEFT JOIN (SELECT CASE lower(entity) WHEN 'project' THEN 'code_chunks' ELSE 'adrs' END AS t, lower(trim(entity_key)) AS k, max(deleted_at) AS at FROM cleanup_log GROUP BY 1, 2) d ON d.t = o.table_name AND d.k = o.ref_key) "
    "SELECT table_name, field_name, reason, strftime(made, '%Y-%m') AS period, count(*) AS n_references FROM r GROUP BY ALL"
)
def p3_reasons(spark, d):
    """Orphans by reason: missing, deleted, deleted_later, late."""
    return references.orphan_report(_orphans(spark, d))
