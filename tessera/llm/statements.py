"""DuckDB statements of the training-data queries, by brute force over the whole tables."""

ALIKE = """c AS (SELECT DISTINCT chunk_id, content FROM code_chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL),
t AS (SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM c),
s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM t WHERE len(w) >= 30),
x AS (SELECT chunk_id, len(s) AS n, unnest(s) AS g FROM s),
alike AS (SELECT a, b FROM (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k, any_value(x.n) AS n, any_value(y.n) AS m FROM x JOIN x y ON x.g = y.g AND x.chunk_id < y.chunk_id AND least(x.n, y.n) >= 0.7 * greatest(x.n, y.n) - 1e-9 GROUP BY 1, 2) WHERE k >= 0.7 * (n + m - k) - 1e-9)"""

P1_FOUND = "WITH " + ALIKE + " SELECT a AS chunk_id_a, b AS chunk_id_b FROM alike"

P1_GROUPS = "WITH RECURSIVE " + ALIKE + """, two AS MATERIALIZED (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike), r AS (SELECT chunk_id AS a, chunk_id AS b FROM s UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a)
SELECT r.a AS chunk_id, min(r.b) AS group_id, coalesce(any_value(l.n), 0) AS n_links FROM r LEFT JOIN (SELECT a, count(*) AS n FROM two GROUP BY 1) l ON r.a = l.a GROUP BY 1"""

TURNED_AWAY = "WITH RECURSIVE " + ALIKE + """,
o AS (SELECT lower(commit_hash) AS commit, min(received_at) AS at FROM ingest_runs GROUP BY 1),
n AS (SELECT chunk_id, any_value(nullif(lower(trim(project_id)), '')) AS project, any_value(lower(content_hash)) AS h, min(CASE WHEN commit_hash IS NULL THEN -4611686018427387904 ELSE coalesce(epoch_us(o.at), 4611686018427387904) END) AS at FROM code_chunks LEFT JOIN o ON lower(commit_hash) = o.commit WHERE chunk_id IS NOT NULL AND nullif(lower(trim(project_id)), '') IS NOT NULL GROUP BY 1),
l AS (SELECT x.chunk_id AS x, y.chunk_id AS y FROM n x JOIN n y ON x.project = y.project AND x.h = y.h AND y.at < x.at
UNION SELECT CASE WHEN p.at > q.at THEN a ELSE b END, CASE WHEN p.at > q.at THEN b ELSE a END FROM alike JOIN n p ON p.chunk_id = a JOIN n q ON q.chunk_id = b WHERE p.project = q.project AND p.at <> q.at),
k AS MATERIALIZED (SELECT n.chunk_id AS id, coalesce(list(l.y) FILTER (WHERE l.y IS NOT NULL), []) AS ys, dense_rank() OVER (ORDER BY any_value(n.at)) AS k FROM n LEFT JOIN l ON l.x = n.chunk_id WHERE n.chunk_id IN (SELECT x FROM l UNION SELECT y FROM l) GROUP BY 1),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS acc UNION ALL SELECT r.k + 1, list_concat(r.acc, coalesce((SELECT list(k.id) FROM k WHERE k.k = r.k + 1 AND NOT list_has_any(k.ys, r.acc)), [])) FROM r WHERE r.k < (SELECT max(k) FROM k)),
away AS (SELECT id AS chunk_id FROM k, (SELECT acc FROM r ORDER BY k DESC LIMIT 1) WHERE NOT list_contains(acc, id))
"""
P6_FOUND = TURNED_AWAY + "SELECT chunk_id FROM away"
P6_REPORT = TURNED_AWAY + "SELECT n.project AS project, n.at AS at, count(*) AS chunks, count(*) FILTER (WHERE chunk_id NOT IN (SELECT chunk_id FROM away)) AS accepted, count(*) FILTER (WHERE chunk_id IN (SELECT chunk_id FROM away)) AS turned_away FROM n GROUP BY 1, 2"


def _vectors(name: str, key: str) -> str:
    return f"(SELECT {key} AS id, any_value(CAST(embedding AS DOUBLE[64])) AS e FROM {name} WHERE len(embedding) = 64 AND {key} IS NOT NULL AND NOT isnan(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 GROUP BY 1)"


def _nearest(name: str, key: str) -> str:
    sim = "array_cosine_similarity(p.e, q.e)"
    v = _vectors(name, key)
    return f"SELECT '{name}' AS t, p.id AS id, q.id AS other, {sim} AS sim FROM {v} p, {v} q WHERE p.id <> q.id QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {sim} DESC, q.id) <= 5"


NEAREST = f"({_nearest('code_chunks', 'chunk_id')} UNION ALL {_nearest('adrs', 'id')})"
P4_FOUND = f"SELECT DISTINCT t AS table_name, least(id, other) AS id_a, greatest(id, other) AS id_b FROM {NEAREST} WHERE sim >= 0.9"
_HEX = "string_split(regexp_replace(lower(id), '[^0-9a-f]', '', 'g'), '')"
P4_NEIGHBOURS = f"SELECT t AS table_name, id, other AS neighbour, round(sim, 4) AS sim FROM {NEAREST} WHERE list_sum(list_transform({_HEX}, lambda c: CAST('0x' || c AS INT))) % 5 = 0 AND CAST('0x' || {_HEX}[-1] AS INT) % 4 = 0"

P5_FOUND = "SELECT DISTINCT chunk_id FROM code_chunks WHERE length(content) > 8000"
P5_RESTORED = "SELECT DISTINCT chunk_id, sha256(content) AS restored, coalesce(line_start, 1) AS first_line, false AS too_long, false AS lines_amiss FROM code_chunks WHERE length(content) > 8000"

P9_BOUNDS = "SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') AS source, false AS over_budget, false AS too_often, false AS short_without_cause FROM mix_targets WHERE source IS NOT NULL"
