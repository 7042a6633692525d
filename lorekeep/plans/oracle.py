"""DuckDB SQL for the registered queries, over the same derived tables as ``views``."""

from __future__ import annotations

from ..functions.text import BEARER, FILLERS, KEY_VALUE, PARTICLE, PARTICLES, SECRETS, STOPWORDS, URL_PASSWORD
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
HIDDEN = "('_trash', '_superseded')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(map(_quoted, values)) + ")"


MEMORIES = f"""
memories AS (
  SELECT d.doc_id, 'doc_' || d.doc_id AS id,
    CASE WHEN d.doc_id % 97 = 5 THEN '_trash' WHEN d.doc_id % 97 = 11 THEN '_superseded' WHEN d.doc_id % 89 = 3 THEN 'playbook' WHEN d.doc_id % 83 = 7 THEN 'root' ELSE d.source END AS project,
    d.text AS document, CAST(e.embedding AS DOUBLE[]) AS embedding,
    TIMESTAMP '2024-01-01' + to_hours((d.doc_id * 7 % 8000)::INT) AS created_at,
    TIMESTAMP '2024-01-01' + to_hours((d.doc_id * 7 % 8000)::INT) + to_days((d.doc_id % 10)::INT) AS updated_at,
    CASE d.doc_id % 5 WHEN 1 THEN 'auto_log' WHEN 2 THEN 'filtered' WHEN 3 THEN 'consolidated' ELSE 'manual' END AS chunk_type,
    CASE d.doc_id % 4 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' ELSE 'log' END AS importance,
    CASE d.doc_id % 6 WHEN 1 THEN 'failure' WHEN 2 THEN 'correction' WHEN 3 THEN 'insight' WHEN 4 THEN 'convention' ELSE 'general' END AS category,
    CASE d.doc_id % 7 WHEN 0 THEN 'rule' WHEN 1 THEN 'fact' WHEN 2 THEN 'procedure' ELSE 'record' END AS memory_kind,
    d.doc_id % 11 = 0 AS pinned, d.doc_id % 13 = 0 AS sensitive,
    CASE WHEN d.doc_id % 97 IN (5, 11) THEN d.source END AS scope_project,
    CASE WHEN d.doc_id % 97 = 5 THEN d.source END AS original_project,
    CASE WHEN d.doc_id % 97 = 5 THEN TIMESTAMP '2024-01-01' + to_hours((d.doc_id * 7 % 8000)::INT) + to_days(3) END AS trashed_at,
    CASE WHEN d.doc_id % 41 = 0 AND d.doc_id > 0 THEN 'doc_' || (d.doc_id - 1) END AS supersedes,
    CASE WHEN d.doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_hours((d.doc_id * 7 % 8000)::INT) + to_days(20) END AS reviewed_at,
    CASE WHEN d.doc_id % 9 = 0 THEN CAST((d.doc_id % 120) / 100.0 AS FLOAT) END AS confidence
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), visible AS (SELECT * FROM memories WHERE project NOT IN {HIDDEN})"""
TURNS = """
turns AS (
  SELECT 'turn_' || conv_id || '_' || turn AS id, 'conv' || (conv_id % 5) AS project, text AS document,
    TIMESTAMP '2024-01-01' + to_minutes(conv_id::INT) + to_seconds(turn::INT) AS created_at, CAST(conv_id AS VARCHAR) AS session_id, role,
    conv_id || ':' || turn AS event_id
  FROM conversations WHERE role IN ('user', 'assistant')
), numbered AS (SELECT *, row_number() OVER (PARTITION BY project, session_id ORDER BY created_at, id) AS turn_no FROM turns)"""
ASKED = f"""
queries AS (
  SELECT b.item_id AS query_id, b.text, CAST(e.embedding AS DOUBLE[]) AS embedding,
    CASE WHEN b.item_id % 3 = 1 THEN ['src' || (b.item_id % 20), 'playbook'] WHEN b.item_id % 3 = 2 THEN ['src1', 'src2', 'src3', 'root'] ELSE CAST([] AS VARCHAR[]) END AS scope,
    10 AS n, {NOW} AS as_of, CASE WHEN b.item_id % 3 = 0 THEN 40 ELSE 200 END AS candidates
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
)"""


def _tokens(text: str) -> str:
    return f"[t FOR t IN regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') IF strlen(t) <= 40]"


def _bm25(rows: str, k: str = "q.candidates", scoped: bool = True, out: str = "t_list") -> str:
    """Text lists from a table of (id, project, document)."""
    scope = "WHERE len(q.scope) = 0 OR list_contains(q.scope, h.project)" if scoped else ""
    return f"""
docs_t AS (SELECT id, project, {_tokens("document")} AS toks FROM {rows}),
stats_t AS (SELECT count(*) AS documents, avg(len(toks)) AS average FROM docs_t),
terms_t AS (SELECT DISTINCT query_id, unnest(toks) AS term FROM (SELECT query_id, {_tokens("text")} AS toks FROM queries)),
post_t AS (SELECT id, project, length, term, count(*) AS tf FROM (SELECT id, project, len(toks) AS length, unnest(toks) AS term FROM docs_t) WHERE term IN (SELECT term FROM terms_t) GROUP BY ALL),
df_t AS (SELECT term, count(*) AS df FROM post_t GROUP BY term),
weight_t AS (SELECT p.term, p.id, p.project, ln(1 + (documents - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average)) AS w FROM post_t p JOIN df_t USING (term), stats_t),
hits_t AS (SELECT query_id, id, project, round(sum(w), 6) AS score FROM terms_t JOIN weight_t USING (term) GROUP BY ALL),
{out} AS (SELECT * FROM (SELECT h.query_id, h.id, h.score, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id) - 1 AS rank, {k} AS k FROM hits_t h JOIN queries q USING (query_id) {scope}) WHERE rank < k)"""


def _syntax() -> str:
    """Text lists of ``views.syntax_queries``: what each form means, leaf by leaf. Leaves: (form, leaf, its words' numbers)."""
    plain = {0: (0, 1), 9: (0, "s", 1), 10: (0,), 13: ("other", 0, 1)}
    trees = {1: ((0,), (1,)), 2: ((0, 1),), 3: ((0,), (1,), (2,)), 4: ((0,), (1,), (2,)), 5: ((0,), (1,)), 6: ((0,),), 7: ((0,), (1,)), 8: ((0, 1, 2), (3,), (4,)), 11: ((0,), (1, 2)), 12: ((0, 1),)}
    word = lambda i: f"coalesce(w[{i + 1}], 'none')" if isinstance(i, int) else _quoted(i)
    parts = [f"SELECT DISTINCT query_id, form, 'x' || t AS leaf, [t] AS terms FROM (SELECT query_id, form, unnest([{', '.join(map(word, own))}]) AS t FROM form_s WHERE form = {f})" for f, own in plain.items()]
    parts += [f"SELECT query_id, form, '{'abc'[i]}' AS leaf, [{', '.join(map(word, own))}] AS terms FROM form_s WHERE form = {f}" for f, tree in trees.items() for i, own in enumerate(tree)]
    holds = "CASE form WHEN 1 THEN a > 0 AND b > 0 WHEN 3 THEN a > 0 AND b IS NULL WHEN 4 THEN (a > 0 OR b > 0) AND c > 0 WHEN 5 THEN a > 0 AND b IS NULL WHEN 6 THEN a > 0 AND p > 0 WHEN 8 THEN a > 0 OR b > 0 AND c IS NULL ELSE total > 0 END"
    score = "CASE form WHEN 3 THEN a + coalesce(c, 0) WHEN 5 THEN a WHEN 6 THEN a + p WHEN 7 THEN 3 * coalesce(a, 0) + coalesce(b, 0) WHEN 8 THEN coalesce(a, 0) + CASE WHEN c IS NULL THEN coalesce(b, 0) ELSE 0 END ELSE total END"
    return f"""
form_s AS (SELECT query_id, query_id % 14 AS form, scope, candidates, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM queries),
leaf_s AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE list_max([strlen(t) FOR t IN terms]) <= 40),
docs_s AS (SELECT id, project, {_tokens("document")} AS kept, regexp_extract_all(lower(document), '[\\p{{L}}\\p{{N}}]+') AS toks FROM visible),
stats_s AS (SELECT count(*) AS documents, avg(len(kept)) AS average FROM docs_s),
word_s AS (SELECT query_id, form, leaf, len(terms) AS n, unnest(terms) AS term, unnest(range(len(terms))) AS offs FROM leaf_s),
tok_s AS (SELECT id, length, term, pos FROM (SELECT id, len(kept) AS length, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM docs_s) WHERE term IN (SELECT term FROM word_s)),
df_s AS (SELECT term, count(DISTINCT id) AS df FROM tok_s GROUP BY term),
idf_s AS (SELECT query_id, leaf, sum(ln(1 + (documents - df + 0.5) / (df + 0.5))) AS idf FROM word_s JOIN df_s USING (term), stats_s GROUP BY ALL),
place_s AS (SELECT query_id, form, leaf, id, length, pos - offs AS place FROM word_s JOIN tok_s USING (term) GROUP BY ALL HAVING count(*) = any_value(n)),
hit_s AS (SELECT query_id, form, leaf, id, idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average)) AS s FROM (SELECT query_id, form, leaf, id, length, count(*) AS tf FROM place_s GROUP BY ALL) JOIN idf_s USING (query_id, leaf), stats_s
  UNION ALL SELECT query_id, 6, 'p', id, ln(1 + (documents - n + 0.5) / (n + 0.5)) FROM form_s JOIN (SELECT id, project, count(*) OVER (PARTITION BY project) AS n FROM docs_s) d ON d.project = 'src' || (query_id % 20), stats_s WHERE form = 6),
held_s AS (SELECT query_id, form, id, sum(s) AS total, {', '.join(f"sum(s) FILTER (leaf = '{x}') AS {x}" for x in 'abcp')} FROM hit_s GROUP BY ALL),
list_s AS (SELECT * FROM (SELECT h.query_id, h.id, score, row_number() OVER (PARTITION BY h.query_id ORDER BY score DESC, h.id) - 1 AS rank, candidates FROM (SELECT query_id, id, round({score}, 6) AS score FROM held_s WHERE {holds}) h JOIN form_s q USING (query_id) JOIN docs_s d USING (id) WHERE len(q.scope) = 0 OR list_contains(q.scope, d.project)) WHERE rank < candidates)"""


VECTORS = """
v_list AS (SELECT * FROM (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank, candidates FROM (
    SELECT q.query_id, q.candidates, m.id, abs(round(1 - list_cosine_similarity(q.embedding, m.embedding), 6)) AS distance
    FROM queries q JOIN visible m ON len(q.scope) = 0 OR list_contains(q.scope, m.project)
    WHERE q.embedding IS NOT NULL AND m.embedding IS NOT NULL)) WHERE rank < candidates)"""
FUSED = """
fused AS (SELECT query_id, id, round((coalesce(10.0 / (10.0 + v.rank), 0) + 0.5 * coalesce(10.0 / (10.0 + t.rank), 0)) / 1.5, 6)::DOUBLE AS fused, v.distance, t.score AS text_score
  FROM v_list v FULL JOIN t_list t USING (query_id, id))"""


def _keywords(text: str) -> str:
    sep = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085},;:!?''\"()\\[\\]{}]+"
    strip = f"CASE WHEN t IN {_list(PARTICLES)} THEN t ELSE regexp_replace(t, '{PARTICLE}', '\\1') END"
    return f"[w FOR w IN [{strip} FOR t IN regexp_split_to_array({text}, '{sep}') IF length(t) >= 2] IF length(w) >= 2 AND lower(w) NOT IN {_list(STOPWORDS)}]"


def _topics(text: str) -> str:
    """Topic keywords in order: each at its first place."""
    bare = f"[lower(regexp_replace(regexp_replace(k, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')) FOR k IN {_keywords(text)}]"
    return f"[w FOR w IN {bare} IF length(w) >= 2 AND w NOT IN {_list(FILLERS)}]"


def _ordered_distinct(words: str) -> str:
    return f"list_filter({words}, lambda x, i: list_position({words}, x) = i)"


def _fold(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spaced(text: str) -> str:
    return f"(' ' || regexp_replace({_fold(text)}, '[^0-9a-z]', ' ', 'g') || ' ')"


def _redact(text: str) -> str:
    out = text
    for p in SECRETS:
        out = f"regexp_replace({out}, {_quoted(p.replace('@', chr(92) + 'b'))}, '[REDACTED_SECRET]', 'g')"
    out = f"regexp_replace({out}, {_quoted(KEY_VALUE)}, '\\1: [REDACTED]', 'g')"
    out = f"regexp_replace({out}, {_quoted(BEARER)}, 'Bearer [REDACTED]', 'g')"
    return f"regexp_replace({out}, {_quoted(URL_PASSWORD)}, '\\1[REDACTED]@', 'g')"


def _one_line(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _scored(extra: str = "", wide: bool = False, reserved: bool = False) -> str:
    """Filtered candidates with on_topic; turns are none of the memories, so their bonus is none."""
    two, one, other = (0.95, 0.9, 0.97) if wide else (0.18, 0.13, 0.21)
    drop = " AND m.project NOT IN ('root', 'default', 'global')" if reserved else ""
    return f"""
words AS MATERIALIZED (SELECT query_id, list_filter(words, lambda w: true) AS words, list_distinct(topics) AS topics FROM (SELECT query_id, {_keywords("text")} AS words, {_topics("text")} AS topics FROM queries)),
rows_s AS (
  SELECT f.query_id, f.id, f.fused, f.distance AS listed, f.text_score, m.project, m.document, m.chunk_type, m.importance, m.updated_at, q.as_of, q.n, w.words, w.topics,
    len([k FOR k IN w.words IF contains(lower(m.document), lower(k))])::DOUBLE / nullif(len(w.words), 0) AS ratio,
    abs(round(1 - list_cosine_similarity(q.embedding, m.embedding), 6)) AS distance
  FROM fused f JOIN memories m USING (id) JOIN queries q USING (query_id) JOIN words w USING (query_id)
  WHERE NOT m.sensitive AND m.project NOT IN {HIDDEN}{drop} AND (len(q.scope) = 0 OR list_contains(q.scope, m.project)){extra}),
topic_s AS (
  SELECT *, coalesce(hits >= 2 AND distance <= {two} OR hits >= 1 AND distance <= {one}, false) AS on_topic FROM (
    SELECT *, len([k FOR k IN topics IF CASE WHEN regexp_matches(k, '^[0-9a-z]+$') THEN contains({_spaced("document")}, ' ' || k || ' ') ELSE contains(lower(document), k) END]) AS hits FROM rows_s))"""


def _admitted(on_topic: bool = False, name: str = "scored") -> str:
    only = "WHERE on_topic" if on_topic else ""
    return f"""
near_s AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, lexical, near ORDER BY fused DESC, id) AS place FROM (
    SELECT *, text_score IS NOT NULL AND coalesce(ratio, 0) > 0 AS lexical, coalesce(listed <= 0.7, false) AS near FROM topic_s {only})),
{name} AS (
  SELECT *, round(CASE WHEN coalesce(ratio, 0) = 0 THEN least(0.1 * fused, 0.049) ELSE 0.1 * fused END + 0.08 * coalesce(ratio, 0)
    + CASE importance WHEN 'knowledge' THEN 0.10 WHEN 'preference' THEN 0.08 WHEN 'decision' THEN 0.05 ELSE 0 END
    + CASE chunk_type WHEN 'manual' THEN 0.10 WHEN 'consolidated' THEN 0.03 WHEN 'auto_log' THEN -0.05 ELSE 0 END
    - least(greatest(datesub('second', updated_at, as_of), 0) / 86400.0 * 0.008, 0.30), 9)::DOUBLE AS score
  FROM near_s WHERE lexical OR near AND place <= CASE WHEN len(words) >= 2 THEN 3 ELSE 0 END)"""


def _diversified(rows: str, order: str, out: str) -> str:
    return f"""
{out} AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, {order}) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY {order}) > greatest(n // 2, 1) AS deferred FROM {rows})) WHERE rank <= n)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _chosen(rows: str, out: str) -> str:
    """The greedy choice by relevance and difference: one row a query and step, with the numbers chosen so far."""
    return f"""
cand_m AS MATERIALIZED (SELECT query_id, id, project, n, document, score, embedding, row_number() OVER w AS i, CASE WHEN max(score) OVER q - min(score) OVER q <= 1.1920928955078125e-07 THEN 1 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END AS rel
  FROM (SELECT s.*, m.embedding FROM {rows} s JOIN memories m USING (id)) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id), q AS (PARTITION BY query_id)),
near_m AS MATERIALIZED (SELECT a.query_id, a.i, b.i AS j, CASE WHEN a.embedding IS NULL THEN 1 WHEN b.embedding IS NULL THEN 0 ELSE greatest(list_cosine_similarity(a.embedding, b.embedding), 0) END AS near FROM cand_m a JOIN cand_m b ON a.query_id = b.query_id AND a.i <> b.i),
step_m AS (
  SELECT query_id, 1 AS step, [1::BIGINT] AS chosen FROM cand_m WHERE i = 1
  UNION ALL
  SELECT query_id, any_value(step) + 1, list_append(any_value(chosen), arg_max(i, (value, -i))) FROM (
    SELECT r.query_id, r.step, r.chosen, c.i, round(0.5 * any_value(c.rel) - 0.5 * max(d.near), 9) AS value
    FROM step_m r JOIN cand_m c ON c.query_id = r.query_id AND r.step < c.n AND NOT list_contains(r.chosen, c.i) JOIN near_m d ON d.query_id = c.query_id AND d.i = c.i AND list_contains(r.chosen, d.j) GROUP BY ALL)
  GROUP BY query_id),
{out} AS (SELECT c.query_id, rank, c.id, c.project, c.score, c.document FROM (SELECT query_id, unnest(chosen) AS i, unnest(range(1, len(chosen) + 1)) AS rank FROM (SELECT query_id, arg_max(chosen, step) AS chosen FROM step_m GROUP BY query_id)) JOIN cand_m c USING (query_id, i))"""


LISTS = (MEMORIES, ASKED, VECTORS, _bm25("visible"), FUSED)
#: The same queries over all projects.
ASKED_WIDE = ASKED[: ASKED.index("CASE")] + "CAST([] AS VARCHAR[])" + ASKED[ASKED.index(" AS scope") : ASKED.index(" CASE", ASKED.index(" AS scope"))] + " 40 AS candidates FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id\n)"
M, T = _with(MEMORIES), _with(TURNS)
PLAIN = "chunk_type = 'manual'"
JOBS = "jobs AS (SELECT event_id % 500 AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS state, ts AS updated_at, value AS ms FROM events)"
AUDIT = "audit AS (SELECT event_id AS id, ts AS created_at, CASE WHEN user_id % 7 = 0 THEN 'unauthenticated' ELSE 'user' || user_id END AS actor, event_type AS action, CASE WHEN event_type = 'error' THEN 'denied' ELSE 'allowed' END AS outcome FROM events)"
WORKSPACES = "workspaces AS (SELECT 'ws' || s_suppkey AS workspace_id, CASE WHEN s_suppkey % 4 <> 0 THEN 'src' || (s_suppkey % 60) END AS legacy_project, s_suppkey FROM supplier)"
PRINCIPALS = "principals AS (SELECT n_name AS principal, n_nationkey = 0 AS admin, ['src' || ((n_nationkey * 3 + i) % 20) FOR i IN [0, 1, 2, 3]] AS read_projects FROM nation)"
RELEVANT = "relevance AS (SELECT b.item_id AS query_id, m.id FROM memories m JOIN benchmark b ON contains(m.document, b.text))"
JUDGED = "lists AS (SELECT query_id, list(id ORDER BY rank) AS ranked FROM t_list GROUP BY query_id), rel AS (SELECT query_id, list_sort(list(DISTINCT id)) AS relevant FROM relevance GROUP BY query_id), judged AS (SELECT query_id, ranked, relevant, 'c' || (query_id % 4) AS category FROM lists JOIN rel USING (query_id))"


def _metrics(ks: tuple[int, ...]) -> str:
    out = ["query_id, category, first_rank, coalesce(1.0 / first_rank, 0.0) AS reciprocal_rank"]
    for k in ks:
        hits = f"len(list_filter(ranked[1:{k}], lambda r: list_contains(relevant, r)))"
        gain = f"coalesce(list_sum(list_transform(ranked[1:{k}], lambda r, i: CASE WHEN list_contains(relevant, r) THEN 1.0 / log2(i + 1) ELSE 0 END)), 0)"
        ideal = f"list_sum([1.0 / log2(i + 1) FOR i IN range(1, least(len(relevant), {k})::BIGINT + 1)])"
        out.append(f"CASE WHEN {hits} > 0 THEN 1.0 ELSE 0.0 END AS any_{k}, CASE WHEN {hits} = len(relevant) THEN 1.0 ELSE 0.0 END AS all_{k}, {hits}::DOUBLE / len(relevant) AS fraction_{k}, {gain} / {ideal} AS ndcg_{k}")
    return "metrics AS (SELECT " + ", ".join(out) + " FROM (SELECT *, list_min([list_position(ranked, r) FOR r IN relevant]) AS first_rank FROM judged))"


TOP10 = _bm25("visible", "10", out="t_list")
DURABLE = " AND m.chunk_type IN ('manual', 'consolidated')"

ORACLES: dict[str, str] = {
    "visible_collection_stats": M + """ SELECT project AS name, count(*) AS chunk_count, count_if(chunk_type = 'manual')::BIGINT AS manual_count, count_if(chunk_type = 'auto_log')::BIGINT AS autolog_count,
        CASE project WHEN 'src1' THEN 'archive' WHEN 'playbook' THEN 'playbook' ELSE 'project' END AS kind, sum(length(document))::BIGINT AS text_chars FROM visible GROUP BY project ORDER BY chunk_count DESC, name LIMIT 1000""",
    "age_buckets": M + f" SELECT count_if(created_at < {NOW} - INTERVAL 30 DAY)::BIGINT AS over_30d, count_if(created_at < {NOW} - INTERVAL 90 DAY)::BIGINT AS over_90d, count_if(created_at < {NOW} - INTERVAL 180 DAY)::BIGINT AS over_180d FROM memories WHERE project = 'root'",
    "store_totals": M + f" SELECT count_if(project NOT IN {HIDDEN})::BIGINT AS visible, count(*) AS stored FROM memories",
    "chunks_by_project": M + " SELECT project, count(*) AS chunks FROM memories GROUP BY project",
    "cleanup_recommendations": M + " SELECT 'free_disk' AS name UNION ALL SELECT 'prune_root' FROM memories WHERE project = 'root' HAVING count(*) > 50000",
    "scoped_scan_newest": _with(MEMORIES, PRINCIPALS) + " SELECT id, project, created_at FROM memories WHERE project IN (SELECT unnest(read_projects) FROM principals) ORDER BY created_at DESC, id DESC LIMIT 50",
    "alias_lookup": M + " SELECT 'old_' || id AS asked_id, id, project FROM memories UNION ALL SELECT id, id, project FROM memories",
    "saved_list": M + f" SELECT id, project, updated_at FROM visible WHERE {PLAIN} AND NOT sensitive ORDER BY updated_at DESC, id DESC LIMIT 50",
    "saved_list_oldest_first": M + f" SELECT id, project, created_at, reviewed_at FROM visible WHERE {PLAIN} AND NOT sensitive ORDER BY greatest(created_at, coalesce(reviewed_at, created_at)), id LIMIT 50",
    "rules_all": M + f" SELECT id, project, created_at FROM visible WHERE {PLAIN} AND (importance = 'preference' OR memory_kind = 'rule')",
    "result_projection": M + f" SELECT id, sha256(left(r, 600)) AS head_sha, length(r) AS doc_len, chunk_type, importance, category, memory_kind FROM (SELECT *, {_redact('document')} AS r FROM memories)",
    "workspace_scope": _with(WORKSPACES) + " , owners AS (SELECT legacy_project, count(*) AS n FROM workspaces WHERE legacy_project IS NOT NULL GROUP BY 1) SELECT workspace_id, workspace_id AS project FROM workspaces UNION SELECT workspace_id, legacy_project FROM workspaces JOIN owners USING (legacy_project) WHERE n = 1 UNION SELECT workspace_id, 'playbook' FROM workspaces",
    "workspace_ids": _with(WORKSPACES) + " SELECT workspace_id, 'ws_pro-ject' || (s_suppkey % 60) || '_' || left(sha256('/home/u/Pro ject' || (s_suppkey % 60)), 32) AS ws_id, 'Pro ject' || (s_suppkey % 60) AS display_name, 'Pro ject' || (s_suppkey % 60) AS named FROM workspaces",
    "grants_filter": _with(MEMORIES, PRINCIPALS) + f" SELECT principal, id FROM memories m, principals p WHERE p.admin OR list_contains(p.read_projects, CASE WHEN m.project IN {HIDDEN} THEN m.scope_project ELSE m.project END)",
    "granted_scopes": _with(PRINCIPALS) + " SELECT principal, unnest(CASE WHEN length(principal) % 2 = 0 THEN read_projects ELSE [p FOR p IN read_projects IF p IN ('src0','src1','src2','src3','src4','src5','src6','src7')] END) AS project FROM principals",
    "keywords": _with(ASKED) + f" SELECT query_id, unnest(range(len(k))) AS pos, unnest(k) AS keyword FROM (SELECT query_id, {_keywords('text')} AS k FROM queries)",
    "topic_keywords": _with(ASKED) + f" , t AS (SELECT query_id, {_topics('text')} AS w FROM queries), u AS (SELECT query_id, {_ordered_distinct('w')} AS k FROM t) SELECT query_id, unnest(range(len(k))) AS pos, unnest(k) AS keyword FROM u",
    "document_keywords": f"SELECT doc_id, len({_keywords('text')})::BIGINT AS n, len(list_distinct({_topics('text')}))::BIGINT AS topics FROM documents",
    "redact_documents": f"SELECT doc_id, sha256({_redact('text')}) AS redacted_sha FROM documents",
    "redact_pages": f"SELECT page_id, sha256({_redact('html')}) AS redacted_sha FROM pages",
    "secret_documents": "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, {_quoted(p.replace('@', chr(92) + 'b'))})" for p in SECRETS) + " AS secret FROM documents",
    "split_parts": "SELECT doc_id, i + 1 AS sequence, total, length(part) AS chars, sha256(part) AS part_sha FROM (SELECT doc_id, total, i, substr(text, i * 8000 + 1, 8000) AS part FROM (SELECT doc_id, text, greatest(ceil(length(text) / 8000.0)::BIGINT, 1) AS total, unnest(range(greatest(ceil(length(text) / 8000.0)::BIGINT, 1))) AS i FROM documents))",
    "transcript_ids": T + " SELECT id, 'transcript_' || left(sha256(project || chr(0) || 'host' || chr(0) || session_id || chr(0) || event_id || chr(0) || '1' || chr(0)), 32) AS transcript_id FROM turns",
    "page_reminders": "SELECT page_id, sha256(regexp_replace(replace(replace(html, '<p>', '<system-reminder>'), '</p>', '</system-reminder>'), '(?s)<system-reminder>.*?(?:</system-reminder>|\\z)', '', 'g')) AS stripped_sha FROM pages",
    "escaped_pages": "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha, sha256(regexp_replace(html, '(?i)<(/?\\s*system[-_ ]?reminder)', '‹\\1', 'g')) AS defused_sha FROM pages",
    "query_gates": f"SELECT conv_id, turn, length(trim(text)) >= 12 AND NOT starts_with(trim(text), '/') AS searched, regexp_matches(text, '[가-힣]') AS korean, sha256(rtrim(left(translate({_one_line('text')}, '<>', '‹›'), 120))) AS title_sha, sha256(left(lower({_one_line('text')}), 240)) AS norm_sha FROM conversations",
    "hint_names": "SELECT p_partkey, regexp_matches(p_brand || '/' || p_type, '^[\\p{L}\\p{N}\\-_./]{1,80}$') AS can_name FROM part",
    "evidence_references": "SELECT conv_id, turn, 'D' || conv_id || ':' || turn || ',D7:8' AS refs FROM conversations",
    "answer_terms": "SELECT conv_id, turn, (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'on') OR contains(lower(text), 'que')) AS answered FROM conversations",
    "latin_terms": "SELECT doc_id, " + ", ".join(f"contains({_spaced('text')}, ' {t} ') AS {n}" for t, n in (("the", "has_the"), ("license", "has_license"), ("es", "has_es"))) + f", regexp_matches({_fold('text')}, '(^|[^0-9a-z])2\\.0($|[^0-9a-z])') AS has_version FROM documents",
    "vector_topk": _with(MEMORIES, ASKED, VECTORS) + " SELECT query_id, rank, id, distance FROM v_list",
    "bm25_topk": _with(MEMORIES, ASKED, _bm25("visible")) + " SELECT query_id, rank, id, score FROM t_list",
    "query_syntax": _with(MEMORIES, ASKED, _syntax()) + " SELECT query_id, rank, id, score FROM list_s",
    "refreshed_search": _with(MEMORIES, ASKED, _bm25("visible", "40")) + " SELECT query_id, rank, id, score FROM t_list",
    "bm25_statistics": _with(MEMORIES, ASKED, _bm25("visible")) + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post_t GROUP BY term",
    "candidate_limits": "SELECT item_id AS query_id, least(greatest(greatest(least(item_id * 3 % 60, 50), 1) * CASE WHEN item_id % 3 = 0 THEN 4 ELSE 20 END, 20), 1000) AS candidates FROM benchmark",
    "rrf_fuse": _with(*LISTS) + " SELECT query_id, id, fused FROM fused",
    "rrf_many": _with(*LISTS) + " SELECT query_id, id, round(sum(1.0 / (61 + rank)), 6)::DOUBLE AS score FROM (SELECT query_id, id, rank FROM v_list UNION ALL SELECT query_id, id, rank FROM t_list) GROUP BY ALL",
    "session_turns": T + " SELECT id, turn_no FROM numbered",
    "turn_neighbours": T + " SELECT a.id, b.turn_no - a.turn_no AS \"offset\", b.id AS neighbour FROM numbered a JOIN numbered b ON a.project = b.project AND a.session_id = b.session_id AND abs(b.turn_no - a.turn_no) BETWEEN 1 AND 5",
    "neighbour_bonus": _with(TURNS, ASKED.replace("CASE WHEN b.item_id % 3 = 0 THEN 40 ELSE 200 END", "40"), _bm25("turns", scoped=False)) + """ , f AS (SELECT query_id, t_list.id, round(0.5 * 10.0 / (10.0 + rank) / 1.5, 6)::DOUBLE AS fused, project, session_id, turn_no FROM t_list JOIN numbered USING (id))
        SELECT a.query_id, a.id, round(any_value(a.fused) + 0.15 * coalesce(max(b.fused), 0), 9)::DOUBLE AS fused FROM f a LEFT JOIN f b ON a.query_id = b.query_id AND a.session_id = b.session_id AND abs(a.turn_no - b.turn_no) = 1 GROUP BY a.query_id, a.id""",
    "following_link": _with(TURNS, ASKED, _bm25("turns", "10", scoped=False)) + """ , run AS (SELECT a.id, b.id AS next_id, b.turn_no, count_if(b.role <> 'assistant') OVER (PARTITION BY a.id ORDER BY b.turn_no) AS broken FROM numbered a JOIN numbered b ON a.session_id = b.session_id AND b.turn_no - a.turn_no BETWEEN 1 AND 5 WHERE a.role = 'user'),
        link AS (SELECT id, max_by(next_id, turn_no) AS following_id FROM run WHERE broken = 0 GROUP BY id),
        res AS (SELECT query_id, t_list.id, rank + 1 AS rank, CASE WHEN (query_id, following_id) NOT IN (SELECT query_id, id FROM t_list) THEN following_id END AS f FROM t_list LEFT JOIN link USING (id))
        SELECT query_id, rank, id, CASE WHEN rank = min(CASE WHEN f IS NOT NULL THEN rank END) OVER (PARTITION BY query_id) THEN f END AS following_id FROM res""",
    "hybrid_candidates": _with(*LISTS, _scored(), _admitted()) + " SELECT query_id, id, score FROM scored",
    "hybrid_search": _with(*LISTS, _scored(), _admitted(), _diversified("scored", "score DESC, id", "out_s")) + " SELECT query_id, rank, id, project, score FROM out_s",
    "recent_first": _with(*LISTS, _scored(), _admitted(), _diversified("scored", "updated_at DESC, id", "out_s")) + " SELECT query_id, rank, id, score FROM out_s",
    "durable_search": _with(*LISTS, _scored(DURABLE, reserved=True), _admitted(), _diversified("scored", "score DESC, id", "out_s")) + " SELECT query_id, rank, id, score FROM out_s",
    "mmr_search": _with(*LISTS, _scored(), _admitted(), _chosen("scored", "out_m")).replace("WITH", "WITH RECURSIVE", 1) + " SELECT query_id, rank, id, score FROM out_m",
    "earlier_rules": _with(*LISTS, _scored(DURABLE), _admitted(), _chosen("scored", "out_m")).replace("WITH", "WITH RECURSIVE", 1)
    + """ , home AS (SELECT query_id, project FROM (SELECT query_id, project, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, project) AS place FROM out_m WHERE project <> 'playbook' GROUP BY query_id, project HAVING count(*) >= 3) WHERE place = 1),
        ruled AS (SELECT h.query_id, m.id, 0 AS part, row_number() OVER (PARTITION BY h.query_id ORDER BY m.created_at DESC, m.id DESC) AS nth FROM visible m JOIN home h USING (project) WHERE m.chunk_type = 'manual' AND (m.importance = 'preference' OR m.memory_kind = 'rule')),
        both_r AS (SELECT query_id, id, min((part, nth)) AS best FROM (SELECT * FROM ruled UNION ALL SELECT query_id, id, 1, rank FROM out_m) GROUP BY ALL)
        SELECT query_id, place, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, id) AS place FROM both_r) WHERE place <= 10""",
    "scope_hint": f"""WITH inside AS ({_with(*LISTS, _scored(DURABLE, wide=True), _admitted(), _diversified("scored", "score DESC, id", "out_s"))} SELECT query_id, rank, project, score, on_topic FROM out_s),
        outside AS ({_with(MEMORIES, ASKED_WIDE, VECTORS, _bm25("visible"), FUSED, _scored(DURABLE, wide=True, reserved=True), _admitted(), _diversified("scored", "score DESC, id", "out_s"))} SELECT query_id, rank, project, score, on_topic FROM out_s),
        {ASKED.strip()}, bar AS (SELECT query_id, max(score) + 0.05 AS bar FROM inside WHERE on_topic GROUP BY query_id),
        c AS (SELECT o.query_id, o.project, count(*) AS hits, min(o.rank) AS best FROM outside o JOIN queries q USING (query_id) LEFT JOIN bar b USING (query_id) WHERE o.on_topic AND NOT list_contains(q.scope, o.project) AND (b.bar IS NULL OR o.score > b.bar) AND regexp_matches(o.project, '^[\\p{{L}}\\p{{N}}\\-_./]{{1,80}}$') AND o.project NOT IN ('task-cards', 'task-cards-done') GROUP BY ALL)
        SELECT query_id, place, project, hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, project) AS place FROM c) WHERE place <= 3""",
    "stratified_sample": "WITH r AS (SELECT conv_id % 7 AS stratum, count(*) AS size FROM conversations WHERE role = 'user' GROUP BY 1), e AS (SELECT *, sum(size) OVER () AS total FROM r), f AS (SELECT *, least(100, total) AS n, least(100, total) * size / total AS exact FROM e), g AS (SELECT *, sum(floor(exact)) OVER () AS floors, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS place FROM f) SELECT stratum, drawn FROM (SELECT stratum, least(size, floor(exact) + CASE WHEN place <= n - floors THEN 1 ELSE 0 END)::BIGINT AS drawn FROM g) WHERE drawn > 0",
    "card_logs": f"""WITH e AS (SELECT title, "at", '- ' || strftime("at", '%Y-%m-%d %H:%M') || ' ' || left({_one_line('text')}, 1000) AS line FROM (SELECT 'Card ' || (conv_id % 20) AS title, TIMESTAMP '2024-01-01' + to_minutes((conv_id * 10 + turn)::INT) AS "at", text FROM conversations WHERE role = 'user')),
        o AS (SELECT *, sum(length(line) + 1) OVER w <= 8000 OR row_number() OVER w = 1 AS fits FROM e WINDOW w AS (PARTITION BY title ORDER BY "at" DESC, line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT title, title || chr(10) || 'body' AS body, (count_if(fits) + max((NOT fits)::INT))::BIGINT AS lines, sha256(CASE WHEN bool_or(NOT fits) THEN '- (earlier lines dropped)' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY "at", line) FILTER (fits)) AS log_sha FROM o GROUP BY title""",
    "on_topic_gate": _with(*LISTS, _scored(wide=True), _admitted()) + " SELECT query_id, id, on_topic FROM scored",
    "context_pack": _with(*LISTS, _scored(DURABLE, wide=True), _admitted(True), _diversified("scored", "score DESC, id", "out_s")) + f""" , l AS (SELECT query_id, rank, '- [' || project || '] ' || replace(replace(replace(left({_one_line(_redact('document'))}, 600), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS line FROM out_s),
        u AS (SELECT *, 19 + sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank) > 2000 AS over FROM l)
        SELECT query_id, count_if(NOT over)::BIGINT AS lines, sha256('Relevant memories:' || coalesce(string_agg(CASE WHEN NOT over THEN chr(10) || line END, '' ORDER BY rank), '') || CASE WHEN bool_or(over) THEN chr(10) || '…' ELSE '' END) AS text_sha FROM u GROUP BY query_id""",
    "context_pack_hinted": _with(*LISTS, _scored(DURABLE, wide=True), _admitted(True), _diversified("scored", "score DESC, id", "out_s")) + f""" , l AS (SELECT query_id, rank, '- [' || project || '] ' || replace(replace(replace(left({_one_line(_redact('document'))}, 600), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS line, 'See also &lt;src' || (query_id % 20) || '&gt;' || repeat('.', (query_id % 9)::INT * 200) AS h FROM out_s),
        k AS (SELECT *, CASE WHEN 20 + length(h) - 6 <= 1200 THEN h END AS hint FROM l),
        u AS (SELECT *, 19 + coalesce(length(hint) + 1, 0) + sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank) > 1200 AS over FROM k)
        SELECT query_id, count_if(NOT over)::BIGINT AS lines, sha256('Relevant memories:' || coalesce(string_agg(CASE WHEN NOT over THEN chr(10) || line END, '' ORDER BY rank), '') || CASE WHEN bool_or(over) THEN chr(10) || '…' ELSE '' END || coalesce(chr(10) || any_value(hint), '')) AS text_sha FROM u GROUP BY query_id""",
    "pages_with_neighbours": T + f""" , m AS (SELECT n.*, {_redact('document')} AS masked FROM numbered n),
        a AS (SELECT id AS asked_id, project, session_id, turn_no, crc % 50 AS f, 20 + crc % 900 AS budget, crc % 7 AS b, crc % 6 AS e FROM (SELECT *, {{crc}} AS crc FROM numbered) WHERE crc % 7 <= 5),
        r AS (SELECT asked_id, m.turn_no - a.turn_no AS place, m.id, masked, length(masked) AS len, CASE WHEN m.turn_no = a.turn_no THEN f ELSE 0 END AS f, budget, m.session_id FROM a JOIN m ON a.project = m.project AND a.session_id = m.session_id AND m.turn_no - a.turn_no BETWEEN -b AND e),
        s AS (SELECT *, greatest(len - f, 0) AS there, least(budget, coalesce(sum(greatest(len - f, 0)) OVER (PARTITION BY asked_id ORDER BY place <> 0, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS spent FROM r),
        t AS (SELECT *, least(there, budget - spent)::BIGINT AS n FROM s)
        SELECT asked_id, CASE WHEN place = 0 THEN 'page' WHEN place < 0 THEN 'before' ELSE 'after' END AS part, place, id, sha256(substr(masked, f::BIGINT + 1, n)) AS document_sha, len AS doc_len, n AS returned_chars, least(f, len) + n < len AS has_more, CASE WHEN least(f, len) + n < len THEN least(f, len) + n ELSE -1 END::BIGINT AS next_offset, f > 0 OR least(f, len) + n < len AS truncated, sum(n) OVER (PARTITION BY asked_id)::BIGINT AS total_returned_chars, session_id FROM t""".replace("{crc}", "((session_id::BIGINT + 3) * (split_part(id, '_', 3)::BIGINT + 7))"),
    "approach_views": f"SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'worked' END AS status, CASE WHEN doc_id % 5 <> 0 THEN sha256(left({_redact('left(text, 300)')}, 256)) END AS applicability_sha, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 OR trim({_redact('left(text, 200)')}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'not_provided' ELSE 'provided_unverified' END END AS evidence_status, doc_id % 5 <> 0 AND length({_redact('left(text, 300)')}) > 256 AS truncated FROM documents",
    "same_subject": M + f""" , r AS (SELECT project, id, embedding, list_distinct({_topics('document')}) AS topics FROM visible WHERE {PLAIN} AND embedding IS NOT NULL AND NOT sensitive), s AS (SELECT project, id, embedding, list_distinct({_topics('document')}) AS topics FROM visible WHERE {PLAIN} AND embedding IS NOT NULL),
        p AS (SELECT s.id AS saved_id, r.id, abs(round(1 - list_cosine_similarity(s.embedding, r.embedding), 6)) AS distance, len(list_intersect(s.topics, r.topics))::DOUBLE / nullif(least(len(s.topics), len(r.topics)), 0) AS shared FROM s JOIN r ON s.project = r.project AND s.id <> r.id)
        SELECT saved_id, id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY saved_id ORDER BY distance, id) AS place FROM p WHERE distance <= 0.55 OR distance <= 0.7 AND coalesce(shared, 0) >= 0.2) WHERE place <= 3""",
    "verified_quotes": _with(MEMORIES, RELEVANT) + " , q AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place FROM relevance) SELECT query_id, place, q.id FROM q JOIN memories m USING (id) JOIN benchmark b ON b.item_id = q.query_id WHERE place <= 5 AND contains(left(m.document, 1000), b.text)",
    "token_overlap_baseline": _with(MEMORIES, ASKED) + f""" , a AS (SELECT DISTINCT query_id, unnest({_tokens('text')}) AS token FROM queries), b AS (SELECT DISTINCT id, unnest({_tokens('document')}) AS token FROM memories), c AS (SELECT query_id, id, count(*) AS shared FROM a JOIN b USING (token) GROUP BY ALL)
        SELECT query_id, rank, id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) AS rank FROM c) WHERE rank <= 5""",
    "prune_victims": M + " SELECT id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM memories WHERE project = 'root' AND NOT pinned) WHERE place > 3 AND created_at < TIMESTAMP '2024-10-01'",
    "ttl_expired": M + f""" , r AS (SELECT *, CASE project WHEN 'src1' THEN 100 WHEN 'src2' THEN 30 END AS days, CASE WHEN doc_id % 3 = 0 THEN 'log' ELSE importance END AS imp FROM visible)
        SELECT id, CASE WHEN days IS NOT NULL THEN 'policy' ELSE 'kind' END AS reason FROM r WHERE CASE WHEN days IS NOT NULL THEN created_at + to_days(days) <= {NOW} ELSE NOT pinned AND imp = 'log' AND (chunk_type = 'auto_log' AND datesub('second', created_at, {NOW}) // 86400 > 30 OR chunk_type = 'filtered' AND datesub('second', created_at, {NOW}) // 86400 > 7) END""",
    "trash_due": M + f" SELECT id, trashed_at FROM memories WHERE project = '_trash' AND trashed_at + INTERVAL 30 DAY < {NOW}",
    "prune_previews": M + " , p AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS nth FROM memories WHERE project = 'src4' AND chunk_type = 'manual') SELECT id, project, created_at, sha256(left(document, 80)) AS preview_sha, matched FROM (SELECT *, count(*) OVER () AS matched FROM p WHERE nth > 2) WHERE nth <= 22",
    "repeated_notes": M + f" SELECT id, CASE WHEN doc_id % 3 <> 0 THEN 0 WHEN id LIKE '%0' THEN 2 ELSE 1 END::BIGINT AS access_count, CASE WHEN doc_id % 3 = 0 THEN {NOW} ELSE updated_at END AS updated_at FROM memories",
    "purged_aliases": M + " SELECT 'old_' || id AS alias_id, id AS canonical_id FROM memories WHERE id NOT IN (SELECT id FROM (SELECT * FROM memories WHERE project = '_trash' OR doc_id < 30 ORDER BY doc_id LIMIT 100) WHERE project = '_trash')",
    "permitted_deletes": _with(MEMORIES, PRINCIPALS) + f" , w AS (SELECT unnest(read_projects) AS project FROM principals WHERE principal = 'FRANCE'), m AS (SELECT id, project, CASE WHEN project IN {HIDDEN} THEN scope_project ELSE project END IN (SELECT project FROM w) AS may, project IN (SELECT project FROM w) AS own FROM memories) SELECT id, 'deleted' AS status, 'own' AS batch FROM m WHERE own UNION ALL SELECT 'no_' || id, 'not_found', 'own' FROM m UNION ALL SELECT id, CASE WHEN NOT may THEN 'denied' WHEN (SELECT bool_or(NOT may) FROM m) THEN 'refused' ELSE 'deleted' END, 'all' FROM m",
    "kept_jobs": _with(JOBS) + " , j AS (SELECT job_id, max((updated_at, state)) AS r FROM jobs GROUP BY 1) SELECT job_id, r[2] AS state, r[1] AS updated_at FROM j WHERE r[1] >= (SELECT max(r[1]) FROM j) - INTERVAL 1 DAY",
    "evidence_overall": "WITH f AS (SELECT page_id // 3 AS g, CASE page_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'unavailable' WHEN 5 THEN 'changed' ELSE 'unchanged' END AS status FROM pages) SELECT g::VARCHAR AS id, CASE WHEN g % 5 = 0 THEN 'different_workspace' WHEN bool_and(status = 'unchanged') THEN 'unchanged' WHEN bool_or(status = 'unavailable') THEN 'unavailable' ELSE 'changed' END AS status FROM f GROUP BY g",
    "upkeep_state": M + f""" , r AS (SELECT *, CASE project WHEN 'src1' THEN 100 WHEN 'src2' THEN 30 END AS days FROM memories WHERE NOT coalesce(project = '_trash' AND trashed_at + INTERVAL 30 DAY < {NOW}, false)),
        x AS (SELECT *, project NOT IN {HIDDEN} AND CASE WHEN days IS NOT NULL THEN created_at + to_days(days) <= {NOW} ELSE NOT pinned AND importance = 'log' AND (chunk_type = 'auto_log' AND datesub('second', created_at, {NOW}) // 86400 > 30 OR chunk_type = 'filtered' AND datesub('second', created_at, {NOW}) // 86400 > 7) END AS over FROM r)
        SELECT id, CASE WHEN over THEN '_trash' ELSE project END AS project, CASE WHEN over THEN {NOW} ELSE trashed_at END AS trashed_at FROM x""",
    "metadata_paths": "SELECT doc_id, lang, n_chars::BIGINT AS n, source, true AS gone FROM documents",
    "id_shapes": f"SELECT page_id, true AS digest, false AS upper_digest, true AS transcript_id, strlen(p) <= 256 AND NOT regexp_matches(p, '[\x00-\x1F\x7F\\\\:]') AND len([x FOR x IN string_split(p, '/') IF x IN ('', '.', '..') OR lower(x) = '.git' OR ends_with(x, '.') OR ends_with(x, ' ')]) = 0 AND {_redact('p')} = p AS url_path, page_id % 3 = 2 AS dotted_path, length(trim(url)) >= 40 AND NOT starts_with(trim(url), '/') AS substantive FROM (SELECT *, regexp_replace(url, '^https?://', '') AS p FROM pages)",
    "exact_duplicates": M + f" SELECT id, canonical_id FROM (SELECT id, first(id) OVER (PARTITION BY trim(document, ' ') ORDER BY created_at, id) AS canonical_id FROM visible) WHERE id <> canonical_id",
    "remember_status": T + " SELECT id, CASE WHEN trim(document) = '' THEN 'failed' WHEN role = 'assistant' OR session_id::BIGINT % 3 = 0 OR k = 2 THEN 'deduplicated' ELSE 'succeeded' END AS status, count(*) AS n FROM turns, (VALUES (1), (2)) c(k) GROUP BY ALL",
    "replay_dedup": T + " SELECT id FROM turns WHERE role = 'user' AND session_id::BIGINT % 3 <> 0",
    "supersede_state": M + """ , new AS (SELECT 'new_' || id AS id, project, scope_project, supersedes FROM memories WHERE supersedes IS NOT NULL), old AS (SELECT m.id, m.project, m.scope_project, bool_or(n.project = m.project AND m.project NOT IN ('_trash', '_superseded')) AS gone FROM memories m LEFT JOIN new n ON n.supersedes = m.id GROUP BY ALL)
        SELECT id, CASE WHEN gone THEN '_superseded' ELSE project END AS project, CASE WHEN gone THEN project ELSE scope_project END AS scope_project FROM old UNION ALL SELECT id, project, scope_project FROM new""",
    "trash_state": M + f" SELECT id, CASE WHEN pinned AND project <> '_trash' THEN '_trash' ELSE project END AS project, CASE WHEN pinned AND project <> '_trash' THEN project ELSE original_project END AS original_project, CASE WHEN pinned AND project NOT IN {HIDDEN} THEN project ELSE scope_project END AS scope_project, CASE WHEN pinned AND project <> '_trash' THEN {NOW} ELSE trashed_at END AS trashed_at FROM memories",
    "restore_state": M + " SELECT id, CASE WHEN project = '_trash' THEN coalesce(original_project, 'default') ELSE project END AS project, CASE WHEN project <> '_trash' THEN original_project END AS original_project, CASE WHEN project <> '_trash' THEN trashed_at END AS trashed_at FROM memories",
    "purge_state": M + " SELECT id, project FROM memories WHERE project <> '_trash'",
    "delete_statuses": M + " SELECT id, CASE WHEN pinned THEN 'deleted' ELSE 'not_found' END AS status FROM memories",
    "mark_reviewed": M + f" SELECT id, CASE WHEN pinned AND project NOT IN {HIDDEN} AND {PLAIN} AND NOT sensitive THEN {NOW} ELSE reviewed_at END AS reviewed_at FROM memories",
    "metadata_patch": M + """ SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'insight' ELSE category END AS category, CASE WHEN doc_id % 6 = 0 THEN 1.0 WHEN confidence IS NOT NULL THEN round(least(confidence, 1)::DOUBLE, 4) END AS confidence,
        length(document) + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS chars, CASE WHEN doc_id % 6 <> 0 THEN reviewed_at END AS reviewed_at, embedding IS NOT NULL AND doc_id % 6 <> 0 AS has_vector FROM memories""",
    "invalid_fields": M + " SELECT id, CASE WHEN confidence > 1 THEN 'confidence' ELSE 'supersedes' END AS problem FROM memories WHERE confidence > 1 OR doc_id % 41 = 0",
    "keep_newest_audit": _with(AUDIT) + " SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY created_at DESC, id DESC) AS place FROM audit) WHERE actor <> 'unauthenticated' OR place <= 100",
    "latest_jobs": _with(JOBS) + " SELECT job_id, CASE WHEN state IN ('queued', 'running') THEN 'failed' ELSE state END AS state, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, state DESC) AS place FROM jobs) WHERE place = 1",
    "evidence_status": "SELECT CASE page_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS files FROM pages GROUP BY 1",
    "job_states": _with(JOBS) + " SELECT count_if(state = 'queued')::BIGINT AS queued, count_if(state = 'running')::BIGINT AS running, count_if(state = 'failed')::BIGINT AS failed FROM jobs",
    "audit_newest": _with(AUDIT) + " SELECT id, actor, outcome FROM audit WHERE actor <> 'unauthenticated' ORDER BY id DESC LIMIT 200",
    "denied_events": _with(AUDIT) + " SELECT count_if(outcome = 'denied')::BIGINT AS denied FROM audit",
    "latency_summary": _with(JOBS) + " SELECT count(ms) AS searches, round(avg(ms), 6) AS average, round(max(ms), 6) AS slowest FROM jobs",
    "home_projects": _with(MEMORIES, ASKED, _bm25("visible", "50")) + " , c AS (SELECT query_id, project, count(*) AS n FROM t_list JOIN memories USING (id) WHERE project <> 'playbook' GROUP BY ALL HAVING count(*) >= 3) SELECT query_id, project FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, project) AS place FROM c) WHERE place = 1",
    "capture_report": "SELECT path, sum(1)::BIGINT AS turns, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END)::BIGINT AS eligible, sum(CASE WHEN turn = 0 THEN 1 ELSE 0 END)::BIGINT AS \"new\", sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END)::BIGINT AS skipped FROM (SELECT 'f' || (conv_id % 10) AS path, turn, role FROM conversations) GROUP BY ROLLUP (path)",
    "retrieval_metrics": _with(MEMORIES, ASKED, TOP10, RELEVANT, JUDGED, _metrics((1, 5, 10))) + " SELECT query_id, first_rank, round(reciprocal_rank, 6) AS reciprocal_rank, " + ", ".join(f"round({m}_{k}, 6)::DOUBLE AS {m}_{k}" for k in (1, 5, 10) for m in ("any", "all", "fraction", "ndcg")) + " FROM metrics",
    "metrics_rollup": _with(MEMORIES, ASKED, TOP10, RELEVANT, JUDGED, _metrics((5, 10))) + " SELECT category, count(*) AS questions, " + ", ".join(f"round(avg({m}), 6)::DOUBLE AS {m}" for m in ("reciprocal_rank", "any_5", "any_10", "ndcg_10")) + " FROM metrics GROUP BY ROLLUP (category)",
    "percentile_nearest_rank": "SELECT event_type, " + ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value) AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events GROUP BY event_type",
    "paired_wins": "WITH r AS (SELECT event_id % 1000 AS q, event_type, max(value) AS x FROM events GROUP BY ALL) SELECT count(*) FILTER (a.x > b.x) AS wins, count(*) FILTER (a.x < b.x) AS losses FROM r a JOIN r b USING (q) WHERE a.event_type = 'view' AND b.event_type = 'click'",
    "throughput": "SELECT round(count(*)::DOUBLE / sum(o_totalprice), 9) AS per_second FROM orders",
    "import_jsonl": f"SELECT 'c_' || conv_id || '_' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'talk' ELSE 'default' END AS project, sha256({_redact('text')}) AS document_sha, CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2024-03-01 08:00:00' WHEN turn % 3 = 0 THEN TIMESTAMP '2024-03-01 08:30:00' ELSE {NOW} END AS created_at, 'auto_log' AS chunk_type, 'log' AS importance FROM conversations WHERE trim(text) <> ''",
    "transcript_parse": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS \"offset\", role, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text_sha, '/w/p' AS cwd, conv_id || '-' || turn AS host_event_id FROM conversations WHERE role <> 'system' AND trim(text) <> ''",
    "activity_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events) SELECT user_id, sum(starts)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY user_id",
    "stale_prompts": "WITH e AS (SELECT user_id::VARCHAR AS session, ts AS \"at\", event_id AS seq, event_type = 'purchase' AS save, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM events) SELECT session, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY session, since ORDER BY \"at\", seq) AS nth FROM e WHERE NOT save) WHERE nth = 8",
    "audit_lines": _with(AUDIT) + " SELECT created_at, actor, action, outcome, least(id % 70 + 1, 50) AS targets FROM audit",
    "vault_round_trip": "SELECT c_name AS name, c_mktsegment AS value FROM customer",
}
