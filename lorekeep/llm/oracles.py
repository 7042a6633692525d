"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations


def _words(text: str) -> str:
    return f"[x FOR x IN string_split_regex({text}, '[\\x20\\x09-\\x0D]+') IF x <> '']"


def _reach(ids: str, links: str) -> str:
    """Components: the least id that each id reaches by links (a, b)."""
    return f"""
ways AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
reach(id, root) AS (SELECT id, id FROM {ids} UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


def _clusters(k: int, rounds: int) -> str:
    """Rounds of centroids (n, i, c: number, component from 1, value) written out, as recursion can't aggregate."""
    near = "(SELECT id, arg_min(struct_pack(n := n, d := d), (d, n)) AS x FROM (SELECT v.id, c.n, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(v.e, c.c)])::HUGEINT AS d FROM v, {c} c) GROUP BY id)"
    parts = [
        "WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [floor(256 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS n, e AS c FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(f"m{r} AS MATERIALIZED (SELECT n, i, floor_div(sum(x), count(*)) AS x FROM (SELECT a.x.n AS n, unnest(range(1, 65)) AS i, unnest(v.e) AS x FROM {near.format(c=f'c{r}')} a JOIN v USING (id)) GROUP BY n, i)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(s.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT n, list(x ORDER BY i) AS c FROM m{r} GROUP BY n) s USING (n))")
    text = ", ".join(parts).replace("floor_div(sum(x), count(*))", "((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))")
    return (
        text
        + f", last AS MATERIALIZED (SELECT id, x.n AS n, x.d AS d FROM {near.format(c=f'c{rounds}')}) SELECT vec_id, last.n::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY last.n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN v USING (id) JOIN c{rounds} c ON c.n = last.n"
    )


ORACLES: dict[str, str] = {
    "op11_centroid_clusters": _clusters(40, 5),
    "op12_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM grp g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * s.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (s.n + 5 * s.v) AS q FROM total g JOIN size s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 50""",
    "op4_embedding_dedup": "WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),"
    + _reach("v", "links")
    + ", n AS (SELECT a AS id, count(*) AS n FROM ways GROUP BY a) SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, id = root AS kept FROM roots LEFT JOIN n USING (id)",
    "op8_substring_dedup": f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT doc_id, i FROM starts WHERE seq IN (SELECT seq FROM starts GROUP BY seq HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM again),
kept AS (SELECT doc_id, string_agg(ws[j], ' ' ORDER BY j) AS text FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_suffix_dedup": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, i, md5(array_slice(t, i, i + 199)) AS h FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 198)) AS i FROM b)),
again AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a - 1 AS u FROM runs UNION ALL SELECT doc_id, max(z), NULL FROM runs GROUP BY doc_id UNION ALL SELECT doc_id, 1, NULL FROM b ANTI JOIN runs USING (doc_id)),
kept AS (SELECT doc_id, string_agg(hex(array_slice(t, f, coalesce(u, octet_length(t)))), '' ORDER BY f) AS k FROM pieces JOIN b USING (doc_id) WHERE coalesce(u, octet_length(t)) >= f GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS n FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM b LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op10_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ids AS (SELECT doc_id AS id FROM documents),"""
    + _reach("ids", "links")
    + " SELECT roots.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, roots.id = root AS kept FROM roots LEFT JOIN n ON n.doc_id = roots.id",
}
