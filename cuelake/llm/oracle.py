"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import secret_scan as S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- op11: product codes -------------------------------------------------------------------
def _op11(rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT p.vid, p.pos, b.entry, CAST(sum((p.x - b.y) * (p.x - b.y)) AS BIGINT) AS dist
  FROM p JOIN b{r} b ON p.pos = b.pos AND p.d = b.d GROUP BY p.vid, p.pos, b.entry),
a{r} AS MATERIALIZED (
  SELECT vid, pos, entry, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY vid, pos ORDER BY dist, entry) AS o FROM d{r}) WHERE o = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT p.pos, a.entry, p.d, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS c
  FROM p JOIN a{r} a ON p.vid = a.vid AND p.pos = a.pos GROUP BY p.pos, a.entry, p.d),
b{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, b.d,
         CASE WHEN m.c IS NULL THEN b.y ELSE CAST((m.s - ((m.s % m.c) + m.c) % m.c) / m.c AS BIGINT) END AS y
  FROM b{r} b LEFT JOIN m{r} m ON b.pos = m.pos AND b.entry = m.entry AND b.d = m.d)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS vid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vid, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i FROM v),
p AS MATERIALIZED (
  SELECT vid, i // 8 AS pos, i % 8 AS d, CAST(floor(4096 * CAST(f AS DOUBLE)) AS BIGINT) AS x FROM e),
b0 AS MATERIALIZED (SELECT pos, vid - 1 AS entry, d, x AS y FROM p WHERE vid <= 16),
{', '.join(steps)},
coded AS (
  SELECT vid, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vid),
one AS (SELECT v.vec_id, v.label, c.code, c.error FROM v JOIN coded c ON v.vid = c.vid),
total AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM one GROUP BY label),
book AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY pos, entry, d)) AS codebooks_sha256 FROM b{rounds})
SELECT one.vec_id, one.code, one.error, total.label_error, book.codebooks_sha256
FROM one JOIN total ON one.label IS NOT DISTINCT FROM total.label, book
"""


# --- op12: phrases -------------------------------------------------------------------------
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT *, row_number() OVER () AS id FROM pieces),
listed AS (SELECT id, lang, regexp_split_to_array(piece, '[\x20\x09]+') AS w FROM numbered),
words AS (SELECT * FROM (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM listed) WHERE w <> ''),
runs AS (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w AS phrase FROM runs
  UNION ALL SELECT lang, 2 AS k, w || ' ' || w2 AS phrase FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3 AS k, w || ' ' || w2 || ' ' || w3 AS phrase FROM runs WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND n >= 10),
around AS (
  SELECT lang, phrase, max(n) AS most FROM (
    SELECT lang, p[1] || ' ' || p[2] AS phrase, n FROM cand WHERE k = 3
    UNION ALL SELECT lang, p[2] || ' ' || p[3] AS phrase, n FROM cand WHERE k = 3) GROUP BY lang, phrase),
left_over AS (
  SELECT c.* FROM cand c LEFT JOIN around o ON c.k = 2 AND c.lang = o.lang AND c.phrase = o.phrase
  WHERE 100 * coalesce(o.most, 0) < 50 * c.n),
cuts AS (
  SELECT lang, phrase, n AS a, 1 AS cut, p[1] AS l_phrase, substr(phrase, length(p[1]) + 2) AS r_phrase FROM left_over
  UNION ALL SELECT lang, phrase, n AS a, 2 AS cut, p[1] || ' ' || p[2] AS l_phrase, p[3] AS r_phrase FROM left_over WHERE k = 3),
lefts AS MATERIALIZED (SELECT c.*, l.n AS l FROM cuts c JOIN f l ON c.lang = l.lang AND c.l_phrase = l.phrase),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, c.l, r.n AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(c.l AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM lefts c JOIN f r ON c.lang = r.lang AND c.r_phrase = r.phrase),
worst AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l,
       CAST(r.r AS BIGINT) AS r, t.n, r.score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""


# --- op13: secrets -------------------------------------------------------------------------
def _found(name: str, pattern: str, where: str = "true") -> str:
    """Matches of a pattern with their places: (doc_id, kind, s, e, word)."""
    return f"""{name}_m AS (
  SELECT doc_id, regexp_extract_all(t, {q(pattern)}) AS m, regexp_split_to_array(t, {q(pattern)}) AS g FROM texts
  WHERE regexp_matches(t, {q(pattern)})),
{name} AS (SELECT * FROM (
  SELECT doc_id, e - length(word) AS s, e, word FROM (
    SELECT doc_id, m[i] AS word, list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m))) WHERE {where})"""


def _windows(kind: str) -> str:
    symbols, case, bits = S.CLASSES[kind]
    x = "word" if case else "lower(word)"
    size = S.WINDOW
    terms = "[" + ", ".join(map(str, S.TERMS)) + "]"
    alien = "[^" + "".join("\\" + c if c in "-" else c for c in symbols) + "]"
    return f"""{kind}_w AS (
  SELECT doc_id, s, word, i FROM (
    SELECT *, substr(x, i + 1, {size}) AS w FROM (
      SELECT doc_id, s, word, {x} AS x, unnest(range(0, length(word) - {size} + 1)) AS i FROM candidates))
  WHERE NOT regexp_matches(w, {q(alien)})
    AND list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({terms})[length(w) - length(replace(w, c, '')) + 1])) <= {S.most(bits)}),
{kind}_g AS (SELECT *, CASE WHEN i - lag(i) OVER o <= {size} THEN 0 ELSE 1 END AS fresh FROM {kind}_w
  WINDOW o AS (PARTITION BY doc_id, s ORDER BY i)),
{kind} AS (
  SELECT doc_id, s + min(i) AS s, s + max(i) + {size} AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY i) AS g FROM {kind}_g) GROUP BY doc_id, s, g)"""


def _op13() -> str:
    allow = " AND ".join(f"NOT regexp_matches(word, {q(p)})" for p in S.ALLOWED)
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{k}' AS kind, s, e FROM {k}" for i, k in enumerate(S.KINDS))
    label = "kind || ':' || s || ':' || e"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found('assign', S.ASSIGN, f"length(regexp_extract(word, {q(S.ASSIGN)}, 2)) >= {S.ASSIGN_LEAST}")},
{_found('access', S.ACCESS)},
{_found('hex', S.HEX)},
{_found('candidates', S.CANDIDATE, allow)},
{', '.join(_windows(k) for k in S.CLASSES)},
spans AS ({rows}),
by_doc AS (
  SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
         string_agg({label}, ',' ORDER BY s, o) FILTER (WHERE o < 3) AS base, string_agg({label}, ',' ORDER BY s, o) AS spans
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN by_doc b ON t.doc_id = b.doc_id
"""


# --- op7: archive rows ---------------------------------------------------------------------
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '')
           AS payload_digest
  FROM p),
best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM best
"""


# --- op9: links within a label ---------------------------------------------------------------
OP9 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
near AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN links k ON e.vec_id = k.a
"""


ORACLE = {"op7_warc": OP7, "op9_embedding_near_dedup": OP9, "op11_vector_trie": _op11(), "op12_phrase_graph": OP12, "op13_secret_scan": _op13()}
