"""DuckDB SQL for the queries that it can express."""

_OP1 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d)),
one AS (SELECT k, min(doc_id) AS d0 FROM win GROUP BY k HAVING count(*) > 1),
start AS (SELECT one.k, d0, min(s) AS s0 FROM one JOIN win ON win.k = one.k AND win.doc_id = d0 GROUP BY one.k, d0),
late AS (SELECT win.doc_id, win.s FROM win JOIN start ON win.k = start.k WHERE win.doc_id > d0 OR win.doc_id = d0 AND win.s > s0),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM late),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 400)) AS s FROM d)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM win SEMI JOIN rep ON win.k = rep.k),
brk AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER w + 400 THEN 0 ELSE 1 END AS b FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
runs AS (SELECT doc_id, r, min(s) AS a, max(s) + 400 AS z FROM (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM brk) GROUP BY doc_id, r),
g AS (SELECT doc_id, sum(z - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id),
gaps AS (
  SELECT d.doc_id, coalesce(lag(z) OVER w, 0) AS a, runs.a AS z, d.h FROM runs JOIN d ON d.doc_id = runs.doc_id WINDOW w AS (PARTITION BY d.doc_id ORDER BY runs.a)
  UNION ALL
  SELECT d.doc_id, coalesce(max(z), 0), length(any_value(h)) // 2, any_value(h) FROM d LEFT JOIN runs ON d.doc_id = runs.doc_id GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (z - a))::BIGINT), '' ORDER BY a) AS t FROM gaps GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FOUND = " UNION ALL ".join(
    f"SELECT r, text, {k} AS kind, unnest(regexp_extract_all(text, '{p}')) AS v, unnest(regexp_split_to_array(text, '{p}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d"
    for k, p in enumerate(_KINDS.values()))
_AT = "sum(length(gap) + length(v)) OVER (PARTITION BY r, kind ORDER BY i)"
_WRITTEN = "string_agg(CASE kind WHEN 0 THEN 'email' WHEN 1 THEN 'ip' WHEN 2 THEN 'card' WHEN 3 THEN 'phone' ELSE 'term' END || ':' || a || ':' || z, ',' ORDER BY a, kind)"

_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
p AS (SELECT r, text, kind, v, ({_AT})::BIGINT AS z, regexp_replace(v, '[^0-9]', '', 'g') AS dig FROM f),
luhn AS (
  SELECT dig, sum(CASE WHEN (length(dig) - j) % 2 = 0 THEN c ELSE 2 * c - 9 * (c > 4)::INT END) % 10 = 0 AS ok
  FROM (SELECT dig, unnest(generate_series(1, length(dig))) AS j, substr(dig, j::INT, 1)::INT AS c FROM (SELECT DISTINCT dig FROM p WHERE kind = 2 AND length(dig) BETWEEN 12 AND 19)) GROUP BY dig),
b AS (
  SELECT r, text, kind, v, z - length(v) AS a, z, p.dig FROM p LEFT JOIN luhn ON p.kind = 2 AND p.dig = luhn.dig
  WHERE kind = 0 OR kind = 1 AND list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 999))) <= 255
    OR kind = 2 AND luhn.ok OR kind = 3 AND length(p.dig) BETWEEN 9 AND 15),
c0 AS (
  SELECT r, CASE kind
      WHEN 0 THEN ['email:' || lower(v), 'user:' || split_part(lower(v), '@', 1), 'domain:' || split_part(lower(v), '@', 2)]
      WHEN 1 THEN ['ip:' || v, 'network:' || regexp_replace(v, '\.[0-9]+$', '')]
      WHEN 2 THEN ['card:' || dig] ELSE ['phone:' || dig, 'exchange:' || regexp_replace(dig, '[0-9]{{4}}$', '')] END AS es,
    regexp_extract_all(lower(CASE WHEN a > 96 THEN regexp_replace(substr(text, a - 95, 96), '^\p{{L}}+', '') ELSE substr(text, 1, a) END), '\p{{L}}{{3,}}') AS lw,
    regexp_extract_all(lower(regexp_replace(substr(text, z + 1, 96), '\p{{L}}+$', '')), '\p{{L}}{{3,}}') AS rw FROM b),
c AS (SELECT r, unnest(es) AS e, list_concat(lw[greatest(len(lw) - 5, 1):], rw[:6]) AS ctx FROM c0),
pairs AS (SELECT e, term FROM (SELECT DISTINCT e, ctx, unnest(ctx) AS term FROM c) GROUP BY e, term HAVING count(DISTINCT ctx) >= 3),
re AS (SELECT DISTINCT r, e FROM c),
said AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '\p{{L}}{{3,}}')) AS term FROM d),
te AS (SELECT pairs.e, pairs.term, count(*) AS n_te FROM pairs JOIN re ON pairs.e = re.e JOIN said ON said.r = re.r AND said.term = pairs.term GROUP BY pairs.e, pairs.term),
ne AS (SELECT e, count(*) AS n_e FROM re GROUP BY e),
nt AS (SELECT term, count(*) AS n_t FROM said WHERE term IN (SELECT term FROM te) GROUP BY term),
tells AS (
  SELECT te.e, te.term FROM te JOIN ne ON te.e = ne.e JOIN nt ON te.term = nt.term, (SELECT count(*)::DOUBLE AS n FROM d)
  WHERE n_e < n AND ln(n * n_te / (n_t::DOUBLE * n_e)) / ln(n / n_e) >= 0.9),
own AS (
  SELECT DISTINCT re.r, d.text, tells.term FROM tells JOIN re ON re.e = tells.e JOIN said ON said.r = re.r AND said.term = tells.term JOIN d ON d.r = re.r),
w AS (
  SELECT r, 4 AS kind, unnest(regexp_extract_all(text, '\p{{L}}+')) AS v, unnest(regexp_split_to_array(text, '\p{{L}}+')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '\p{{L}}+'), 1) AS i
  FROM (SELECT DISTINCT r, text FROM own)),
wz AS (SELECT r, kind, v, ({_AT})::BIGINT AS z FROM w),
s AS (
  SELECT r, kind, a, z FROM b
  UNION ALL SELECT wz.r, kind, z - length(v), z FROM wz JOIN own ON wz.r = own.r AND lower(wz.v) = own.term),
g AS (
  SELECT r, {" ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{n}," for k, n in enumerate([*_KINDS, "term"]))}
    {_WRITTEN} FILTER (WHERE kind < 4) AS base, {_WRITTEN} AS spans FROM s GROUP BY r)
SELECT doc_id, {" ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}," for n in [*_KINDS, "term"])}
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.r = g.r
"""

_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT edge.v, reach.r FROM reach JOIN edge ON edge.u = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0)::HUGEINT AS c FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w)::HUGEINT AS p FROM grid WINDOW w AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM grid GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w)::HUGEINT AS q FROM whole WINDOW w AS (PARTITION BY lang)),
diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN diff ON diff.lang = g.lang AND diff.source = g.source AND diff.item = h.source),
term AS (SELECT p.lang, p.source, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM r) WHERE part = 'pair' OR k <= 50
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op6_suffix_dedup": _OP6, "op10_pii": _OP10, "op11_jaccard_join": _OP11, "op12_source_divergence": _OP12}
