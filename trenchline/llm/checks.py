"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

CHECKS = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, rowid AS r, i, line, translate(trim(line, {_TRIM}), {_LOWER}) AS key
  FROM (SELECT doc_id, row_number() OVER () AS rowid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       UNNEST(parts) WITH ORDINALITY AS u(line, i)),
lost AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.holder AS gone FROM lines l LEFT JOIN lost k USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op4_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][number % 3 + 1] AS w, 2 * source_size AS most FROM per_source),
rates AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0::DOUBLE - coalesce(sum(most) OVER before, 0)::DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS rate
  FROM weighed WINDOW before AS (ORDER BY most::DOUBLE / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(rate, most::DOUBLE / w) AS rate FROM rates WHERE rate * w <= most),
targets AS (SELECT r.number, r.source, r.source_size, least(r.most::DOUBLE, coalesce(c.rate * r.w, r.most)) AS target FROM rates r, common c),
placed AS (
  SELECT t.number, s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
         coalesce(sum(s.size) OVER (PARTITION BY t.number ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
blocked AS (
  SELECT *, ceil(source_size / greatest(1, ceil(source_size / 65536.0)))::BIGINT AS length FROM (
    SELECT number, source_size, CAST(floor(target + 0.5) AS BIGINT) AS take FROM targets WHERE source_size > 0)),
needs AS (
  SELECT *, ceil(source_size / length::DOUBLE)::BIGINT AS blocks,
         (take // source_size) * ceil(source_size / length::DOUBLE)::BIGINT + ceil((take % source_size) / length::DOUBLE)::BIGINT AS slots FROM blocked),
circle AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low, (sum(slots) OVER ())::BIGINT AS total FROM needs),
points AS (
  SELECT slot, (slot % 2147483648) * 2654435769 % 4294967296 / 4294967296::DOUBLE * total AS point
  FROM (SELECT DISTINCT total FROM circle) t, range(0, (SELECT 2 * max(total) FROM circle)) r(slot)),
dealt AS (
  SELECT slot, c.*, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM points JOIN circle c ON point >= low AND point < low + slots),
used AS (
  SELECT number, slot, rank % blocks * length AS block_start, least((rank % blocks + 1) * length, take - rank // blocks * source_size) AS block_end FROM dealt WHERE rank < slots),
firsts AS (
  SELECT p.number, p.start, min(slot) AS first_slot FROM placed p JOIN used u ON u.number = p.number AND u.block_start < p.start + p.size AND u.block_end > p.start
  WHERE p.size > 0 GROUP BY ALL)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, take) - start) + greatest(0, least(start + size, take - source_size) - start) AS BIGINT) AS taken,
       CASE WHEN size > 0 THEN first_slot END AS first_slot
FROM placed LEFT JOIN firsts USING (number, start)""",
    "op9_top_k": """
WITH whole AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""",
    "op10_exact_dedup": f"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT p.doc_id, g.keep_id, g.group_size, p.doc_id = g.keep_id AS kept, sha256(p.t) AS text_sha256
FROM plain p JOIN groups g USING (t)""",
    "op11_source_divergence": r"""
WITH words AS (
  SELECT d, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents), UNNEST(terms) AS u(term)),
terms AS (SELECT lang, term, count(*) AS times FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS times FROM words w JOIN terms t ON w.lang = t.lang AND w.term = t.term GROUP BY ALL),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
langs AS (SELECT g.lang, count(t.term) AS v, coalesce(sum(t.times), 0) AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN terms t USING (lang) GROUP BY g.lang),
sums AS (SELECT g.lang, g.source, coalesce(sum(c.times), 0) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
rates AS (
  SELECT s.lang, s.source, t.term, coalesce(c.times, 0) AS times,
         1 + CAST(1000000000 * (coalesce(c.times, 0) + 5)::HUGEINT // (s.n + 5 * l.v)::HUGEINT AS BIGINT) AS p,
         1 + CAST(1000000000 * (t.times + 5)::HUGEINT // (l.n + 5 * l.v)::HUGEINT AS BIGINT) AS q
  FROM sums s JOIN langs l USING (lang) JOIN terms t USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM rates WHERE times > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found) WHERE part = 'pair' OR r <= 50""",
    "op12_filter_audit": r"""
WITH said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
split AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_ids AS (SELECT t, min(doc_id) AS first FROM split GROUP BY t),
fails AS (
  SELECT s.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a,
         CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * length(regexp_replace(s.t, '[^A-Z]', '', 'g')) > 3 * length(s.t) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(s.t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
         CASE WHEN s.doc_id > f.first THEN 1 ELSE 0 END AS e
  FROM split s JOIN least_ids f ON s.t = f.t LEFT JOIN said ON said.doc_id = s.doc_id),
cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) x(i)),
counts AS (
  SELECT c.part, s.filter_order, s.step, s.own,
         sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells c, steps s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts""",
}
