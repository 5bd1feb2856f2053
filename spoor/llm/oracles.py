"""Plain SQL for the operators that SQL can express."""

from __future__ import annotations

# CRC-32 (polynomial 0xEDB88320, reflected), its table made by the rule.
CRC = """crct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32(text: str, table: str = "(SELECT t FROM crct)") -> str:
    """CRC-32 of an expression of ASCII characters."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split({text}, '') IF c <> '']), "
            f"lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)")


# --- op11 ---------------------------------------------------------------------------
_BLANK = r"[\x20\x09-\x0D]"
_EMPTY = "'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'"
OP11 = f"""WITH RECURSIVE {CRC},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations, crct),
bad AS (SELECT *, {crc32('name', 't')} % 20 AS f FROM src),
dam AS (SELECT coalesce('c' || conv_id::VARCHAR, '') AS conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM bad WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM dam),
kind AS (SELECT *, regexp_replace(text, '{_BLANK}+$', '') AS bare,
  row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS again,
  left(lag(role) OVER (PARTITION BY conv ORDER BY n), 1) || left(role, 1) AS pair FROM num),
rws AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate'
  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM kind),
tot AS (SELECT conv, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rws GROUP BY conv),
-- q, m: 0 nothing, 1 system, 2 user, 3 assistant came last
ins(q, m, c, e, l) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:~'), (0, 3, 6, 'II', 'user:~assistant:~'),
  (1, 1, 0, '', ''), (1, 2, 3, 'I', 'user:~'), (1, 3, 6, 'II', 'user:~assistant:~'),
  (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:~'), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:~')),
eat(m, op, init, r) AS (VALUES (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3),
  (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
  (0, 'R', '', 2), (1, 'R', '', 2), (2, 'R', '', 3), (3, 'R', '', 2)),
dp AS (SELECT conv, 0::BIGINT AS n, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS body FROM tot
  UNION ALL
  SELECT conv, n, r, cost, audit, body FROM (SELECT d.conv, w.n, t.r, d.cost + i.c
      + CASE t.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN t.op <> 'D' AND w.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      d.audit || i.e || t.op AS audit, d.body || replace(i.l, '~', chr(10)) || CASE t.op WHEN 'D' THEN ''
        WHEN 'K' THEN w.role || ':' || w.text || chr(10)
        ELSE CASE t.r WHEN 2 THEN 'user:' ELSE 'assistant:' END || w.text || chr(10) END AS body,
      row_number() OVER (PARTITION BY d.conv, t.r ORDER BY d.cost + i.c
        + CASE t.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN t.op <> 'D' AND w.fault = 'truncated' THEN 3 ELSE 0 END,
        d.audit || i.e || t.op) AS k
    FROM dp d JOIN rws w ON w.conv = d.conv AND w.n = d.n + 1 JOIN ins i ON i.q = d.q JOIN eat t ON t.m = i.m
    WHERE t.op = 'D' OR (w.fault NOT IN ('blank', 'duplicate') AND (t.op = 'R' OR t.init = left(w.role, 1)))) WHERE k = 1),
fin AS (SELECT d.conv, d.cost + z.c AS cost, d.audit || z.e AS audit, d.body || replace(z.l, '~', chr(10)) AS body,
  row_number() OVER (PARTITION BY d.conv ORDER BY d.cost + z.c, d.audit || z.e) AS k
  FROM dp d JOIN tot USING (conv) JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', 'user:~assistant:~'),
    (2, 3, 'I', 'assistant:~'), (3, 0, '', '')) z(q, c, e, l) ON z.q = d.q WHERE d.n = size)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha256(left(body, length(body) - 1)), {_EMPTY}) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN tot ON tot.conv = coalesce('c' || s.conv_id::VARCHAR, '')
LEFT JOIN fin ON fin.conv = tot.conv AND k = 1"""


# --- op12 ---------------------------------------------------------------------------
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = (("assign", f"""({_WORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18),
            ("hex", "[0-9a-f]+", 0, 16), ("opaque", "[A-Za-z0-9+/_-]{24,}", 0, 24))
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, source, {k} AS rank, '{kind}' AS kind, unnest(regexp_split_to_array(text, {_q(p)})) AS gap,
    unnest(list_append(regexp_extract_all(text, {_q(p)}, 0), NULL)) AS hit, unnest(list_append(regexp_extract_all(text, {_q(p)}, {g}), NULL)) AS val,
    unnest(range(len(regexp_extract_all(text, {_q(p)}, 0)) + 1)) AS pos, {least} AS least FROM d WHERE regexp_matches(text, {_q(p)})"""
    for k, (kind, p, g, least) in enumerate(_SECRETS))
OP12 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({_MATCHES}),
s0 AS (SELECT *, sum(length(gap)) OVER k + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM m WINDOW k AS (PARTITION BY doc_id, rank ORDER BY pos)),
s AS (SELECT *, a + length(hit) AS b, a + length(hit) - length(val) AS va FROM s0 WHERE hit IS NOT NULL AND length(val) >= least),
own AS (SELECT val, count(DISTINCT coalesce(source, '~')) AS owners FROM s GROUP BY val),
j AS (SELECT s.*, owners >= 3 AS copied, owners < 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
  AND len(list_distinct(string_split(val, ''))) >= 8 AS live FROM s JOIN own USING (val)),
p AS (SELECT doc_id, a, rank, b, kind, copied FROM j WHERE rank < 3
  UNION ALL SELECT DISTINCT doc_id, va, 4, b, 'live', false FROM j WHERE live),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank, b)
    FILTER (rank < 3), '')) AS base_sha256, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank, b) AS spans,
  count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (copied) AS n_copied FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (doc_id)"""


# --- op13 ---------------------------------------------------------------------------
def _part(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, leaves: str) -> str:
    """All nodes ``name(lvl, g, slot, d)`` over ``leaves(g, slot, d)``, and the siblings ``name_s(lvl, g, slot, l, r)``."""
    run = "PARTITION BY lvl, g, slot // 3 ORDER BY slot ROWS BETWEEN"
    return f"""{name} AS (SELECT 0 AS lvl, g, slot, d FROM {leaves} UNION ALL
  SELECT lvl + 1, g, slot // 3, sha256(string_agg(d, '' ORDER BY slot)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name})
  WHERE c > 1 GROUP BY lvl, g, slot // 3),
{name}_s AS (SELECT lvl, g, slot, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT *, max(lvl) OVER (PARTITION BY g) AS h FROM {name}) WHERE lvl < h)"""


_HEAD = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP13 = f"""WITH RECURSIVE {CRC},
lf AS (SELECT doc_id, coalesce('g' || source, '') AS g, sha256({_HEAD} || {_part('text')}) AS d,
  sha256({_HEAD} || {_part("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")}) AS tam
  FROM (SELECT documents.*, coalesce({crc32('doc_id::VARCHAR', 't')} % 2 = 0, false) AS even FROM documents, crct)),
lv AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS slot, row_number() OVER () AS k FROM lf),
{_tree('nd', 'lv')},
sr AS (SELECT g AS src, '' AS g, d, row_number() OVER (ORDER BY g) - 1 AS slot FROM nd
  WHERE (g, lvl) IN (SELECT (g, max(lvl)) FROM nd GROUP BY g)),
{_tree('tp', 'sr')},
rt AS (SELECT d AS root FROM tp ORDER BY lvl DESC LIMIT 1),
st AS (SELECT k, s.lvl, l, r FROM lv JOIN nd_s s ON s.g = lv.g AND s.slot = lv.slot // (3 ** s.lvl)::BIGINT
  UNION ALL SELECT k, 1000 + s.lvl, l, r FROM lv JOIN sr ON sr.src = lv.g JOIN tp_s s ON s.slot = sr.slot // (3 ** s.lvl)::BIGINT),
pf AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM st GROUP BY k),
fo AS (SELECT doc_id, lv.d AS leaf, sr.d AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(tam, coalesce(steps, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM lv JOIN sr ON sr.src = lv.g LEFT JOIN pf USING (k), rt)
SELECT *, folded_root = root AS verified FROM fo"""
