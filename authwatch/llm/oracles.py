"""DuckDB equivalents of the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

URL_FILTER = f"""
WITH rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
       ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
whole AS (SELECT page_id, n, regexp_extract(r, '(?s)^[^?#]*') AS w FROM rest),
parts AS (SELECT page_id, n, translate(regexp_extract(w, '(?s)^[^/]*'), '{_UPPER}', '{_LOWER}') AS host,
                 CASE WHEN contains(w, '/') THEN substr(w, instr(w, '/')) ELSE '' END AS path FROM whole)
SELECT page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(max_by(r.action, length(r.host || r.path)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY page_id, n, p.host, p.path
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * (256 + 49)) AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0), 256)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS p, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, o, h, unnest(range(0, least(256, length(h) // 2 - 49))) AS i FROM part)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before
        FROM w JOIN f USING (s) WHERE first < doc_id),
run AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
edge AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM span),
piece AS (SELECT e.doc_id, a, b, substr(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END AS x
          FROM edge e JOIN d USING (doc_id)),
gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(x, '' ORDER BY a) AS kept FROM piece GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

DECONTAMINATION = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[p:p + 12], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
seen AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS s
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
             FROM doc, (SELECT DISTINCT size FROM win))),
found AS (SELECT doc_id, seen.size, p, item FROM seen JOIN win ON seen.s = win.s AND seen.size = win.size),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(hits.n > 0 AND 20 * hits.n >= len(w), false) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE c / (p.n + q.n - c) >= 0.8),
reach(doc_id, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, link.b FROM reach r JOIN link ON r.b = link.a)
SELECT doc_id, min(b) AS class_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

TOOL_CALLS = """
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations),
asked AS (SELECT *, 'c' || turn AS call_id, CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'unlisted' END AS name,
                 length(text) % 5 = 0 AS quoted FROM turns WHERE role = 'assistant'),
answer AS (SELECT u.* FROM turns u SEMI JOIN asked a ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 WHERE role = 'user'),
first AS (SELECT conv_id, min(turn) AS first FROM asked GROUP BY conv_id),
c AS (SELECT a.*, first, EXISTS (SELECT 1 FROM answer r WHERE r.conv_id = a.conv_id AND r.turn = a.turn + 1) AS answered,
             EXISTS (SELECT 1 FROM answer r WHERE r.conv_id = a.conv_id AND r.turn = first + 1) AS first_answered
      FROM asked a JOIN first USING (conv_id)),
call AS (SELECT *, CASE WHEN turn = first OR NOT first_answered THEN 0 ELSE 2 END AS level FROM c)
SELECT conv_id, turn, 'message' AS kind, NULL AS call_id, 'plain' AS status, '' AS errors, turn AS order_turn, 0 AS order_level,
       '{"content":' || to_json(text) || ',"role":"' || role || '"}' AS json
FROM turns t WHERE role <> 'assistant' AND NOT EXISTS (SELECT 1 FROM answer r WHERE r.conv_id = t.conv_id AND r.turn = t.turn)
UNION ALL
SELECT conv_id, turn, 'call', call_id, CASE WHEN answered THEN 'linked' ELSE 'no_result' END,
       CASE name WHEN 'search' THEN CASE WHEN quoted THEN 'type:limit' ELSE '' END WHEN 'summarise' THEN 'unknown:limit' ELSE 'unknown_tool' END,
       turn, level,
       '{"arguments":{"limit":' || CASE WHEN quoted THEN '"' || turn || '"' ELSE turn::VARCHAR END || ',"text":' || to_json(text)
       || '},"call":{"call_id":"' || call_id || '","name":"' || name || '"}}'
FROM call
UNION ALL
SELECT r.conv_id, r.turn, 'result', c.call_id, 'linked', '', r.turn, c.level + 1,
       '{"call_id":"' || c.call_id || '","content":' || to_json(r.text) || ',"role":"tool"}'
FROM answer r JOIN call c ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
"""


LEXICAL_SEARCH = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
stat AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, coalesce(sum(len(w)), 0)::BIGINT AS big_l FROM doc),
tf AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM doc) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
item AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS t FROM
         (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark)) GROUP BY ALL),
weight AS (SELECT i, item_id, t, q, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * coalesce(df, 0) + 1)::DOUBLE))::BIGINT AS w
           FROM item LEFT JOIN df USING (t), stat),
scored AS (SELECT i, item_id, r, doc_id,
                  sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
           FROM weight JOIN tf USING (t), stat GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

FILTER_AUDIT = r"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
                    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT x, min(doc_id) AS first FROM doc GROUP BY x),
label AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flag AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
                 'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x),
                 'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
         FROM doc JOIN first USING (x) LEFT JOIN label USING (doc_id)),
fails AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C
                 WHEN 'D' THEN f.D ELSE f.E END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY ALL),
letter(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
ord AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM letter a, letter b, letter c, letter d, letter e
        WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
step AS (SELECT filter_order, s AS step, filter_order[s] AS own, string_split(filter_order[1:s - 1], '') AS before FROM ord, range(1, 6) t(s)),
walk AS (SELECT part, filter_order, step, own, sum(n) AS total,
                sum(n) FILTER (list_has_any(failed, before)) AS gone_before,
                sum(n) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS removed,
                sum(n) FILTER (list_contains(failed, own) AND list_has_any(failed, before)) AS redundant,
                sum(n) FILTER (failed = [own]) AS unique_fails,
                sum(good) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS good_lost,
                sum(toxic) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS toxic_lost
         FROM fails, step GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, (total - coalesce(gone_before, 0) - coalesce(removed, 0))::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM walk
"""


def mixing(powers: dict[str, float], rounds: int = 8) -> str:
    """Raking, written out step by step."""
    steps = ["""
doc AS (SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l,
               len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n FROM documents),
placed AS (SELECT *, CASE WHEN n < 100 THEN 'note' WHEN n < 800 THEN 'article' ELSE 'long read' END AS t FROM doc),
cell0 AS (SELECT s, l, t, sum(n)::DOUBLE AS tokens, 1::DOUBLE AS f FROM placed GROUP BY s, l, t)"""]
    short = {"source": "s", "lang": "l", "topic": "t"}
    for dim, power in powers.items():
        steps.append(f"goal_{short[dim]} AS (SELECT {short[dim]}, pow(sum(tokens), {power}) AS goal FROM cell0 GROUP BY 1 HAVING sum(tokens) > 0)")
    i = 0
    for _ in range(rounds):
        for dim in powers:
            d = short[dim]
            steps.append(f"have{i} AS (SELECT {d}, sum(tokens * f) AS have FROM cell{i} GROUP BY {d})")
            steps.append(f"cell{i + 1} AS MATERIALIZED (SELECT s, l, t, tokens, CASE WHEN have > 0 AND goal IS NOT NULL THEN f * (goal / have) ELSE f END AS f "
                         f"FROM cell{i} LEFT JOIN have{i} USING ({d}) LEFT JOIN goal_{d} USING ({d}))")
            i += 1
    return f"""
WITH {", ".join(steps)}
SELECT doc_id, source, lang, t AS topic, n::BIGINT AS n_tokens, round(p, 9) AS probability
FROM (SELECT doc_id, source, lang, t, n, least(1.0, f * (1 / (SELECT max(f) FROM cell{i}))) AS p
      FROM placed JOIN cell{i} USING (s, l, t))
WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/mix'), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 < p
"""


def sql(mix_powers: dict[str, float]) -> dict[str, str]:
    return {"op1_url_filter": URL_FILTER, "op2_suffix_dedup": SUFFIX_DEDUP, "op4_tool_calls": TOOL_CALLS,
            "op6_decontamination": DECONTAMINATION, "op8_near_duplicates": NEAR_DUPLICATES, "op10_mixing": mixing(mix_powers),
            "op12_lexical_search": LEXICAL_SEARCH, "op13_filter_audit": FILTER_AUDIT}
