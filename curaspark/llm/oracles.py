"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .mixing import GOLDEN
from .urls import GIVEN_RULES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in GIVEN_RULES)

# every slot of the schedule, its rank in its source, and the words of the source's line that it takes
MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WS})) AS BIGINT) AS size, sha256('mix:' || doc_id) AS h FROM documents),
t AS (SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][(k - 1) % 3 + 1] AS w, 2 * s AS most FROM t),
l AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS r FROM w
      WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT source, s, least(CAST(most AS DOUBLE), coalesce((SELECT first(level ORDER BY r) FROM l WHERE level * w <= most), 0) * w) AS target FROM l),
q AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, sum(target) OVER () AS total, sum(target) OVER (ORDER BY source NULLS LAST) / nullif(sum(target) OVER (), 0) AS hi FROM p),
e AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM q),
u AS (SELECT i AS slot, (i + 0.5::DOUBLE) * {GOLDEN} - floor((i + 0.5::DOUBLE) * {GOLDEN}) AS u FROM range(CAST((SELECT ceil(any_value(total) / 512) FROM e) AS BIGINT)) r(i)),
early AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM u JOIN e ON lo <= u AND (u < hi OR hi >= 1)),
have AS (SELECT e.sid, count(slot) AS have, ceil(round(any_value(target)) / 512) AS need FROM e LEFT JOIN early USING (sid) GROUP BY 1),
late AS (SELECT sid, unnest(range(CAST(have AS BIGINT), CAST(need AS BIGINT))) AS rank FROM have WHERE have < need),
slots AS (SELECT sid, rank, slot FROM early UNION ALL SELECT sid, rank, (SELECT count(*) FROM u) + row_number() OVER (ORDER BY sid, rank) - 1 FROM late),
takes AS (SELECT sid, slot, s, rank * 512 AS a, least(rank * 512 + 512, round(target)) AS b FROM slots JOIN e USING (sid) WHERE rank * 512 < round(target)),
pieces AS (SELECT sid, slot, greatest(a, k * s) - k * s AS a, least(b, k * s + s) - k * s AS b FROM takes, (VALUES (0), (1)) v(k) WHERE greatest(a, k * s) < least(b, k * s + s)),
c AS (SELECT d.*, sid, s, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS lo FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
got AS (SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(greatest(a, lo) - lo AS BIGINT) AS first, CAST(least(b, lo + size) - greatest(a, lo) AS BIGINT) AS n FROM c JOIN pieces ON c.sid = pieces.sid AND a < lo + size AND lo < b),
each AS (SELECT doc_id, sum(n) AS taken, count(*) AS k, min(slot) AS first_slot, string_agg(slot || ':' || first || ':' || n, ',' ORDER BY slot, first, n) AS x FROM got GROUP BY 1)
SELECT c.doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(k, 0) AS n_slots, first_slot, sha256(coalesce(x, '')) AS slots_sha256
FROM c LEFT JOIN each USING (doc_id)"""

# all token sets of the labelled pages by enumeration
URLS = rf"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(html, '(?i)<html\b[^>]*\blang\s*=\s*["'']?([A-Za-z]+)', 1)) AS lang, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, q) AS (VALUES {_RULES}),
fit AS (SELECT page_id, h || q AS rule, verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) = 1),
b AS (SELECT p.*, rule, verdict, list_filter(string_split(host, '.'), lambda x: x <> '') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS sg FROM p LEFT JOIN fit USING (page_id)),
tok AS (SELECT page_id, lang, list_sort(list_distinct(
    CASE WHEN len(ls) > 1 THEN ['h:' || ls[-1], 'h:' || ls[-2] || '.' || ls[-1]] WHEN len(ls) = 1 THEN ['h:' || ls[1]] ELSE [] END
    || list_transform(list_filter(flatten(list_transform(CASE WHEN len(ls) > 2 THEN ls[1:len(ls) - 2] ELSE [] END, lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'w:' || x)
    || list_transform(sg, lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN 'd:' || x[1] ELSE 'p:' || x END))) AS ts FROM b),
one AS (SELECT page_id, CASE WHEN lang <> '' THEN lang NOT IN ('en', 'de', 'fr') END AS blocked, unnest(ts) AS t FROM tok),
sets AS (SELECT page_id, blocked, t AS last, t AS s FROM one UNION ALL SELECT sets.page_id, sets.blocked, t, s || chr(10) || t FROM sets JOIN one ON sets.page_id = one.page_id AND t > last),
f AS (SELECT s, count(*) AS n, count(*) FILTER (blocked) AS k FROM sets WHERE blocked IS NOT NULL GROUP BY ALL),
need AS (SELECT ceil(0.002 * count(*)) AS m FROM tok WHERE lang <> ''),
good AS (SELECT s, CASE WHEN k >= m AND k / n >= 0.95 THEN k / n END AS cb, CASE WHEN n - k >= m AND (n - k) / n >= 0.95 THEN (n - k) / n END AS ca FROM f, need),
fired AS (SELECT page_id, max(cb) AS cb, max(ca) AS ca FROM sets JOIN good USING (s) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(cb, 0) > coalesce(ca, 0) THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN verdict IS NULL THEN cb END AS mined_confidence
FROM b LEFT JOIN fired USING (page_id)"""

DECONTAMINATION = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM documents),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, k FROM places JOIN win USING (n, s)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT y, r FROM reach JOIN pairs ON doc_id = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
s AS (SELECT doc_id, i FROM k SEMI JOIN (SELECT m FROM k GROUP BY 1 HAVING count(*) > 1) USING (m)),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM s),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY ALL),
pieces AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r UNION ALL SELECT doc_id, length(h) // 2, coalesce(b, 0) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM r GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS x FROM pieces JOIN d USING (doc_id) GROUP BY 1),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM r GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

_ESCAPED = r"replace(replace(replace({}, '\', '\e'), '<', '\l'), '[', '\b')"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|turn|>') + length(replace({_ESCAPED.format("role")}, chr(10), '\\k')) + 1 + length({_ESCAPED.format("text")}) + length('<|end|>') + 1) AS f FROM t GROUP BY 1)
SELECT conv_id, n AS n_turns, sha256(a) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS n_expanded_tokens FROM c"""

ORACLES = {"op2_mixing": MIXING, "op3_url_filter": URLS, "op4_decontamination": DECONTAMINATION, "op5_near_duplicates": NEAR_DUPLICATES, "op7_substring_dedup": SUBSTRINGS, "op10_chat": CHAT}
