"""The same results as plain SQL over the same tables, for DuckDB. Written from the rules, not
from the Spark plans: stacks are self-joins, first and best rows are ranked windows."""

from docreview.constants import (
    ERROR_CITE_RANGE, ERROR_ITEM, ERROR_PARSE, ERROR_REASON, ERROR_TIER, FLAG_FALLBACK, FLAG_NOT_FOUND,
    MISS_LABEL_NOT_FOUND, MISS_LABEL_NO_FILE, REASON_NOT_FOUND, REASON_NO_FILE, REASON_UNRATED,
    RETRY_MESSAGE,
)

PAIR = "project, bidder, item_id"
_GUID = "'00000000-0000-0000-0000-' || lpad(({})::VARCHAR, 12, '0')"

# A score as a cell shows it.
_CELL = "coalesce(CASE WHEN score = 0 THEN '0' ELSE regexp_replace(score::VARCHAR, '\\.0$', '') END, '—')"

# ---- shared views --------------------------------------------------------------------------

DOCS = f"""
docs AS (
  SELECT 'P' || (doc_id % 2) AS project, source AS bidder, doc_id::INTEGER AS file_no,
    'doc' || doc_id || '-' || {_GUID.format("(doc_id // 2) % 2")} || '.pdf' AS file,
    {_GUID.format("(doc_id // 2) % 2")} AS guid, text
  FROM documents)"""

LINES = DOCS + """,
fx_lines AS (
  SELECT project, bidder, file_no, file, guid, i::INTEGER AS line_no, (1 + i // 40)::INTEGER AS page,
    parts[i + 1] AS text
  FROM (SELECT *, unnest(range(len(parts))) AS i
        FROM (SELECT * EXCLUDE (text), string_split(text, chr(10)) AS parts FROM docs)))"""

NUMBERED = LINES + """,
numbered AS (
  SELECT * EXCLUDE (text), CASE
    WHEN line_no % 7 = 0 THEN '第' || (1 + line_no // 7) || '章 ' || left(text, 10)
    WHEN line_no % 7 = 2 THEN '2.1 ' || text
    WHEN line_no % 7 = 3 THEN '一、' || left(text, 10)
    WHEN line_no % 7 = 4 THEN '1.' || line_no || ' ' || left(text, 12)
    WHEN line_no % 7 = 5 THEN '（3）' || left(text, 8)
    WHEN line_no % 7 = 6 AND line_no % 2 = 0 THEN '4、' || left(text, 9)
    ELSE text END AS text
  FROM fx_lines),
leveled AS (
  SELECT *, length(text) AS len, CASE
    WHEN regexp_matches(text, '^\\s*第[一二三四五六七八九十百\\d]+(章|节|篇|部分)') THEN 1
    WHEN regexp_matches(text, '^\\s*[一二三四五六七八九十百]{1,3}、') THEN 2
    WHEN regexp_matches(text, '^\\s*\\d+\\.\\d+\\.\\d+([^0-9]|$)') THEN 4
    WHEN regexp_matches(text, '^\\s*\\d+\\.\\d+([^0-9]|$)') THEN 4
    WHEN regexp_matches(text, '^\\s*\\d{1,2}[、.．]([^0-9]|$)') THEN 3
    WHEN regexp_matches(text, '^\\s*[（(][一二三四五六七八九十百\\d]{1,3}[）)]') THEN 5 END AS level
  FROM numbered),
p90s AS (
  SELECT project, bidder, file_no, count(*) AS n_lines,
    list_sort(list(len))[least(floor(count(*) * 0.9::DOUBLE)::INTEGER, count(*) - 1) + 1] AS p90
  FROM leveled GROUP BY ALL),
marked AS (
  SELECT l.*, level IS NOT NULL AND len < 0.8::DOUBLE * p90 AS is_heading
  FROM leveled l JOIN p90s USING (project, bidder, file_no)),
heads AS (SELECT * FROM marked WHERE is_heading),
paths AS (
  SELECT h.project, h.bidder, h.file_no, h.line_no, h.level, h.page, list(g.text ORDER BY g.line_no) AS path
  FROM heads h JOIN heads g ON h.project = g.project AND h.bidder = g.bidder AND h.file_no = g.file_no
    AND g.line_no <= h.line_no
  WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.project = h.project AND k.bidder = h.bidder
    AND k.file_no = h.file_no AND k.line_no > g.line_no AND k.line_no <= h.line_no AND k.level <= g.level)
  GROUP BY ALL),
blocked AS (
  SELECT *, coalesce(max(CASE WHEN is_heading THEN line_no END) OVER (
    PARTITION BY project, bidder, file_no ORDER BY line_no), -1) AS block FROM marked),
blocks AS (
  SELECT project, bidder, file_no, block, min(file) AS file, min(guid) AS guid, arg_min(page, line_no) AS first_page,
    regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text
  FROM blocked WHERE NOT is_heading GROUP BY ALL HAVING length(trim(string_agg(text, ''))) > 0),
built AS (
  SELECT b.project, b.bidder, b.file_no, b.file, b.guid,
    row_number() OVER (PARTITION BY b.project, b.bidder, b.file_no ORDER BY b.block) AS seq,
    CASE WHEN block = -1 THEN ['(前言)'] ELSE p.path END AS path,
    CASE WHEN block = -1 THEN 0 ELSE p.level END AS level,
    CASE WHEN block = -1 THEN first_page ELSE p.page END AS page, text, length(text) AS char_len
  FROM blocks b LEFT JOIN paths p ON b.project = p.project AND b.bidder = p.bidder AND b.file_no = p.file_no
    AND b.block = p.line_no),
sections AS (SELECT *, file_no || '#' || seq AS id FROM built)"""

LINE_SECTIONS = LINES + """,
sections AS (
  SELECT project, bidder, file_no || '#' || (line_no + 1) AS id, file, guid, file_no, line_no + 1 AS seq,
    [file_no::VARCHAR, (line_no // 5)::VARCHAR, left(text, 30)] AS path, 3 AS level, page, text,
    length(text) AS char_len
  FROM fx_lines)"""

ITEMS = f"""
words AS (SELECT item_id AS n, text, regexp_extract_all(text, '\\p{{L}}{{2,}}') AS w FROM benchmark),
items AS (
  SELECT 'P' || (n % 2) AS project, 'T-' || lpad(n::VARCHAR, 4, '0') AS item_id, n AS item_no,
    {_GUID.format("(n // 2) % 2")} AS guid, array_to_string(w[1:2], ' ') AS name,
    array_to_string(w[1:3], ' ') AS aspect, array_to_string(w[4:5], ' ') AS synonym,
    [20, 8, 4, 3, 2][n % 5 + 1]::DOUBLE AS max_score, text AS criteria
  FROM words),
budgets AS (SELECT project, item_id, (600 + max_score * 100)::INTEGER AS budget FROM items),
dims AS (
  SELECT project, item_id, guid, dim_no, phrase,
    list_sort(list_distinct(list_filter(string_split(phrase, ' '), lambda x: length(x) >= 2))) AS terms
  FROM (
    SELECT project, item_id, guid, 0 AS dim_no, aspect AS phrase FROM items WHERE aspect <> ''
    UNION ALL SELECT project, item_id, guid, CASE WHEN aspect <> '' THEN 1 ELSE 0 END, synonym FROM items
      WHERE synonym <> '' AND synonym <> aspect
    UNION ALL SELECT project, item_id, guid, -1, name FROM items WHERE name <> '' AND (aspect <> '' OR synonym <> '')))"""


def _locate(sections: str) -> str:
    """Everything from sections to packages."""
    return sections + "," + ITEMS + """,
sec AS (
  SELECT *, replace(replace(text, chr(13), ''), chr(10), '') AS body, array_to_string(path, ' ') AS title,
    CASE WHEN len(path) > 1 THEN path[1:len(path) - 1] ELSE path END AS unit
  FROM sections),
sizes AS (SELECT project, bidder, count(*) AS n FROM sec GROUP BY ALL),
vocab AS (SELECT DISTINCT project, unnest(terms) AS term FROM dims),
freq AS (
  SELECT z.project, z.bidder, v.term, z.n, coalesce(c.df, 0) AS df, ln((z.n + 1.0::DOUBLE) / (coalesce(c.df, 0) + 1.0::DOUBLE)) AS idf
  FROM sizes z JOIN vocab v USING (project)
  LEFT JOIN (SELECT s.project, s.bidder, v.term, count(*) AS df FROM sec s JOIN vocab v USING (project)
             WHERE contains(s.body || ' ' || s.title, v.term) GROUP BY ALL) c USING (project, bidder, term)),
weighed AS (
  SELECT d.project, z.bidder, d.item_id, d.guid, d.dim_no, d.phrase, z.n, s.stats, s.anchor, s.anchor_df
  FROM dims d JOIN sizes z USING (project)
  LEFT JOIN (
    SELECT *, a['term'] AS anchor, a['df'] AS anchor_df FROM (
    SELECT project, bidder, item_id, dim_no, list({'term': term, 'df': df, 'idf': idf} ORDER BY term) AS stats,
      min({'df': df, 'term': term}) FILTER (WHERE df <= n * 0.05::DOUBLE) AS a
    FROM (SELECT project, item_id, dim_no, unnest(terms) AS term FROM dims) t JOIN freq USING (project, term)
    GROUP BY ALL)) s ON s.project = d.project AND s.bidder = z.bidder AND s.item_id = d.item_id AND s.dim_no = d.dim_no),
pairs AS (
  SELECT s.project, s.bidder, w.item_id, w.dim_no, s.id, s.file, s.file_no, s.seq, s.unit, s.char_len,
    w.n, w.phrase, coalesce(w.stats, []) AS stats, s.title, s.body,
    coalesce(list_max(list_transform(list_filter(coalesce(w.stats, []), lambda t: contains(w.phrase, t.term)), lambda t: t.idf)), 0) AS pw
  FROM sec s JOIN weighed w ON s.project = w.project AND s.bidder = w.bidder AND s.guid = w.guid
  WHERE (w.anchor_df IS NULL OR w.anchor_df > 0)
    AND (w.anchor IS NULL OR contains(s.body, w.anchor) OR contains(s.title, w.anchor))),
parts AS (
  SELECT *, list_concat(
    CASE WHEN contains(title, phrase) THEN [{'g': (pw + 2.0::DOUBLE) * 3.0::DOUBLE, 't': 'T:' || phrase}]
         WHEN contains(body, phrase) THEN [{'g': pw + 2.0::DOUBLE, 't': 'B:' || phrase}] ELSE [] END,
    list_transform(
      list_filter(stats, lambda t: t.df <= n * 0.22::DOUBLE AND (contains(title, t.term) OR contains(body, t.term))),
      lambda t: CASE WHEN contains(title, t.term) THEN {'g': t.idf * 3.0::DOUBLE, 't': 't:' || t.term}
                     ELSE {'g': t.idf, 't': 'b:' || t.term} END)) AS p
  FROM pairs),
scores AS (
  SELECT project, bidder, item_id, dim_no, id, file, file_no, seq, unit,
    list_sum(list_transform(p, lambda x: x.g)) * CASE WHEN char_len > 8000 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score,
    list_transform(p, lambda x: x.t) AS hits
  FROM parts WHERE len(p) > 0),
passing AS (SELECT *, dim_no = -1 AS fallback FROM scores WHERE score >= 4.0),
choice AS (
  SELECT project, bidder, item_id, min(fallback) AS fallback, coalesce(count(*) FILTER (WHERE NOT fallback), 0) AS candidates,
  FROM passing GROUP BY ALL),
kept AS (SELECT p.*, c.candidates FROM passing p JOIN choice c USING (project, bidder, item_id, fallback)),
met AS (
  SELECT *, row_number() OVER (PARTITION BY project, bidder, item_id ORDER BY dim_no, score DESC, file_no, seq) AS ord FROM kept),
unit_best AS (
  SELECT project, bidder, item_id, fallback, candidates, file, unit, min(ord) AS met,
    max(score) AS score, arg_min(hits, -score * 1e6 + ord * 1e-6) AS hits
  FROM met GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project, bidder, item_id ORDER BY score DESC, met) AS unit_no FROM unit_best),
tops AS (SELECT * FROM ranked WHERE unit_no <= 6),
walk AS (
  SELECT t.project, t.bidder, t.item_id, t.unit_no, t.score, t.hits, s.id, s.file, s.path, t.unit, s.page, s.char_len, b.budget,
    coalesce(sum(s.char_len) OVER w, 0) AS used, count(*) OVER w AS idx
  FROM tops t JOIN items i USING (project, item_id) JOIN budgets b USING (project, item_id)
  JOIN sec s ON s.project = t.project AND s.bidder = t.bidder AND s.guid = i.guid AND s.file = t.file AND s.unit = t.unit
  WINDOW w AS (PARTITION BY t.project, t.bidder, t.item_id ORDER BY t.unit_no, s.file_no, s.seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
picks AS (
  SELECT project, bidder, item_id, idx, id AS section_id, file, path, unit, page, printf('%.1f', score)::DOUBLE AS match_score,
    hits[1:6] AS hit, least(char_len, budget - used) AS chars, char_len > budget - used AS truncated
  FROM walk WHERE used < budget),
pool AS (SELECT project, bidder, guid, count(*) AS pool_sections FROM sec GROUP BY ALL),
taken AS (
  SELECT project, bidder, item_id, count(*) AS picks, sum(chars) AS evidence_chars, bool_or(truncated) AS cut,
    count(DISTINCT file || '|' || array_to_string(unit, '|')) AS taken_units
  FROM picks GROUP BY ALL),
considered AS (SELECT project, bidder, item_id, count(*) AS units FROM tops GROUP BY ALL),
packages AS (
  SELECT z.project, z.bidder, i.item_id, i.guid AS item_guid, i.name, i.max_score, coalesce(c.candidates, 0) AS candidates,
    coalesce(u.units, 0) AS units, coalesce(c.fallback, false) AS fallback,
    coalesce(t.evidence_chars, 0)::BIGINT AS evidence_chars, b.budget, coalesce(p.pool_sections, 0) AS pool_sections,
    coalesce(t.picks, 0) AS picks, coalesce(t.cut, false) AS cut, coalesce(t.taken_units, 0) AS taken_units
  FROM sizes z JOIN items i USING (project) JOIN budgets b USING (project, item_id)
  LEFT JOIN choice c USING (project, bidder, item_id) LEFT JOIN considered u USING (project, bidder, item_id)
  LEFT JOIN taken t USING (project, bidder, item_id)
  LEFT JOIN pool p ON p.project = z.project AND p.bidder = z.bidder AND p.guid = i.guid)"""


LOCATE = _locate(LINE_SECTIONS)

EVENTS = """
base AS (
  SELECT event_id AS e, ts, event_type, value, event_id // 4 AS g, (event_id // 4) % 228 AS rest FROM events),
keyed AS (
  SELECT *, 'P' || (g // 684) AS project, rest // 19 AS b, rest % 19 + 1 AS i,
    'B' || lpad((rest // 19)::VARCHAR, 2, '0') AS bidder, 'T-' || lpad((rest % 19 + 1)::VARCHAR, 2, '0') AS item_id,
    (g // 228) % 3 + 1 AS sample_no, e % 4 + 1 AS attempt_no
  FROM base)"""

ATTEMPTS = EVENTS + f""",
pairs AS (SELECT DISTINCT project, b, i, bidder, item_id FROM keyed),
pkg AS (
  SELECT *, {_GUID.format("i")} AS item_guid, '项' || i AS name, (b * 19 + i) % 23 = 0 AS empty,
    (b * 19 + i) % 23 <> 0 AND i % 7 = 0 AS fallback, i % 5 = 0 AS cut,
    CASE WHEN (b * 19 + i) % 23 = 0 AND i % 2 = 0 THEN 0 ELSE 5 END AS pool_sections FROM pairs),
items AS (SELECT DISTINCT project, item_id, i AS item_no, '项' || i AS name, 4.0::DOUBLE AS max_score FROM pairs),
answers AS (
  SELECT *, CASE WHEN i = 19 THEN 2.5::DOUBLE ELSE value / 25 END AS s, e % 4 AS c, (b * 19 + i) % 23 = 0 AS empty,
    event_type = 'error' AS failed,
    1000 + e % 500 AS in_tokens, 100 + e % 50 AS out_tokens, 2000 + e % 3000 AS latency_ms
  FROM keyed),
checked AS (
  SELECT *, CASE WHEN failed THEN 'HTTP 503' WHEN e % 8 = 6 THEN '{ERROR_PARSE}' WHEN e % 8 = 7 THEN '{ERROR_REASON}'
      WHEN c >= CASE WHEN empty THEN 0 ELSE 3 END THEN printf('{ERROR_CITE_RANGE}', c::VARCHAR, (CASE WHEN empty THEN 0 ELSE 3 END - 1)::VARCHAR)
      WHEN NOT (s >= 1 AND s <= 4) THEN printf('{ERROR_TIER}', s::VARCHAR, '优 3.0-4.0、良 2.0-3.0、一般 1.0-2.0') END AS fault,
    CASE WHEN failed OR e % 8 = 6 THEN NULL WHEN s >= 3 AND s <= 4 THEN '优' WHEN s >= 2 AND s < 3 THEN '良'
      WHEN s >= 1 AND s < 2 THEN '一般' END AS tier
  FROM answers),
firsts AS (
  SELECT project, bidder, item_id, sample_no, min(attempt_no) FILTER (WHERE fault IS NULL) AS hit FROM checked GROUP BY ALL),
samples AS (
  SELECT c.project, c.bidder, c.item_id, c.sample_no, f.hit IS NOT NULL AS valid, coalesce(f.hit, 4) AS attempts,
    max(s) FILTER (WHERE attempt_no = f.hit) AS score, max(tier) FILTER (WHERE attempt_no = f.hit) AS tier,
    max(c) FILTER (WHERE attempt_no = f.hit) AS cite, 'r' || max(e) FILTER (WHERE attempt_no = f.hit) AS reason,
    CASE WHEN f.hit IS NULL THEN arg_max(fault, attempt_no) END AS last_error,
    coalesce(sum(in_tokens) FILTER (WHERE NOT failed), 0)::BIGINT AS in_tokens,
    coalesce(sum(out_tokens) FILTER (WHERE NOT failed), 0)::BIGINT AS out_tokens,
    coalesce(sum(latency_ms) FILTER (WHERE NOT failed), 0)::BIGINT AS latency_ms
  FROM checked c JOIN firsts f USING (project, bidder, item_id, sample_no)
  WHERE attempt_no <= coalesce(f.hit, 4) GROUP BY c.project, c.bidder, c.item_id, c.sample_no, f.hit),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project, bidder, item_id, valid ORDER BY score, sample_no) AS rn,
    count(*) FILTER (WHERE valid) OVER (PARTITION BY project, bidder, item_id) AS n FROM samples),
medians AS (
  SELECT project, bidder, item_id, max(n) AS n, sum(attempts)::INTEGER AS calls,
    arg_max(last_error, sample_no) FILTER (WHERE NOT valid) AS last_error,
    sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens, sum(latency_ms)::BIGINT AS latency_ms,
    max(score) FILTER (WHERE valid AND rn = (n - 1) // 2 + 1) AS score,
    max(tier) FILTER (WHERE valid AND rn = (n - 1) // 2 + 1) AS tier,
    max(cite) FILTER (WHERE valid AND rn = (n - 1) // 2 + 1) AS cite,
    max(reason) FILTER (WHERE valid AND rn = (n - 1) // 2 + 1) AS reason,
    string_agg(tier, '|' ORDER BY sample_no) FILTER (WHERE valid) AS tiers
  FROM numbered GROUP BY ALL),
agreed AS (
  SELECT m.*, CASE WHEN n > 0 THEN (SELECT count(*) FROM samples s WHERE s.project = m.project AND s.bidder = m.bidder
    AND s.item_id = m.item_id AND s.valid AND s.tier = m.tier) / n::DOUBLE END AS agreement FROM medians m),
reviews AS (
  SELECT p.project, p.bidder, p.item_id, p.i, p.b, p.item_guid,
    CASE WHEN p.empty OR a.n > 0 THEN 'rated' ELSE 'unrated' END AS status,
    CASE WHEN p.empty THEN NULL ELSE a.tier END AS tier, CASE WHEN p.empty THEN 0.0::DOUBLE ELSE a.score END AS score,
    CASE WHEN p.empty THEN CASE WHEN p.pool_sections = 0 THEN 'no_file' ELSE 'not_found' END END AS miss_reason,
    CASE WHEN p.empty OR a.n = 0 THEN NULL ELSE a.cite END AS cite,
    CASE WHEN p.empty THEN CASE WHEN p.pool_sections = 0 THEN '{REASON_NO_FILE}' ELSE '{REASON_NOT_FOUND}' END
         WHEN a.n > 0 THEN a.reason ELSE '{REASON_UNRATED}' END AS reason,
    CASE WHEN p.empty THEN CASE WHEN p.pool_sections = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END WHEN a.n = 0 THEN 0.0::DOUBLE
      ELSE printf('%.3f', CASE WHEN p.fallback AND p.cut THEN 0.63::DOUBLE WHEN p.fallback THEN 0.7::DOUBLE WHEN p.cut THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
                 * a.agreement)::DOUBLE END AS confidence,
    CASE WHEN p.empty THEN 0 WHEN a.n > 0 THEN a.calls ELSE 4 END AS attempts,
    CASE WHEN p.empty OR a.n > 0 THEN '' ELSE a.last_error END AS last_error,
    CASE WHEN NOT p.empty AND a.n > 0 THEN a.n END AS sample_count,
    CASE WHEN p.empty THEN 0 ELSE a.in_tokens END AS in_tokens, CASE WHEN p.empty THEN 0 ELSE a.out_tokens END AS out_tokens,
    CASE WHEN p.empty THEN 0 ELSE a.latency_ms END AS latency_ms
  FROM pkg p LEFT JOIN agreed a USING (project, bidder, item_id)),
n_items AS (SELECT project, count(*) AS n_items FROM items GROUP BY ALL),
n_bidders AS (SELECT project, count(DISTINCT bidder) AS n_bidders FROM reviews GROUP BY ALL),
grid AS (
  SELECT r.project, r.bidder, i.item_id, i.name, i.max_score, v.status, CASE WHEN v.status = 'rated' THEN v.score END AS score
  FROM (SELECT DISTINCT project, bidder FROM reviews) r JOIN items i USING (project)
  LEFT JOIN reviews v USING (project, bidder, item_id))"""

EXPERT = """
expert AS (
  SELECT 'P' || (o_orderkey // 4104) AS project, 'B' || lpad((o_custkey % 12)::VARCHAR, 2, '0') AS bidder,
    'T-' || lpad((o_orderkey % 19 + 1)::VARCHAR, 2, '0') AS item_id,
    CASE WHEN o_orderstatus = 'F' THEN '改判' ELSE '认可' END AS action, round(o_totalprice % 400 / 100, 1) AS expert_score,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS reviewed_at, o_orderkey AS pos
  FROM orders),
latest AS (
  SELECT * FROM expert QUALIFY row_number() OVER (PARTITION BY project, bidder, item_id ORDER BY reviewed_at DESC, pos DESC) = 1)"""

TOTALS = ATTEMPTS + "," + EXPERT + """,
totals AS (
  SELECT g.project, g.bidder, printf('%.1f', coalesce(sum(g.score), 0))::DOUBLE AS score, count(*) FILTER (WHERE g.score IS NULL) AS unrated,
    printf('%.1f', sum(CASE WHEN l.action = '改判' THEN l.expert_score ELSE coalesce(g.score, 0) END))::DOUBLE AS expert_score,
    count(*) FILTER (WHERE l.action = '改判') AS expert_overrides
  FROM grid g LEFT JOIN latest l USING (project, bidder, item_id) GROUP BY ALL)"""

RUN_EVENTS = EVENTS + """,
run_events AS (
  SELECT e AS seq, ts, project, bidder, item_id, CASE WHEN e % 97 = 0 OR e % 89 = 0 THEN 'control' WHEN e % 50 = 0 THEN 'stage'
      WHEN event_type = 'error' THEN 'retry' ELSE 'review' END AS type,
    'S' || (e // 50) % 4 AS stage, CASE WHEN e % 100 = 0 THEN 'done' ELSE 'running' END AS stage_status,
    CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END AS paused, attempt_no,
    CASE WHEN e % 13 = 0 THEN 'unrated' ELSE 'rated' END AS review_status,
    CASE WHEN e % 9 = 0 THEN 0.0::DOUBLE WHEN e % 11 <> 0 THEN round(value / 100, 2) END AS score,
    CASE WHEN e % 9 = 0 THEN CASE WHEN e % 2 = 0 THEN 'no_file' ELSE 'not_found' END END AS miss_reason,
    CASE WHEN e % 3 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
    1000 + e % 500 AS in_tokens, 100 + e % 50 AS out_tokens, 2000 + e % 3000 AS latency_ms
  FROM keyed)"""

_COUNTERS = """
counters AS (
  SELECT project, count(*) FILTER (WHERE type = 'review') AS done, count(*) FILTER (WHERE type = 'retry') AS retries,
    count(*) FILTER (WHERE type = 'review' AND NOT (review_status = 'rated' AND score IS NOT NULL)) AS unrated,
    coalesce(sum(in_tokens) FILTER (WHERE type = 'review'), 0)::BIGINT AS in_tokens,
    coalesce(sum(out_tokens) FILTER (WHERE type = 'review'), 0)::BIGINT AS out_tokens,
    coalesce(sum(latency_ms) FILTER (WHERE type = 'review'), 0)::BIGINT AS latency_ms
  FROM run_events GROUP BY ALL)"""

TENDER = f"""
parts AS (
  SELECT 'P' || (p_partkey // 19) AS project, (p_partkey % 19)::INTEGER AS item_no,
    'T-' || lpad((p_partkey % 19 + 1)::VARCHAR, 2, '0') AS item_id, {_GUID.format("p_partkey")} AS guid,
    replace(p_name || '[' || p_partkey || ']', ' ', '') AS name, p_partkey AS p, p_size AS s,
    '一般得' || p_size || '-' || (p_size + 3) || ' 分，良得' || (p_size + 3) || '-' || (p_size + 7) AS head,
    CASE WHEN p_partkey % 5 = 0 THEN '续行' ELSE '' END AS intruder,
    ' 分，优得' || (p_size + 7) || '-' || (p_size + 9) || '.5分' AS tail FROM part),
bodies AS (
  SELECT *, name || '，评委根据 方案打分：' || head || tail || '。相关标书内容在' || name || '中体现。' AS clean,
    name || '，评委根据 方案打分：' || head || intruder || tail || '。相关标书内容在' || name || '中体现。' AS body FROM parts)"""

_RANGES = "[s || '-' || (s + 3), (s + 3) || '-' || (s + 7), (s + 7) || '-' || (s + 9) || '.5']"

SUPPLIERS = """
sup AS (
  SELECT 'P' || (s_suppkey // 25) AS project, (s_suppkey % 25)::INTEGER AS pos, s_suppkey AS s, s_name,
    lower(replace(s_name, '#', '-')) AS bidder, unnest(range(1, 20)) AS k FROM supplier)"""

UPLOADS = SUPPLIERS + f""",
paths AS (
  SELECT *, s * 19 + k AS path_id, s * 1000 + k AS size,
    CASE WHEN (s + k) % 11 = 0 THEN '/商务标/' ELSE '/【技术标】文件/' END || CASE WHEN s % 10 = 9 THEN '其他公司' ELSE s_name END || '/'
      || CASE WHEN k % 3 = 0 THEN '第' || k || '项 方案' WHEN k % 3 = 1 THEN 'a1b2c3d4-0000-4000-8000-' || lpad(k::VARCHAR, 12, '0') ELSE '说明' END
      || CASE WHEN k % 17 = 0 THEN '.docx' ELSE '.PDF' END AS path FROM sup),
bound AS (
  SELECT project, path_id, path, size, k, s, bidder AS who,
    NOT ((s + k) % 11 = 0 OR k % 17 = 0) AS technical, s % 10 <> 9 AS known, k % 3 <> 2 AS named FROM paths),
states AS (
  SELECT project, path_id, path, size, CASE WHEN technical AND known THEN who END AS bidder,
    CASE WHEN technical AND named THEN 'T-' || lpad(k::VARCHAR, 2, '0') END AS item_id,
    CASE WHEN NOT technical THEN 'ignored' WHEN NOT known THEN 'unmatched' ELSE 'bound' END AS state FROM bound)"""

LISTING = SUPPLIERS + """,
listing AS (
  SELECT project, CASE WHEN s % 7 = 6 THEN '_' ELSE '' END || bidder AS bidder, s, k,
    CASE WHEN k % 5 = 4 THEN '_converted/' WHEN k % 3 = 0 THEN 'b/' ELSE '' END AS sub,
    CASE WHEN k % 8 = 7 THEN '~$' WHEN k % 9 = 8 THEN '招标文件' ELSE '' END || 'f' || k
      || CASE WHEN s % 4 = 3 THEN CASE WHEN k % 2 = 0 THEN '.docx' ELSE '.DOC' END
              WHEN k % 6 = 5 THEN '.txt' ELSE '.pdf' END AS name FROM sup)"""

_BLOCK = "<(h[1-6]|p|li)(?:\\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"
HTML = f"""
html AS (
  SELECT 'P' || (page_id % 2) AS project, 'W' || (page_id % 10) AS bidder, page_id::INTEGER AS file_no,
    regexp_extract_all(html, '{_BLOCK}', 1, 'is') AS tags, regexp_extract_all(html, '{_BLOCK}', 2, 'is') AS bodies FROM pages),
paras AS (
  SELECT project, bidder, file_no, i::INTEGER AS line_no,
    CASE WHEN lower(left(tags[i + 1], 1)) = 'h' THEN 'Heading ' || substr(tags[i + 1], 2, 1) END AS style,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(bodies[i + 1], '<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS text
  FROM (SELECT *, unnest(range(len(tags))) AS i FROM html))"""

REPEATED = """
repeated AS (
  SELECT 'P' || (l_orderkey % 5) AS project, 'S' || (l_orderkey % 11) AS bidder, l_orderkey || '#' || l_linenumber AS id,
    'S' || (l_orderkey % 11 + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END) AS bidder_in, l_quantity::INTEGER AS char_len FROM lineitem)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}" if ctes else select


def _order_stats(source: str, keys: str, value: str) -> str:
    """Sorted values of each group, for discrete order statistics."""
    return f"SELECT {keys}, list_sort(list({value})) AS v, count(*) AS n FROM {source} GROUP BY ALL"


def _at(index: str) -> str:
    return f"v[({index})::INTEGER + 1]"


_Q90 = _at("least(floor(n * 0.9::DOUBLE), n - 1)")
_STAT_COLUMNS = f"n AS sections, list_sum(v)::BIGINT AS chars, {_at('n // 2')} AS median_len, {_Q90} AS p90_len, v[n] AS max_len"

def _checks(source: str, **checks: str) -> str:
    rows = ", ".join(f"{{'check': '{n}', 'ok': {c}}}" for n, c in checks.items())
    return f"SELECT project, bidder, c.check AS \"check\", c.ok AS ok FROM (SELECT project, bidder, unnest([{rows}]) AS c FROM ({source}))"


_MARK_POINTS = """
outline AS (
  SELECT 'P' || (p_partkey // 100) AS project, (p_partkey % 100)::INTEGER AS line_no, p_partkey % 10 AS k,
    substr('①②③④⑤⑥⑦⑧⑨⑩', ((p_partkey // 10) % 10 + 1)::INTEGER, 1) AS mark,
    '大类' || p_brand || '、' || p_type || '方案' AS cat, p_name || '，' || p_type || '及措施' AS point, p_name, p_type, p_brand FROM part),
tagged AS (
  SELECT *, max(CASE WHEN k = 3 THEN line_no END) OVER (PARTITION BY project ORDER BY line_no) AS cat_line FROM outline),
points AS (
  SELECT t.project, t.line_no, c.mark, c.cat, CASE WHEN t.k <> 3 THEN c.mark || '-' || t.k END AS point_id,
    CASE WHEN t.k = 3 THEN t.cat ELSE t.point END AS name,
    CASE WHEN t.k = 3 THEN [t.cat, '大类' || t.p_brand, t.p_type || '方案'] ELSE [t.point, t.p_name, t.p_type, '措施'] END AS phrases
  FROM tagged t JOIN outline c ON c.project = t.project AND c.line_no = t.cat_line WHERE t.k <> 5)"""

_BIGRAMS = "list_transform(range(1, length(p)), lambda i: substr(p, i::INTEGER, 2))"

POINTS = LINE_SECTIONS + f""",
words AS (SELECT item_id AS n, regexp_extract_all(text, '\\p{{L}}{{2,}}') AS w FROM benchmark),
points AS (
  SELECT 'P' || (n % 2) AS project, n // 10 AS cat_no, 'cat' || (n // 10) AS cat, n, 'Q-' || lpad(n::VARCHAR, 4, '0') AS item_id,
    [array_to_string(w[6:7], ' '), w[8]] AS phrases, w[6:8] AS terms, [array_to_string(w[9:10], ' ')] AS cp, w[9:10] AS ct FROM words),
cats AS (SELECT project, cat_no, arg_min(cp, n) AS phrases, arg_min(ct, n) AS terms FROM points GROUP BY ALL),
uniq AS (
  SELECT project, item_id, dim_no, phrases, list_filter(terms, lambda x, i: list_position(terms, x) = i) AS terms FROM (
    SELECT project, item_id, 0 AS dim_no, phrases, terms FROM points
    UNION ALL SELECT p.project, p.item_id, -1, c.phrases, c.terms FROM points p JOIN cats c USING (project, cat_no))),
sec AS (
  SELECT *, replace(text, chr(13), '') AS body, array_to_string(path, ' ') AS title, path[1:2] AS unit FROM sections),
sizes AS (SELECT project, bidder, count(*) AS n FROM sec GROUP BY ALL),
vocab AS (SELECT DISTINCT project, unnest(terms) AS term FROM uniq),
freq AS (
  SELECT z.project, z.bidder, v.term, z.n, coalesce(c.df, 0) AS df, ln((z.n + 1.0::DOUBLE) / (coalesce(c.df, 0) + 1.0::DOUBLE)) AS idf
  FROM sizes z JOIN vocab v USING (project)
  LEFT JOIN (SELECT s.project, s.bidder, v.term, count(*) AS df FROM sec s JOIN vocab v USING (project)
             WHERE contains(s.body || ' ' || s.title, v.term) GROUP BY ALL) c USING (project, bidder, term)),
weighed AS (
  SELECT t.project, f.bidder, t.item_id, t.dim_no, any_value(t.phrases) AS phrases, any_value(f.n) AS n,
    list({{'term': t.term, 'df': f.df, 'idf': f.idf}} ORDER BY t.pos) AS stats,
    min({{'df': f.df, 'pos': t.pos, 'term': t.term}}) FILTER (WHERE f.df <= f.n * 0.05::DOUBLE) AS a
  FROM (SELECT *, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM uniq) t JOIN freq f USING (project, term)
  GROUP BY t.project, f.bidder, t.item_id, t.dim_no),
pairs AS (
  SELECT s.*, w.item_id, w.dim_no, w.phrases, w.stats, w.n FROM sec s JOIN weighed w USING (project, bidder)
  WHERE (w.a IS NULL OR (w.a.df > 0 AND (contains(s.body, w.a.term) OR contains(s.title, w.a.term))))),
parts AS (
  SELECT *, list_concat(
    list_transform(list_filter(phrases, lambda p: contains(title, p) OR contains(body, p)), lambda p:
      (coalesce(list_max(list_transform(list_filter(stats, lambda t: contains(p, t.term)), lambda t: t.idf)), 0) + 2.0::DOUBLE)
      * CASE WHEN contains(title, p) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END),
    list_transform(list_filter(stats, lambda t: t.df <= n * 0.22::DOUBLE AND (contains(title, t.term) OR contains(body, t.term))),
      lambda t: t.idf * CASE WHEN contains(title, t.term) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END)) AS g FROM pairs),
scores AS (
  SELECT *, list_sum(g) * CASE WHEN char_len > 8000 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score, dim_no = -1 AS fallback
  FROM parts WHERE len(g) > 0),
passing AS (SELECT * FROM scores WHERE score >= 6.0),
choice AS (SELECT project, bidder, item_id, min(fallback) AS fallback FROM passing GROUP BY ALL),
met AS (
  SELECT *, row_number() OVER (PARTITION BY project, bidder, item_id ORDER BY score DESC, file_no, seq) AS ord
  FROM passing JOIN choice USING (project, bidder, item_id, fallback)),
units AS (
  SELECT project, bidder, item_id, fallback, file, unit, min(ord) AS met, max(score) AS score, count(*) AS passing FROM met GROUP BY ALL),
tops AS (
  SELECT *, row_number() OVER (PARTITION BY project, bidder, item_id ORDER BY score DESC, met) AS unit_no FROM units QUALIFY unit_no <= 6),
walk AS (
  SELECT t.project, t.bidder, t.item_id, s.id, s.char_len, coalesce(sum(s.char_len) OVER w, 0) AS used, count(*) OVER w AS idx
  FROM tops t JOIN sec s ON s.project = t.project AND s.bidder = t.bidder AND s.file = t.file AND s.unit = t.unit
  WINDOW w AS (PARTITION BY t.project, t.bidder, t.item_id ORDER BY t.unit_no, s.file_no, s.seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
taken AS (
  SELECT project, bidder, item_id, sum(least(char_len, 900 - used))::BIGINT AS evidence_chars, string_agg(id, '|' ORDER BY idx) AS picks
  FROM walk WHERE used < 900 GROUP BY ALL),
found AS (SELECT project, bidder, item_id, bool_or(fallback) AS fallback, sum(passing)::BIGINT AS candidates FROM units GROUP BY ALL),
considered AS (SELECT project, bidder, item_id, count(*) AS units FROM tops GROUP BY ALL)"""

# ---- one statement per query -----------------------------------------------------------------

ORACLES: dict[str, str] = {
    "discover_files": _with(LISTING + """,
picked AS (SELECT *, ends_with(name, '.pdf') AND NOT contains(name, '招标文件') AND NOT starts_with(name, '~$') AS pdf,
    regexp_matches(lower(name), '\\.docx?$') AND NOT starts_with(name, '~$') AND sub <> '_converted/' AS doc FROM listing),
kept AS (SELECT *, bool_or(pdf) OVER (PARTITION BY project, bidder) AS has FROM picked WHERE pdf OR doc)""",
        """SELECT project, bidder, sub || name AS rel, row_number() OVER (PARTITION BY project, bidder ORDER BY string_split(sub || name, '/')) AS file_no
FROM kept WHERE pdf = has"""),
    "discover_bidders": _with(LISTING, """SELECT project, bidder FROM listing WHERE NOT regexp_matches(bidder, '^[_.]')
GROUP BY ALL HAVING bool_or(ends_with(name, '.pdf') AND NOT contains(name, '招标文件'))"""),
    "text_lines": _with(DOCS + """,
split AS (SELECT *, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS t, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS pos FROM docs)""",
        """SELECT project, bidder, file_no, (row_number() OVER (PARTITION BY project, bidder, file_no ORDER BY pos) - 1)::INTEGER AS line_no, 1 AS page, trim(t) AS text
FROM split WHERE trim(t) <> ''"""),
    "html_paragraphs": _with(HTML, "SELECT project, bidder, file_no, line_no, style, text FROM paras"),
    "item_guid": _with(DOCS, "SELECT guid, count(*) AS files FROM docs GROUP BY ALL"),
    "heading_levels": _with(NUMBERED, "SELECT level, count(*) AS n_lines FROM leveled GROUP BY ALL"),
    "line_p90": _with(NUMBERED, "SELECT project, bidder, file_no, n_lines, p90 FROM p90s"),
    "headings": _with(NUMBERED, "SELECT project, bidder, file_no, line_no, level FROM heads"),
    "heading_paths": _with(NUMBERED, "SELECT project, bidder, file_no, line_no, level, array_to_string(path, ' > ') AS path FROM paths"),
    "assign_lines": _with(NUMBERED, "SELECT project, bidder, file_no, line_no, block FROM blocked WHERE NOT is_heading"),
    "sections": _with(NUMBERED, """SELECT project, bidder, id, guid AS item_guid, array_to_string(path, ' > ') AS path, level, page, text, char_len FROM sections"""),
    "zero_section_files": """SELECT DISTINCT 'P' || ((p_partkey // 10) % 2) AS project, 'S' || ((p_partkey // 10) % 5) AS bidder,
  (p_partkey // 10)::INTEGER AS file_no FROM part WHERE (p_partkey // 10) % 3 = 0""",
    "ingest_rollup": _with(NUMBERED, f"""SELECT scope, project, bidder, file_no, {_STAT_COLUMNS} FROM (
  SELECT 'file' AS scope, * FROM ({_order_stats('sections', 'project, bidder, file_no', 'char_len')})
  UNION ALL SELECT 'bidder', project, bidder, NULL, v, n FROM ({_order_stats('sections', 'project, bidder', 'char_len')})
  UNION ALL SELECT 'project', project, NULL, NULL, v, n FROM ({_order_stats('sections', 'project', 'char_len')}))"""),
    "page_counts": _with(LINES, "SELECT project, bidder, file_no, max(page) AS pages FROM fx_lines GROUP BY ALL"),
    "single_bidder_gate": _with(DOCS, """SELECT project, count(*) AS bidders, array_to_string(list(bidder ORDER BY bidder)[1:3], '、') AS first_names, count(*) < 2 AS ok
FROM (SELECT DISTINCT project, bidder FROM docs) GROUP BY ALL"""),
    "font_profile": _with(LINES + """,
fonts AS (SELECT project, bidder, file_no, CASE WHEN length(text) < 20 THEN 14.0::DOUBLE WHEN length(text) % 3 = 0 THEN 10.6::DOUBLE ELSE 10.5::DOUBLE END AS font_size,
    line_no % 7 = 0 AS bold FROM fx_lines WHERE regexp_matches(text, '[^\\s]')),
counts AS (SELECT project, bidder, file_no, font_size, count(*) AS size_lines, count(*) FILTER (WHERE bold) AS b FROM fonts GROUP BY ALL),
whole AS (SELECT *, (sum(size_lines) OVER f)::BIGINT AS n_lines, (sum(b) OVER f)::BIGINT AS bold_lines,
    row_number() OVER (PARTITION BY project, bidder, file_no ORDER BY size_lines DESC, font_size) AS size_rank,
    first_value(font_size) OVER (PARTITION BY project, bidder, file_no ORDER BY size_lines DESC, font_size) AS body_size
  FROM counts WINDOW f AS (PARTITION BY project, bidder, file_no))""",
        """SELECT project, bidder, file_no, font_size, size_lines, n_lines, bold_lines, size_rank, body_size,
  round(size_lines / n_lines::DOUBLE, 6) AS size_share, round(bold_lines / n_lines::DOUBLE, 6) AS bold_share FROM whole WHERE size_lines / n_lines::DOUBLE > 0.01"""),
    "extract_lines": _with(LINES, """SELECT project, bidder, file_no, (row_number() OVER (PARTITION BY project, bidder, file_no ORDER BY line_no) - 1)::INTEGER AS line_no,
  page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM fx_lines WHERE regexp_matches(text, '[^\\s]')"""),
    "structure_profile": _with(NUMBERED + """,
classed AS (SELECT *, CASE
    WHEN regexp_matches(text, '^第[一二三四五六七八九十百\\d]+[章节篇部分]') THEN '第N章/节'
    WHEN regexp_matches(text, '^\\d+\\.\\d+\\.\\d+') THEN 'N.N.N' WHEN regexp_matches(text, '^\\d+\\.\\d+([^0-9]|$)') THEN 'N.N'
    WHEN regexp_matches(text, '^\\d{1,2}[、.]([^0-9]|$)') THEN 'N、/N.' WHEN regexp_matches(text, '^[一二三四五六七八九十]{1,3}[、.]') THEN '中文数字、'
    WHEN regexp_matches(text, '^[（(][一二三四五六七八九十\\d]{1,3}[）)]') THEN '（N）' END AS cls,
    count(*) OVER (PARTITION BY project, bidder, file_no) AS n_lines FROM numbered)""",
        """SELECT project, bidder, file_no, cls, count(*) AS hits, n_lines, array_to_string(list(left(text, 38) ORDER BY line_no)[1:3], ' | ') AS samples,
  round(count(*) / n_lines::DOUBLE, 6) AS share FROM classed WHERE cls IS NOT NULL GROUP BY project, bidder, file_no, cls, n_lines"""),
    "html_sections": _with(HTML + """,
marked AS (SELECT *, CASE WHEN style IS NOT NULL THEN substr(style, 9, 1)::INTEGER
    WHEN length(text) <= 60 AND regexp_matches(text, '^(第[一二三四五六七八九十百]+[章节]|[0-9]+(\\.[0-9]+){0,4})[\\s、.．]')
    THEN least(length(regexp_extract(text, '^\\S+')) - length(replace(regexp_extract(text, '^\\S+'), '.', '')) + 2, 6) END AS level
  FROM paras WHERE text <> ''),
heads AS (SELECT * FROM marked WHERE level IS NOT NULL),
paths AS (
  SELECT h.project, h.bidder, h.file_no, h.line_no, h.level, list(g.text ORDER BY g.line_no) AS path
  FROM heads h JOIN heads g ON h.file_no = g.file_no AND g.line_no <= h.line_no
  WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.file_no = h.file_no AND k.line_no > g.line_no AND k.line_no <= h.line_no AND k.level <= g.level)
  GROUP BY ALL),
blocked AS (SELECT *, coalesce(max(CASE WHEN level IS NOT NULL THEN line_no END) OVER (PARTITION BY file_no ORDER BY line_no), -1) AS block FROM marked),
blocks AS (SELECT project, bidder, file_no, block, string_agg(text, chr(10) ORDER BY line_no) AS text FROM blocked WHERE level IS NULL GROUP BY ALL)""",
        """SELECT b.project, b.bidder, b.file_no || '#' || row_number() OVER (PARTITION BY b.file_no ORDER BY block) AS id,
  CASE WHEN block = -1 THEN '(前言)' ELSE array_to_string(path, ' > ') END AS path, CASE WHEN block = -1 THEN 0 ELSE level END AS level,
  text, length(text) AS char_len FROM blocks b LEFT JOIN paths p ON p.file_no = b.file_no AND p.line_no = b.block"""),
    "flatten_table": """WITH cells AS (
  SELECT 'P' || (o_custkey % 3) AS project, 'C' || (o_custkey % 7) AS bidder, o_custkey::INTEGER AS file_no, o_orderkey AS o,
    o_orderstatus || chr(9) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END || chr(9)
      || CASE WHEN o_orderkey % 10 = 0 THEN 'a b' ELSE o_orderkey::VARCHAR END AS line FROM orders)
SELECT project, bidder, file_no, chr(10) || '[表]' || chr(10) || string_agg(line, chr(10) ORDER BY o) AS text FROM cells WHERE o % 17 <> 0 GROUP BY ALL""",
    "merge_bidders": _with(LINE_SECTIONS, """SELECT project, bidder, count(*) AS sections, sum(char_len)::BIGINT AS chars FROM sections
GROUP BY GROUPING SETS ((project, bidder), (project))"""),
    "missing_bidders": _with(DOCS, "SELECT DISTINCT project, 'src_none' AS bidder FROM docs"),
    "duplicate_ids": _with(REPEATED, "SELECT project, bidder, id, count(*) AS times FROM repeated GROUP BY ALL HAVING count(*) > 1"),
    "duplicate_report": _with(REPEATED + """,
dup AS (SELECT project, bidder, id, count(*) AS times FROM repeated GROUP BY ALL HAVING count(*) > 1)""",
        """SELECT project, bidder, count(*) AS duplicates, array_to_string(list(id || ' x' || times ORDER BY id)[1:5], '、') AS detail FROM dup GROUP BY ALL"""),
    "bidder_conflicts": _with(REPEATED, "SELECT project, bidder, id, bidder_in FROM repeated WHERE bidder_in <> bidder"),
    "section_stats": _with(REPEATED, """SELECT project, bidder, count(*) AS sections, sum(char_len)::BIGINT AS chars FROM repeated
GROUP BY GROUPING SETS ((project, bidder), (project))"""),
    "section_lookup": """SELECT 'P' || (user_id % 3) AS project, 'U' || (user_id % 12) AS bidder, user_id || '#' || (event_id % 5) AS id,
  arg_max(event_type || '-' || event_id, event_id) AS text FROM events WHERE event_id % 4 <> 0 GROUP BY ALL""",
    "section_checks": _with(LINE_SECTIONS, _checks(
        """SELECT project, bidder, count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT file_no) AS files, min(page) AS page FROM sections GROUP BY ALL""",
        fields="true", item_guid="true", page="page >= 1", char_len="true", unique_id="ids = n", file_count="files <= 20", level="true")),
    "section_length_profile": _with(LINE_SECTIONS, f"""SELECT project, bidder, n, ({_at('(n - 1) // 2')} + {_at('n // 2')}) / 2 AS median, {_Q90} AS p90, v[n] AS longest
FROM ({_order_stats('sections', 'project, bidder', 'char_len')})"""),
    "validate_items": _with(TENDER, "SELECT project, item_id, 'blank_criteria' AS fault FROM parts"),
    "clean_tender": _with(TENDER, """SELECT project, string_agg(name || clean, '' ORDER BY item_no) AS text, count(*) AS dropped,
  coalesce(string_agg(CASE WHEN intruder <> '' THEN intruder END, '|' ORDER BY item_no), '') AS fragments FROM bodies GROUP BY ALL"""),
    "segment_criteria": _with(TENDER, "SELECT project, item_id, true AS ok, clean AS criteria FROM bodies"),
    "verify_criteria": _with(TENDER, "SELECT project, item_id, intruder = '' AS verbatim, true AS tiers_ok FROM bodies"),
    "parse_tiers": _with(TENDER + """,
found AS (
  SELECT project, item_no * 4 + 1 AS line_no, unnest(CASE WHEN intruder = '' THEN [0, 1, 2] ELSE [0, 1] END) AS pos, s, intruder FROM bodies)""",
        """SELECT project, line_no, pos, (s + [0, 3, 7][CASE WHEN intruder <> '' AND pos = 1 THEN 3 ELSE pos + 1 END])::DOUBLE AS min,
  (s + [3, 7, 9.5][CASE WHEN intruder <> '' AND pos = 1 THEN 3 ELSE pos + 1 END])::DOUBLE AS max FROM found"""),
    "first_external": _with(TENDER, """SELECT project, guid, p * 2 AS row_no,
  CASE WHEN p % 7 = 0 THEN regexp_replace(head || tail, '^一般得[0-9]+', '一般得0') ELSE head || tail END AS "desc" FROM parts WHERE p % 13 <> 0"""),
    "reconcile_tiers": _with(TENDER, f"""SELECT project, guid, item_id, true AS name_found, array_to_string({_RANGES}, '|') AS source_ranges,
  array_to_string(CASE WHEN p % 7 = 0 THEN list_concat(['0-' || (s + 3)], ({_RANGES})[2:3]) ELSE {_RANGES} END, '|') AS external_ranges,
  p % 7 <> 0 AS "match" FROM parts WHERE p % 13 <> 0"""),
    "reconcile_summary": _with(TENDER, """SELECT project, count(*) AS items, count(*) FILTER (WHERE p % 7 <> 0) AS matching FROM parts WHERE p % 13 <> 0 GROUP BY ALL"""),
    "merge_config": _with(TENDER, """SELECT project, item_id, guid, CASE WHEN item_no % 3 = 0 THEN name ELSE 'ref-' || name END AS name,
  s + 9.5::DOUBLE + CASE WHEN item_no % 5 <> 0 THEN 1 ELSE 0 END AS max_score, 'ref criteria' AS criteria,
  CASE WHEN item_no % 2 = 0 THEN 3 ELSE 2 END AS n_tiers FROM parts"""),
    "tier_texts": _with(TENDER, """SELECT project, item_id,
  '优 ' || (s + 7) || '.0-' || (s + 9) || '.5 分 / 良 ' || (s + 3) || '.0-' || (s + 7) || '.0 分 / 一般 ' || s || '.0-' || (s + 3) || '.0 分' AS long_form,
  '一般 ' || s || '–' || (s + 3) || '｜良 ' || (s + 3) || '–' || (s + 7) || '｜优 ' || (s + 7) || '–' || (s + 9) || '.5' AS short_form FROM parts"""),
    "parse_points": _with(_MARK_POINTS, f"""SELECT project, line_no, mark, cat, point_id, name, array_to_string(phrases, '|') AS phrases,
  array_to_string(list_filter(grams, lambda g, i: list_position(grams, g) = i AND g NOT IN ('要求','内容','计划','管理','体系','建设','工程','项目','进行','以及','对应','相关','各种','有关')), '|') AS terms
FROM (SELECT *, flatten(list_transform(phrases, lambda p: {_BIGRAMS})) AS grams FROM points)"""),
    "match_keys": _with(UPLOADS, "SELECT path_id, regexp_replace(lower(path), '[^\\p{L}\\p{N}]+', '', 'g') AS match_key FROM paths"),
    "bind_files": _with(UPLOADS, "SELECT project, path_id, bidder, item_id, state FROM states"),
    "bidder_files": _with(UPLOADS, """SELECT project, bidder, count(*) AS files, sum(size)::BIGINT AS bytes,
  coalesce(array_to_string(list_sort(list(DISTINCT item_id)), '|'), '') AS items, array_to_string(list(path ORDER BY path_id)[1:3], ' | ') AS samples
FROM states WHERE state = 'bound' GROUP BY ALL"""),
    "binding_coverage": _with(UPLOADS + """,
expected AS (SELECT project, count(DISTINCT s) AS expected FROM sup GROUP BY ALL),
counts AS (SELECT project, item_id, count(DISTINCT bidder) AS bound FROM states WHERE state = 'bound' AND item_id IS NOT NULL GROUP BY ALL),
rows AS (SELECT DISTINCT project, 'T-' || lpad(k::VARCHAR, 2, '0') AS item_id, '第' || k || '项方案' AS name FROM sup),
st AS (SELECT project, item_id, name, expected, coalesce(bound, 0) AS bound,
  CASE WHEN coalesce(bound, 0) >= expected THEN 'matched' WHEN coalesce(bound, 0) > 0 THEN 'partial' ELSE 'unverified' END AS status
  FROM rows JOIN expected USING (project) LEFT JOIN counts USING (project, item_id))""",
        """SELECT *, CASE status WHEN 'matched' THEN '文件名 GUID/评分项名称已匹配' WHEN 'partial' THEN '仅部分投标人文件名匹配，需补齐或等待后续定位确认'
  ELSE '文件名未匹配到 GUID/评分项名称，需等待后续定位确认' END AS note FROM st"""),
    "item_budgets": _with(ITEMS, """SELECT project, item_id, greatest(1500, least(9000, floor(4500 * 19 * max_score / 100)))::INTEGER AS budget FROM items"""),
    "dimensions": _with(ITEMS, """SELECT project, item_id, guid AS scope, dim_no, phrase AS phrases, array_to_string(terms, '|') AS terms FROM dims"""),
    "bigram_terms": _with(ITEMS, f"""SELECT project, item_id, dim_no, array_to_string(list_sort(list_distinct({_BIGRAMS})), '|') AS terms
FROM (SELECT *, phrase AS p FROM dims WHERE dim_no >= 0)"""),
    "doc_freq": _with(LOCATE, "SELECT project, bidder, term, n, df, round(idf, 6) AS idf FROM freq"),
    "generic_terms": _with(LOCATE, "SELECT project, bidder, term, df FROM freq WHERE df > n * 0.22::DOUBLE"),
    "anchors": _with(LOCATE, "SELECT project, bidder, item_id, dim_no, anchor, anchor_df FROM weighed"),
    "section_scores": _with(LOCATE, "SELECT project, bidder, item_id, dim_no, id, round(score, 6) AS score, array_to_string(hits, '|') AS hits FROM scores"),
    "rank_sections": _with(LOCATE, """SELECT project, bidder, item_id, dim_no, id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY project, bidder, item_id, dim_no ORDER BY score DESC, file_no, seq) AS rank FROM passing"""),
    "best_units": _with(LOCATE, """SELECT project, bidder, item_id, fallback, file, array_to_string(unit, ' > ') AS unit_path, round(score, 6) AS score,
  CASE WHEN NOT fallback THEN candidates END AS candidates FROM unit_best"""),
    "top_units": _with(LOCATE, "SELECT project, bidder, item_id, unit_no, file, array_to_string(unit, ' > ') AS unit_path FROM tops"),
    "packed_evidence": _with(LOCATE, """SELECT project, bidder, item_id, idx::INTEGER AS idx, section_id, page, match_score, array_to_string(hit, '|') AS hit,
  chars::INTEGER AS chars, truncated FROM picks"""),
    "packages": _with(LOCATE, """SELECT project, bidder, item_id, item_guid, candidates, units, fallback, evidence_chars, budget, pool_sections, picks FROM packages"""),
    "fallback_packages": _with(LOCATE, "SELECT project, bidder, item_id, candidates, evidence_chars FROM packages WHERE fallback"),
    "locate_points": _with(POINTS, """SELECT z.project, z.bidder, p.item_id, p.cat, coalesce(f.candidates, 0) AS candidates, coalesce(c.units, 0) AS units,
  coalesce(f.fallback, false) AS fallback, coalesce(t.evidence_chars, 0) AS evidence_chars, coalesce(t.picks, '') AS picks
FROM sizes z JOIN points p USING (project) LEFT JOIN found f USING (project, bidder, item_id)
LEFT JOIN considered c USING (project, bidder, item_id) LEFT JOIN taken t USING (project, bidder, item_id)"""),
    "locate_summary": _with(LOCATE + """,
raw AS (SELECT project, bidder, sum(char_len)::BIGINT AS raw_chars FROM sections GROUP BY ALL)""",
        """SELECT project, bidder, count(*) AS items, count(*) FILTER (WHERE picks = 0) AS miss, count(*) FILTER (WHERE fallback) AS fallback,
  sum(evidence_chars)::BIGINT AS evidence_chars, any_value(raw_chars) AS raw_chars,
  round(any_value(raw_chars) / greatest(sum(evidence_chars), 1)::DOUBLE, 6) AS compression FROM packages JOIN raw USING (project, bidder) GROUP BY project, bidder"""),
    "package_preview": _with(LOCATE + """,
flat AS (SELECT project, bidder, id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM sections)""",
        """SELECT p.project, p.bidder, p.item_id, p.idx::INTEGER AS idx, p.section_id, p.page, 3 AS level, p.chars::INTEGER AS chars, p.truncated,
  CASE WHEN length(t) > 360 THEN left(t, 359) || '…' ELSE t END AS text
FROM picks p JOIN flat f ON f.project = p.project AND f.bidder = p.bidder AND f.id = p.section_id WHERE idx < 4"""),
    "evidence_ceilings": _with(LOCATE + """,
facts AS (SELECT project, units >= 6 AS full_u, taken_units < units AS dropped, cut, CASE WHEN taken_units < units THEN 1 - taken_units / units::DOUBLE END AS share
  FROM packages WHERE picks > 0)""",
        """SELECT project, count(*) AS packages, round(avg(full_u::INTEGER), 6) AS full_share, round(avg(dropped::INTEGER), 6) AS dropped_units_share,
  round(avg(cut::INTEGER), 6) AS cut_share, round(list_sort(list(share) FILTER (WHERE share IS NOT NULL))[(count(share) - 1) // 2 + 1], 6) AS median_dropped
FROM facts GROUP BY ALL"""),
    "nonempty_rate": _with(LOCATE, """SELECT project, bidder, count(*) AS packages, count(*) FILTER (WHERE picks > 0) AS nonempty,
  round(avg((picks > 0)::INTEGER), 6) AS rate FROM packages GROUP BY GROUPING SETS ((project, bidder), (project))"""),
    "unit_sizes": _with(LINE_SECTIONS + """,
sizes AS (SELECT project, bidder, file_no, path[1:2] AS unit, sum(char_len)::BIGINT AS chars FROM sections GROUP BY ALL)""",
        f"""SELECT project, n AS units, {_at('n // 2')} AS median, {_at('least(floor(n * 0.75::DOUBLE), n - 1)')} AS p75, {_Q90} AS p90, v[n] AS longest,
  round(len(list_filter(v, lambda x: x > 1500)) / n::DOUBLE, 6) AS over_share FROM ({_order_stats('sizes', 'project', 'chars')})"""),
    "unit_sizes_fixed_level": _with(LINE_SECTIONS + """,
sizes AS (SELECT project, bidder, file_no, sum(char_len)::BIGINT AS chars FROM sections GROUP BY ALL)""",
        f"""SELECT project, n AS units, {_at('n // 2')} AS median, {_at('least(floor(n * 0.75::DOUBLE), n - 1)')} AS p75, {_Q90} AS p90, v[n] AS longest,
  round(len(list_filter(v, lambda x: x > 3000)) / n::DOUBLE, 6) AS over_share FROM ({_order_stats('sizes', 'project', 'chars')})"""),
    "package_checks": _with(LOCATE + """,
sums AS (SELECT project, bidder, count(*) AS n, bool_and(evidence_chars <= budget) AS within,
    bool_and(budget = greatest(1500, least(9000, floor(855 * max_score)))) AS formula FROM packages GROUP BY ALL)""",
        _checks("SELECT * FROM sums", item_count="true", fields="true", item_guid="true", within_budget="within", budget_formula="formula",
                pick_fields="true", pick_page="true", guid_as_table="true", name_as_table="true", coverage="true")),
    "coverage_gaps": _with(ATTEMPTS, """SELECT project, bidder, item_id, false AS score_field, true AS renamed_field
FROM (SELECT DISTINCT project, bidder FROM pkg UNION ALL SELECT DISTINCT project, 'B99' FROM pkg) JOIN items USING (project)
WHERE (project, bidder, item_id) NOT IN (SELECT (project, bidder, item_id) FROM pkg WHERE item_id <> 'T-04')"""),
    "package_summary": _with(LOCATE, """SELECT project, bidder, count(*) AS packages, count(*) FILTER (WHERE picks > 0 AND NOT fallback) AS direct,
  count(*) FILTER (WHERE fallback) AS fallback, count(*) FILTER (WHERE picks = 0) AS miss, sum(evidence_chars)::BIGINT AS evidence_chars,
  sum(budget)::BIGINT AS budget, count(*) FILTER (WHERE picks = 0) = count(*) AS all_missed, sum(evidence_chars) > sum(budget) AS over_budget
FROM packages GROUP BY ALL"""),
    "all_miss_signal": _with(LOCATE, "SELECT project, item_id, count(*) AS bidders FROM packages GROUP BY ALL HAVING max(picks) = 0"),
    "evidence_texts": _with(LOCATE, """SELECT p.project, p.bidder, p.item_id, p.idx::INTEGER AS idx, p.section_id, left(s.text, p.chars::INTEGER) AS text, false AS missing
FROM picks p JOIN sections s ON s.project = p.project AND s.bidder = p.bidder AND s.id = p.section_id"""),
    "requests": _with(LOCATE, """SELECT p.project, p.bidder, p.item_id, k.picks AS n_evidence, k.name, p.section_id AS first_id, left(s.text, p.chars::INTEGER) AS first_text, 'rule' AS rule
FROM picks p JOIN packages k USING (project, bidder, item_id) JOIN sections s ON s.project = p.project AND s.bidder = p.bidder AND s.id = p.section_id WHERE idx = 0"""),
    "stub_scores": _with(ATTEMPTS, "SELECT project, bidder, item_id, 2.5::DOUBLE AS score, 1 AS in_tokens FROM pkg WHERE NOT empty"),
    "estimate_tokens": "SELECT doc_id, greatest(1, round_even(length(text) / 1.5::DOUBLE, 0))::INTEGER AS tokens FROM documents",
    "usage_check": """SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) OR (event_id % 5 = 2 AND event_id > 0) THEN 'prompt_tokens 不是非负整数' END AS fault FROM events""",
    "validate_output": _with(ATTEMPTS, f"""SELECT project, bidder, item_id, sample_no, attempt_no,
  CASE WHEN i = 18 THEN printf('{ERROR_ITEM.replace("'", "''")}', item_id) ELSE fault END AS fault, CASE WHEN i <> 18 THEN tier END AS tier,
  CASE WHEN failed OR e % 8 = 6 THEN NULL ELSE round(s, 6) END AS score, CASE WHEN failed OR e % 8 = 6 THEN NULL ELSE c::VARCHAR END AS cite,
  CASE WHEN NOT failed AND e % 8 < 6 THEN 'r' || e END AS reason, NOT failed AS answered, in_tokens, out_tokens, latency_ms FROM checked"""),
    "tier_of_score": """WITH v AS (SELECT event_id, round(value % 5, 1) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3 AND s <= 4 THEN '优' WHEN s >= 2 AND s < 3 THEN '良' WHEN s >= 1 AND s < 2 THEN '一般' END AS tier FROM v""",
    "resolve_attempts": _with(ATTEMPTS, """SELECT project, bidder, item_id, sample_no, valid, attempts, last_error, tier, round(score, 6) AS score, in_tokens, out_tokens, latency_ms FROM samples"""),
    "median_sample": _with(ATTEMPTS, """SELECT project, bidder, item_id, n, calls, tier, reason, round(score, 6) AS score, round(agreement, 6) AS agreement, coalesce(tiers, '') AS tiers FROM agreed"""),
    "reviews": _with(ATTEMPTS, """SELECT project, bidder, item_id, item_guid, status, tier, round(score, 6) AS score, miss_reason, confidence, attempts, last_error, sample_count, in_tokens FROM reviews"""),
    "retry_round": _with(ATTEMPTS, """SELECT project, bidder, item_id, 'rated' AS status, attempts + CASE WHEN status = 'unrated' THEN 2 ELSE 0 END AS attempts,
  in_tokens * CASE WHEN status = 'unrated' THEN 2 ELSE 1 END AS in_tokens FROM reviews"""),
    "review_rounds": _with(ATTEMPTS, """SELECT r.project, r.bidder, r.item_id, r.status, r.tier, round(r.score, 6) AS score,
  r.attempts * CASE WHEN r.status = 'unrated' THEN 2 ELSE 1 END AS attempts, r.last_error,
  r.in_tokens * CASE WHEN r.status = 'unrated' THEN 2 ELSE 1 END AS in_tokens,
  r.latency_ms * CASE WHEN r.status = 'unrated' THEN 2 ELSE 1 END AS latency_ms,
  CASE WHEN r.miss_reason IS NULL THEN m.calls ELSE 0 END * CASE WHEN r.status = 'unrated' THEN 2 ELSE 1 END AS calls,
  CASE WHEN r.miss_reason IS NULL THEN m.calls ELSE 0 END * CASE WHEN r.status = 'unrated' THEN 2 ELSE 1 END AS requests
FROM reviews r JOIN medians m USING (project, bidder, item_id)"""),
    "retry_counts": _with(ATTEMPTS, """SELECT project, bidder, item_id, greatest(attempts - coalesce(sample_count, CASE WHEN status = 'rated' THEN 1 ELSE 0 END), 0) AS retries FROM reviews"""),
    "review_totals": _with(ATTEMPTS, """SELECT project, count(*) AS calls, sum(greatest(attempts - coalesce(sample_count, CASE WHEN status = 'rated' THEN 1 ELSE 0 END), 0))::BIGINT AS retries,
  sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens, sum(latency_ms)::BIGINT AS latency_ms FROM reviews GROUP BY ALL"""),
    "unknown_items": _with(ATTEMPTS, "SELECT project, bidder, item_id FROM pkg WHERE i = 19"),
    "jobs": _with(EVENTS, """SELECT project, bidder, item_id, min(sample_no * 10 + attempt_no) AS place, arg_min(1000 + e % 500, sample_no * 10 + attempt_no) AS in_tokens
FROM keyed WHERE item_id <> 'T-07' GROUP BY project, bidder, item_id"""),
    "classify_jobs": _with(ATTEMPTS, """SELECT project, bidder, item_id, CASE WHEN i <> 3 AND status = 'rated' THEN 'completed' ELSE 'errored' END AS state FROM reviews"""),
    "pending_jobs": _with(ATTEMPTS, """SELECT project, bidder, item_id, 'resume' AS mode FROM reviews WHERE attempts >= 8
UNION ALL SELECT project, bidder, item_id, 'retry' FROM reviews WHERE NOT (attempts < 8 AND status = 'rated')"""),
    "merge_runs": _with(ATTEMPTS, """SELECT project, bidder, item_id, CASE WHEN status = 'unrated' OR attempts > 8 THEN 2 ELSE 1 END AS run_no, 'rated' AS status,
  CASE WHEN status = 'unrated' OR attempts > 8 THEN 2.0::DOUBLE ELSE round(score, 6) END AS score FROM reviews"""),
    "run_summary": _with(ATTEMPTS, """SELECT project, count(*) AS calls, sum(greatest(attempts - coalesce(sample_count, CASE WHEN status = 'rated' THEN 1 ELSE 0 END), 0))::BIGINT AS retries,
  count(*) FILTER (WHERE status <> 'unrated') AS completed, count(*) FILTER (WHERE status = 'unrated') AS errored FROM reviews GROUP BY ALL"""),
    "wall_clock": _with(ATTEMPTS, """SELECT project, round(sum(latency_ms) / 1000::DOUBLE, 3) AS wall_clock_sec, max(sample_no) * 4 AS concurrency FROM answers GROUP BY ALL"""),
    "batch_acceptance": _with(ATTEMPTS + """,
log AS (SELECT project, bidder, b, sum(latency_ms) / 1000::DOUBLE AS elapsed, CASE WHEN b % 5 = 0 THEN 'failed' WHEN b % 7 = 0 THEN 'skipped' ELSE 'success' END AS status
  FROM answers GROUP BY ALL),
faults AS (SELECT r.project, count(*) FILTER (WHERE r.status = 'unrated') AS unrated, count(*) FILTER (WHERE r.miss_reason = 'not_found') AS not_found
  FROM reviews r JOIN log l USING (project, bidder) WHERE l.status = 'success' GROUP BY ALL)""",
        """SELECT project, count(*) AS bidders, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status <> 'success') AS failed,
  coalesce(any_value(unrated), 0) AS unrated, coalesce(any_value(not_found), 0) AS not_found, round(sum(elapsed), 6) AS total_sec, round(sum(elapsed) / count(*), 6) AS mean_sec
FROM log LEFT JOIN faults USING (project) GROUP BY project"""),
    "ranked_totals": _with(TOTALS, """SELECT project, row_number() OVER (PARTITION BY project ORDER BY score DESC, bidder) AS rank, bidder, score, score AS expert_score,
  CASE WHEN unrated > 0 THEN '含 ' || unrated || ' 项未评定，合计不含这些项' ELSE '' END AS notes FROM totals"""),
    "score_matrix": _with(ATTEMPTS, "SELECT project, bidder, item_id, name, max_score, round(score, 6) AS score FROM grid"),
    "wide_matrix": _with(ATTEMPTS, "SELECT project, item_id, " + ", ".join(
        f"round(max(score) FILTER (WHERE bidder = 'B{b:02d}'), 6) AS \"B{b:02d}\"" for b in range(12)) + " FROM grid GROUP BY ALL"),
    "matrix_rows": _with(ATTEMPTS, f"""SELECT project, item_id, name, max_score, count(*) AS bidders,
  string_agg(bidder || '=' || {_CELL}, '|' ORDER BY bidder) AS scores FROM grid GROUP BY project, item_id, name, max_score"""),
    "cell_texts": _with(ATTEMPTS, f"SELECT project, bidder, item_id, {_CELL} AS cell FROM grid"),
    "details": _with(ATTEMPTS, """SELECT project, bidder, item_id, row_number() OVER (PARTITION BY project, bidder ORDER BY item_id) AS place, item_guid, status, tier,
  round(score, 6) AS score, miss_reason, reason, attempts, last_error, in_tokens, out_tokens, latency_ms FROM reviews"""),
    "latest_expert": _with(EXPERT, "SELECT project, bidder, item_id, action, expert_score, reviewed_at, pos FROM latest"),
    "expert_totals": _with(TOTALS, "SELECT project, bidder, score, unrated, expert_score, expert_overrides FROM totals"),
    "unrated_list": _with(ATTEMPTS, "SELECT project, bidder, item_id, attempts, last_error FROM reviews WHERE status = 'unrated'"),
    "review_flags": _with(ATTEMPTS, f"""SELECT project, bidder, item_id, confidence, CASE WHEN miss_reason = 'not_found' THEN '{FLAG_NOT_FOUND}' ELSE '{FLAG_FALLBACK}' END AS why
FROM reviews WHERE status <> 'unrated' AND confidence < 0.85::DOUBLE"""),
    "audit_uniform": _with(ATTEMPTS + """,
groups AS (SELECT project, item_id, min(coalesce(tier, '未命中')) AS g, count(DISTINCT coalesce(tier, '未命中')) AS kinds, count(*) AS n FROM reviews WHERE status = 'rated' GROUP BY ALL)""",
        """SELECT project, item_id, 'no_discrimination' AS kind, CASE WHEN g = '未命中' THEN n || ' 家全部 0 分（未命中）' ELSE n || ' 家全部判「' || g || '」档' END AS detail,
  '优 ' || CASE WHEN g = '优' THEN n ELSE 0 END || '，良 ' || CASE WHEN g = '良' THEN n ELSE 0 END || '，一般 ' || CASE WHEN g = '一般' THEN n ELSE 0 END
    || CASE WHEN g = '未命中' THEN '，未命中 ' || n ELSE '' END AS dist FROM groups JOIN n_bidders USING (project) WHERE kinds = 1 AND n = n_bidders"""),
    "audit_any_zero": _with(ATTEMPTS + """,
groups AS (SELECT project, item_id, min(CASE WHEN score = 0 THEN '0分' ELSE tier END) AS g, count(DISTINCT CASE WHEN score = 0 THEN '0分' ELSE tier END) AS kinds, count(*) AS n
  FROM reviews WHERE status = 'rated' GROUP BY ALL)""",
        """SELECT project, item_id, n || ' 家全部判「' || g || '」档' AS detail,
  '优 ' || CASE WHEN g = '优' THEN n ELSE 0 END || '，良 ' || CASE WHEN g = '良' THEN n ELSE 0 END || '，一般 ' || CASE WHEN g = '一般' THEN n ELSE 0 END
    || '，0分 ' || CASE WHEN g = '0分' THEN n ELSE 0 END AS dist FROM groups JOIN n_bidders USING (project) WHERE kinds = 1 AND n = n_bidders"""),
    "perf_totals": _with(ATTEMPTS, """SELECT project, any_value(n_bidders) * any_value(n_items) AS calls, (sum(attempts) - count(*) FILTER (WHERE attempts >= 1))::BIGINT AS retries,
  sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens, sum(latency_ms)::BIGINT AS latency_ms, '未采集' AS concurrency
FROM reviews JOIN n_items USING (project) JOIN n_bidders USING (project) GROUP BY project"""),
    "cite_sources": _with(ATTEMPTS, """SELECT project, bidder, item_id, '[' || cite || '] file' || i || '.pdf · ' || CASE WHEN i % 4 <> 0 THEN 'p.' || (cite + 1) ELSE '页码未采集' END
  || ' · 第一章 > 节' || cite AS sources FROM reviews WHERE cite IS NOT NULL"""),
    "evidence_sheet": _with(ATTEMPTS, f"""SELECT project, bidder, item_id, '项' || i AS item_name, 4.0::DOUBLE AS max_score,
  CASE WHEN status = 'rated' THEN {_CELL} ELSE '—' END AS score, coalesce(tier, '—') AS tier,
  CASE WHEN status = 'rated' THEN reason ELSE '未评定：' || last_error END AS reason,
  CASE WHEN cite IS NULL THEN '' ELSE '[' || cite || '] file' || i || '.pdf · ' || CASE WHEN i % 4 <> 0 THEN 'p.' || (cite + 1) ELSE '页码未采集' END || ' · 第一章 > 节' || cite END AS sources,
  CASE miss_reason WHEN 'no_file' THEN '{MISS_LABEL_NO_FILE}' WHEN 'not_found' THEN '{MISS_LABEL_NOT_FOUND}' ELSE '' END AS miss_label, confidence, attempts FROM reviews"""),
    "summary_sheet": _with(ATTEMPTS + """,
sums AS (SELECT project, bidder, round(coalesce(sum(round(score, 1)), 0), 1) AS score, count(*) FILTER (WHERE score IS NULL) AS unrated, sum(max_score) AS max_score FROM grid GROUP BY ALL)""",
        """SELECT project, bidder, 'B' AS short_name, 1 AS part, '' AS item_id, '合计（未评定项不计入）' AS label, max_score,
  CASE WHEN score = floor(score) THEN score::BIGINT::VARCHAR ELSE score::VARCHAR END AS value FROM sums
UNION ALL SELECT project, bidder, 'B', 2, '', '其中未评定项数', NULL, unrated::VARCHAR FROM sums
UNION ALL SELECT project, bidder, 'B', 0, item_id, name, max_score,
  coalesce(regexp_replace(round(score, 1)::VARCHAR, '\\.0$', ''), '—') FROM grid"""),
    "audit_sheet": _with(ATTEMPTS + """,
groups AS (SELECT project, item_id, min(coalesce(tier, '未命中')) AS g, count(DISTINCT coalesce(tier, '未命中')) AS kinds, count(*) AS n FROM reviews WHERE status = 'rated' GROUP BY ALL)""",
        """SELECT project, item_id, '优 ' || CASE WHEN g = '优' THEN n ELSE 0 END || '　良 ' || CASE WHEN g = '良' THEN n ELSE 0 END || '　一般 ' || CASE WHEN g = '一般' THEN n ELSE 0 END
    || CASE WHEN g = '未命中' THEN '　未命中 ' || n ELSE '' END AS distribution,
  CASE WHEN g = '未命中' THEN n || ' 家全部 0 分（未命中）' ELSE n || ' 家全部判「' || g || '」档' END AS detail
FROM groups JOIN n_bidders USING (project) WHERE kinds = 1 AND n = n_bidders"""),
    "perf_sheet": _with(ATTEMPTS + """,
p AS (SELECT project, any_value(n_bidders) * any_value(n_items) AS calls, (sum(attempts) - count(*) FILTER (WHERE attempts >= 1))::BIGINT AS retries,
  sum(in_tokens)::BIGINT AS a, sum(out_tokens)::BIGINT AS b, sum(latency_ms) / 1000::DOUBLE AS seconds
  FROM reviews JOIN n_items USING (project) JOIN n_bidders USING (project) GROUP BY project)""",
        """SELECT project, unnest([0, 1, 2, 3, 4, 5]) AS line, unnest(['总耗时', '并发路数', '评审项次数', '重试次数', '输入 tokens', '输出 tokens']) AS label,
  unnest(['未采集', '未采集', calls::VARCHAR, retries::VARCHAR, a::VARCHAR, b::VARCHAR]) AS value,
  unnest(['未采集（调度器未落盘墙钟耗时；逐项 latency 之和为 ' || printf('%.1f', seconds) || ' 秒，并发下实际墙钟低于该值）', '逐项评审的并发数',
    '覆盖度校验位 = 投标人数 × 评分项数', '调用失败后的额外重试，不是失败项数', '**本地估算**：端点不返回 token 计数，按中文约 1.5 字/token 估算', '同上，为估算值']) AS note FROM p"""),
    "valid_citations": _with(ATTEMPTS, "SELECT project, bidder, item_id, 0 AS pos, cite AS idx, i || '#' || (cite + 1) AS section_id FROM reviews WHERE cite IS NOT NULL"),
    "normalised_results": _with(ATTEMPTS, """SELECT project, bidder, item_id, CASE WHEN status = 'rated' AND attempts <> 4 THEN 'rated' ELSE 'unrated' END AS status,
  CASE WHEN status = 'rated' AND attempts <> 4 THEN round(score, 6) END AS score,
  CASE WHEN last_error <> '' THEN last_error WHEN attempts = 4 THEN '未知评审状态：error' ELSE '' END AS last_error FROM reviews"""),
    "low_confidence": _with(ATTEMPTS, """SELECT project, bidder, item_id, confidence FROM reviews WHERE status = 'rated' AND confidence < 0.85::DOUBLE AND coalesce(miss_reason, '') <> 'no_file'"""),
    "overlay_report": _with(ATTEMPTS, """SELECT project, bidder, item_id, CASE WHEN i = 5 OR status <> 'rated' THEN 'unrated' ELSE 'rated' END AS status,
  CASE WHEN i <> 5 AND status = 'rated' THEN round(score, 1) END AS score FROM reviews"""),
    "partial_totals": _with(TOTALS + """,
done AS (SELECT * FROM reviews WHERE attempts > 3),
names AS (SELECT DISTINCT project, bidder FROM done)""",
        """SELECT d.project, d.bidder, round(sum(CASE WHEN d.status = 'rated' THEN d.score ELSE 0 END), 1) AS score,
  round(sum(CASE WHEN l.action = '改判' THEN l.expert_score WHEN d.status = 'rated' THEN d.score ELSE 0 END), 1) AS expert_score,
  count(*) FILTER (WHERE l.action = '改判') AS expert_overrides, count(*) FILTER (WHERE d.status <> 'rated') AS unrated, count(*) AS completed
FROM done d LEFT JOIN latest l USING (project, bidder, item_id) GROUP BY d.project, d.bidder"""),
    "expert_records": _with(TOTALS, """SELECT e.project, e.bidder, e.item_id, e.pos, e.action,
  round(CASE WHEN e.action = '改判' THEN floor(e.expert_score * 10 + 0.5::DOUBLE) / 10 ELSE r.score END, 6) AS expert_score,
  round(CASE WHEN e.action = '改判' THEN floor((e.expert_score - r.score) * 10 + 0.5::DOUBLE) / 10 WHEN r.score IS NOT NULL THEN 0 END, 6) AS delta
FROM expert e LEFT JOIN reviews r USING (project, bidder, item_id)"""),
    "merged_expert_records": _with(EXPERT, """SELECT project, bidder, item_id, reviewed_at, note, pos FROM (
  SELECT project, bidder, item_id, reviewed_at, '' AS note, pos, 0 AS src FROM expert WHERE action = '改判'
  UNION ALL SELECT project, bidder, item_id, reviewed_at, 'override', pos, 1 FROM latest)
QUALIFY row_number() OVER (PARTITION BY project, bidder, item_id, reviewed_at ORDER BY src, pos) = 1"""),
    "visible_audit": _with(ATTEMPTS + """,
groups AS (SELECT project, item_id, min(coalesce(tier, '未命中')) AS g, count(DISTINCT coalesce(tier, '未命中')) AS kinds, count(*) AS n FROM reviews WHERE status = 'rated' GROUP BY ALL),
full_items AS (SELECT project, item_id, count(*) AS c FROM reviews WHERE attempts > 1 GROUP BY ALL)""",
        """SELECT project, item_id, CASE WHEN g = '未命中' THEN n || ' 家全部 0 分（未命中）' ELSE n || ' 家全部判「' || g || '」档' END AS detail
FROM groups JOIN n_bidders USING (project) JOIN full_items USING (project, item_id) WHERE kinds = 1 AND n = n_bidders AND c = n_bidders"""),
    "matrix_cells": _with(TOTALS + """,
cells AS (
  SELECT g.project, g.bidder, g.item_id, r.attempts > 3 AS ready, r.status, round(r.score, 1) AS score,
    r.status = 'rated' AND r.confidence < 0.85::DOUBLE AND coalesce(r.miss_reason, '') <> 'no_file' AS low, l.action
  FROM grid g LEFT JOIN reviews r USING (project, bidder, item_id) LEFT JOIN latest l USING (project, bidder, item_id)),
st AS (SELECT *, CASE WHEN NOT coalesce(ready, false) THEN 'pending' WHEN status = 'unrated' THEN 'unrated' WHEN score = 0 THEN 'zero' WHEN low THEN 'low' ELSE 'rated' END AS state FROM cells)""",
        """SELECT project, bidder, item_id, state, CASE state WHEN 'pending' THEN '评审中' WHEN 'unrated' THEN '—' WHEN 'zero' THEN '0' || CASE WHEN low THEN ' 复核' ELSE '' END
  ELSE printf('%.1f', score) || CASE WHEN low THEN ' 复核' ELSE '' END END AS label,
  CASE WHEN state = 'pending' THEN NULL WHEN action = '改判' THEN 'override' WHEN action = '认可' THEN 'approved' END AS mark FROM st"""),
    "total_dispersion": _with(TOTALS, "SELECT project, min(score) AS lowest, max(score) AS highest, round(stddev_samp(score), 6) AS deviation FROM totals GROUP BY ALL"),
    "dispersion": _with(ATTEMPTS, """SELECT project, item_id, count(*) AS rated, round(min(score), 6) AS lowest, round(max(score), 6) AS highest, round((max(score) - min(score)) / 4, 6) AS spread
FROM reviews WHERE status = 'rated' GROUP BY ALL"""),
    "tier_distribution": _with(ATTEMPTS, "SELECT project, coalesce(tier, '未命中') AS tier, count(*) AS results FROM reviews WHERE status = 'rated' GROUP BY ALL"),
    "boundary_scores": _with(ATTEMPTS, """SELECT project, bidder, item_id, round(score, 1) AS score, tier, CASE round(score, 1) WHEN 3 THEN '优' WHEN 2 THEN '良' ELSE '一般' END AS bound_tier
FROM reviews WHERE status = 'rated' AND tier IS NOT NULL AND round(score, 1) IN (1, 2, 3)"""),
    "repeatability": _with(ATTEMPTS + """,
per AS (SELECT project, bidder, item_id, count(DISTINCT coalesce(tier, 'unrated')) = 1 AS same FROM samples GROUP BY ALL HAVING count(*) > 1)""",
        "SELECT project, count(*) AS pairs, round(avg(same::INTEGER), 6) AS same_tier_share FROM per GROUP BY ALL"),
    "total_spread": _with(ATTEMPTS + """,
per AS (SELECT project, bidder, sample_no, sum(score) AS total FROM samples WHERE valid GROUP BY ALL)""",
        "SELECT project, bidder, count(*) AS runs, printf('%.1f', max(total) - min(total))::DOUBLE AS spread FROM per GROUP BY ALL"),
    "attempt_rates": _with(ATTEMPTS, """SELECT project, count(*) AS results, sum(attempts)::BIGINT AS calls, round(sum(greatest(attempts - 1, 0)) / count(*)::DOUBLE, 6) AS extra_call_rate,
  round(avg((attempts > 1)::INTEGER), 6) AS retried_share FROM reviews GROUP BY ALL"""),
    "expand_events": _with(ATTEMPTS + """,
steps AS (SELECT *, greatest(attempts, 1) AS n, unnest(range(1, greatest(attempts, 1) + 1)) AS k FROM reviews)""",
        f"""SELECT project, bidder, item_id, CASE WHEN k < n THEN 'retry' ELSE 'review' END AS type, CASE WHEN k < n THEN k END AS attempt,
  CASE WHEN k < n THEN n END AS max_attempts, CASE WHEN k < n THEN CASE WHEN last_error <> '' THEN last_error ELSE '{RETRY_MESSAGE}' END END AS message,
  CASE WHEN k = n THEN in_tokens END AS in_tokens FROM steps"""),
    "stage_status": _with(RUN_EVENTS, "SELECT project, stage, arg_max(stage_status, seq) AS status, max(seq) AS seq FROM run_events WHERE type = 'stage' GROUP BY ALL"),
    "cursor_read": _with(RUN_EVENTS, "SELECT type, count(*) AS events, max(seq) AS last_seq FROM run_events WHERE seq > 500 GROUP BY ALL"),
    "live_counters": _with(RUN_EVENTS + "," + _COUNTERS, "SELECT * FROM counters"),
    "progress_eta": _with(RUN_EVENTS + "," + _COUNTERS, """SELECT project, done, greatest(3420 - done, 0) AS remaining, round(least(100.0, done * 100.0 / 3420), 6)::DOUBLE AS percent,
  round(CASE WHEN done > 0 THEN latency_ms / 4 / done * greatest(3420 - done, 0) ELSE 0 END, 6) AS eta_ms,
  round(CASE WHEN done > 0 THEN greatest(3420 - done, 0) * greatest(round(latency_ms / done), 2400) / 4 ELSE 0 END, 6) AS first_eta_ms FROM counters"""),
    "event_gaps": _with(RUN_EVENTS + """,
g AS (SELECT project, seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY project ORDER BY seq) AS gap FROM run_events)""",
        "SELECT project, seq, coalesce(gap >= 600000000, false) AS stalled, round(gap / 1000000, 6) AS gap_sec FROM g"),
    "stall_stream": _with(RUN_EVENTS + """,
mark AS (SELECT epoch_us(max(ts)) // 1000 - 7200000 AS w FROM run_events),
passed AS (SELECT project, seq, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER f AS nxt, row_number() OVER f AS pending
  FROM run_events WINDOW f AS (PARTITION BY project ORDER BY seq))""",
        """SELECT project, seq, us AS since_us, pending FROM passed, mark
WHERE us // 1000 < w AND (nxt IS NULL OR nxt - us >= 600000000) AND (coalesce(nxt // 1000 < w, false) OR (us + 600000000) // 1000 < w)"""),
    "watch_results": _with(ATTEMPTS, "SELECT project, bidder, item_id, status, tier, round(score, 6) AS score, attempts, last_error FROM reviews"),
    "live_matrix": _with(TOTALS, """SELECT project, bidder, item_id, coalesce(regexp_replace(round(score, 1)::VARCHAR, '\\.0$', ''), '—') AS value FROM grid
UNION ALL SELECT project, bidder, NULL, regexp_replace(score::VARCHAR, '\\.0$', '') FROM totals"""),
    "stored_results": _with(ATTEMPTS, """SELECT project, bidder, item_id, mode, CASE WHEN status = 'unrated' OR attempts > 8 THEN 2 ELSE 1 END AS run_no, 'rated' AS status,
  CASE WHEN status = 'unrated' OR attempts > 8 THEN 2.0::DOUBLE ELSE round(score, 6) END AS score FROM reviews, (SELECT unnest(['versions', 'compacted']) AS mode)"""),
    "section_files": _with(LINE_SECTIONS, """SELECT project, bidder, id, file, guid AS item_guid, array_to_string(path, ' > ') AS path, level, page, text, char_len::INTEGER AS char_len,
  file_no, seq::INTEGER AS seq FROM sections"""),
    "package_files": _with(ATTEMPTS, """SELECT project, bidder, item_id, item_guid, name, CASE WHEN empty THEN 0 ELSE 3 END AS candidates, CASE WHEN empty THEN 0 ELSE 1 END AS units,
  fallback, CASE WHEN empty THEN 0 ELSE 300 END AS evidence_chars, 3420 AS budget, pool_sections,
  CASE WHEN empty THEN '' ELSE array_to_string(list_transform([1, 2, 3], lambda n: i || '#' || n || '@' || CASE WHEN i % 4 <> 0 THEN n::VARCHAR ELSE '-' END), '|') END AS picks FROM pkg"""),
    "review_files": _with(TOTALS, "SELECT project, bidder, score, unrated, expert_score, expert_overrides FROM totals"),
    "project_manifest": _with(LINE_SECTIONS, "SELECT project, bidder, bidder AS name, count(*) AS sections, sum(char_len)::BIGINT AS chars FROM sections GROUP BY ALL"),
    "report_files": _with(ATTEMPTS + """,
groups AS (SELECT project, item_id, count(DISTINCT coalesce(tier, '未命中')) AS kinds, count(*) AS n FROM reviews WHERE status = 'rated' GROUP BY ALL),
sizes AS (
  SELECT project, count(DISTINCT bidder) AS b, count(*) AS r, count(*) FILTER (WHERE status = 'unrated') AS u,
    count(*) FILTER (WHERE status <> 'unrated' AND confidence < 0.85::DOUBLE) AS f FROM reviews GROUP BY ALL),
audits AS (SELECT project, count(*) AS a FROM groups JOIN n_bidders USING (project) WHERE kinds = 1 AND n = n_bidders GROUP BY ALL),
counted AS (
  SELECT project, unnest([
    {'k': 'blocks', 'm': 'bidders', 'n': b}, {'k': 'blocks', 'm': 'matrix', 'n': b * n_items}, {'k': 'blocks', 'm': 'totals', 'n': b},
    {'k': 'blocks', 'm': 'ranking', 'n': b}, {'k': 'blocks', 'm': 'details', 'n': r}, {'k': 'blocks', 'm': 'unrated', 'n': u},
    {'k': 'blocks', 'm': 'review_flags', 'n': f}, {'k': 'blocks', 'm': 'audit', 'n': coalesce(a, 0)}, {'k': 'blocks', 'm': 'perf', 'n': 1},
    {'k': 'sheets', 'm': 'evidence', 'n': r}, {'k': 'sheets', 'm': 'summary', 'n': b * (n_items + 2)}, {'k': 'sheets', 'm': 'unrated', 'n': u},
    {'k': 'sheets', 'm': 'flags', 'n': f}, {'k': 'sheets', 'm': 'audit', 'n': coalesce(a, 0)}, {'k': 'sheets', 'm': 'perf', 'n': 6}]) AS e
  FROM sizes JOIN n_items USING (project) LEFT JOIN audits USING (project))""",
        "SELECT e.k AS kind, e.m AS name, project, e.n AS n FROM counted WHERE e.n > 0"),
    "active_time": _with(RUN_EVENTS + """,
c AS (SELECT project, seq, epoch_us(ts) AS t, paused FROM run_events WHERE type = 'control'),
ends AS (SELECT project, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM run_events GROUP BY ALL),
spans AS (SELECT c.project, coalesce(lead(t) OVER (PARTITION BY c.project ORDER BY seq), z) - t AS d, paused FROM c JOIN ends USING (project)),
sums AS (SELECT project, coalesce(sum(d) FILTER (WHERE paused = 1), 0) AS p FROM spans GROUP BY ALL)""",
        """SELECT project, round((z - a) / 1000000, 6) AS elapsed_sec, round(coalesce(p, 0) / 1000000, 6)::DOUBLE AS paused_sec,
  round((z - a - coalesce(p, 0)) / 1000000, 6)::DOUBLE AS active_sec FROM ends LEFT JOIN sums USING (project)"""),
    "run_log": _with(RUN_EVENTS + """,
r AS (SELECT *, review_status = 'rated' AND score IS NOT NULL AS usable, confidence < 0.85::DOUBLE AND NOT coalesce(score = 0 AND miss_reason = 'no_file', false) AS low FROM run_events)""",
        """SELECT seq, type, CASE WHEN type = 'retry' THEN 'retry' WHEN type <> 'review' THEN 'system' WHEN NOT usable THEN 'unrated' WHEN low THEN 'retry'
    WHEN score = 0 THEN 'miss' ELSE 'rated' END AS kind,
  CASE WHEN type = 'retry' THEN '重试 ' || attempt_no || '/4' WHEN type = 'stage' THEN CASE WHEN stage_status = 'done' THEN '已完成' ELSE '进行中' END
    WHEN type = 'control' THEN '后台运行状态已更新' WHEN NOT usable THEN '— 未评定'
    WHEN score = 0 THEN '0 分 ' || CASE miss_reason WHEN 'no_file' THEN '缺文件' WHEN 'not_found' THEN '检索未命中' ELSE '未命中' END || CASE WHEN low THEN ' · 建议复核' ELSE '' END
    ELSE '良 ' || printf('%.1f', score) || ' 分' || CASE WHEN low THEN ' · 建议复核' ELSE '' END END AS result FROM r"""),
    "pipeline_ranking": _with(_locate(NUMBERED) + """,
graded AS (
  SELECT project, bidder, CASE WHEN picks > 0 THEN printf('%.1f', max_score * 0.625::DOUBLE)::DOUBLE ELSE 0 END AS score FROM packages),
sums AS (SELECT project, bidder, printf('%.1f', sum(score))::DOUBLE AS score FROM graded GROUP BY ALL)""",
        """SELECT project, row_number() OVER (PARTITION BY project ORDER BY score DESC, bidder) AS rank, bidder, score, score AS expert_score, '' AS notes FROM sums"""),
}
