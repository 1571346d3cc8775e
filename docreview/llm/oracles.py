"""SQL twins of the registered queries, where SQL can express them."""

ORACLES: dict[str, str] = {}


def _unit(key: str, shard: int) -> str:
    return f"((('0x' || substr(md5({key} || '/{shard}'), 1, 13))::BIGINT + 0.5) / {2**52}.0)"


def _best(key: str, shards: int) -> str:
    """The shard of the highest score; the higher number wins a draw."""
    scores = ", ".join(f"{{'s': 1.0 / -ln({_unit(key, i)}), 'i': {i}}}" for i in range(shards))
    return f"list_max([{scores}]).i"


# CRC-32 byte by byte: the table of the reflected polynomial, then one look-up per byte of the text.
ORACLES["op8_sharding"] = f"""
WITH crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS lookup FROM (
    SELECT i, list_reduce(range(8), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c
    FROM range(256) AS t(i))
), keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
)
SELECT doc_id, length(h) // 2 + 1 AS size,
  xor(4294967295, list_reduce(
    list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda a, b: xor(a >> 8, lookup[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32,
  'key' AS law, {_best('k', 8)} AS shard,
  row_number() OVER (PARTITION BY {_best('k', 8)} ORDER BY md5(k), doc_id) - 1 AS slot,
  {_best('k', 9)} AS grown_shard
FROM keyed, crc_table
"""

ORACLES["op9_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, text_sha256,
  first_value(doc_id) OVER g AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER g = 1 AS kept
FROM bare
WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS FIRST)
"""

ORACLES["op10_curriculum"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), filled AS (
  SELECT *, coalesce(least(cap::DOUBLE, weight * max(CASE WHEN cap / weight > level THEN level END) OVER ()), cap::DOUBLE) AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.rank, floor(s.target + 0.5)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.h, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN filled s ON d.source IS NOT DISTINCT FROM s.source
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS full_passes FROM placed
), parts AS (
  SELECT *, greatest(least(goal - full_passes * source_size - before, size), 0) AS last FROM passes
), taken AS (
  SELECT *, full_passes * size + last AS taken,
    CASE WHEN full_passes > 0 THEN size ELSE last END AS first_words
  FROM parts
), shares AS (
  SELECT *, (before + first_words / 2) / goal AS f, [0.5, 0.0, -0.5][(rank - 1) % 3 + 1] AS c FROM taken
), halves AS (
  -- the weight falls from 1 + c to 1 at the middle and on to 1 - c; its integral up to the middle is (1 + c/2) / 2
  SELECT *, CASE WHEN 2 * f >= 1 + c / 2 THEN 1 ELSE 0 END AS i FROM shares
), roots AS (
  SELECT *, CASE WHEN i = 0 THEN 1 + c ELSE 1 END AS low, 2 * f - CASE WHEN i = 0 THEN 0 ELSE 1 + c / 2 END AS rest FROM halves
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN size > 0 THEN floor(taken / size + 0.5) ELSE 0 END::INTEGER AS copies,
  CASE WHEN first_words > 0 THEN
    (i + least(2 * rest / (low + sqrt(greatest(low * low - 2 * c * rest, 0))), 1)) / 2 END AS position
FROM roots
"""

ORACLES["op4_suffix_dedup"] = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, s, h[2 * s + 1 : 2 * s + 100] AS g
  FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS s FROM texts)
), firsts AS (
  SELECT g, min(doc_id) AS first_doc FROM strings GROUP BY g
), later AS (
  SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS step
  FROM strings JOIN firsts USING (g) WHERE first_doc < doc_id
), numbered AS (
  SELECT doc_id, s, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM later
), spans AS (
  SELECT doc_id, span, min(s) AS a, max(s) + 50 AS b FROM numbered GROUP BY doc_id, span
), ends AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), rest AS (
  SELECT e.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(t.h[2 * before + 1 : 2 * a], '' ORDER BY a) AS kept
  FROM ends e JOIN texts t USING (doc_id) GROUP BY e.doc_id
)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || t.h[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM texts t LEFT JOIN rest USING (doc_id)
"""

# The rebuilt sequences are lists of digests; a node is a prefix, its key the digests in a row.
ORACLES["op11_prefix_trie"] = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS lookup FROM (
    SELECT i, list_reduce(range(8), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c
    FROM range(256) AS t(i))
), turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL
), sequences AS (
  SELECT conv_id, list({'digest': digest, 'words': words} ORDER BY turn NULLS FIRST, digest) AS s FROM turns GROUP BY conv_id
), shares AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)),
    lambda a, b: xor(a >> 8, lookup[(xor(a, b) & 255) + 1]), 4294967295)) % 4 AS h
  FROM sequences, crc_table
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1 : c.h], []), c.s[c.h + 1 :]) AS s
  FROM shares c LEFT JOIN sequences b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, depth, depth = len(s) AS ends, coalesce(array_to_string(list_transform(s[1 : depth], lambda x: x.digest), ''), '') AS k,
    s[depth].words AS words
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY k, depth
), children AS (
  SELECT left(k, 64 * (depth - 1)::INTEGER) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), grown AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (k)
), totals AS (
  SELECT left(k, 64 * above::INTEGER) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
    sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM grown) GROUP BY 1
)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens, g.ends_sha256
FROM grown g JOIN totals USING (k)
LEFT JOIN nodes p ON g.depth > 0 AND p.k = left(g.k, 64 * (g.depth - 1)::INTEGER)
"""

# Windows are opened turn by turn, over lists of a part's tokens and lengths.
ORACLES["op13_chat_format"] = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv_id
), sized AS (
  SELECT conv_id, floor(turn / 128) AS part, turn, role, text,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
    24 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'))
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars
  FROM turns
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // 128 AS block
  FROM sized
), systems AS (
  SELECT conv_id, tokens AS system_tokens, chars AS system_chars FROM numbered WHERE n = 1 AND role = 'system'
), units AS (
  SELECT n.conv_id, part, block, coalesce(any_value(system_tokens), 0) AS system_tokens, coalesce(any_value(system_chars), 0) AS system_chars,
    coalesce(list(tokens ORDER BY n) FILTER (n > 1 OR role <> 'system'), []) AS tok,
    coalesce(list(chars ORDER BY n) FILTER (n > 1 OR role <> 'system'), []) AS len
  FROM numbered n LEFT JOIN systems s ON s.conv_id IS NOT DISTINCT FROM n.conv_id GROUP BY n.conv_id, part, block
), walk AS (
  SELECT conv_id, part, block, system_tokens, system_chars, tok, len, 0 AS i, 0::BIGINT AS used,
    CASE WHEN len(tok) = 0 THEN system_chars ELSE 0 END::BIGINT AS chars
  FROM units
  UNION ALL
  SELECT conv_id, part, block, system_tokens, system_chars, tok, len, i + 1,
    (CASE WHEN fits THEN used ELSE coalesce(list_sum(tok[i + 1 - back : i]), 0) END + tok[i + 1])::BIGINT,
    (len[i + 1] + CASE WHEN fits THEN 0 ELSE system_chars + coalesce(list_sum(len[i + 1 - back : i]), 0) END)::BIGINT
  FROM (
    SELECT *, i > 0 AND used + tok[i + 1] <= 1024 - system_tokens AS fits,
      len(list_filter([1, 2, 3, 4], lambda k: k <= i
        AND list_sum(tok[i + 1 - k : i]) <= least(256, 1024 - system_tokens - tok[i + 1]))) AS back
    FROM walk WHERE i < len(tok)
  )
), formatted AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM walk GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole w JOIN formatted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id
"""
