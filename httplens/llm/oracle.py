"""The same results in SQL, where SQL can express them; the others are tested against brute force."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_ESCAPED = r"replace(replace(replace({c}, '\', '\\'), '### ', '\h'), '</turn>', '\t')"

CHAT = rf"""
WITH turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
    SELECT *, length('### ' || replace({_ESCAPED.format(c="role")}, ': ', '\c') || ': ' || {_ESCAPED.format(c="text")} || '</turn>') + 1 AS size
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""

CONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
grams AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS gram
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, g.item FROM places p JOIN grams g ON p.gram = g.gram AND p.n = g.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

REPEATS = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS place FROM places) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

WARC = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
hashed AS (SELECT *, sha1(html) AS h FROM own)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '')
           AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM hashed"""

JACCARD = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS same FROM shingles GROUP BY doc_id),
classes AS (
    SELECT doc_id, coalesce(n, 0) AS n, min(doc_id) OVER (PARTITION BY coalesce(same, '')) AS class_id,
           count(*) OVER (PARTITION BY coalesce(same, '')) AS n_copies
    FROM docs LEFT JOIN sets USING (doc_id)),
firsts AS (SELECT doc_id, s FROM shingles SEMI JOIN (SELECT class_id AS doc_id FROM classes) USING (doc_id)),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM firsts a JOIN firsts b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y, b.n_copies FROM common JOIN classes a ON a.doc_id = x JOIN classes b ON b.doc_id = y
    WHERE 5 * k >= 4 * (a.n + b.n - k)),
reached(node, root) AS (
    SELECT doc_id, doc_id FROM classes WHERE doc_id = class_id
    UNION SELECT y, root FROM reached JOIN links ON x = node),
groups AS (SELECT node, min(root) AS group_id FROM reached GROUP BY node),
counts AS (SELECT x, sum(n_copies) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, n_copies, CAST(n_copies - 1 + coalesce(c.n, 0) AS BIGINT) AS n_links, group_id
FROM classes JOIN groups ON node = class_id LEFT JOIN counts c ON c.x = class_id"""


REPAIR = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations),
hashed AS (
    SELECT *, xor(list_reduce(
        list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda s, b: list_reduce(
            list_prepend(xor(s, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
            lambda x, z: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT)) % 20 AS harm
    FROM keyed),
harmed AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
           CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM hashed WHERE harm <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
looked AS (
    SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen
    FROM numbered),
turns AS (
    SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
           CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN body NOT SIMILAR TO '(.|\n)*[.!?]' THEN 'truncated' ELSE '' END AS fault
    FROM looked),
gap(a, b, letter, cost) AS (
    VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (3, 2, 'I', 3), (2, 3, 'I', 3)),
form(a, b, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edge AS (
    SELECT DISTINCT a AS a, a AS b, 'D' AS letter, 4 AS cost, NULL AS initial FROM gap
    UNION ALL SELECT a, b, 'K', 0, initial FROM form
    UNION ALL SELECT a, b, 'R', 3, NULL FROM form WHERE initial <> 's'),
node AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, '000000000' AS weight FROM turns
    UNION ALL
    SELECT t.conv_id, t.i, e.b, min(lpad(CAST(CAST(left(n.weight, 9) AS INTEGER) + g.cost + e.cost +
               CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END AS VARCHAR), 9, '0')
           || substr(n.weight, 10) || g.letter || e.letter)
    FROM node n JOIN turns t ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.i = n.i + 1 JOIN gap g ON g.a = n.state JOIN edge e ON e.a = g.b
    WHERE (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = t.initial)
    GROUP BY t.conv_id, t.i, e.b),
counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id),
best AS (
    SELECT c.conv_id, min(lpad(CAST(CAST(left(weight, 9) AS INTEGER) + g.cost AS VARCHAR), 9, '0') || substr(weight, 10) || g.letter) AS weight
    FROM node JOIN counted c ON c.conv_id IS NOT DISTINCT FROM node.conv_id AND node.i = c.n JOIN gap g ON g.a = state
    WHERE g.b IN (0, 3) GROUP BY c.conv_id),
letters AS (
    SELECT conv_id, unnest(string_split(substr(weight, 10), '')) AS letter, unnest(range(1, length(weight) - 8)) AS k,
           length(replace(substr(weight, 10), 'D', '')) AS size
    FROM best WHERE length(weight) > 9),
placed AS (
    SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER own AS i, count(*) FILTER (WHERE letter <> 'D') OVER own - 1 AS position
    FROM letters WINDOW own AS (PARTITION BY conv_id ORDER BY k)),
repaired AS (
    SELECT p.conv_id, position, CASE WHEN letter = 'K' THEN t.role WHEN (position - size % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
           CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text
    FROM placed p LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i
    WHERE letter <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY position)) AS digest FROM repaired GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(weight, 9), '0') AS BIGINT) AS cost,
       coalesce(substr(weight, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""

LEXICAL = rf"""
WITH terms AS (SELECT doc_id, unnest({_ALNUM}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest({_ALNUM}) AS term FROM benchmark),
times AS (SELECT doc_id, term, count(*) AS tf FROM terms SEMI JOIN wanted USING (term) GROUP BY doc_id, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM times, whole GROUP BY term, docs),
parts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part
    FROM times JOIN weights USING (term) JOIN sizes USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": CHAT,
        "op3_contamination": CONTAMINATION,
        "op5_repeats": REPEATS,
        "op7_warc": WARC,
        "op10_jaccard": JACCARD,
        "op11_repair": REPAIR,
        "op13_lexical": LEXICAL,
    }
