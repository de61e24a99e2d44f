"""The same results in plain SQL, for an engine that has the test tables as views.

Written on its own, with window functions and one scan per rule where the Spark
side takes other ways. ``DISTINCT`` is left out where rows cannot repeat.
"""

from __future__ import annotations

from httplens import patterns as P
from httplens.acceptance.queries import FIRST, LIMITED, PANEL_ROWS
from httplens.sources import fixture

BASE = "id, host, method, path, status_code"
BODY = "coalesce(req_body, '')"
WITH_BODY = "id, host, method, path, req_body"
HEADERS = "lower(req_headers)"
PATH = "lower(path)"
DENIED = "status_code IN (401, 403)"
NOT_SAFE = "method NOT IN ('GET', 'HEAD', 'OPTIONS')"


def _found(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}') <> ''"


def _has(*words: str) -> str:
    return " OR ".join(f"{HEADERS} LIKE '%{w}%'" for w in words)


_STATE_CHANGE = (
    "method IN ('POST', 'PUT', 'DELETE', 'PATCH') "
    f"AND {HEADERS} NOT LIKE '%csrf%' AND {HEADERS} NOT LIKE '%xsrf%'")


def _unauthenticated(pattern: str) -> str:
    return f"status_code = 200 AND {HEADERS} NOT LIKE '%authorization%' AND {_found(PATH, pattern)}"


PREDICATES = {
    "A1": DENIED,
    "A3": _found(PATH, P.LOGIN_PATHS),
    "A4": _has("authorization", "x-api-key"),
    "I3": "req_body IS NOT NULL AND length(req_body) > 0",
    "I4": _has("application/json"),
    "E1": "status_code >= 500",
    "E2": "status_code >= 400 AND status_code < 500",
    "E5": "status_code >= 400 AND resp_length > 1000",
    "O2": f"status_code = 200 AND {_found(PATH, P.PRIVILEGED_PATHS)}",
    "O3": f"protocol = 'http' AND {_found(f'lower(path || {BODY})', P.SENSITIVE_WORDS)}",
    "O4": _found(f"lower(path || ' ' || {BODY})", P.INJECTION),
    "O5": f"status_code = 200 AND {_found(PATH, P.DEBUG_PATHS)}",
    "O7": _found(f"path || ' ' || {BODY}", P.INTERNAL_URLS),
    "C1": _found(f"lower({BODY} || ' ' || path)", P.SCRIPT_PAYLOADS),
    "C2": _found(f"lower({BODY} || ' ' || path)", P.SQL_PAYLOADS),
    "C3": f"path LIKE '%../%' OR {PATH} LIKE '%2e2e%' OR {_found(PATH, P.ENCODED_TRAVERSAL)}",
    "C4": _STATE_CHANGE,
    "C5": _found(PATH, P.REDIRECT_PARAMS),
    "C6": _found(f"lower(path || ' ' || {BODY})", P.SSRF_PARAMS),
    "S1": _found(PATH, P.INTERESTING_PATHS),
    "S3": " OR ".join(f"{PATH} LIKE '%{w}%'" for w in ("/api/", "/v1/", "/v2/", "/v3/", "/rest/", "/graphql")),
    "S4": "status_code >= 300 AND status_code < 400",
    "S5": f"{_has('multipart')} OR {_found(PATH, P.UPLOAD_PATHS)}",
    "X1": _unauthenticated(P.UNAUTHENTICATED_PATHS),
    "X2": _unauthenticated(P.UNAUTHENTICATED_API_PATHS),
    "X3": _STATE_CHANGE,
}

# id -> columns, order, limit
_NEWEST, _BY_HOST = "id DESC", "host, path, id"
SHAPES = {
    "A1": (BASE, _NEWEST, None),
    "A3": (BASE, _BY_HOST, None),
    "A4": ("id, host, path, req_headers", _BY_HOST, 50),
    "I3": (f"{BASE}, CAST(length(req_body) AS INT) AS body_length", "body_length DESC, id", 50),
    "I4": (BASE, _NEWEST, 50),
    "E1": ("id, host, path, status_code", _NEWEST, None),
    "E2": ("id, host, path, status_code", _NEWEST, None),
    "E3": (f"{BASE}, resp_length", "resp_length DESC, id", 20),
    "E5": ("id, host, path, status_code, resp_length", "resp_length DESC, id", 20),
    "O2": (BASE, _BY_HOST, 50),
    "O3": (BASE, _NEWEST, 50),
    "O4": (WITH_BODY, "id", 50),
    "O5": (BASE, _BY_HOST, 50),
    "O7": (WITH_BODY, "id", 50),
    "C1": (WITH_BODY, "id", 50),
    "C2": (WITH_BODY, "id", 50),
    "C3": (BASE, _NEWEST, 50),
    "C4": ("id, host, method, path, req_headers", _NEWEST, 50),
    "C5": (BASE, _NEWEST, 50),
    "C6": (WITH_BODY, "id", 50),
    "S1": (BASE, _BY_HOST, None),
    "S3": (BASE, "path, id", None),
    "S4": (BASE, _NEWEST, None),
    "S5": (BASE, _BY_HOST, None),
    "X1": (BASE, _BY_HOST, None),
    "X2": ("DISTINCT host, path, status_code", "host, path", None),
    "X3": (BASE, _NEWEST, 50),
}


def _rule(rule_id: str) -> str:
    columns, order, limit = SHAPES[rule_id]
    where = f"WHERE {PREDICATES[rule_id]}" if rule_id in PREDICATES else ""
    return f"SELECT {columns} FROM traffic {where} ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


def _mixed(ok: str, denied: str) -> str:
    return f"""SELECT path, count(CASE WHEN status_code = 200 THEN 1 END) AS {ok},
                      count(CASE WHEN {DENIED} THEN 1 END) AS {denied}
               FROM traffic GROUP BY path HAVING {ok} > 0 AND {denied} > 0"""


_D6_FOUND = _found(PATH, P.INTERESTING_PATHS)

GROUPED = {
    "R1": """SELECT host, protocol, count(*) AS requests, count(DISTINCT path) AS unique_paths
             FROM traffic GROUP BY host, protocol""",
    "R2": "SELECT DISTINCT protocol || '://' || host || path AS url, method FROM traffic",
    "R3": "SELECT method, count(*) AS count FROM traffic GROUP BY method",
    "R4": "SELECT status_code, count(*) AS count FROM traffic GROUP BY status_code",
    "R5": """SELECT strftime(timestamp, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests
             FROM traffic GROUP BY 1 ORDER BY minute DESC LIMIT 60""",
    "A2": _mixed("ok_hits", "auth_fail_hits"),
    "O1": _mixed("ok_200", "denied"),
    "I1": f"SELECT method, host, path, count(*) AS requests FROM traffic WHERE {NOT_SAFE} GROUP BY 1, 2, 3",
    "I2": """SELECT DISTINCT host, split_part(path, '?', 1) AS base_path, split_part(path, '?', 2) AS query_string
             FROM traffic WHERE path LIKE '%?%'""",
    "E4": "SELECT path, count(*) AS hits FROM traffic WHERE status_code = 404 GROUP BY path",
    "O6": f"SELECT host, path, count(*) AS failures FROM traffic WHERE {DENIED} GROUP BY 1, 2 HAVING count(*) >= 3",
    "S2": """SELECT host, method, regexp_replace(path, '[0-9]+', '{id}') AS path_pattern,
                    count(DISTINCT path) AS id_variations
             FROM traffic WHERE regexp_extract(path, '/[0-9]+') <> '' GROUP BY 1, 2, 3
             ORDER BY id_variations DESC, path_pattern, host, method LIMIT 30""",
    "D1": "SELECT count(*) AS total_requests, count(DISTINCT host) AS unique_hosts FROM traffic",
    "D2": f"""SELECT path, count(*) AS hits, count(DISTINCT host) AS hosts FROM traffic WHERE {DENIED}
              GROUP BY path ORDER BY hits DESC, path LIMIT 15""",
    "D3": """SELECT host, path, status_code, count(*) AS hits FROM traffic WHERE status_code >= 500
             GROUP BY 1, 2, 3 ORDER BY hits DESC, host, path, status_code LIMIT 15""",
    "D4": f"""SELECT method, host, path, count(*) AS requests, count(DISTINCT status_code) AS response_variants
              FROM traffic WHERE {NOT_SAFE} GROUP BY 1, 2, 3 ORDER BY requests DESC, method, host, path LIMIT 20""",
    "D5": """SELECT host, method, path, status_code, resp_length FROM traffic
             ORDER BY resp_length DESC, id LIMIT 10""",
    "D6": f"""SELECT host, method, path, status_code, count(*) AS hits FROM traffic WHERE {_D6_FOUND}
              GROUP BY 1, 2, 3, 4 ORDER BY hits DESC, path, host, method, status_code LIMIT 20""",
    "D7": """SELECT host, protocol, count(*) AS requests, count(DISTINCT path) AS unique_paths,
                    CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors
             FROM traffic GROUP BY host, protocol""",
    "M1": f"""SELECT count(*) AS total, count(DISTINCT host) AS hosts, count(DISTINCT method) AS methods,
                     CAST(sum(CASE WHEN {DENIED} THEN 1 ELSE 0 END) AS BIGINT) AS auth_fails,
                     CAST(sum(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS server_errs
              FROM traffic""",
    "M2": """SELECT host || '(' || count(*) || ')' AS v FROM traffic GROUP BY host
             ORDER BY count(*) DESC, host LIMIT 5""",
    "M3": """SELECT CAST(status_code AS VARCHAR) || '(' || count(*) || ')' AS v FROM traffic GROUP BY status_code
             ORDER BY count(*) DESC, status_code LIMIT 8""",
    "M4": "SELECT method || '(' || count(*) || ')' AS v FROM traffic GROUP BY method",
    "M5": "SELECT method, path, status_code FROM traffic ORDER BY id DESC LIMIT 10",
}


def _digest(rows: str) -> str:
    """The digest of one set of rows, put together from ranked parts."""
    def top(column: str, n: int | None) -> str:
        limit = "" if n is None else f"LIMIT {n}"
        return f"""(SELECT string_agg({column} || '(' || n || ')', ' ' ORDER BY n DESC, {column}) FROM (
                    SELECT {column}, count(*) AS n FROM {rows} GROUP BY {column}
                    ORDER BY n DESC, {column} {limit}))"""
    recent = f"""(SELECT string_agg(method || ' ' || path || '→' || status_code, ', ' ORDER BY id DESC)
                  FROM (SELECT * FROM {rows} ORDER BY id DESC LIMIT 10))"""
    return f"""count(*) || ' reqs | ' || count(DISTINCT host) || ' hosts | ' || count(DISTINCT method)
        || ' methods | ' || count(CASE WHEN {DENIED} THEN 1 END) || ' auth_fails | '
        || count(CASE WHEN status_code >= 500 THEN 1 END) || ' server_errs' || chr(10)
        || 'hosts: ' || {top('host', 5)} || chr(10) || 'status: ' || {top('status_code', 8)} || chr(10)
        || 'methods: ' || {top('method', None)} || chr(10) || 'recent: ' || {recent} || chr(10) AS digest"""


TIME = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp"
ALL = ("id, {time}, host, port, protocol, method, path, status_code, req_headers, req_body, "
       "resp_headers, resp_body, resp_length")
ALL_READABLE = ALL.format(time=TIME)

_NORMALIZED_RESP_HEADERS = (
    """'{"Content-Type":"text/html","Set-Cookie":"u=\\"' || CAST(u AS VARCHAR) || '\\"","Set-Cookie":"p=C:\\\\'"""
    """ || page_path || '\\t' || t || '\\n\\r"}'""")


def _normalized_cte() -> str:
    columns = {**fixture.TRAFFIC, "resp_headers": _NORMALIZED_RESP_HEADERS}
    chosen = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"{fixture.traffic_cte()}, captured AS (SELECT {chosen} FROM hits JOIN sites ON hits.page_no = sites.page_id)"


_REPEATS = f"""
    , stored AS (SELECT * REPLACE ('stored.' || host AS host) FROM traffic WHERE method = 'GET')
    , incoming AS (SELECT * FROM traffic UNION ALL
                   SELECT * REPLACE ('repeat.invalid' AS host, timestamp + INTERVAL 1 MINUTE AS timestamp) FROM traffic)
    , fresh AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS nth FROM incoming
                WHERE id NOT IN (SELECT id FROM stored))
    SELECT {ALL_READABLE} FROM (SELECT * FROM stored UNION ALL SELECT * EXCLUDE (nth) FROM fresh WHERE nth = 1)
"""

_MESSAGE = ("CASE WHEN coalesce({body}, '') = '' THEN coalesce({headers}, '') "
            "ELSE coalesce({headers}, '') || chr(13) || chr(10) || chr(13) || chr(10) || {body} END")

_DETAIL = "id, {} AS request, {} AS response".format(
    _MESSAGE.format(headers="req_headers", body="req_body"),
    _MESSAGE.format(headers="resp_headers", body="resp_body"))

# --- chat text ----------------------------------------------------------------

_LOOKS = "({})".format(" OR ".join(
    [f"starts_with(upper(x), '{w}')" for w in P.SQL_STARTS]
    + ["contains(upper(x), ' FROM ')", "contains(upper(x), chr(10) || 'FROM ')"]))


def _category(text: str) -> str:
    branches = " ".join(
        "WHEN {} THEN '{}'".format(" OR ".join(f"contains(upper({text}), '{w}')" for w in words), name)
        for name, words in P.CATEGORY_WORDS)
    return f"CASE {branches} ELSE '{P.DEFAULT_CATEGORY}' END"


def _preview(text: str) -> str:
    line = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({line}) > 110 THEN substring({line}, 1, 107) || '…' ELSE {line} END"


_REPLIES = f"""
    replies AS (SELECT conv_id, turn, {fixture.REPLY} AS md FROM conversations WHERE role = 'assistant'),
    listed AS (
        SELECT conv_id, turn, list_filter(
            list_transform(regexp_extract_all(md, '{P.SQL_BLOCK}', 1),
                           lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
            lambda x: x <> '' AND {_LOOKS}) AS found
        FROM replies),
    blocks AS (
        SELECT conv_id, turn, CAST(generate_subscripts(found, 1) - 1 AS INT) AS block_no, unnest(found) AS sql_text
        FROM listed)
"""

_RESPONSES = f"""
    quoted AS (SELECT conv_id, turn, text, CAST(to_json(text) AS VARCHAR) AS q FROM conversations),
    responses AS (SELECT conv_id, turn, text, {fixture.RESPONSE} AS json FROM quoted)
"""

_SAVED = """
    saved AS (SELECT doc_id AS id, lang AS category, source || '/' || CAST(doc_id AS VARCHAR) AS name,
                     text AS sql_text FROM documents)
"""


def _append(rows: str) -> str:
    return f"""SELECT id, category, name, sql_text FROM saved UNION ALL
               SELECT (SELECT coalesce(max(id), 0) FROM saved)
                      + row_number() OVER (ORDER BY category, name, sql_text) AS id, category, name, sql_text
               FROM {rows}"""


_CONTENT = """
    SELECT conv_id, turn,
           CASE WHEN conv_id % 9 IN (0, 1, 3, 6) THEN text
                WHEN conv_id % 9 = 2 THEN text || chr(10) || 'tail' || chr(10) || 'end'
                WHEN conv_id % 9 = 4 THEN text || chr(10) || 'more' END AS content,
           CASE conv_id % 9 WHEN 5 THEN 'API error: ' || text
                WHEN 7 THEN 'No text content in response: {}'
                WHEN 8 THEN 'No text content in response: not json' END AS error
    FROM responses
"""

_HTTP = """
    SELECT conv_id, turn, 'HTTP ' || CAST(400 + conv_id % 9 AS VARCHAR) || ': '
           || CASE conv_id % 9 WHEN 5 THEN text ELSE json END AS error
    FROM responses
"""

# --- streams -------------------------------------------------------------------


def _panels() -> str:
    parts = []
    ids = dict(auth_failures="D2", server_errors="D3", attack_surface="D4", largest_responses="D5",
               interesting_paths="D6", hosts="D7", overview="D1")
    for name, (keys, n) in PANEL_ROWS.items():
        label = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        parts.append(f"SELECT '{name}' AS panel, concat_ws(' ', {label}) AS label, CAST({n} AS BIGINT) AS n "
                     f"FROM ({GROUPED[ids[name]]})")
    return " UNION ALL ".join(parts)


_TIMELINE = """
    SELECT strftime(timestamp, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM traffic
    GROUP BY 1
"""

_ALERTS = f"""
    , refused AS (SELECT * FROM traffic WHERE {DENIED})
    , spans AS (
        SELECT host, path, date_trunc('day', timestamp) - to_days(k) AS start
        FROM refused, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k))
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS since, host, path, count(*) AS failures FROM spans
    GROUP BY start, host, path HAVING count(*) >= 3
"""

_FINDINGS = "SELECT {}, concat_ws(',', {}) AS findings FROM traffic".format(
    BASE, ", ".join(f"CASE WHEN {p} THEN '{i}' END" for i, p in PREDICATES.items()))

_COUNTS = " UNION ALL ".join(
    f"SELECT '{i}' AS rule, count(*) AS hits FROM traffic WHERE {p}" for i, p in PREDICATES.items())

_COUNTS_BY_HOST = " UNION ALL ".join(
    f"SELECT host, '{i}' AS rule, count(CASE WHEN {p} THEN 1 END) AS hits FROM traffic GROUP BY host"
    for i, p in PREDICATES.items())


def _over_traffic() -> dict[str, str]:
    found = {i: _rule(i) for i in SHAPES} | GROUPED
    found |= {f"{i}_all": found[i].rsplit(" LIMIT ", 1)[0] for i in LIMITED}
    found |= {
        "F1": _FINDINGS,
        "F2": _COUNTS,
        "F2_by_host": _COUNTS_BY_HOST,
        "M6": f"SELECT {_digest('traffic')} FROM traffic",
        "T-1": f"SELECT {ALL_READABLE} FROM traffic",
        "T-6": f"SELECT {ALL_READABLE} FROM traffic",
        "T-7": f"SELECT {ALL_READABLE} FROM traffic",
        "T-2_rejects": """SELECT id, CASE id % 6 WHEN 1 THEN 'not an exchange' WHEN 2 THEN 'not an exchange'
                                 WHEN 3 THEN 'no id' WHEN 4 THEN 'no text' ELSE 'kept' END AS outcome FROM traffic""",
        "T-8": f"SELECT {ALL_READABLE} FROM traffic",
        "T-9": "SELECT host, method, count(*) AS requests, max(resp_length) AS largest FROM traffic GROUP BY 1, 2",
        "T-11": "SELECT id, host, method, path, status_code, resp_length FROM traffic ORDER BY id DESC LIMIT 100",
        "T-12": f"SELECT {ALL_READABLE} FROM traffic WHERE method = 'POST'",
        "T-5": f"SELECT {_DETAIL} FROM traffic",
        "V1": f"SELECT {_DETAIL} FROM traffic WHERE status_code >= 500",
        "Q-0": _rule("X1"),
        "Q-00": f"SELECT host, count(*) AS refusals FROM traffic WHERE {DENIED} GROUP BY host",
        "Q1": """SELECT host, id, resp_length, CAST(place AS INT) AS place FROM (
                     SELECT *, row_number() OVER (PARTITION BY host ORDER BY resp_length DESC, id) AS place FROM traffic)
                 WHERE place <= 3""",
        "Q2": """SELECT * FROM (
                     SELECT id, host, epoch_us(timestamp)
                            - lag(epoch_us(timestamp)) OVER (PARTITION BY host ORDER BY timestamp, id) AS gap_micros
                     FROM traffic)
                 WHERE gap_micros IS NOT NULL""",
        "Q3": "SELECT host, method, count(*) AS requests FROM traffic GROUP BY ROLLUP (host, method)",
        "Q4": """SELECT path FROM traffic WHERE status_code = 200
                 EXCEPT SELECT path FROM traffic WHERE lower(req_headers) LIKE '%authorization%'""",
        "Q5": """SELECT id, host, path, ok.id AS ok_id, ok.seen - epoch_us(timestamp) AS after_micros,
                        ok.seen - epoch_us(timestamp) <= 3600000000 AS within_hour
                 FROM (
                     SELECT id, host, path, status_code, timestamp,
                            min(CASE WHEN status_code = 200 THEN {'seen': epoch_us(timestamp), 'id': id} END) OVER (
                                PARTITION BY host, path ORDER BY timestamp, id
                                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ok
                     FROM traffic)
                 WHERE status_code = 401 AND ok IS NOT NULL""",
        "Q6": f"SELECT {BASE} FROM traffic WHERE host IN (SELECT host FROM traffic WHERE status_code >= 500)",
        "Q7": """SELECT id, json_extract_string(req_headers, '$.Host') AS header_host,
                        json_extract_string(req_headers, '$.Authorization') AS authorization FROM traffic""",
        "Q8": """SELECT id, host, count(*) OVER (PARTITION BY host ORDER BY timestamp, id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS requests_so_far FROM traffic""",
        "W-2": _TIMELINE,
        "W-3": _panels(),
        "W-4": _FINDINGS,
    }
    return found


def oracle_sql() -> dict[str, str]:
    cte, normalized = fixture.traffic_cte(), _normalized_cte()
    found = {name: f"WITH {cte} {sql}" for name, sql in _over_traffic().items()}
    found["T-3"] = f"WITH {cte} {_REPEATS}"
    found["W-5"] = f"WITH {cte} {_ALERTS}"
    found["W-5_emitted"] = f"SELECT since, host, path, true AS reached FROM (WITH {cte} {_ALERTS})"
    found["W-3_sketches"] = f"WITH {cte} SELECT host, protocol, count(*) AS requests, true AS close FROM traffic GROUP BY host, protocol"
    for name in ("http", "https"):
        cte += f", {name}_only AS (SELECT * FROM traffic WHERE protocol = '{name}')"
    found["M6_by_protocol"] = f"WITH {cte} " + " UNION ALL ".join(
        f"SELECT '{name}' AS protocol, {_digest(f'{name}_only')} FROM {name}_only HAVING count(*) > 0"
        for name in ("http", "https"))
    for name in ("T-2", "T-3_indexed", "T-4", "W-1_first"):
        found[name] = f"WITH {normalized} SELECT {ALL_READABLE} FROM captured"
    found["W-1"] = f"WITH {normalized} SELECT {ALL_READABLE} FROM captured"
    found |= {
        "T-10": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "K-1": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate,
                         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS row_no
                  FROM lineitem""",
        "K-2": f"""WITH {_REPLIES}, {_SAVED}, suggestions AS (
                       SELECT {_category('sql_text')} AS category,
                              concat_ws('.', conv_id, turn, block_no) AS name, sql_text FROM blocks)
                   {_append('suggestions')}""",
        "K-3": f"WITH {_SAVED} SELECT id, category, name, sql_text FROM saved",
        "K-4": f"WITH {_SAVED} SELECT * FROM saved WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "K-5": f"WITH {_SAVED} {_append('saved')}",
        "K-6": f"""WITH {_SAVED} SELECT category, name, id,
                       row_number() OVER (PARTITION BY category ORDER BY name, id) AS position FROM saved""",
        "K-6_categories": f"WITH {_SAVED} SELECT DISTINCT category FROM saved",
        "G-1": f"WITH {_REPLIES} SELECT conv_id, turn, block_no, sql_text FROM blocks",
        "G-2": f"WITH {_REPLIES} SELECT conv_id, turn, {_LOOKS.replace('(x)', '(md)')} AS is_sql FROM replies",
        "G-3": f"""WITH {_REPLIES} SELECT conv_id, turn, block_no, {_category('sql_text')} AS category,
                       {_preview('sql_text')} AS preview FROM blocks""",
        "G-4": f"SELECT doc_id, {_preview('text')} AS preview FROM documents",
        "G-5": f"WITH {_RESPONSES} {_CONTENT}",
        "G-6": f"WITH {_RESPONSES} {_HTTP}",
    }
    found |= {f"{i}_first": found[i] for i in FIRST} | {f"{i}_ranked": found[i] for i in ("E3", "E5", "D5", "I3")}
    found |= {"A2_sieved": found["A2"], "O1_sieved": found["O1"]}
    found["T-2_no_time"] = f"WITH {normalized} SELECT id, CASE WHEN id % 2 = 0 THEN 'own' ELSE 'now' END AS time FROM captured"
    found["T-5_files"] = f"SELECT * FROM ({found['T-5']}) WHERE id IN (SELECT id FROM ({found['E3']}))"
    numbered = "row_number() OVER (ORDER BY category, name, sql_text)"
    stored = f"{_SAVED}, stored AS (SELECT {numbered} AS id, category, name, sql_text FROM saved)"
    found["K-2_stored"] = f"""WITH {_REPLIES}, {stored}, suggestions AS (
        SELECT {_category('sql_text')} AS category, concat_ws('.', conv_id, turn, block_no) AS name, sql_text FROM blocks)
        SELECT id, category, name, sql_text, true AS dated FROM stored UNION ALL
        SELECT (SELECT count(*) FROM stored) + {numbered}, category, name, sql_text, true FROM suggestions"""
    found["K-4_stored"] = f"""WITH {stored}
        SELECT id, category, name, sql_text, true AS dated FROM stored WHERE id % 3 <> 0 UNION ALL
        SELECT (SELECT count(*) FROM stored) + {numbered}, category, name, sql_text, true FROM stored"""
    found["K-5_array"] = f"WITH {stored} SELECT *, true AS dated FROM stored"
    return found
