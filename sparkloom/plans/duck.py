"""Pieces of DuckDB SQL for the oracles: rule chains, tests and derived inputs, spelled for RE2."""

from __future__ import annotations

from ..functions import rules as R


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewrite(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    return c


def any_of(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in patterns) + ")"


LOG_LINES = """log_lines AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'debug' ELSE 'info' END AS lvl,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END || '] '
      || event_type || ' request ' || event_id || ' took ' || CAST(floor(value) AS BIGINT) || 'ms for ''/api/user/' || user_id || '''' AS raw,
    event_type || ' request ' || event_id || ' took ' || CAST(floor(value) AS BIGINT) || 'ms for ''/api/user/' || user_id || '''' AS message,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, ts, event_id, user_id, event_type, value
  FROM events)"""
RICH = LOG_LINES + """, rich AS (SELECT doc_id, pos, event_id, raw || ' trace=' || md5(CAST(event_id AS VARCHAR)) || ' from 10.0.' || (event_id % 256) || '.' || (user_id % 256) || ':8080 at /srv/app/' || event_type || '.log' AS raw FROM log_lines)"""
HTTP_LINES = """http_lines AS (
  SELECT event_id, user_id, 'GET /items/' || (event_id % 50) || '?u=' || user_id || ' ' || CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END || ' ' || CAST(floor(value) AS BIGINT) || 'ms' AS raw FROM events)"""
BUILD_LINES = """build_lines AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey % 20 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS pos, l_partkey % 20 AS doc_id,
    'src/p' || (l_partkey % 20) || '.ts(' || l_linenumber || ',' || l_suppkey || '): error TS' || (2300 + l_linenumber) || ': Cannot find name ''v' || (l_orderkey % 7) || '''.' AS raw FROM lineitem)"""
COMMANDS = """commands AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    CASE event_type WHEN 'view' THEN 'npm run test --watch' WHEN 'click' THEN 'npm test src/a.ts' WHEN 'error' THEN 'npm run build' ELSE 'git status' END AS cmd FROM events)"""
CODE_FILES = """code_files AS (
  SELECT 'src/p' || p_partkey || '.py' AS path, p_partkey,
    'import os' || chr(10) || 'from mod' || (p_partkey % 9) || ' import x' || chr(10) || 'def f_' || p_partkey || '(x):' || chr(10) || '    return g_' || (p_partkey % 13) || '(x)' || chr(10) || 'class C_' || p_size || ':' || chr(10) || '    pass' AS content FROM part)"""
CONVO = """convo AS (
  SELECT conv_id, turn, role, 'We decided to use plan ' || turn || ' for file_' || conv_id || '.py' || chr(10) || '- keep item ' || turn || chr(10) || text AS text FROM conversations)"""
DIFF_LINES = """diff_lines AS (
  SELECT l_orderkey AS doc_id, pos, raw FROM (
    SELECT l_orderkey, 0 AS pos, 'diff --git a/f' || min(l_partkey) || ' b/f' || min(l_partkey) AS raw FROM lineitem GROUP BY 1
    UNION ALL SELECT DISTINCT l_orderkey, 1, '@@ -1,3 +1,3 @@' FROM lineitem
    UNION ALL SELECT l_orderkey, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice), CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END || 'line ' || l_linenumber || ' of ' || l_suppkey FROM lineitem))"""
TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)"
TF_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2 AND x NOT IN (" + ", ".join(q(w) for w in R.STOPWORDS) + "))"


def level(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(p)}) THEN {q(name)}" for name, p in R.LOG_LEVELS) + " ELSE 'info' END"


def timestamp(c: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {q(p)}, {g}), '')" for p, g in R.TIMESTAMPS) + ")"


def keyword_boost(c: str) -> str:
    return "least(1.0, " + " + ".join(f"CASE WHEN regexp_matches({c}, {q(p)}) THEN {w} ELSE 0 END" for w, p in R.KEYWORD_BOOST) + ")"


def greedy(items: str, budget: str) -> str:
    """Places p of a list of {p, c}, taken in its order while the costs c fit ``budget``; one that doesn't fit is skipped."""
    return f"list_reduce(list_transform({items}, lambda x: {{'used': CAST(x.c AS BIGINT), 'kept': [CAST(x.p AS BIGINT)]}}), lambda a, x: CASE WHEN a.used + x.used <= {budget} THEN {{'used': a.used + x.used, 'kept': list_concat(a.kept, x.kept)}} ELSE a END, {{'used': CAST(0 AS BIGINT), 'kept': []::BIGINT[]}}).kept"


def tokens(c: str) -> str:
    return f"CAST(ceil(length({c}) / 4.0) AS BIGINT)"
