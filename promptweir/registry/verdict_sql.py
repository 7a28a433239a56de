"""SQL twins of verdict parsing.

Each takes the name of a relation with request_id, raw (and query) and defines its result.
"""

from __future__ import annotations

from promptweir.functions import text as tx
from promptweir.registry.inputs import q, sql_list
from promptweir.sources.lexicons import CATEGORIES, RESCUE_FRAGMENTS

_SPACES = " || ".join(f"chr({ord(c)})" for c in tx.SPACE_CHARS)


def strip(text: str) -> str:
    return f"trim({text}, {_SPACES})"


def strict(json: str) -> str:
    """Valid JSON; DuckDB alone would also take a trailing comma."""
    return f"(json_valid({json}) AND NOT regexp_matches({json}, ',\\s*[\\]}}]\\s*$'))"


def last(json: str, key: str) -> str:
    """Value of a key of an object, the last one where the object repeats the key."""
    keys = f"json_keys({json})"
    return f"json_extract({json}, '$.*')[len({keys}) + 1 - list_position(list_reverse({keys}), '{key}')]"


def last_text(json: str, key: str) -> str:
    return f"json_extract_string({last(json, key)}, '$')"


def greedy(text: str) -> str:
    return f"nullif(regexp_extract({text}, '(?s)\\{{.*\\}}'), '')"


def classifier_sql(source: str) -> str:
    contained = (
        f"list_filter({sql_list(CATEGORIES)}, lambda c: contains(c, cat) OR contains(cat, c))[1]")
    rescue = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(rname, {q(f)})" for f in fragments) + f" THEN {q(category)}"
        for fragments, category in RESCUE_FRAGMENTS) + " ELSE 'BUSINESS_PROFESSIONAL' END"
    return f"""
v1 AS (SELECT request_id, query, raw, {strip('raw')} AS t FROM {source}),
v2 AS (
  SELECT *, CASE WHEN contains(t, '<think>') AND contains(t, '</think>')
    THEN {strip("substring(t, strpos(t, '</think>') + 8)")} ELSE t END AS rest FROM v1),
v3 AS (SELECT *, coalesce(nullif(regexp_extract(rest, '\\{{[^}}]*\\}}'), ''), rest) AS j FROM v2),
v4 AS (SELECT * REPLACE (CASE WHEN {strict('j')} THEN j END AS j), {strict('j')} AS valid FROM v3),
v5 AS (
  SELECT *, CASE WHEN valid THEN json_type(j) END AS kind,
    CASE WHEN valid AND json_type(j) = 'OBJECT' THEN json_type({last('j', 'category')}) END AS ckind,
    CASE WHEN valid AND json_type(j) = 'OBJECT' THEN json_type({last('j', 'confidence')}) END AS fkind,
    upper(regexp_extract(t, '(?i)"category":\\s*"([^"]+)"', 1)) AS rname,
    regexp_extract(t, '"confidence":\\s*([0-9.]+)', 1) AS rtext FROM v4),
v6 AS (
  SELECT *, upper(coalesce(CASE WHEN ckind = 'VARCHAR' THEN {last_text('j', 'category')} END, '')) AS cat,
    CASE WHEN fkind IS NULL THEN 0.7 WHEN fkind = 'BOOLEAN' THEN CAST({last_text('j', 'confidence')} = 'true' AS INT)
      ELSE TRY_CAST({last_text('j', 'confidence')} AS DOUBLE) END AS conf,
    CASE WHEN rtext = '' THEN 0.7 ELSE TRY_CAST(rtext AS DOUBLE) END AS rconf FROM v5),
v7 AS (
  SELECT *, CASE
    WHEN valid AND (kind <> 'OBJECT' OR coalesce(ckind, 'VARCHAR') <> 'VARCHAR'
      OR coalesce(fkind, '') IN ('NULL', 'ARRAY', 'OBJECT')) THEN 'no_verdict'
    WHEN valid AND conf IS NOT NULL THEN 'ok'
    WHEN rname <> '' AND rconf IS NULL THEN 'no_verdict'
    WHEN rname <> '' THEN 'rescued'
    WHEN contains(lower(query), 'lawsuit') OR contains(lower(query), 'legal') THEN 'legal_default'
    ELSE 'no_verdict' END AS parse_status FROM v6),
verdict_result AS (
  SELECT request_id, parse_status, CASE parse_status
      WHEN 'ok' THEN CASE WHEN list_contains({sql_list(CATEGORIES)}, cat) THEN cat
        ELSE coalesce({contained}, 'BUSINESS_PROFESSIONAL') END
      WHEN 'rescued' THEN {rescue} WHEN 'legal_default' THEN 'BUSINESS_PROFESSIONAL' END AS verdict_category,
    CASE parse_status WHEN 'ok' THEN greatest(0.0, least(1.0, conf)) WHEN 'rescued' THEN rconf
      WHEN 'legal_default' THEN 0.8 END AS verdict_confidence FROM v7)"""


def light_sql(source: str) -> str:
    return f"""
l0 AS (SELECT request_id, raw, coalesce({greedy(strip('raw'))}, {strip('raw')}) AS j FROM {source}),
l1 AS (SELECT * REPLACE (CASE WHEN {strict('j')} THEN j END AS j) FROM l0),
l2 AS (
  SELECT *, json_type(j) AS kind,
    regexp_extract(raw, '"score":\\s*(\\d+)', 1) AS digits FROM l1),
l3 AS (
  SELECT *, CASE WHEN kind = 'OBJECT' AND json_exists(j, '$.score') AND json_exists(j, '$.justification') THEN 'ok'
    WHEN kind <> 'OBJECT' THEN 'error' WHEN digits <> '' THEN 'score_rescued' ELSE 'default' END AS parse_status FROM l2),
light_result AS (
  SELECT request_id, parse_status,
    CASE parse_status WHEN 'ok' THEN TRY_CAST({last_text('j', 'score')} AS DOUBLE)
      WHEN 'score_rescued' THEN CAST(digits AS DOUBLE) ELSE 3.0 END AS score,
    CASE WHEN parse_status = 'ok' THEN TRY_CAST({last_text('j', 'is_correct')} AS BOOLEAN) ELSE true END AS is_correct,
    CASE parse_status WHEN 'ok' THEN {last_text('j', 'justification')}
      WHEN 'score_rescued' THEN 'Manually extracted from response: ' || left(raw, 200)
      WHEN 'error' THEN 'Error in judging: ''' || CASE kind WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str'
        WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType'
        ELSE 'float' END || ''' object has no attribute ''get'''
      ELSE 'Could not parse judge response. Raw response: ' || left(raw, 200) END AS justification
  FROM l3)"""


def strict_judge_sql(source: str) -> str:
    keys = ("score", "accuracy", "completeness", "clarity", "is_correct", "justification")
    present = " AND ".join(f"json_exists(j, '$.{k}')" for k in keys)
    number = lambda k: f"CASE WHEN parse_status = 'ok' THEN TRY_CAST({last_text('j', k)} AS DOUBLE) END AS {k}"
    cleaned = strip("regexp_replace(" + strip("raw") + ", '(?s)<think>.*?</think>', '', 'g')")
    return f"""
s1 AS (SELECT request_id, model_id, {greedy(cleaned)} AS j FROM {source}),
s2 AS (
  SELECT *, CASE WHEN j IS NULL THEN 'no_json' WHEN NOT {strict('j')} THEN 'bad_json'
    WHEN NOT ({present}) THEN 'missing_keys' ELSE 'ok' END AS parse_status FROM s1),
judge_result AS (
  SELECT request_id, model_id, parse_status, {', '.join(map(number, keys[:4]))},
    CASE WHEN parse_status = 'ok' THEN TRY_CAST({last_text('j', 'is_correct')} AS BOOLEAN) END AS is_correct,
    CASE WHEN parse_status = 'ok' THEN {last_text('j', 'justification')} END AS justification FROM s2)"""


def legacy_judge_sql(source: str) -> str:
    return f"""
g1 AS (SELECT request_id, raw, {strict('raw')} AS valid FROM {source}),
g2 AS (SELECT *, CASE WHEN valid AND json_type(raw) = 'OBJECT' THEN raw ELSE '{{}}' END AS j FROM g1),
legacy_result AS (
  SELECT request_id, CASE WHEN valid THEN 'ok' ELSE 'default' END AS parse_status,
    CASE WHEN valid THEN TRY_CAST({last_text('j', 'score')} AS DOUBLE) ELSE 3.0 END AS score,
    CASE WHEN valid THEN TRY_CAST({last_text('j', 'is_correct')} AS BOOLEAN) ELSE true END AS is_correct,
    CASE WHEN valid THEN {last_text('j', 'justification')}
      ELSE 'Could not parse judge response' END AS justification FROM g2)"""


def clean_answer_sql(raw: str) -> str:
    block = f"regexp_extract({raw}, '(?s)<think>.*?</think>')"
    return strip(f"""CASE WHEN {block} <> '' THEN replace({raw}, {block}, '')
    WHEN contains({raw}, '<think>') THEN replace({raw}, '<think>', '')
    WHEN contains({raw}, 'Answer:') THEN substring({raw}, strpos({raw}, 'Answer:') + 7) ELSE {raw} END""")
