"""DuckDB SQL for every registered query; the driver compares the rows."""

from __future__ import annotations

from contactrank.functions.schema import REASONS, WEIGHTS
from contactrank.functions.text import JS_WS, tokens_of
from contactrank.plans.adaptors import CONTACTS_SQL, FILE_ROWS, SEARCHES_SQL
from contactrank.plans.queries import QUERY

_FIELDS = "full_name, position, company, email, url, connected_on"


def _score(tokens: list[str], of: str = "c.") -> str:
    def one(t: str) -> str:
        return "CASE " + " ".join(f"WHEN contains(lower({of}{f}), '{t}') THEN {w}" for f, w in WEIGHTS.items()) + " ELSE 0 END"

    return "CAST(" + " + ".join(map(one, tokens)) + " AS INTEGER)"


def _field(token: str = "token") -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({f}), {token}) THEN {k}" for k, f in enumerate(WEIGHTS, 1)) + " END"


_WEIGHT_OF = "CASE f " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS.values(), 1)) + " ELSE 0 END"
_TOKENS = ", ".join(f"({k}, '{t}')" for k, t in enumerate(dict.fromkeys(tokens_of(QUERY))))
_LABELS = "CASE f " + " ".join(f"WHEN {k} THEN '{label}'" for k, label in enumerate(REASONS.values(), 1)) + " END"

_HITS = f"""
tok(pos, token) AS (VALUES {_TOKENS}),
hits AS (SELECT owner_id, row_ord, pos, token, {_field()} AS f FROM contacts, tok),
matched AS (SELECT owner_id, row_ord, coalesce(string_agg(token, '|' ORDER BY f, pos) FILTER (WHERE f IS NOT NULL), '') AS matched,
  string_agg(token, ', ' ORDER BY f, pos) FILTER (WHERE f IS NOT NULL) AS listed FROM hits GROUP BY ALL),
lines AS (SELECT owner_id, row_ord, f, {_LABELS} || ': ' || string_agg(token, ', ' ORDER BY pos) AS line FROM hits WHERE f <= 4 GROUP BY owner_id, row_ord, f),
own AS (SELECT owner_id, row_ord, string_agg(line, '|' ORDER BY f) AS own FROM lines GROUP BY ALL),
told AS (SELECT owner_id, row_ord, matched, coalesce(own, 'Matched: ' || listed, '') AS reasons FROM matched LEFT JOIN own USING (owner_id, row_ord))
"""

_BATCH = f"""
asked AS (SELECT search_id, owner_id, unnest(regexp_split_to_array(lower(criteria), '[{JS_WS},;]+')) AS token,
  generate_subscripts(regexp_split_to_array(lower(criteria), '[{JS_WS},;]+'), 1) AS pos FROM searches),
pair AS (SELECT search_id, c.*, token, pos, {_field()} AS f FROM asked JOIN contacts c USING (owner_id) WHERE token <> ''),
scored AS (SELECT search_id, owner_id, source_file, row_ord, CAST(sum({_WEIGHT_OF}) AS INTEGER) AS score FROM pair GROUP BY ALL HAVING sum({_WEIGHT_OF}) > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, source_file, row_ord) AS rank FROM scored QUALIFY rank <= 10),
distinct_hit AS (SELECT search_id, owner_id, row_ord, token, f, min(pos) AS pos FROM pair WHERE f IS NOT NULL GROUP BY ALL),
batch_matched AS (SELECT search_id, owner_id, row_ord, string_agg(token, '|' ORDER BY f, pos) AS matched, string_agg(token, ', ' ORDER BY f, pos) AS listed FROM distinct_hit GROUP BY ALL),
batch_lines AS (SELECT search_id, owner_id, row_ord, f, {_LABELS} || ': ' || string_agg(token, ', ' ORDER BY pos) AS line FROM distinct_hit WHERE f <= 4 GROUP BY search_id, owner_id, row_ord, f),
batch_own AS (SELECT search_id, owner_id, row_ord, string_agg(line, '|' ORDER BY f) FILTER (WHERE k <= 3) AS own FROM (SELECT *, row_number() OVER (PARTITION BY search_id, owner_id, row_ord ORDER BY f) AS k FROM batch_lines) GROUP BY ALL)
"""

_FILE = f"'contacts-' || owner_id || '-' || (row_ord // {FILE_ROWS}) || '.CSV'"
_NOTE = """'a, ' || notes || ' "x"' || chr(10) || '2nd'"""
_FULL = "split_part(full_name, '#', 1) || ' ' || split_part(full_name, '#', 2)"
_CSV_CELLS = [("First Name", "split_part(full_name, '#', 1)"), ("Last Name", "split_part(full_name, '#', 2)"), ("Position", "position"), ("Company", "company"), ("Email Address", "email"), ("URL", "url"), ("Connected On", "connected_on"), ("Notes", _NOTE), ("Full Name", _FULL)]
_EVENT_FILE = f"'events-' || (event_id // {FILE_ROWS}) || '.Json'"

_VALUATIONS = """
v AS (SELECT r_name AS fund, CAST(o_orderdate AS DATE) AS as_of, o_totalprice AS value, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def oracle_sql() -> dict[str, str]:
    contacts = _with(CONTACTS_SQL)
    return {
        "normalize_key": "SELECT p_partkey AS id, regexp_replace(lower(' ' || p_name || '_' || p_brand), '[^a-z0-9]+', '', 'g') AS normalized FROM part",
        "tokenize_query": f"""WITH t AS (SELECT doc_id, rowid AS r, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[{JS_WS},;]+')) AS token, generate_subscripts(regexp_split_to_array(lower(coalesce(text, '')), '[{JS_WS},;]+'), 1) AS pos FROM (SELECT *, row_number() OVER () AS rowid FROM documents))
            SELECT doc_id, count(*) FILTER (WHERE token <> '') AS n_tokens, md5(coalesce(string_agg(token, '|' ORDER BY pos) FILTER (WHERE token <> ''), '')) AS tokens_md5 FROM t GROUP BY r, doc_id""",
        "js_trim": "SELECT c_custkey, c_name || chr(133) AS trimmed FROM customer",
        "to_text": "SELECT event_id, event_type || '  ' || user_id AS array_text, replace(props, ': ', ':') AS object_text FROM events",
        "csv_parse": contacts + f"SELECT {_FILE} AS source_file, row_ord % {FILE_ROWS} AS row_ord, " + " || '|' || ".join(f"'{k}=' || {v}" for k, v in _CSV_CELLS) + " AS row_text FROM contacts",
        "csv_header_detect": contacts + f"SELECT DISTINCT {_FILE} AS source_file, '" + "|".join(k for k, _ in _CSV_CELLS) + "' AS header FROM contacts",
        "csv_records": contacts + " UNION ALL ".join(f"SELECT '{k}' AS col_name, count(*) AS n, CAST(sum(length({v})) AS BIGINT) AS chars FROM contacts" for k, v in _CSV_CELLS),
        "derive_full_name": contacts + f"SELECT {_FILE} AS source_file, row_ord % {FILE_ROWS} AS row_ord, {_FULL} AS full_name FROM contacts",
        "json_ingest": f"""SELECT {_EVENT_FILE} AS source_file, event_id % {FILE_ROWS} AS row_ord, 'Full Name=user ' || user_id || '|role=' || upper(event_type) || '|n=' || event_id
            || '|tags=' || event_type || '  true 2.5 1e+21|props=' || replace(props, ': ', ':') || '|none=' AS row_text FROM events""",
        "json_clean": f"""SELECT 'events-' || (event_id // {FILE_ROWS}) || '.json' AS source_file, event_id % {FILE_ROWS} AS row_ord, 'Full Name=user ' || user_id || '|role=' || event_type || '|n=' || event_id
            || '|share=2.5|tags=' || event_type || '  "é|props=' || replace(props, ': ', ':') || '|none=|new=true' AS row_text FROM events""",
        "csv_ranges": contacts + "SELECT owner_id, row_ord, " + " || '|' || ".join(f"'{k}=' || {v}" for k, v in _CSV_CELLS) + " AS row_text FROM contacts",
        "file_status": """SELECT 'file-' || c_custkey || CASE WHEN k IN (0, 1) THEN '.csv' WHEN k = 5 THEN '.txt' ELSE '.json' END AS source_file,
            CASE WHEN k IN (0, 2) THEN 'OK' ELSE 'ERROR' END AS status,
            CASE k WHEN 1 THEN 'No rows found in file.' WHEN 3 THEN 'JSON must be an array of objects.' WHEN 4 THEN 'Failed to parse file.' WHEN 6 THEN 'Failed to parse file.'
              WHEN 5 THEN 'Unsupported file type. Please upload a .csv or .json file.' END AS error,
            CAST(CASE k WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS row_count FROM (SELECT *, c_custkey % 7 AS k FROM customer)""",
        "resolve_fields": contacts + f"SELECT owner_id, {_FILE} AS source_file, row_ord % {FILE_ROWS} AS row_ord, {_FULL} AS full_name, position, company, email, url, connected_on, " + " || ' ' || ".join(v for _, v in _CSV_CELLS) + " AS all_text FROM contacts",
        "discover_columns": f"SELECT DISTINCT {_EVENT_FILE} AS source_file, CAST(position AS INTEGER) AS position, col_name FROM events, (VALUES (0, 'Full Name'), (1, 'role'), (2, 'n'), (3, 'tags'), (4, 'props'), (5, 'none')) AS x(position, col_name)",
        "load_stats": contacts + f"SELECT {_FILE} AS source_file, count(*) AS staged_rows, count(*) FILTER (WHERE CAST(owner_id AS INTEGER) % 2 = 0) AS confirmed_rows, CAST({len(_CSV_CELLS)} AS BIGINT) AS column_count FROM contacts GROUP BY 1",
        "discover_csv_columns": "SELECT 'years-' || n_nationkey || '.csv' AS source_file, CAST(position AS INTEGER) AS position, col_name FROM nation, (VALUES (0, '10'), (1, '2023'), (2, 'Name'), (3, '007'), (4, 'Note'), (5, '4294967295')) AS x(position, col_name)",
        "confirm_snapshot": contacts
        + """SELECT owner_id, source_file, row_ord, full_name, CASE WHEN owner_id = '7' THEN 'new' ELSE position END AS position,
            company, email, url, connected_on, all_text FROM contacts""",
        "revoke_snapshot": contacts
        + f"""SELECT owner_id, source_file, row_ord, {_FIELDS}, all_text FROM contacts WHERE owner_id NOT IN ('3', '4')
            UNION ALL SELECT owner_id, {_FILE}, row_ord % {FILE_ROWS}, {_FULL}, position, company, email, url, connected_on, """
        + " || ' ' || ".join(v for _, v in _CSV_CELLS)
        + " FROM contacts WHERE owner_id = '4'",
        "score_rows": contacts + f"SELECT owner_id, row_ord, {_score(tokens_of(QUERY))} AS score FROM contacts c",
        "matched_tokens": _with(CONTACTS_SQL, _HITS) + "SELECT owner_id, row_ord, matched FROM told",
        "match_reasons": _with(CONTACTS_SQL, _HITS) + "SELECT owner_id, row_ord, reasons FROM told",
        "search_topk": _with(CONTACTS_SQL, _HITS) + f"SELECT source_file, row_ord, {_FIELDS}, {_score(tokens_of(QUERY))} AS score, matched, reasons FROM contacts c JOIN told USING (owner_id, row_ord) WHERE score > 0 ORDER BY score DESC, source_file, row_ord LIMIT 10",
        "search_confirmed": _with(CONTACTS_SQL, _HITS) + f"SELECT source_file, row_ord, {_FIELDS}, {_score(tokens_of(QUERY))} AS score, matched, reasons FROM contacts c JOIN told USING (owner_id, row_ord) WHERE score > 0 AND owner_id = '7' ORDER BY score DESC, source_file, row_ord LIMIT 10",
        "upload_and_search": contacts
        + f""", c AS (SELECT owner_id, {_FILE} AS source_file, row_ord % {FILE_ROWS} AS row_ord, {_FULL} AS full_name, position, company, email, url, connected_on, """
        + " || ' ' || ".join(v for _, v in _CSV_CELLS)
        + f" AS all_text FROM contacts WHERE owner_id = '4') SELECT owner_id, source_file, row_ord, full_name, {_score(tokens_of(QUERY))} AS score FROM c WHERE score > 0 ORDER BY score DESC, source_file, row_ord LIMIT 10",
        "search_guard": _with(CONTACTS_SQL, SEARCHES_SQL) + f"SELECT search_id, len(list_filter(regexp_split_to_array(lower(criteria), '[{JS_WS},;]+'), lambda t: t <> '')) > 0 AND owner_id IN (SELECT owner_id FROM contacts WHERE CAST(owner_id AS INTEGER) % 3 = 0) AS runs FROM searches",
        "confirmed_pages": contacts
        + """, p(page, page_size) AS (VALUES (1, 25), (0, 100), (1000000, 50)), n AS (SELECT count(*) AS n FROM contacts WHERE owner_id = '7')
            SELECT source_file, row_ord, CASE WHEN full_name = '' THEN '(no name)' ELSE full_name END AS name, """
        + ", ".join(f"CASE WHEN {c} = '' THEN '—' ELSE {c} END AS {c}" for c in ("position", "company", "connected_on", "email", "url"))
        + ", CAST(page_size AS INTEGER) AS page_size FROM contacts, p, n WHERE owner_id = '7' AND row_ord // page_size = least(page, greatest(0, (n - 1) // page_size))",
        "batch_search": _with(CONTACTS_SQL, SEARCHES_SQL, _BATCH) + "SELECT search_id, CAST(rank AS INTEGER) AS rank, owner_id, row_ord, score, matched FROM best JOIN batch_matched USING (search_id, owner_id, row_ord)",
        "result_cards": _with(CONTACTS_SQL, SEARCHES_SQL, _BATCH)
        + """SELECT search_id, CAST(rank AS INTEGER) AS rank, CASE WHEN full_name = '' THEN '(no name)' ELSE full_name END AS name, concat_ws(' • ', nullif(position, ''), nullif(company, '')) AS subtitle,
            email, url, score, coalesce(own, 'Matched: ' || listed) AS reasons, matched AS tokens
            FROM best JOIN contacts USING (owner_id, source_file, row_ord) JOIN batch_matched USING (search_id, owner_id, row_ord) LEFT JOIN batch_own USING (search_id, owner_id, row_ord)""",
        "search_documents": "WITH c AS (SELECT source AS source_file, doc_id AS row_ord, '' AS full_name, coalesce(text, '') AS position, coalesce(lang, '') AS company, '' AS email, '' AS url, '' AS connected_on, '' AS all_text FROM documents) "
        + f"SELECT source_file, row_ord, {_score(tokens_of('en the of, tion; der'))} AS score FROM c WHERE score > 0 ORDER BY score DESC, source_file, row_ord LIMIT 10",
        "preview_page": contacts
        + """, n AS (SELECT source_file, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM contacts GROUP BY 1)
            SELECT source_file, row_ord, CASE WHEN full_name = '' THEN '(no name)' ELSE full_name END AS name, """
        + ", ".join(f"CASE WHEN {c} = '' THEN '—' ELSE {c} END AS {c}" for c in ("position", "company", "connected_on", "email", "url"))
        + " FROM contacts JOIN n USING (source_file) WHERE row_ord // 50 = least(1, pages - 1)",
        "page_stats": contacts + "SELECT source_file, count(*) AS row_count, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS page_count FROM contacts GROUP BY 1",
        "valuation_trend": _with(_VALUATIONS) + "SELECT CAST(CAST(date_trunc('month', as_of) AS DATE) AS VARCHAR) AS month, fund, round(sum(value), 2) AS value FROM v GROUP BY ALL",
        "aum_yoy": _with(_VALUATIONS) + ", t AS (SELECT CAST(year(as_of) AS INTEGER) AS year, sum(value) AS total FROM v GROUP BY 1) SELECT year, round(total, 2) AS total, round(100 * (total - lag(total) OVER (ORDER BY year)) / lag(total) OVER (ORDER BY year), 4) AS change_pct FROM t",
        "valuation_rollup": _with(_VALUATIONS) + "SELECT CAST(CAST(date_trunc('month', as_of) AS DATE) AS VARCHAR) AS month, fund, round(sum(value), 2) AS value FROM v GROUP BY ALL",
        "aum_rollup": _with(_VALUATIONS) + ", t AS (SELECT CAST(year(as_of) AS INTEGER) AS year, sum(value) AS total FROM v GROUP BY 1) SELECT year, round(total, 2) AS total, round(100 * (total - lag(total) OVER (ORDER BY year)) / lag(total) OVER (ORDER BY year), 4) AS change_pct FROM t",
        "activity_rollup": """WITH a AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'),
            f AS (SELECT c, min(month) AS month FROM a GROUP BY c)
            SELECT CAST(month AS VARCHAR) AS month, count(*) AS companies, (SELECT count(*) FROM f WHERE f.month <= a.month) AS companies_so_far FROM a GROUP BY a.month""",
        "active_portfolio": "SELECT count(DISTINCT c_custkey) AS companies, count(DISTINCT c_mktsegment) AS sectors FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
        "fund_deployment": _with(_VALUATIONS)
        + "SELECT fund, round(sum(value), 2) AS committed, round(coalesce(sum(value) FILTER (WHERE status = 'F'), 0), 2) AS called, round(100 * coalesce(sum(value) FILTER (WHERE status = 'F'), 0) / sum(value), 4) AS deployed_pct, round(sum(value) - coalesce(sum(value) FILTER (WHERE status = 'F'), 0), 2) AS dry_powder FROM v GROUP BY 1",
        "deal_funnel": "WITH s(position, stage) AS (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')), n AS (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1) SELECT CAST(position AS INTEGER) AS position, stage, coalesce(n, 0) AS n, CAST(ceil(100.0 * coalesce(n, 0) / max(n) FILTER (WHERE position = 0) OVER ()) AS BIGINT) AS pct FROM s LEFT JOIN n USING (stage)",
        "recent_calls": "SELECT o_orderkey AS call_id, c_name AS entity, o_totalprice AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS call_date, CASE o_orderstatus WHEN 'F' THEN 'FUNDED' WHEN 'O' THEN 'PENDING' ELSE 'OVERDUE' END AS status FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY call_date DESC, call_id LIMIT 3",
        "upcoming_meetings": "SELECT event_id AS meeting_id, event_type AS title, ts AS start_ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 3",
    }
