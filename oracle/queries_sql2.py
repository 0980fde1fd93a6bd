"""DuckDB SQL for joins, sampling, linearization, request accounting and gather."""

from __future__ import annotations

from oracle.fixtures_sql import CTES, NA_TOKENS, VOCAB, cte, with_fixtures as W
from oracle.queries_sql import SQL, joined, numeric_ok

SEED_ROWS = 20260311
SEED_SHUFFLE = 20260312
SEED_EXAMPLES = 20260313
SEED_PREP = 20260314
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def h(seed: int, *parts: str) -> str:
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5({inner}), 1, 8))::BIGINT"


def csvf(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN contains({x}, ',') OR contains({x}, '\"') OR contains({x}, chr(10))"
            f" OR contains({x}, chr(13)) THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END")


def jstr(x: str) -> str:
    """Python-style JSON string literal (ASCII escapes)."""
    per_char = (f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE "
                "WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' "
                "WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' "
                "WHEN c = chr(12) THEN '\\f' "
                "WHEN unicode(c) > 65535 THEN '\\u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10)) "
                "|| '\\u' || printf('%04x', 56320 + ((unicode(c) - 65536) % 1024)) "
                "WHEN unicode(c) < 32 OR unicode(c) > 126 THEN '\\u' || printf('%04x', unicode(c)) ELSE c END), '')")
    return (f"CASE WHEN {x} IS NULL THEN 'null' WHEN regexp_matches({x}, '[^\\x20-\\x7e]') "
            f"THEN '\"' || {per_char} || '\"' "
            f"ELSE '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' END")


def num(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'null' WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"
            f" ELSE CAST({x} AS VARCHAR) END")


def tokens(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{TOKEN_RE}')), 0)"


# --- extra fixtures -----------------------------------------------------------------------

EXP = ("'corpus_' || CAST(table_id % 3 AS VARCHAR)",
       "CASE WHEN table_id % 2 = 0 THEN 'gpt-3.5-turbo-1106' ELSE 'gpt-4-0613' END || "
       "CASE WHEN table_id % 4 < 2 THEN '-with-headers' ELSE '-without-headers' END")

cte("fx_names", ("fx_tables",), """
  SELECT table_id, CASE WHEN table_id % 17 = 0 THEN '' ELSE 'orders_' || CAST(table_id AS VARCHAR) END AS table_name,
         list_transform(range(n_cols), lambda k: 'c' || CAST(k AS VARCHAR)) AS headers
  FROM fx_tables""")

cte("fx_sampled", ("fx_rows",), f"""
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY {h(SEED_ROWS, 'table_id', 'row_idx')}, row_idx)
                   AS INTEGER) AS sample_rank
    FROM fx_rows) WHERE sample_rank <= 3""")

cte("fx_models", (), """
  SELECT * FROM (VALUES ('gpt-3.5-turbo-1106', 10000, 2000000, 0.001, 0.002, 16385, 4096),
                        ('gpt-4-0613', 10000, 300000, 0.03, 0.06, 8192, NULL))
    AS m(model, max_rpm, max_tpm, cost_per_1k_input, cost_per_1k_output, max_context, max_output_tokens)""")

cte("fx_requests", (), """
  SELECT conv_id AS request_id,
         CASE WHEN conv_id % 2 = 0 THEN 'gpt-3.5-turbo-1106' ELSE 'gpt-4-0613' END AS model,
         CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 50 + conv_id % 200 END AS max_tokens,
         CASE WHEN conv_id % 13 = 0 THEN 1.0 ELSE 0.0 END AS temperature,
         CASE WHEN conv_id % 11 = 0 THEN NULL ELSE 42 END AS seed,
         CASE WHEN conv_id % 7 = 0 THEN 2 END AS n,
         CASE WHEN conv_id % 21 = 0 THEN 3 END AS best_of,
         list({'role': role, 'content': text} ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id""")

cte("fx_req_doc", ("fx_requests",), f"""
  SELECT *, sha256(request_json) AS request_hash FROM (
    SELECT *, '{{"model": ' || {jstr('model')} || ', "max_tokens": ' || {num('max_tokens')}
              || ', "temperature": ' || {num('temperature')} || ', "messages": ['
              || array_to_string(list_transform(messages, lambda m: '{{"role": ' || {jstr('m.role')}
                                 || ', "content": ' || {jstr('m.content')} || '}}'), ', ') || ']'
              || CASE WHEN seed IS NOT NULL THEN ', "seed": ' || {num('seed')} ELSE '' END
              || CASE WHEN n IS NOT NULL THEN ', "n": ' || {num('n')} ELSE '' END
              || CASE WHEN best_of IS NOT NULL THEN ', "best_of": ' || {num('best_of')} ELSE '' END
              || '}}' AS request_json
    FROM fx_requests)""")

_RESP = ("'{\"choices\": [{\"message\": {\"content\": \"cached\"}, \"finish_reason\": \"stop\"}], "
         "\"usage\": {\"total_tokens\": ' || CAST(request_id AS VARCHAR) || '}}'")
cte("fx_cache", ("fx_req_doc",), f"""
  SELECT request_id * 10 AS entry_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(request_id) AS cached_at,
         request_hash, request_json, {_RESP} AS response_json FROM fx_req_doc WHERE request_id % 3 = 0
  UNION ALL
  SELECT request_id * 10 + 1, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(request_id) + INTERVAL 1 HOUR,
         request_hash, request_json, {_RESP} FROM fx_req_doc WHERE request_id % 6 = 0
  UNION ALL
  SELECT request_id * 10 + 2, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(request_id) - INTERVAL 1 HOUR,
         request_hash, request_json || ' ', {_RESP} FROM fx_req_doc WHERE request_id % 9 = 0""")

cte("fx_lookup", ("fx_req_doc", "fx_cache"), """
  SELECT r.request_id, coalesce(e.request_json IS NOT NULL AND e.request_json = r.request_json, false) AS cached,
         CASE WHEN e.request_json = r.request_json THEN e.response_json END AS cached_response
  FROM fx_req_doc r LEFT JOIN (SELECT request_hash, arg_min(request_json, cached_at) AS request_json,
                                      arg_min(response_json, cached_at) AS response_json
                               FROM fx_cache GROUP BY request_hash) e USING (request_hash)""")

cte("fx_usage", ("fx_requests", "fx_models"), f"""
  SELECT *, input_usage + output_usage AS max_total_usage,
         input_usage * (cost_per_1k_input / 1000) + output_usage * (cost_per_1k_output / 1000) AS max_cost
  FROM (
    SELECT *, coalesce(best_of, n, 1) * input_tokens AS input_usage, coalesce(best_of, n, 1) * max_output AS output_usage
    FROM (
      SELECT *, coalesce(max_tokens, CASE WHEN max_output_tokens IS NOT NULL
                                               AND max_output_tokens < greatest(0, max_context - input_tokens)
                                          THEN max_output_tokens ELSE greatest(0, max_context - input_tokens) END)
                AS max_output
      FROM (SELECT r.*, m.* EXCLUDE (model),
                   CAST(list_sum(list_transform(r.messages, lambda x: {tokens('x.content')} + 10)) AS BIGINT)
                     AS input_tokens
            FROM fx_requests r LEFT JOIN fx_models m USING (model))))""")

cte("fx_actual", ("fx_responses", "fx_models"), """
  SELECT request_id, ok, CASE WHEN ok THEN total_tokens ELSE 0 END AS usage,
         CASE WHEN ok THEN coalesce(prompt_tokens * (cost_per_1k_input / 1000), 0.0)
                           + coalesce(completion_tokens * (cost_per_1k_output / 1000), 0.0) ELSE 0.0 END AS cost
  FROM (SELECT request_id, json_extract(body, '$.choices') IS NOT NULL AS ok,
               json_extract_string(body, '$.model') AS model,
               CAST(json_extract_string(body, '$.usage.total_tokens') AS BIGINT) AS total_tokens,
               CAST(json_extract_string(body, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens,
               CAST(json_extract_string(body, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens
        FROM fx_responses) LEFT JOIN fx_models USING (model)""")

cte("fx_meta", ("fx_columns",), """
  SELECT k AS file_key, kind, header, column_type FROM (
    SELECT DISTINCT header, column_type,
           CASE WHEN data_type = 'numerical' THEN 'numerical_cols' ELSE 'textual_cols' END AS kind
    FROM fx_columns WHERE column_type IS NOT NULL), (SELECT unnest(['/en/', '/fr/', '/de/', '/e']) AS k)
  UNION ALL SELECT '/fr/', 'numerical_cols', 'c1', 'quantity'""")

cte("fx_match", (), """
  SELECT p.page_id, coalesce(m.n, 0) AS n_matches, CASE WHEN m.n = 1 THEN m.k END AS file_key,
         CASE WHEN m.n = 1 THEN 'ok' WHEN m.n IS NULL THEN 'no match' ELSE 'ambiguous' END AS status
  FROM pages p LEFT JOIN (
    SELECT page_id, count(*) AS n, min(k) AS k
    FROM pages, (SELECT unnest(['/en/', '/fr/', '/de/', '/e']) AS k) WHERE contains(url, k) GROUP BY page_id) m
  USING (page_id)""")

cte("fx_indexed", ("fx_columns",), f"""
  SELECT table_id, CAST(row_number() OVER (ORDER BY {h(SEED_SHUFFLE, 'table_id')}, table_id) - 1 AS BIGINT) AS ix
  FROM (SELECT table_id FROM fx_columns GROUP BY table_id HAVING count(column_type) > 0)""")


def examples_sql(k: int) -> str:
    return f"""
  SELECT s.table_id, j, p.table_id AS example_id
  FROM (SELECT table_id, ix, unnest(range({k})) AS j,
               {h(SEED_EXAMPLES, 'table_id')} AS hh, (SELECT count(*) FROM fx_indexed) AS n
        FROM fx_indexed) s
  JOIN fx_indexed p ON p.ix = (s.ix + 1 + (s.hh + s.j) % (s.n - 1)) % s.n"""


cte("fx_examples1", ("fx_indexed",), examples_sql(1))

# grouped reports (per dataset and experiment)
cte("fx_pairs_g", ("fx_pairs",), f"SELECT *, {EXP[0]} AS dataset, {EXP[1]} AS exp_name FROM fx_pairs")


def _grouped(sql: str) -> str:
    return (sql.replace("fx_pairs", "fx_pairs_g").replace("fx_keyed", "fx_keyed_g")
               .replace("fx_label_counts", "fx_label_counts_g").replace("fx_label_rows", "fx_label_rows_g")
               .replace("SELECT mode,", "SELECT mode, dataset, exp_name,")
               .replace("GROUP BY mode,", "GROUP BY mode, dataset, exp_name,"))


cte("fx_keyed_g", ("fx_pairs_g",), _grouped(CTES["fx_keyed"][1]))
cte("fx_label_counts_g", ("fx_keyed_g",), _grouped(CTES["fx_label_counts"][1]))
cte("fx_label_rows_g", ("fx_label_counts_g", "fx_vocabulary"), """
  SELECT mode, dataset, exp_name, slice, slice_value, label, support, predicted, tp,
         coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp / nullif(support, 0), 0.0) AS recall,
         coalesce(2.0 * tp / nullif(predicted + support, 0), 0.0) AS f1
  FROM (
    SELECT m.mode, m.dataset, m.exp_name, m.slice, m.slice_value, v.column_type AS label,
           coalesce(c.support, 0) AS support, coalesce(c.predicted, 0) AS predicted, coalesce(c.tp, 0) AS tp
    FROM fx_vocabulary v
    CROSS JOIN (SELECT DISTINCT mode, dataset, exp_name, slice, slice_value FROM fx_label_counts_g) m
    LEFT JOIN fx_label_counts_g c ON c.mode = m.mode AND c.dataset = m.dataset AND c.exp_name = m.exp_name
      AND c.slice = m.slice AND c.slice_value IS NOT DISTINCT FROM m.slice_value AND c.label = v.column_type)""")
cte("fx_report_g", ("fx_label_rows_g", "fx_label_counts_g", "fx_vocabulary"),
    CTES["fx_report"][1].replace("fx_label_rows", "fx_label_rows_g").replace("fx_label_counts", "fx_label_counts_g")
    .replace("SELECT mode, slice, slice_value, label, round", "SELECT mode, dataset, exp_name, slice, slice_value, label, round")
    .replace("round(precision, 6) AS ", "").replace("round(recall, 6) AS ", "").replace("round(f1, 6) AS ", "")
    .replace("SELECT mode, slice, slice_value, label, precision", "SELECT mode, dataset, exp_name, slice, slice_value, label, precision")
    .replace("SELECT e.mode, e.slice", "SELECT e.mode, e.dataset, e.exp_name, e.slice")
    .replace("SELECT mode, slice, slice_value, sum(support)", "SELECT mode, dataset, exp_name, slice, slice_value, sum(support)")
    .replace("SELECT mode, slice, slice_value, sum(precision)", "SELECT mode, dataset, exp_name, slice, slice_value, sum(precision)")
    .replace("USING (mode, slice, slice_value)", "USING (mode, dataset, exp_name, slice, slice_value)"))
cte("fx_wf1", ("fx_report_g",), """
  SELECT dataset, exp_name, slice, slice_value, f1 AS wf1 FROM fx_report_g
  WHERE mode = 'padded' AND label = 'weighted avg'""")

# --- schema shaping ----------------------------------------------------------------------

SQL["drop_index_column"] = W("""
SELECT table_id, row_idx, CAST(len(c) AS INTEGER) AS n_cells, c[1] AS first_cell
FROM (SELECT table_id, row_idx, CASE WHEN table_id % 3 = 0 THEN cells[2:] ELSE cells END AS c FROM fx_rows)""",
                             "fx_rows")

SQL["anonymize_headers"] = W("SELECT table_id, col_idx, 'empty' AS header FROM fx_columns", "fx_columns")

SQL["drop_unannotated_tables"] = W("""
SELECT table_id, col_idx, column_type FROM fx_columns
WHERE table_id IN (SELECT table_id FROM fx_columns GROUP BY table_id HAVING count(column_type) > 0)""", "fx_columns")

SQL["drop_unspecified_columns"] = W(f"""
SELECT r.table_id, r.row_idx, {joined('list_filter(r.cells, lambda x, i: i.true_types[i] IS NOT NULL)'.replace('i.true_types', 'true_types'))} AS cells,
       {joined('list_filter(true_types, lambda x: x IS NOT NULL)')} AS labels
FROM fx_rows r JOIN fx_instances i USING (table_id)""", "fx_rows", "fx_instances")

SQL["stringify_unspecified"] = W(f"""
SELECT table_id, {joined("list_transform(true_types, lambda x: coalesce(x, 'unspecified'))")} AS labels
FROM fx_instances""", "fx_instances")

SQL["strip_header_flag"] = W(f"""
SELECT DISTINCT exp_name, replace(replace(exp_name, '-with-headers', ''), '-without-headers', '') AS base_name,
       CASE WHEN contains(exp_name, 'with-headers') THEN 'with' WHEN contains(exp_name, 'without-headers') THEN 'w/out'
            ELSE 'error' END AS headers
FROM (SELECT {EXP[1]} AS exp_name FROM fx_evaluated)""", "fx_evaluated")

# --- joins ---------------------------------------------------------------------------------

SQL["annotate_columns"] = W("""
SELECT c.table_id, c.col_idx, c.header, g.label AS column_type, coalesce(g.n, 0) AS n_labels
FROM fx_columns c LEFT JOIN (SELECT table_id, target_column, min(annotation_label) AS label, count(*) AS n
                             FROM fx_gt GROUP BY ALL) g
  ON g.table_id = CAST(c.table_id AS VARCHAR) || '_dbpedia' AND g.target_column = c.col_idx""",
                            "fx_columns", "fx_gt")

SQL["annotation_conflicts"] = W("""
SELECT table_id, target_column, count(*) AS n_labels FROM fx_gt GROUP BY ALL HAVING count(*) > 1""", "fx_gt")

SQL["metadata_substring_match"] = W("SELECT * FROM fx_match", "fx_match")

SQL["scan_nested_metadata"] = W("SELECT * FROM fx_meta", "fx_meta")

SQL["header_type_lookup"] = W("""
SELECT c.table_id, c.col_idx, u.file_key, m.column_type, m.kind, coalesce(u.status, 'no match') AS status
FROM (SELECT table_id, col_idx, header, table_id % (SELECT count(*) FROM pages) AS page_id FROM fx_columns) c
LEFT JOIN (SELECT page_id, file_key, status FROM fx_match) u USING (page_id)
LEFT JOIN (SELECT file_key, header,
                  arg_max(column_type, CASE WHEN kind = 'numerical_cols' THEN 1 ELSE 0 END) AS column_type,
                  arg_max(kind, CASE WHEN kind = 'numerical_cols' THEN 1 ELSE 0 END) AS kind
           FROM fx_meta GROUP BY ALL) m ON m.file_key = u.file_key AND m.header = c.header""",
                              "fx_columns", "fx_match", "fx_meta")

SQL["type_to_datatype_lookup"] = W("""
SELECT column_type, CASE WHEN bool_or(kind = 'numerical_cols' OR column_type IS NULL) THEN 'numerical' ELSE 'non-numerical' END AS data_type
FROM (SELECT column_type, kind FROM fx_meta UNION ALL SELECT NULL, NULL) GROUP BY column_type""", "fx_meta")

SQL["request_hash"] = W("SELECT request_id, request_hash FROM fx_req_doc", "fx_req_doc")

SQL["cached_response_lookup"] = W("""
SELECT request_id, cached, CAST(json_extract_string(cached_response, '$.usage.total_tokens') AS BIGINT) AS cached_tokens
FROM fx_lookup""", "fx_lookup")

SQL["pending_requests"] = W("SELECT request_id FROM fx_lookup WHERE NOT cached", "fx_lookup")

SQL["pair_request_response"] = W("""
SELECT coalesce(q.id, s.id) AS request_id,
       CASE WHEN q.id IS NOT NULL AND s.id IS NOT NULL THEN 'paired' WHEN q.id IS NOT NULL THEN 'no response'
            ELSE 'no request' END AS status
FROM (SELECT table_id AS id FROM fx_tables) q
FULL OUTER JOIN (SELECT request_id AS id FROM fx_responses WHERE json_extract(body, '$.choices') IS NOT NULL) s
  ON q.id = s.id""", "fx_tables", "fx_responses")

cte("mt_copies", ("fx_rows",), """
  SELECT 't' AS side, table_id, row_idx, CASE WHEN table_id % 14 = 0 AND row_idx = 0 THEN list_concat(['changed'], cells[2:])
                                             WHEN table_id % 22 = 0 THEN list_concat(['+00' || cells[1]], cells[2:]) ELSE cells END AS cells,
         NULL AS path
  FROM fx_rows WHERE table_id % 2 = 0
  UNION ALL SELECT 's', table_id, row_idx, cells, 'a/' || CAST(table_id AS VARCHAR) || '.csv' FROM fx_rows
  UNION ALL SELECT 's', table_id, row_idx, cells, 'b/' || CAST(table_id AS VARCHAR) || '.csv' FROM fx_rows
            WHERE table_id % 10 = 0""")
cte("mt_ct", ("mt_copies",), f"""
  SELECT side, table_id, path, array_to_string(list(data_type ORDER BY col_idx), ',') AS t
  FROM (SELECT side, table_id, path, k AS col_idx,
               CASE WHEN bool_and(ok) THEN 'numerical' ELSE 'non-numerical' END AS data_type
        FROM (SELECT side, table_id, path, unnest(range(len(cells))) AS k, unnest(cells) AS v FROM mt_copies)
        CROSS JOIN LATERAL (SELECT {numeric_ok('v')} AS ok)
        GROUP BY side, table_id, path, k)
  GROUP BY side, table_id, path""")
cte("mt_fp", ("mt_copies",), """
  SELECT side, table_id, path, count(*) AS n_rows, max(len(cells)) AS n_cols,
         list(list_transform(cells, lambda x: CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE x END)
              ORDER BY row_idx) AS content
  FROM mt_copies GROUP BY side, table_id, path""")
cte("mt_fp2", ("mt_fp", "mt_ct"), """
  SELECT f.side, f.table_id, f.path, f.n_rows, f.n_cols, sha256(CAST(f.content AS VARCHAR) || '|' || c.t) AS fp
  FROM mt_fp f JOIN mt_ct c ON c.side = f.side AND c.table_id = f.table_id AND c.path IS NOT DISTINCT FROM f.path""")

SQL["match_tables_by_content"] = W("""
SELECT t.table_id AS target_id, arg_min(s.table_id, s.path) AS source_id, min(s.path) AS source_path
FROM mt_fp2 t JOIN mt_fp2 s ON t.side = 't' AND s.side = 's' AND t.n_rows = s.n_rows AND t.n_cols = s.n_cols AND t.fp = s.fp
GROUP BY t.table_id""", "mt_fp2")

SQL["sample_examples"] = W("SELECT * FROM fx_examples1", "fx_examples1")
SQL["self_excluding_example_pairs"] = W(examples_sql(3), "fx_indexed")

SQL["discover_experiments"] = W(f"SELECT DISTINCT {EXP[0]} AS dataset, {EXP[1]} AS exp_name FROM fx_evaluated",
                                "fx_evaluated")

SQL["label_vocabulary"] = W("SELECT DISTINCT column_type FROM fx_columns WHERE column_type IS NOT NULL", "fx_columns")

SQL["vocabulary_by_data_type"] = W(f"""
SELECT data_type, {joined('list_sort(list(DISTINCT column_type))')} AS labels
FROM fx_columns WHERE column_type IS NOT NULL GROUP BY data_type""", "fx_columns")

SQL["vocabulary_union"] = W("""
SELECT DISTINCT column_type FROM (SELECT column_type FROM fx_meta UNION ALL SELECT column_type FROM fx_columns)
WHERE column_type IS NOT NULL""", "fx_meta", "fx_columns")

SQL["vocabulary_difference"] = W(f"""
SELECT table_id, {joined(f'list_filter(list_sort({VOCAB}), lambda v: NOT list_contains(true_types, v))')} AS remaining
FROM fx_instances""", "fx_instances")

SQL["corpus_concat"] = W("""
SELECT 'corpus_' || CAST(table_id % 3 AS VARCHAR) || '/' || CAST(table_id AS VARCHAR) || '.csv' AS path,
       'corpus_' || CAST(table_id % 3 AS VARCHAR) AS tag
FROM fx_tables""", "fx_tables")

# --- sampling and ordering -------------------------------------------------------------------

SQL["shuffle_limit_reindex"] = W(f"""
SELECT table_id, CAST(row_number() OVER (ORDER BY hh, table_id) - 1 AS BIGINT) AS ix
FROM (SELECT table_id, {h(SEED_SHUFFLE, 'table_id')} AS hh
      FROM (SELECT table_id FROM fx_columns GROUP BY table_id HAVING count(column_type) > 0)
      ORDER BY hh, table_id LIMIT 500)""", "fx_columns")

SQL["aligned_shuffle"] = W(f"""
SELECT table_id, {joined('list(t ORDER BY hh, i)')} AS true_types, {joined('list(d ORDER BY hh, i)')} AS data_types
FROM (SELECT table_id, t, d, i, {h(SEED_SHUFFLE, 'table_id', 'i')} AS hh
      FROM (SELECT table_id, unnest(true_types) AS t, unnest(data_types) AS d,
                   unnest(range(len(true_types))) AS i FROM fx_instances))
GROUP BY table_id""", "fx_instances")

SQL["sample_rows"] = W("SELECT table_id, row_idx, sample_rank FROM fx_sampled", "fx_sampled")

SQL["sample_rows_aligned"] = W("""
SELECT table_id, col_idx, row_idx, text FROM (
  SELECT table_id, row_idx, CAST(unnest(range(len(cells))) AS INTEGER) AS col_idx, unnest(cells) AS text
  FROM fx_rows WHERE (table_id, row_idx) IN (SELECT (table_id, row_idx) FROM fx_sampled))
WHERE text IS NOT NULL""", "fx_rows", "fx_sampled")

SQL["sample_columns"] = W(f"""
SELECT table_id, array_to_string(kept, ',') AS kept_cols,
       {joined('list_transform(kept, lambda i: true_types[i + 1])')} AS true_types
FROM (SELECT table_id, true_types,
             CASE WHEN len(true_types) > 5
                  THEN list_sort(list_transform(list_sort(list_transform(range(len(true_types)),
                         lambda i: {{'hh': {h(SEED_PREP, 'table_id', 'i')}, 'i': i}}))[1:5], lambda e: e.i))
                  ELSE range(len(true_types)) END AS kept
      FROM fx_instances)""", "fx_instances")

STEPS = "[2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857]"


def candidates_sql(own_sql: str, size: int) -> str:
    """(table_id, candidates) from (table_id, own): entries in the order of the walk that aren't own ones."""
    return f"""
  SELECT table_id, list_sort(list_concat(own, list_filter(walk, lambda v: NOT list_contains(own, v))[1:greatest({size} - len(own), 0)])) AS candidates
  FROM (SELECT table_id, own, list_transform(range(len(vocab)), lambda i:
               vocab[CAST((start + i * step) % len(vocab) AS INTEGER) + 1]) AS walk
        FROM (SELECT *, list_sort({VOCAB}) AS vocab, {h(SEED_PREP, "'start'", 'table_id')} AS start,
                     {STEPS}[{h(SEED_PREP, "'step'", 'table_id')} % 8 + 1] AS step FROM ({own_sql})))"""


SQL["candidate_vocabulary"] = W(f"""
SELECT table_id, {joined('list_sort(list_distinct(list_concat(own, drawn)))')} AS candidates
FROM (
  SELECT table_id, own,
         list_transform(list_sort(list_transform(list_filter(list_sort({VOCAB}), lambda v: NOT list_contains(own, v)),
                                                 lambda x: {{'hh': {h(SEED_PREP, 'table_id', 'x')}, 'x': x}}))
                        [1:greatest(10 - len(own), 0)], lambda e: e.x) AS drawn
  FROM (SELECT i.table_id, list_distinct(list_filter(list_concat(i.true_types, coalesce(x.true_types, [])),
                                                     lambda v: v IS NOT NULL)) AS own
        FROM fx_instances i LEFT JOIN fx_examples1 e USING (table_id)
        LEFT JOIN fx_instances x ON x.table_id = e.example_id))""", "fx_instances", "fx_examples1")

SQL["largest_requests_first"] = W("""
SELECT request_id, max_total_usage,
       CAST(row_number() OVER (ORDER BY max_total_usage DESC, request_id) - 1 AS BIGINT) AS exec_order
FROM fx_usage""", "fx_usage")

SQL["cache_retention"] = W("""
SELECT entry_id, age_rank, age_rank >= 100000 AS evict FROM (
  SELECT entry_id, CAST(row_number() OVER (ORDER BY cached_at DESC, request_hash, entry_id) - 1 AS BIGINT) AS age_rank
  FROM fx_cache)""", "fx_cache")

cte("rb_log", (), """
  SELECT event_id AS request_id, ts AS started_at,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts + to_seconds(event_id % 40) END AS finished_at,
         event_id % 500 AS tokens,
         CASE WHEN user_id % 2 = 0 THEN 'gpt-3.5-turbo-1106' ELSE 'gpt-4-0613' END AS model
  FROM events""")
SQL["rolling_request_budget"] = W("""
SELECT r.request_id, count(q.request_id) AS n_relevant, CAST(coalesce(sum(q.tokens), 0) AS BIGINT) AS tokens_relevant,
       count(q.request_id) > any_value(m.max_rpm) * 0.3 AS over_rpm,
       coalesce(sum(q.tokens), 0) > any_value(m.max_tpm) * 0.3 AS over_tpm
FROM rb_log r JOIN fx_models m USING (model)
LEFT JOIN rb_log q ON (q.started_at < r.started_at OR (q.started_at = r.started_at AND q.request_id < r.request_id))
               AND (q.finished_at IS NULL OR q.finished_at + INTERVAL 70 SECOND >= r.started_at)
GROUP BY r.request_id""", "fx_models", "rb_log")

SQL["f1_ranking"] = W("""
SELECT dataset, exp_name, label, round(f1, 6) AS f1,
       row_number() OVER (PARTITION BY dataset, exp_name ORDER BY f1 DESC, label) AS rank
FROM fx_report_g WHERE mode = 'padded' AND slice = 'all'
  AND label NOT IN ('macro avg', 'weighted avg', 'micro avg', 'accuracy')""", "fx_report_g")


def series(slice_: str) -> str:
    return W(f"""
SELECT dataset, exp_name, CAST(slice_value AS DOUBLE) AS x, round(wf1, 6) AS wf1,
       row_number() OVER (PARTITION BY dataset, exp_name ORDER BY CAST(slice_value AS DOUBLE)) AS pos
FROM fx_wf1 WHERE slice = '{slice_}'""", "fx_wf1")


SQL["metric_series"] = series("idx")
SQL["f1_by_num_columns"] = series("num_columns")
SQL["f1_by_sparsity"] = series("sparsity")

SQL["round_score"] = W("SELECT dataset, exp_name, round(wf1, 2) AS wf1 FROM fx_wf1 WHERE slice = 'all'", "fx_wf1")

_DS = ("corpus_0", "corpus_1", "corpus_2")
SQL["main_results_pivot"] = W("""
SELECT base_name, """ + ", ".join(
    f"max(CASE WHEN dataset = '{d}' AND headers = '{hh}' THEN round(wf1, 2) END) AS {d}_{'with' if hh == 'with' else 'wout'}"
    for d in _DS for hh in ("with", "w/out")) + """
FROM (SELECT dataset, wf1, replace(replace(exp_name, '-with-headers', ''), '-without-headers', '') AS base_name,
             CASE WHEN contains(exp_name, 'with-headers') THEN 'with' WHEN contains(exp_name, 'without-headers')
                  THEN 'w/out' ELSE 'error' END AS headers
      FROM fx_wf1 WHERE slice = 'all')
GROUP BY base_name""", "fx_wf1")

SQL["data_type_pivot"] = W("""
SELECT exp_name, """ + ", ".join(
    f"max(CASE WHEN dataset = '{d}' AND kind = '{k}' THEN round(wf1, 2) END) AS {d}_{k}"
    for d in _DS for k in ("nonnum", "num")) + """
FROM (SELECT dataset, exp_name, wf1, CASE WHEN slice_value = 'numerical' THEN 'num' ELSE 'nonnum' END AS kind
      FROM fx_wf1 WHERE slice = 'data_type')
GROUP BY exp_name""", "fx_wf1")

# --- linearization ---------------------------------------------------------------------------

_LINE = f"array_to_string(list_transform(cells, lambda x: {csvf('x')}), ',')"
cte("fx_lin_csv", ("fx_sampled", "fx_names"), f"""
  SELECT s.table_id,
         array_to_string(list_concat([array_to_string(list_transform(any_value(n.headers), lambda x: {csvf('x')}),
                                                      ',')],
                                     list(s.line ORDER BY s.sample_rank)), chr(10)) || chr(10) AS table_text
  FROM (SELECT table_id, sample_rank, {_LINE} AS line FROM fx_sampled) s JOIN fx_names n USING (table_id)
  GROUP BY s.table_id""")
SQL["linearize_csv"] = W("SELECT * FROM fx_lin_csv", "fx_lin_csv")

SQL["linearize_key_value"] = W("""
SELECT s.table_id, array_to_string(list(s.line ORDER BY s.sample_rank), chr(10)) AS table_text
FROM (SELECT r.table_id, r.sample_rank,
             array_to_string(list_transform(range(len(r.cells)),
                 lambda i: n.headers[i + 1] || ': ' || coalesce(r.cells[i + 1], 'nan')), ', ') AS line
      FROM fx_sampled r JOIN fx_names n USING (table_id)) s
GROUP BY s.table_id""", "fx_sampled", "fx_names")

cte("md_w", ("fx_sampled", "fx_names"), """
  SELECT table_id, list(w ORDER BY i) AS w FROM (
    SELECT r.table_id, i, greatest(length(any_value(n.headers)[i + 1]),
                                   max(length(coalesce(r.cells[i + 1], 'nan')))) AS w
    FROM (SELECT table_id, cells, unnest(range(len(cells))) AS i FROM fx_sampled) r JOIN fx_names n USING (table_id)
    GROUP BY r.table_id, i)
  GROUP BY table_id""")
cte("md_lines", ("fx_sampled", "md_w"), """
  SELECT r.table_id, r.sample_rank,
         '| ' || array_to_string(list_transform(range(len(w.w)),
                                 lambda i: rpad(coalesce(r.cells[i + 1], 'nan'), CAST(w.w[i + 1] AS INTEGER), ' ')), ' | ') || ' |' AS line
  FROM fx_sampled r JOIN md_w w USING (table_id)""")
SQL["linearize_markdown"] = W("""
SELECT w.table_id,
       array_to_string(list_concat(
         ['| ' || array_to_string(list_transform(range(len(w.w)), lambda i: rpad(n.headers[i + 1], CAST(w.w[i + 1] AS INTEGER), ' ')),
                                  ' | ') || ' |',
          '|' || array_to_string(list_transform(w.w, lambda x: ':' || repeat('-', CAST(x + 1 AS INTEGER))), '|') || '|'],
         (SELECT list(line ORDER BY sample_rank) FROM md_lines l WHERE l.table_id = w.table_id)), chr(10)) AS table_text
FROM md_w w JOIN fx_names n USING (table_id)""", "md_w", "md_lines", "fx_names")

SQL["replace_na"] = W(f"""
SELECT table_id, row_idx, {joined("list_transform(cells, lambda x: coalesce(x, '-'))")} AS cells FROM fx_rows""",
                      "fx_rows")

SQL["fill_table_template"] = W("""
SELECT table_id,
       replace(CASE WHEN length(coalesce(table_name, '')) > 0
                    THEN replace('{{table_name}}' || chr(10) || '{{table}}', '{{table_name}}', table_name)
                    ELSE '{{table_name}}' || chr(10) || '{{table}}' END, '{{table}}', table_text) AS text
FROM fx_lin_csv JOIN fx_names USING (table_id)""", "fx_lin_csv", "fx_names")

SQL["linearize_list"] = W("""
SELECT table_id, '[' || array_to_string(list_transform(l, lambda x: '"' || x || '"'), ', ') || ']' AS json_list,
       array_to_string(l, ',') AS csv_list
FROM (SELECT table_id, list_transform(true_types, lambda x: coalesce(x, 'unspecified')) AS l FROM fx_instances)""",
                         "fx_instances")

SQL["delinearize_list_csv"] = W(rf"""
SELECT table_id, {joined('items')} AS items, CAST(len(items) AS INTEGER) AS n_items
FROM (SELECT table_id, list_transform(string_split(replace(array_to_string(
             list_transform(true_types, lambda x: coalesce(x, 'unspecified')), ','), ',', ', '), ','),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS items FROM fx_instances)""", "fx_instances")

SQL["max_tokens_for_truth"] = W(f"""
SELECT table_id AS request_id, {tokens("'[' || array_to_string(list_transform(true_types, lambda x: '\"' || coalesce(x, 'unspecified') || '\"'), ', ') || ']'")} + 100 AS max_tokens
FROM fx_instances WHERE len(list_filter(true_types, lambda x: x IS NOT NULL)) > 0""", "fx_instances")

# --- request accounting -----------------------------------------------------------------------

SQL["estimate_tokens"] = W("SELECT request_id, input_tokens FROM fx_usage", "fx_usage")
SQL["estimate_max_output"] = W("SELECT request_id, input_tokens, max_output FROM fx_usage", "fx_usage")
SQL["estimate_usage_cost"] = W("""
SELECT request_id, input_usage, output_usage, max_total_usage, round(max_cost, 6) AS max_cost FROM fx_usage""",
                               "fx_usage")
SQL["request_checks"] = W("""
SELECT request_id, array_to_string(list_filter([
    CASE WHEN max_context < input_tokens THEN 'input_exceeds_context' END,
    CASE WHEN max_context = input_tokens THEN 'no_room_for_output' END,
    CASE WHEN max_tokens IS NOT NULL AND max_output_tokens IS NOT NULL AND max_output_tokens < max_tokens
         THEN 'max_tokens_exceeds_output_limit' END,
    CASE WHEN max_tokens IS NOT NULL AND max_context < input_tokens + max_tokens THEN 'max_tokens_exceeds_context' END,
    CASE WHEN seed IS NULL THEN 'seed_missing' END,
    CASE WHEN temperature IS NULL OR temperature <> 0 THEN 'temperature_not_zero' END], lambda x: x IS NOT NULL), ',')
    AS violations
FROM fx_usage""", "fx_usage")

SQL["actual_usage_cost"] = W("SELECT request_id, usage, round(cost, 6) AS cost FROM fx_actual", "fx_actual")

SQL["request_usage_totals"] = W("""
SELECT round(p.max_cost_pending, 6) AS max_cost_pending, p.n_pending, round(e.actual_cost, 6) AS actual_cost,
       e.n_failed, e.actual_usage, c.n_cached, p.max_cost_pending >= 1e-9 AS needs_confirmation
FROM (SELECT coalesce(sum(u.max_cost), 0.0) AS max_cost_pending, count(*) AS n_pending
      FROM fx_usage u JOIN fx_lookup l USING (request_id) WHERE NOT l.cached) p,
     (SELECT coalesce(sum(cost), 0.0) AS actual_cost, count(*) FILTER (WHERE NOT ok) AS n_failed,
             CAST(coalesce(sum(usage), 0) AS BIGINT) AS actual_usage FROM fx_actual) e,
     (SELECT count(*) FILTER (WHERE cached) AS n_cached FROM fx_lookup) c""", "fx_usage", "fx_lookup", "fx_actual")

cte("dn_cells", ("fx_rows",), """
  SELECT table_id, col_idx, row_idx, text FROM (
    SELECT table_id, row_idx, CAST(unnest(range(len(cells))) AS INTEGER) AS col_idx, unnest(cells) AS text
    FROM fx_rows) WHERE text IS NOT NULL""")
cte("dn_grid", ("dn_cells",), """
  SELECT c.table_id, c.col_idx, CAST(unnest(range(n.n_rows)) AS INTEGER) AS row_idx
  FROM (SELECT DISTINCT table_id, col_idx FROM dn_cells) c
  JOIN (SELECT table_id, max(row_idx) + 1 AS n_rows FROM dn_cells GROUP BY table_id) n USING (table_id)""")
SQL["densify_sparse_cells"] = W("""
SELECT g.table_id, g.col_idx, g.row_idx, c.text FROM dn_grid g LEFT JOIN dn_cells c USING (table_id, col_idx, row_idx)""",
                                "dn_grid", "dn_cells")


# --- chat requests --------------------------------------------------------------------------

_TEMPLATE = ("replace(CASE WHEN length(coalesce(table_name, '')) > 0 THEN replace('{{table_name}}' || chr(10) || '{{table}}', "
             "'{{table_name}}', table_name) ELSE '{{table_name}}' || chr(10) || '{{table}}' END, '{{table}}', %s)")


def chat_sql(body: str, examples: int, limit: int, vocabulary: str) -> str:
    """body reads req(table_id, messages, max_tokens): the vocabulary's message, two for each example, the table's."""
    line = f"array_to_string(list_transform(kept, lambda i: {csvf('cells[i]')}), ',')"
    return W(f"""
, pr_kept AS (
  SELECT table_id, true_types, CASE WHEN len(known) > {limit}
         THEN list_sort(list_transform(list_sort(list_transform(range(len(known)), lambda p: {{'hh': {h(SEED_PREP, 'table_id', 'p')}, 'p': p}}))[1:{limit}],
                                       lambda e: known[e.p + 1])) ELSE known END AS kept
  FROM (SELECT table_id, true_types, list_filter(range(1, len(true_types) + 1), lambda i: true_types[i] IS NOT NULL) AS known FROM fx_instances)
  WHERE len(known) > 0),
pr_examples AS (
  SELECT s.table_id, array_to_string(list_concat([array_to_string(list_transform(any_value(k.kept), lambda i: any_value(n.headers)[i]), ',')],
                                                 list(s.line ORDER BY s.sample_rank)), chr(10)) || chr(10) AS text
  FROM (SELECT table_id, sample_rank, {line} AS line FROM fx_sampled JOIN pr_kept USING (table_id)) s
  JOIN pr_kept k USING (table_id) JOIN fx_names n USING (table_id) GROUP BY s.table_id),
pr_parts AS (
  SELECT k.table_id, k.true_types, {_TEMPLATE % 'l.table_text'} AS table_text, {_TEMPLATE % 'x.text'} AS ex_text,
         '[' || array_to_string(list_transform(k.kept, lambda i: '"' || k.true_types[i] || '"'), ', ') || ']' AS ex_types
  FROM pr_kept k JOIN fx_names USING (table_id) JOIN fx_lin_csv l USING (table_id) JOIN pr_examples x USING (table_id)),
pr_pairs AS ({examples_sql(examples)}),
pr_own AS (
  SELECT p.table_id, list_distinct(list_filter(list_concat(any_value(p.true_types), flatten(list(x.true_types))), lambda v: v IS NOT NULL)) AS own
  FROM pr_parts p JOIN pr_pairs e USING (table_id) JOIN pr_parts x ON x.table_id = e.example_id GROUP BY p.table_id),
pr_vocabulary AS ({vocabulary}),
pr_shown AS (
  SELECT e.table_id, flatten(list([{{'role': 'user', 'content': x.ex_text}}, {{'role': 'assistant', 'content': x.ex_types}}] ORDER BY e.j)) AS m
  FROM pr_pairs e JOIN pr_parts x ON x.table_id = e.example_id GROUP BY e.table_id),
req AS (
  SELECT p.table_id, {tokens("'[' || array_to_string(list_transform(p.true_types, lambda x: '\"' || coalesce(x, 'unspecified') || '\"'), ', ') || ']'")} + 100 AS max_tokens,
         list_concat([{{'role': 'user', 'content': 'Predict the column types of the following tables. Provide just the column types as a JSON list without any '
                        || 'introduction or explanation.' || chr(10) || 'Column types are: [' || array_to_string(list_transform(v.candidates, lambda x: '"' || x || '"'), ', ') || ']'}}],
                     s.m, [{{'role': 'user', 'content': p.table_text}}]) AS messages
  FROM pr_parts p JOIN pr_shown s USING (table_id) JOIN pr_vocabulary v USING (table_id))
{body}""", "fx_instances", "fx_sampled", "fx_names", "fx_lin_csv", "fx_indexed").replace(")\n\n, pr_kept", "),\npr_kept")


_WHOLE = f"SELECT table_id, list_sort({VOCAB}) AS candidates FROM pr_own"

SQL["fill_chat_template"] = chat_sql("""
SELECT table_id AS request_id, CAST(pos AS INTEGER) AS pos, messages[pos + 1].role AS role, messages[pos + 1].content AS content
FROM (SELECT table_id, messages, unnest(range(len(messages))) AS pos FROM req)""", 1, 20, _WHOLE)

SQL["unfilled_variables"] = chat_sql(r"""
SELECT table_id AS request_id, unfilled FROM (
  SELECT table_id, array_to_string(flatten(list_transform(messages, lambda m: regexp_extract_all(m.content, '\{\{(.*)\}\}', 1))), ',') AS unfilled FROM req)
WHERE unfilled <> ''""", 2, 20, _WHOLE)

SQL["assemble_requests"] = chat_sql(f"""
SELECT table_id AS request_id, '{{"model": "gpt-3.5-turbo-1106", "max_tokens": ' || CAST(max_tokens AS VARCHAR) || ', "temperature": 0, "messages": ['
       || array_to_string(list_transform(messages, lambda m: '{{"role": "' || m.role || '", "content": ' || {jstr('m.content')} || '}}'), ', ') || ']}}' AS request_json
FROM req""", 1, 4, candidates_sql("SELECT * FROM pr_own", 11))


# --- file sources and sinks: what was written comes back ---------------------------------------

SQL["scan_jsonl_gz_corpus"] = """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(l_returnflag) AS n_flags,
       CAST(0 AS BIGINT) AS n_missing_key
FROM lineitem GROUP BY 1"""

SQL["scan_label_tables"] = W("SELECT table_id, target_column, annotation_label FROM fx_gt", "fx_gt")

SQL["scan_json_text"] = W("SELECT table_id, CAST(len(true_types) AS INTEGER) AS n_types FROM fx_instances", "fx_instances")

SQL["sink_results"] = W("SELECT dataset, exp_name, count(*) AS n_rows FROM fx_report_g GROUP BY dataset, exp_name", "fx_report_g")

SQL["overwrite_stage_output"] = W("""
SELECT dataset, mode, count(*) AS n_rows FROM fx_report_g
WHERE slice = 'all' AND (dataset <> 'corpus_0' OR mode = 'adjusted') GROUP BY dataset, mode""", "fx_report_g")

_SPARSE_CELLS = "SELECT CAST(table_id AS VARCHAR) AS table_id, col_idx, row_idx, text FROM dn_cells"
SQL["scan_sparse_cell_json"] = W(_SPARSE_CELLS, "dn_cells")
SQL["scan_sparse_cell_arrays"] = W(f"""
SELECT table_id, 'cell' AS kind, col_idx, row_idx || ':' || text AS value FROM ({_SPARSE_CELLS})
UNION ALL SELECT CAST(table_id AS VARCHAR), 'header', col_idx, header FROM fx_columns
UNION ALL SELECT CAST(table_id AS VARCHAR), 'type', col_idx, column_type FROM fx_columns WHERE column_type IS NOT NULL""", "dn_cells", "fx_columns")

_MIXED = f"""
  SELECT request_id, CASE WHEN c THEN 'completion-model' ELSE model END AS model, max_tokens, temperature, seed, n, best_of, c, body,
         CASE WHEN c THEN {tokens('prompt')} ELSE CAST(list_sum(list_transform(messages, lambda x: {tokens('x.content')} + 10)) AS BIGINT) END AS input_tokens
  FROM (SELECT *, CASE WHEN c THEN '"prompt": ' || {jstr('prompt')}
                       ELSE '"messages": [' || array_to_string(list_transform(messages, lambda m: '{{"role": ' || {jstr('m.role')} || ', "content": '
                                                               || {jstr('m.content')} || '}}'), ', ') || ']' END AS body
        FROM (SELECT *, request_id % 3 = 0 AS c, array_to_string(list_transform(messages, lambda m: m.content), chr(10)) AS prompt FROM fx_requests))"""
SQL["completion_requests"] = W(f"""
SELECT request_id, model, input_tokens, max_output, coalesce(best_of, n, 1) * (input_tokens + max_output) AS max_total_usage,
       round((coalesce(best_of, n, 1) * input_tokens) * (cost_per_1k_input / 1000) + (coalesce(best_of, n, 1) * max_output) * (cost_per_1k_output / 1000), 6) AS max_cost,
       sha256('{{"model": "' || model || '", "max_tokens": ' || {num('max_tokens')} || ', "temperature": ' || {num('temperature')} || ', ' || body
              || CASE WHEN seed IS NOT NULL THEN ', "seed": ' || {num('seed')} ELSE '' END || CASE WHEN n IS NOT NULL THEN ', "n": ' || {num('n')} ELSE '' END
              || CASE WHEN best_of IS NOT NULL THEN ', "best_of": ' || {num('best_of')} ELSE '' END || '}}') AS request_hash
FROM (SELECT *, coalesce(max_tokens, least(coalesce(max_output_tokens, 1000000000), greatest(0, max_context - input_tokens))) AS max_output
      FROM ({_MIXED}) JOIN (SELECT * FROM fx_models
                            UNION ALL SELECT 'completion-model', 3000, 250000, 0.002, 0.004, 4096, NULL) m USING (model))""", "fx_requests", "fx_models")
