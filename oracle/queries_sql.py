"""DuckDB SQL per query id (same column names and types as the Spark results)."""

from __future__ import annotations

from oracle.fixtures_sql import _ALIGNED as ALIGNED, NA_TOKENS, NUMERIC_RE, with_fixtures as W

SQL: dict[str, str] = {}

_INT_RE = r"^\s*[+-]?\d+\s*$"


def joined(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda e: coalesce(e, '∅')), '|')"


def numeric_ok(v: str) -> str:
    body = f"regexp_replace(trim({v}), '^[+-]?0*', '')"
    neg = f"starts_with(trim({v}), '-')"
    int_ok = (f"(length({body}) < 19 OR (length({body}) = 19 AND (NOT {neg} OR {body} <= '9223372036854775808'))"
              f" OR (length({body}) = 20 AND NOT {neg} AND {body} <= '18446744073709551615'))")
    return (f"({v} IS NULL OR {v} IN ({NA_TOKENS}) OR (regexp_matches({v}, '{NUMERIC_RE}')"
            f" AND (NOT regexp_matches({v}, '{_INT_RE}') OR {int_ok})))")


DATASET = "'corpus_' || CAST(table_id % 3 AS VARCHAR)"

# --- profiling ------------------------------------------------------------------------

SQL["table_shape"] = W("""
SELECT table_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(max(len(cells)) AS INTEGER) AS n_cols
FROM fx_rows GROUP BY table_id""", "fx_rows")

SQL["table_sparsity"] = W("SELECT table_id, round(sparsity, 6) AS sparsity FROM fx_sparsity", "fx_sparsity")

_COL_TYPES = f"""
  SELECT table_id, CAST(k - 1 AS INTEGER) AS col_idx,
         CASE WHEN bool_and({numeric_ok('v')}) THEN 'numerical' ELSE 'non-numerical' END AS data_type
  FROM (SELECT table_id, unnest(cells) AS v, unnest(range(1, len(cells) + 1)) AS k FROM fx_rows)
  GROUP BY table_id, k"""

SQL["column_data_type"] = W(_COL_TYPES, "fx_rows")

SQL["data_type_share"] = W(f"""
SELECT CAST(count(*) FILTER (WHERE data_type = 'numerical') AS BIGINT) AS n_numerical,
       CAST(count(*) FILTER (WHERE data_type <> 'numerical') AS BIGINT) AS n_non_numerical,
       round(avg(CASE WHEN data_type = 'numerical' THEN 1.0 ELSE 0.0 END), 6) AS numerical_share,
       round(avg(CASE WHEN data_type <> 'numerical' THEN 1.0 ELSE 0.0 END), 6) AS non_numerical_share
FROM ({_COL_TYPES})""", "fx_rows")

SQL["annotated_column_counts"] = W("""
SELECT column_type IS NOT NULL AS annotated, count(*) AS n_columns FROM fx_columns GROUP BY 1""", "fx_columns")


def excl_q(values_sql: str, col: str, alias: str) -> str:
    return f"""
  SELECT dataset, CASE WHEN n >= 2 THEN (xs[j] * (20 - (19 * (n + 1) - 20 * j)) + xs[j + 1] * (19 * (n + 1) - 20 * j)) / 20.0 END AS {alias}
  FROM (SELECT dataset, n, xs, least(greatest((19 * (n + 1)) // 20, 1), n - 1) AS j
        FROM (SELECT dataset, count({col}) AS n, list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL)) AS xs
              FROM ({values_sql}) GROUP BY dataset))"""


_SHAPE = f"""SELECT {DATASET} AS dataset, table_id, count(*) AS n_rows, max(len(cells)) AS n_cols,
                   sum(len(list_filter(cells, lambda x: x IS NULL OR x IN ({NA_TOKENS})))) AS n_null
            FROM fx_rows GROUP BY table_id"""

SQL["exclusive_quantile"] = W(f"""
SELECT r.dataset, round(r.p95_rows, 6) AS p95_rows, round(c.p95_cols, 6) AS p95_cols
FROM ({excl_q(_SHAPE, 'n_rows', 'p95_rows')}) r JOIN ({excl_q(_SHAPE, 'n_cols', 'p95_cols')}) c USING (dataset)""",
                              "fx_rows")

SQL["annotated_columns_per_table"] = W("""
SELECT table_id, count(column_type) AS n_annotated, count(*) AS n_columns FROM fx_columns GROUP BY table_id""", "fx_columns")

SQL["annotated_columns_total"] = W("""
SELECT count(*) AS n_tables, count(*) FILTER (WHERE a > 0) AS n_annotated_tables, CAST(sum(a) AS BIGINT) AS n_annotated, CAST(sum(n) AS BIGINT) AS n_columns
FROM (SELECT table_id, count(column_type) AS a, count(*) AS n FROM fx_columns GROUP BY table_id)""", "fx_columns")


def characteristics_sql(shapes: str, listed: str) -> str:
    """From shapes (dataset, n_rows, n_cols, n_null, n_numerical; one row per readable table) and listed (dataset; one per table)."""
    return f"""
SELECT l.dataset, l.n_tables, round(b.mean_cols, 6) AS mean_cols, round(b.median_cols, 6) AS median_cols, round(qc.p95, 6) AS p95_cols,
       round(b.mean_rows, 6) AS mean_rows, round(b.median_rows, 6) AS median_rows, round(qr.p95, 6) AS p95_rows,
       round(b.mean_sparsity, 6) AS mean_sparsity, round(1 - b.numerical_share, 6) AS non_numerical_share,
       round(b.numerical_share, 6) AS numerical_share, l.n_tables - coalesce(b.n, 0) AS parsing_failed
FROM (SELECT dataset, count(*) AS n_tables FROM ({listed}) GROUP BY dataset) l
LEFT JOIN (SELECT dataset, count(*) AS n, avg(n_cols) AS mean_cols, quantile_cont(n_cols, 0.5) AS median_cols,
                  avg(n_rows) AS mean_rows, quantile_cont(n_rows, 0.5) AS median_rows,
                  avg(CASE WHEN n_rows * n_cols <> 0 THEN n_null / (n_rows * n_cols) END) AS mean_sparsity,
                  sum(n_numerical) / sum(n_cols) AS numerical_share
           FROM ({shapes}) GROUP BY dataset) b USING (dataset)
LEFT JOIN ({excl_q(shapes, 'n_cols', 'p95')}) qc USING (dataset)
LEFT JOIN ({excl_q(shapes, 'n_rows', 'p95')}) qr USING (dataset)"""


SQL["corpus_characteristics"] = W(characteristics_sql(f"""
  SELECT s.*, t.n_numerical FROM ({_SHAPE}) s
  JOIN (SELECT table_id, count(*) FILTER (WHERE data_type = 'numerical') AS n_numerical FROM ({_COL_TYPES}) GROUP BY table_id) t USING (table_id)""",
    "SELECT 'corpus_' || CAST(o_orderkey % 3 AS VARCHAR) AS dataset FROM orders"), "fx_rows")

SQL["precomputed_stats_profile"] = "SELECT * EXCLUDE (parsing_failed) FROM (" + W(characteristics_sql(f"""
  SELECT {DATASET} AS dataset, table_id, count(*) AS n_rows, max(n_cols) AS n_cols, sum(len(list_filter(cells, lambda x: x IS NULL))) AS n_null,
         max(len(list_filter(range(n_cols), lambda k: k NOT IN (1, 3, 5, 8)))) AS n_numerical
  FROM fx_rows GROUP BY table_id""", f"SELECT {DATASET} AS dataset FROM fx_tables"), "fx_rows", "fx_tables") + ")"

_NOTE = "CASE WHEN l_orderkey % 3 = 0 THEN 'say \"x\",' || chr(10) || 'then ' || l_linenumber ELSE 'plain' END"
_FLAG = "CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END"
_CSV_TABLES = f"""
  SELECT 'set' || k || '/month=' || month AS file, 'set' || k AS dataset, count(*) AS n_rows, any_value(heads) AS heads,
         CAST(sum(len(list_filter(cells, lambda x: x IS NULL))) AS BIGINT) AS n_null, CAST(sum(length(array_to_string(cells, ''))) AS BIGINT) AS n_chars
  FROM (SELECT k, month, CASE k WHEN 0 THEN ['order key', 'part', 'note'] WHEN 1 THEN ['flag', 'shipped', 'a, "note"', 'supplier']
                                ELSE ['two' || chr(10) || 'lines', 'flag'] END AS heads,
               CASE k WHEN 0 THEN [CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), note]
                      WHEN 1 THEN [flag, strftime(l_shipdate, '%Y-%m-%d'), note, CAST(l_suppkey AS VARCHAR)] ELSE [note, flag] END AS cells
        FROM (SELECT *, month(l_shipdate) % 3 AS k, strftime(l_shipdate, '%Y-%m') AS month, {_NOTE} AS note, {_FLAG} AS flag FROM lineitem))
  GROUP BY k, month"""
_ODD = "(SELECT DISTINCT year(l_shipdate) AS y FROM lineitem), (SELECT unnest(['bare', 'blank', 'long', 'open']) AS folder)"

SQL["scan_csv_corpus"] = f"""
SELECT file, n_rows, CAST(len(heads) AS INTEGER) AS n_cols, array_to_string(heads, '|') AS headers, false AS parse_error, n_null, n_chars FROM ({_CSV_TABLES})
UNION ALL
SELECT folder || '/year=' || y, 0, CASE folder WHEN 'bare' THEN 3 END, CASE folder WHEN 'bare' THEN 'x|y|z' END, folder <> 'bare', NULL, NULL FROM {_ODD}"""

SQL["scan_to_profile"] = characteristics_sql(f"""
  SELECT dataset, n_rows, len(heads) AS n_cols, n_null, CASE dataset WHEN 'set0' THEN 2 WHEN 'set1' THEN 1 ELSE 0 END AS n_numerical FROM ({_CSV_TABLES})
  UNION ALL SELECT folder, 0, 3, 0, 0 FROM {_ODD} WHERE folder = 'bare'""",
    f"SELECT dataset FROM ({_CSV_TABLES}) UNION ALL SELECT folder FROM {_ODD}")

# --- parsing --------------------------------------------------------------------------

SQL["extract_response_text"] = W("""
SELECT request_id, CASE WHEN json_extract(body, '$.choices') IS NOT NULL
                        THEN json_extract_string(body, '$.choices[0].message.content') END AS text
FROM fx_responses""", "fx_responses")

SQL["failed_response_filter"] = W("""
SELECT count(*) AS n_responses, count(*) FILTER (WHERE json_extract(body, '$.choices') IS NULL) AS n_failed
FROM fx_responses""", "fx_responses")

SQL["delinearize_list_json"] = W(f"""
SELECT request_id, {joined('parsed')} AS parsed, CAST(len(parsed) AS INTEGER) AS n_items FROM fx_preds""",
                                 "fx_preds")

SQL["prediction_or_empty"] = W(f"""
SELECT request_id, {joined('pred_types')} AS pred_types, CAST(len(pred_types) AS INTEGER) AS n_items
FROM fx_preds""", "fx_preds")

SQL["finish_reason_counts"] = W("""
SELECT finish_reason, count(*) AS n FROM (
  SELECT unnest(CASE WHEN failed THEN ['failed_api_request']
                     WHEN parsed IS NULL THEN [finish_reason, 'delinearizeation_failed']
                     ELSE [finish_reason] END) AS finish_reason FROM fx_preds)
GROUP BY 1""", "fx_preds")

# --- evaluation -----------------------------------------------------------------------

_PADDED = "list_transform(aligned, lambda x: x.{f})"

SQL["pad_sequences"] = W(f"""
SELECT table_id, {joined(_PADDED.format(f='true_type'))} AS padded_true,
       {joined(_PADDED.format(f='pred_type'))} AS padded_pred,
       {joined(_PADDED.format(f='data_type'))} AS padded_data_types
FROM fx_candidates_padded""", "fx_candidates_padded")

# best gaps of the tables whose lengths differ only (others have none), aligned once
SQL["align_with_insertions"] = W(f"""
SELECT table_id, array_to_string(gaps, ',') AS gaps,
       CAST(len(list_filter(aligned, lambda x: x.true_type IS NULL OR x.true_type = x.pred_type)) AS INTEGER) AS matches,
       {joined(_PADDED.format(f='true_type'))} AS adjusted_true, {joined(_PADDED.format(f='pred_type'))} AS adjusted_pred
FROM (SELECT table_id, gaps, {ALIGNED} AS aligned
      FROM (SELECT * FROM fx_dims JOIN fx_best_gaps USING (table_id) WHERE k > 0
            UNION ALL SELECT *, CAST([] AS BIGINT[]) AS gaps FROM fx_dims WHERE k = 0))""", "fx_dims", "fx_best_gaps")

SQL["scored_pairs"] = W("SELECT * FROM fx_pairs", "fx_pairs")

SQL["ignore_null_truth"] = W("SELECT mode, count(*) AS n_pairs FROM fx_pairs GROUP BY mode", "fx_pairs")

SQL["sparsity_bucket"] = W("""
SELECT CAST(b // 10 AS VARCHAR) || '.' || CAST(b % 10 AS VARCHAR) AS sparsity_bucket, count(*) AS n_tables
FROM (SELECT CAST(round_even(sparsity * 10, 0) AS INTEGER) AS b FROM fx_sparsity) GROUP BY 1""", "fx_sparsity")

SQL["label_confusion_counts"] = W("""
SELECT mode, label, support, predicted, tp FROM fx_label_counts WHERE slice = 'all'""", "fx_label_counts")

SQL["classification_report"] = W("""
SELECT label, precision, recall, f1, support FROM fx_report WHERE mode = 'padded' AND slice = 'all'""", "fx_report")

SQL["adjusted_report"] = W("""
SELECT label, precision, recall, f1, support FROM fx_report WHERE mode = 'adjusted' AND slice = 'all'""",
                           "fx_report")

SQL["report_averages"] = W("""
SELECT mode, label, precision, recall, f1, support FROM fx_report
WHERE slice = 'all' AND label IN ('macro avg', 'weighted avg', 'micro avg', 'accuracy')""", "fx_report")

for _s in ("idx", "data_type", "sparsity", "num_columns"):
    for _mode, _prefix in (("padded", "report_by_"), ("adjusted", "adjusted_report_by_")):
        SQL[_prefix + _s] = W(f"""
SELECT slice_value, label, precision, recall, f1, support FROM fx_report
WHERE mode = '{_mode}' AND slice = '{_s}'""", "fx_report")

SQL["not_a_column_type"] = W("""
SELECT pred_type, count(*) AS n FROM fx_pairs
WHERE mode = 'padded' AND pred_type NOT IN (SELECT column_type FROM fx_vocabulary) GROUP BY pred_type""",
                             "fx_pairs", "fx_vocabulary")

SQL["num_tables_with_column_at_idx"] = W("""
SELECT idx, count(*) AS n_tables FROM fx_pairs WHERE mode = 'padded' AND true_type <> 'MISSING' GROUP BY idx""",
                                         "fx_pairs")

SQL["column_count_deviation"] = W("""
SELECT table_id, CAST(len(pred_types) - len(true_types) AS INTEGER) AS deviation FROM fx_evaluated""",
                                  "fx_evaluated")

SQL["deviation_histogram"] = W("""
SELECT CAST(b.deviation AS INTEGER) AS deviation, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(min(d), max(d) + 1)) AS deviation
      FROM (SELECT len(pred_types) - len(true_types) AS d FROM fx_evaluated)) b
LEFT JOIN (SELECT len(pred_types) - len(true_types) AS deviation, count(*) AS n
           FROM fx_evaluated GROUP BY 1) c USING (deviation)""", "fx_evaluated")

SQL["accuracy_counter"] = W("""
SELECT mode, correct, incorrect, correct + incorrect AS total, round(correct / (correct + incorrect), 6) AS accuracy
FROM (SELECT mode,
             count(*) FILTER (WHERE a.true_type IS NULL OR a.true_type = a.pred_type) AS correct,
             count(*) FILTER (WHERE NOT (a.true_type IS NULL OR a.true_type = a.pred_type)) AS incorrect
      FROM (SELECT 'padded' AS mode, unnest(aligned) AS a FROM fx_candidates_padded
            UNION ALL
            SELECT 'adjusted', unnest(c.aligned) FROM fx_candidates c
            JOIN fx_best_gaps b ON b.table_id = c.table_id AND b.gaps = c.gaps)
      GROUP BY mode)""", "fx_candidates_padded", "fx_candidates", "fx_best_gaps")

SQL["accuracy_counter_merge"] = SQL["accuracy_counter"]
