"""The derived corpus (FIXTURES.md part B) as DuckDB common table expressions.

``with_fixtures(body, *names)`` prefixes ``body`` with the CTEs it needs (and
their dependencies) in a valid order.
"""

from __future__ import annotations

TYPES = ("['part.key', 'flag.return', 'quantity', 'date.ship', 'supplier.key', 'flag.line', "
         "'line.number', 'discount.pct', 'flag.pair', 'price.cents', 'tax.pct']")
VOCAB = ("['part.key', 'flag.return', 'quantity', 'date.ship', 'supplier.key', 'flag.line', "
         "'line.number', 'discount.pct', 'flag.pair', 'price.cents', 'tax.pct', 'unused.a', 'unused.b']")
NA_TOKENS = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
             "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")
NUMERIC_RE = (r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
              r"|inf|Inf|INF|infinity|Infinity|INFINITY|nan|NaN|NAN)\s*$")

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("fx_li", (), """
  SELECT l_orderkey AS o, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                 l_extendedprice, l_shipdate) - 1 AS INTEGER) AS row_idx
  FROM lineitem""")

cte("fx_rows", ("fx_li",), """
  SELECT o AS table_id, row_idx, CAST(3 + o % 9 AS INTEGER) AS n_cols,
    list_transform(
      [CAST(l_partkey AS VARCHAR), l_returnflag, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),
       strftime(l_shipdate, '%Y-%m-%d'), CAST(l_suppkey AS VARCHAR), l_linestatus,
       CAST(l_linenumber AS VARCHAR), CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR),
       l_returnflag || l_linestatus, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
       CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR)][1:3 + o % 9],
      lambda x, k: CASE WHEN (o * 7 + row_idx * 3 + (k - 1) * 5) % 10 < o % 6 THEN NULL ELSE x END) AS cells
  FROM fx_li""")

cte("fx_tables", (), """
  SELECT l_orderkey AS table_id, CAST(3 + l_orderkey % 9 AS INTEGER) AS n_cols,
         CAST(count(*) AS INTEGER) AS n_rows
  FROM lineitem GROUP BY l_orderkey""")

cte("fx_columns", ("fx_tables",), f"""
  SELECT table_id, CAST(k AS INTEGER) AS col_idx, 'c' || CAST(k AS VARCHAR) AS header,
         CASE WHEN (table_id + k) % 13 = 0 OR table_id % 97 = 0 THEN NULL ELSE {TYPES}[k + 1] END AS column_type,
         CASE WHEN k IN (1, 3, 5, 8) THEN 'non-numerical' ELSE 'numerical' END AS data_type
  FROM (SELECT table_id, unnest(range(n_cols)) AS k FROM fx_tables)""")

cte("fx_instances", ("fx_columns",), """
  SELECT table_id, list(column_type ORDER BY col_idx) AS true_types,
         list(data_type ORDER BY col_idx) AS data_types
  FROM fx_columns GROUP BY table_id""")

cte("fx_vocabulary", (), f"SELECT unnest({VOCAB}) AS column_type")

cte("fx_gt", ("fx_columns",), """
  SELECT CAST(table_id AS VARCHAR) || '_dbpedia' AS table_id, col_idx AS target_column,
         column_type AS annotation_label
  FROM fx_columns WHERE column_type IS NOT NULL
  UNION ALL
  SELECT CAST(table_id AS VARCHAR) || '_dbpedia', col_idx, 'flag.pair'
  FROM fx_columns WHERE column_type IS NOT NULL AND table_id % 211 = 0 AND col_idx = 0""")

cte("fx_responses", ("fx_instances",), """
  SELECT o AS request_id,
    CASE WHEN o % 10 = 7 THEN '{"error":{}}' ELSE CAST(to_json({
      'model': CASE WHEN o % 2 = 0 THEN 'gpt-3.5-turbo-1106' ELSE 'gpt-4-0613' END,
      'choices': [{'message': {'content':
                     CASE o % 10 WHEN 5 THEN substring(t, 1, length(t) - 4)
                                 WHEN 6 THEN 'Sure: ' || t
                                 WHEN 8 THEN substring(t, 1, length(t) - 1)
                                 ELSE t END},
                   'finish_reason': CASE WHEN o % 10 = 8 THEN 'length' ELSE 'stop' END}],
      'usage': {'prompt_tokens': 100 + o % 50, 'completion_tokens': nc * 5,
                'total_tokens': 100 + o % 50 + nc * 5}}) AS VARCHAR) END AS body
  FROM (
    SELECT o, nc,
      '[' || array_to_string(list_transform(pred,
              lambda x: CASE WHEN o % 10 = 9 THEN '" ' || x || ' "' ELSE '"' || x || '"' END), ', ') || ']' AS t
    FROM (
      SELECT o, nc, CASE o % 10
          WHEN 1 THEN list_filter(tr, lambda x, i: i - 1 <> o % nc)
          WHEN 2 THEN list_filter(tr, lambda x, i: i - 1 <> 0 AND i - 1 <> 2)
          WHEN 3 THEN list_concat(['quantity'], tr)
          WHEN 4 THEN list_concat([tr[2], tr[1]], tr[3:])
          WHEN 9 THEN list_concat(tr[1:nc - 1], ['not.a.type'])
          ELSE tr END AS pred
      FROM (SELECT table_id AS o, len(true_types) AS nc,
                   list_transform(true_types, lambda x: coalesce(x, 'unspecified')) AS tr
            FROM fx_instances)))""")

# parsed predictions: strict candidates s, s"], s], s""]; first valid wins; non-array -> null
cte("fx_preds", ("fx_responses",), r"""
  SELECT request_id, failed, finish_reason, parsed, coalesce(parsed, CAST([] AS VARCHAR[])) AS pred_types
  FROM (
    SELECT request_id, failed, finish_reason,
      CASE WHEN chosen IS NOT NULL AND json_type(CAST(chosen AS JSON)) = 'ARRAY'
           THEN list_transform(CAST(CAST(chosen AS JSON) AS VARCHAR[]),
                               lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) END AS parsed
    FROM (
      SELECT request_id, failed, finish_reason,
        CASE WHEN json_valid(txt) THEN txt
             WHEN json_valid(txt || '"]') THEN txt || '"]'
             WHEN json_valid(txt || ']') THEN txt || ']'
             WHEN json_valid(txt || '""]') THEN txt || '""]' END AS chosen
      FROM (
        SELECT request_id, json_extract(body, '$.choices') IS NULL AS failed,
               json_extract_string(body, '$.choices[0].finish_reason') AS finish_reason,
               CASE WHEN json_extract(body, '$.choices') IS NOT NULL
                    THEN json_extract_string(body, '$.choices[0].message.content') END AS txt
        FROM fx_responses)))""")

cte("fx_sparsity", ("fx_rows",), f"""
  SELECT table_id,
         sum(len(list_filter(cells, lambda x: x IS NULL OR x IN ({NA_TOKENS}))))::DOUBLE
           / (count(*) * max(len(cells))) AS sparsity
  FROM fx_rows GROUP BY table_id""")

cte("fx_evaluated", ("fx_instances", "fx_preds", "fx_sparsity"), """
  SELECT i.table_id, i.true_types, i.data_types, p.pred_types, s.sparsity
  FROM fx_instances i JOIN fx_preds p ON p.request_id = i.table_id
  LEFT JOIN fx_sparsity s ON s.table_id = i.table_id
  WHERE len(list_filter(i.true_types, lambda x: x IS NOT NULL)) > 0""")

# alignment by brute force over every gap combination (the oracle for the linear-time search)
cte("fx_dims", ("fx_evaluated",), """
  SELECT *, len(true_types) AS nt, len(pred_types) AS np,
         greatest(len(true_types), len(pred_types)) AS n,
         least(abs(len(true_types) - len(pred_types)), 2) AS k
  FROM fx_evaluated""")

_ALIGNED = """list_transform(range(n), lambda j: {
      'idx': CAST(j AS INTEGER),
      'true_type': CASE WHEN nt < np
          THEN (CASE WHEN list_contains(gaps, j) THEN 'MISSING'
                     WHEN j - len(list_filter(gaps, lambda g: g < j)) < nt
                     THEN true_types[j - len(list_filter(gaps, lambda g: g < j)) + 1] ELSE 'MISSING' END)
          ELSE (CASE WHEN j < nt THEN true_types[j + 1] ELSE 'MISSING' END) END,
      'pred_type': CASE WHEN nt < np
          THEN (CASE WHEN j < np THEN pred_types[j + 1] ELSE 'MISSING' END)
          ELSE (CASE WHEN list_contains(gaps, j) THEN 'MISSING'
                     WHEN j - len(list_filter(gaps, lambda g: g < j)) < np
                     THEN pred_types[j - len(list_filter(gaps, lambda g: g < j)) + 1] ELSE 'MISSING' END) END,
      'data_type': CASE WHEN nt < np
          THEN (CASE WHEN list_contains(gaps, j) THEN 'MISSING'
                     WHEN j - len(list_filter(gaps, lambda g: g < j)) < nt
                     THEN data_types[j - len(list_filter(gaps, lambda g: g < j)) + 1] ELSE 'MISSING' END)
          ELSE (CASE WHEN j < nt THEN data_types[j + 1] ELSE 'MISSING' END) END})"""

cte("fx_candidates", ("fx_dims",), f"""
  SELECT table_id, gaps, {_ALIGNED} AS aligned
  FROM (
    SELECT d.*, CAST([] AS BIGINT[]) AS gaps FROM fx_dims d WHERE k = 0
    UNION ALL
    SELECT * EXCLUDE (i1), [i1] FROM (SELECT *, unnest(range(n)) AS i1 FROM fx_dims WHERE k = 1)
    UNION ALL
    SELECT * EXCLUDE (i1, i2), [i1, i2] FROM (
      SELECT *, unnest(range(i1 + 1, n)) AS i2 FROM (SELECT *, unnest(range(n)) AS i1 FROM fx_dims WHERE k = 2)))""")

cte("fx_best_gaps", ("fx_candidates",), """
  SELECT table_id, gaps FROM (
    SELECT table_id, gaps,
      row_number() OVER (PARTITION BY table_id
                         ORDER BY len(list_filter(aligned, lambda x: x.true_type IS NULL
                                                  OR x.true_type = x.pred_type)) DESC, gaps) AS rk
    FROM fx_candidates) WHERE rk = 1""")

cte("fx_pairs", ("fx_dims", "fx_best_gaps"), f"""
  SELECT mode, table_id, CAST(a.idx AS INTEGER) AS idx, a.true_type, a.pred_type, a.data_type,
         sparsity_tenths, num_columns
  FROM (
    SELECT mode, table_id, sparsity_tenths, num_columns, unnest(aligned) AS a FROM (
      SELECT 'padded' AS mode, table_id, CAST(round_even(sparsity * 10, 0) AS INTEGER) AS sparsity_tenths,
             CAST(nt AS INTEGER) AS num_columns, {_ALIGNED} AS aligned
      FROM (SELECT d.*, CAST([] AS BIGINT[]) AS gaps FROM fx_dims d)
      UNION ALL
      SELECT 'adjusted', table_id, CAST(round_even(sparsity * 10, 0) AS INTEGER), CAST(nt AS INTEGER),
             {_ALIGNED}
      FROM (SELECT d.*, g.gaps FROM fx_dims d JOIN fx_best_gaps g USING (table_id))))
  WHERE a.true_type IS NOT NULL""")

cte("fx_label_counts", ("fx_pairs",), """
  SELECT mode, slice, slice_value, label, CAST(sum(s) AS BIGINT) AS support,
         CAST(sum(q) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp
  FROM (
    SELECT mode, slice, slice_value, true_type AS label, 1 AS s, 0 AS q,
           CASE WHEN true_type = pred_type THEN 1 ELSE 0 END AS tp FROM fx_keyed
    UNION ALL
    SELECT mode, slice, slice_value, pred_type, 0, 1, 0 FROM fx_keyed)
  GROUP BY mode, slice, slice_value, label""")

cte("fx_keyed", ("fx_pairs",), """
  SELECT mode, 'all' AS slice, '' AS slice_value, true_type, pred_type FROM fx_pairs
  UNION ALL SELECT mode, 'idx', CAST(idx AS VARCHAR), true_type, pred_type FROM fx_pairs WHERE true_type <> 'MISSING'
  UNION ALL SELECT mode, 'data_type', data_type, true_type, pred_type FROM fx_pairs WHERE true_type <> 'MISSING'
  UNION ALL SELECT mode, 'sparsity', CAST(sparsity_tenths // 10 AS VARCHAR) || '.' || CAST(sparsity_tenths % 10 AS VARCHAR),
                   true_type, pred_type FROM fx_pairs WHERE true_type <> 'MISSING'
  UNION ALL SELECT mode, 'num_columns', CAST(num_columns AS VARCHAR), true_type, pred_type
            FROM fx_pairs WHERE true_type <> 'MISSING'""")
# fx_label_counts depends on fx_keyed
CTES["fx_label_counts"] = (("fx_keyed",), CTES["fx_label_counts"][1])

cte("fx_label_rows", ("fx_label_counts", "fx_vocabulary"), """
  SELECT mode, slice, slice_value, label, support, predicted, tp,
         coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp / nullif(support, 0), 0.0) AS recall,
         coalesce(2.0 * tp / nullif(predicted + support, 0), 0.0) AS f1
  FROM (
    SELECT m.mode, m.slice, m.slice_value, v.column_type AS label,
           coalesce(c.support, 0) AS support, coalesce(c.predicted, 0) AS predicted, coalesce(c.tp, 0) AS tp
    FROM fx_vocabulary v CROSS JOIN (SELECT DISTINCT mode, slice, slice_value FROM fx_label_counts) m
    LEFT JOIN fx_label_counts c ON c.mode = m.mode AND c.slice = m.slice
      AND c.slice_value IS NOT DISTINCT FROM m.slice_value AND c.label = v.column_type)""")

cte("fx_report", ("fx_label_rows", "fx_label_counts", "fx_vocabulary"), """
  SELECT mode, slice, slice_value, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
         round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
  FROM (
    SELECT mode, slice, slice_value, label, precision, recall, f1, support FROM fx_label_rows
    UNION ALL
    SELECT e.mode, e.slice, e.slice_value, x.label, x.precision, x.recall, x.f1, x.support
    FROM (SELECT mode, slice, slice_value, sum(support) AS n_pairs, sum(tp) AS n_correct
          FROM fx_label_counts GROUP BY ALL) e
    LEFT JOIN (SELECT mode, slice, slice_value, sum(precision) AS sp, sum(recall) AS sr, sum(f1) AS sf,
                      sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf,
                      sum(support) AS sup, sum(predicted) AS pred, sum(tp) AS tp
               FROM fx_label_rows GROUP BY ALL) s USING (mode, slice, slice_value)
    CROSS JOIN LATERAL (SELECT unnest([
      {'label': 'macro avg', 'precision': coalesce(s.sp, 0) / (SELECT count(DISTINCT column_type) FROM fx_vocabulary),
       'recall': coalesce(s.sr, 0) / (SELECT count(DISTINCT column_type) FROM fx_vocabulary),
       'f1': coalesce(s.sf, 0) / (SELECT count(DISTINCT column_type) FROM fx_vocabulary), 'support': coalesce(s.sup, 0)},
      {'label': 'weighted avg', 'precision': coalesce(s.wp / nullif(s.sup, 0), 0.0),
       'recall': coalesce(s.wr / nullif(s.sup, 0), 0.0), 'f1': coalesce(s.wf / nullif(s.sup, 0), 0.0),
       'support': coalesce(s.sup, 0)},
      {'label': 'micro avg', 'precision': coalesce(s.tp / nullif(s.pred, 0), 0.0),
       'recall': coalesce(s.tp / nullif(s.sup, 0), 0.0),
       'f1': coalesce(2.0 * s.tp / nullif(s.pred + s.sup, 0), 0.0), 'support': coalesce(s.sup, 0)},
      {'label': 'accuracy', 'precision': NULL, 'recall': NULL,
       'f1': coalesce(e.n_correct / nullif(e.n_pairs, 0), 0.0), 'support': e.n_pairs}], max_depth := 2)) x)
""")


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(body: str, *names: str) -> str:
    order = _order(names)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    return f"WITH {parts}\n{body}"


cte("fx_candidates_padded", ("fx_dims",), f"""
  SELECT table_id, {_ALIGNED} AS aligned FROM (SELECT d.*, CAST([] AS BIGINT[]) AS gaps FROM fx_dims d)""")
