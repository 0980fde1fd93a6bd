"""A sample of registered queries against their DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events", "conversations", "pages")
SAMPLE = ["table_shape", "column_data_type", "exclusive_quantile", "finish_reason_counts", "scored_pairs",
          "report_by_sparsity", "adjusted_report", "annotate_columns", "request_hash", "linearize_csv",
          "rolling_request_budget", "sample_examples", "main_results_pivot"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, sdf.collect()) == _rows(dcols, rel.fetchall())
