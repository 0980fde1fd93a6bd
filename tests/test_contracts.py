"""Errors that a plan raises on a bad row, beside the audit tables; counters that
are pushed and merged; a tall sparse table."""

import pytest
from pyspark.sql import functions as F

from colsense.operators import annotate, report, sample
from colsense.sources import corpus, sinks


def test_conflicting_annotations(spark):
    cols = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "table_id long, col_idx int, header string")
    good = [("1", 0, "x")]
    name = F.col("table_id").cast("string")
    gt = spark.createDataFrame(good, "table_id string, target_column int, annotation_label string")
    assert annotate.annotate_columns(cols, gt, name, strict=True).count() == 2
    bad = spark.createDataFrame([*good, ("1", 0, "y")], gt.schema)
    assert annotate.annotate_columns(cols, bad, name).where("n_labels > 1").count() == 1
    with pytest.raises(Exception, match="several annotations of column 0 of table 1"):
        annotate.annotate_columns(cols, bad, name, strict=True).collect()


def test_unpaired_requests(spark):
    r = spark.range(3).select(F.col("id").alias("request_id"))
    assert annotate.pair_request_response(r, r, strict=True).count() == 3
    for a, b, status in ((r, r.limit(2), "no response"), (r.limit(2), r, "no request")):
        assert annotate.pair_request_response(a, b).where(F.col("status") == status).count() == 1
        with pytest.raises(Exception, match=f"{status}: 2"):
            annotate.pair_request_response(a, b, strict=True).collect()


def test_files_without_one_key(spark):
    files = spark.createDataFrame([("x_goals.csv",), ("cards.csv",)], "file_name string")
    keys = spark.createDataFrame([("goals",), ("cards",)], "file_key string")
    found = annotate.metadata_substring_match(files, keys)
    assert {r.file_name: r.file_key for r in annotate.match_audit(files, found, strict=True).collect()} == {"x_goals.csv": "goals", "cards.csv": "cards"}
    for extra, status in (("goals_cards", "ambiguous"), ("plain", "no match")):
        more = files.unionByName(spark.createDataFrame([(extra,)], files.schema))
        found = annotate.metadata_substring_match(more, keys)
        audit = {r.file_name: (r.status, r.file_key) for r in annotate.match_audit(more, found).collect()}
        assert audit[extra] == (status, None) and audit["cards.csv"] == ("ok", "cards")
        with pytest.raises(Exception, match=f"{status}: {extra}"):
            annotate.match_audit(more, found, strict=True).collect()


def test_shuffled_lists_of_one_length(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], [])], "id long, x array<string>, y array<int>")
    for r in sample.aligned_shuffle(df, 5, "id", ["x", "y"]).collect():
        assert list(zip(r.x, r.y)) in ([("a", 1), ("b", 2)], [("b", 2), ("a", 1)], [])
    with pytest.raises(Exception, match="x, y must have the same length in row 3"):
        sample.aligned_shuffle(spark.createDataFrame([(3, ["a"], [1, 2])], df.schema), 5, "id", ["x", "y"]).collect()


def test_merged_counters(spark, tmp_path):
    rows = [(i, ["a", "b", None][: 1 + i % 3], ["a", "c", "b"][: 1 + i % 2]) for i in range(40)]
    e = spark.createDataFrame(rows, "table_id long, true_types array<string>, pred_types array<string>")
    e = e.withColumn("data_types", F.transform("true_types", lambda _: F.lit("numerical"))).withColumn("sparsity", F.lit(0.0))
    whole = report.accuracy_counter(e, "padded").collect()
    path = str(tmp_path / "states")
    for k in (0, 1, 2, 1):  # batch 1 is pushed again
        sinks.push_state(report.accuracy_state(e.where(F.col("table_id") % 3 == k), "padded"), path, f"b{k}")
    assert report.accuracy_report(sinks.stored_states(spark, path)).collect() == whole
    sinks.push_state(report.accuracy_state(e.limit(0), "padded"), path, "none")
    assert report.accuracy_report(sinks.stored_states(spark, path)).collect() == whole
    (empty,) = report.accuracy_counter(e.limit(0), "padded").collect()
    assert (empty.correct, empty.incorrect, empty.total, empty.accuracy) == (0, 0, 0, None)


def test_tall_sparse_table(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2_999_999, "b"), (1, 1, 70_000, "c"), (2, 3, 1, "d")], "table_id long, col_idx int, row_idx int, text string")
    out = corpus.densify_sparse_cells(cells)
    assert {(r.table_id, r.col_idx): (r.n, r.present) for r in out.groupBy("table_id", "col_idx").agg(
        F.count("*").alias("n"), F.count("text").alias("present")).collect()} == {(1, 0): (3_000_000, 2), (1, 1): (3_000_000, 1), (2, 3): (2, 1)}
    assert {tuple(r) for r in out.where("text is not null").collect()} == {tuple(r) for r in cells.collect()}
    small = corpus.densify_sparse_cells(cells.where("table_id = 2 or row_idx < 100"), block=1).collect()
    assert {tuple(r) for r in small} == {(1, 0, 0, "a"), (2, 3, 0, None), (2, 3, 1, "d")}


def test_requests_without_the_field_their_model_needs(spark):
    from colsense.operators import requests as rq
    models = spark.createDataFrame([("talk", "chat", 100, None), ("write", "completion", 50, 20)],
                                   "model string, chat_or_completion string, max_context bigint, max_output_tokens bigint").withColumns(
        {"cost_per_1k_input": F.lit(1.0), "cost_per_1k_output": F.lit(2.0)})
    schema = "request_id long, model string, prompt string, messages array<struct<role: string, content: string>>, max_tokens bigint, n bigint, best_of bigint"
    rows = [(1, "talk", None, [("user", "one two")], None, None, None), (2, "write", "one two, three", None, None, 2, None)]
    got = {r.request_id: (r.input_tokens, r.max_output, r.max_total_usage, r.max_cost) for r in rq.usage_and_cost(spark.createDataFrame(rows, schema), models).collect()}
    assert got == {1: (12, 88, 100, pytest.approx(0.188)), 2: (4, 20, 48, pytest.approx(0.088))}
    for bad, field in (((3, "talk", "text", None, None, None, None), "messages"), ((3, "write", None, [("user", "x")], None, None, None), "prompt")):
        with pytest.raises(Exception, match=f"missing the field {field}: 3"):
            rq.usage_and_cost(spark.createDataFrame([*rows, bad], schema), models).collect()
