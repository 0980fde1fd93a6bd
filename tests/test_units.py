"""Literal unit cases (published doctests and edge cases) on tiny inline DataFrames."""

from pyspark.sql import functions as F

from colsense.functions.numeric import is_numeric_token, sparsity_bucket
from colsense.functions.text import json_string, with_strict_json_array
from colsense.operators import align, linearize, profile, report


def test_sparsity_half(spark):
    rows = spark.createDataFrame([(1, 0, ["1", None]), (1, 1, [None, "2"])],
                                 "table_id int, row_idx int, cells array<string>")
    assert profile.table_sparsity(rows).first()["sparsity"] == 0.5


def test_accuracy_counter(spark):
    ev = spark.createDataFrame([(1, ["a", "b"], ["a", "x"], ["n", "n"])],
                               "table_id int, true_types array<string>, pred_types array<string>, "
                               "data_types array<string>")
    r = report.accuracy_counter(ev, "padded").first()
    assert (r["correct"], r["incorrect"], r["total"], r["accuracy"]) == (1, 1, 2, 0.5)


def _pairs(spark, truth, pred, mode, cap=2):
    df = spark.createDataFrame([(1, truth, pred, ["d"] * len(truth))],
                               "table_id int, true_types array<string>, pred_types array<string>, "
                               "data_types array<string>")
    p = align.align(df, mode, cap).first()["pairs"]
    return [x["true_type"] for x in p], [x["pred_type"] for x in p]


def test_pad_sequences(spark):
    assert _pairs(spark, ["a", "b", "c"], ["a", "b"], "padded") == (["a", "b", "c"], ["a", "b", "MISSING"])
    assert _pairs(spark, ["a", "b"], ["a", "b", "c"], "padded") == (["a", "b", "MISSING"], ["a", "b", "c"])


def test_adjusted_alignment_inserts_gap(spark):
    t, p = _pairs(spark, ["a", "b", "c"], ["a", "c"], "adjusted")
    assert p == ["a", "MISSING", "c"]
    assert sum(x == y for x, y in zip(t, p)) == 2


def test_insert_and_pad_positions(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"], ["a", "b"], ["1", "2", "3", "4", "5"], [1])],
                               "table_id int, true_types array<string>, pred_types array<string>, "
                               "data_types array<string>, gaps array<int>")
    p = align.with_pairs(df, gaps="gaps").first()["pairs"]
    assert [x["pred_type"] for x in p] == ["a", "MISSING", "b", "MISSING", "MISSING"]


def test_json_repair(spark):
    cases = {
        '["a","b"': ["a", "b"], '["a","b': ["a", "b"], '["a",': ["a", ""], "[": [],
        '["a",]': None, '["a"] x': None, '["a"]]': None, "['a']": None,
        '```json\n["a"]\n```': None, '{"a":1}': None, '"x"': None,
        '[true, null, 1, " y "]': ["True", "None", "1", "y"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["p"] for r in with_strict_json_array(df, "s", "p").collect()}
    for k, v in cases.items():
        assert got[k] == v, (k, got[k], v)


def test_sparsity_bucket_half_even(spark):
    df = spark.createDataFrame([(0.05,), (0.15,), (0.25,), (0.35,)], "x double")
    got = [r[0] for r in df.select(sparsity_bucket(F.col("x"))).collect()]
    assert got == [0.0, 0.2, 0.2, 0.4]


def test_exclusive_quantile(spark):
    data = [("a", v) for v in [1, 2, 3]] + [("b", v) for v in range(1, 101)] + \
           [("c", v) for v in [5, 5, 5, 9]] + [("d", v) for v in [3, 8]]
    df = spark.createDataFrame(data, "g string, v long")
    got = {r["g"]: r["p95"] for r in profile.exclusive_quantile(df, ["g"], {"p95": "v"}).collect()}
    assert got == {"a": 3.8, "b": 95.95, "c": 12.0, "d": 12.25}


def test_numeric_tokens(spark):
    yes = ["1", "1e3", "inf", " 12 ", "-3.5", ".5", "18446744073709551615"]
    no = ["True", "1d", "0x1A", "1_0", "2024-01-01", "18446744073709551616", "abc"]
    df = spark.createDataFrame([(x,) for x in yes + no], "v string")
    got = {r["v"]: r["n"] for r in df.select("v", is_numeric_token(F.col("v")).alias("n")).collect()}
    assert all(got[x] for x in yes) and not any(got[x] for x in no)


def test_json_string_ascii_escapes(spark):
    df = spark.createDataFrame([('é"\\\n😀',)], "s string")
    assert df.select(json_string(F.col("s"))).first()[0] == '"\\u00e9\\"\\\\\\n\\ud83d\\ude00"'


def test_chat_template(spark):
    df = spark.createDataFrame([("Micha",)], "name string")
    greeting = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("Nice to meet you!").alias("content")))
    msgs = linearize.fill_chat_template(
        [{"role": "user", "content": "My name is {{name}}."}, "{{greeting}}"],
        {"name": F.col("name")}, {"greeting": greeting})
    out = df.select(msgs.alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in out] == [("user", "My name is Micha."),
                                                        ("assistant", "Nice to meet you!")]
