"""Content matching against Python: typed cells, near copies, colliding fingerprints."""

import pytest
from pyspark.sql import functions as F

from colsense.operators import annotate

A = [["1", "x", "2.50"], ["2", None, "3"]]
B = [["1", "x", "2.50"], ["2", "y", "3"]]  # one cell from A
SOURCES = {("s1", "b/1"): A, ("s2", "a/9"): A, ("s3", "c/1"): B, ("s4", "d"): [["7"]], ("s5", "e"): [["True"]], ("s6", "f"): [["7.0"]],
           ("s7", "a/1"): [["q"], ["r"]], ("s8", "a/0"): [["r"], ["q"]], ("s9", "z"): [[None]]}
TARGETS = {"t1": A, "t2": B, "t3": [["+01", "x", "2.5"], ["02", "NA", "3.0"]], "t4": [["1", "x", "2.5"], ["2", "z", "3"]], "t5": [["07"]], "t6": [["7.00"]],
           "t7": [["q"], ["r"]], "t8": [["-0"]], "t9": [["nan"]], "t10": [["x"], ["q"]], "t11": A}
WANT = {"t1": ("s2", "a/9"), "t2": ("s3", "c/1"), "t3": ("s2", "a/9"), "t5": ("s4", "d"), "t6": ("s6", "f"), "t7": ("s7", "a/1"), "t9": ("s9", "z"), "t11": ("s2", "a/9")}


def _rows(spark, tables, named):
    data = [(*(k if named else (k,)), i, r) for k, t in tables.items() for i, r in enumerate(t)]
    return spark.createDataFrame(data, f"copy_id string, {'path string, ' if named else ''}row_idx int, cells array<string>")


@pytest.mark.parametrize("digits", [64, 0])  # 0: every table of a shape collides
def test_match(spark, digits):
    t, s = _rows(spark, TARGETS, False), _rows(spark, SOURCES, True)
    got = {r.target_id: (r.source_id, r.source_path) for r in annotate.match_tables_by_content(t, s, digits).collect()}
    assert got == WANT
    assert annotate.match_tables_by_content(t, s.limit(0), digits).collect() == []
    assert annotate.match_tables_by_content(t.limit(0), s, digits).collect() == []


def test_popular_content(spark):
    """A table that a third of all copies hold is compared once for each copy."""
    t = spark.range(600).select(F.col("id").cast("string").alias("copy_id"), F.lit(0).alias("row_idx"),
                                F.array(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), "id"))).alias("cells"))
    s = t.withColumn("path", F.concat(F.lit("p"), F.lpad("copy_id", 3, "0")))
    got = {r.target_id: r.source_id for r in annotate.match_tables_by_content(t, s).collect()}
    assert got == {str(i): "0" if i % 3 == 0 else str(i) for i in range(600)}


@pytest.mark.parametrize("digits", [64, 0])
@pytest.mark.parametrize("block", [1, 2])
def test_tables_of_several_blocks(spark, digits, block):
    t, s = _rows(spark, TARGETS, False), _rows(spark, SOURCES, True)
    got = {r.target_id: (r.source_id, r.source_path) for r in annotate.match_tables_by_content(t, s, digits, block).collect()}
    assert got == WANT


def test_small_tables_move_once(spark, monkeypatch):
    """A table of one block is matched by its text; no fingerprints, no joins of rows."""
    monkeypatch.setattr(annotate, "table_fingerprints", None)
    t, s = _rows(spark, TARGETS, False), _rows(spark, SOURCES, True)
    got = {r.target_id: (r.source_id, r.source_path) for r in annotate.match_tables_by_content(t, s).collect()}
    assert got == WANT


ODD = {"escapes": [(0, ["a;b", "c"])], "more cells": [(0, ["a", "b", "c"])], "a row more": [(0, ["a;b"]), (1, ["c"])], "backslash": [(0, ["\\N", "x"])],
       "null": [(0, [None, "x"])], "line break": [(0, ["a\nb"])], "its text": [(0, ["a\\nb"])], "other rows": [(1, ["v"]), (2, ["w"])], "from zero": [(0, ["v"]), (1, ["w"])],
       "twice": [(0, ["p"]), (0, ["p"]), (1, ["q"])], "once": [(0, ["p"]), (1, ["q"])], "ahead": [(1, ["u"]), (1, ["u"]), (2, ["u"])], "behind": [(0, ["u"]), (1, ["u"]), (1, ["u"])],
       "no index": [(None, ["k"]), (0, ["l"])], "no cells": [(0, None)], "some cells": [(0, None), (1, ["m"])], "empty": [(0, [])], "ragged": [(0, ["1"]), (1, ["2", "z"])],
       "spaces": [(0, ["5\n", "1;2"])], "blank": [(0, ["5", "1;2"])], "numbers": [(0, ["1.0"]), (1, ["2"])], "same numbers": [(0, ["1"]), (1, ["2.00"])],
       "long": [(i, [str(i), None]) for i in range(200)], "nearly": [(i, [str(i), "x" if i == 199 else None]) for i in range(200)]}


@pytest.mark.parametrize("block", [1, 64])
def test_odd_tables(spark, block):
    """Rows that come twice or have no index, cells like the marks of the text; each matches itself only."""
    data = [(k, i, c) for k, rows in ODD.items() for i, c in rows]
    t = spark.createDataFrame(data, "copy_id string, row_idx int, cells array<string>")
    got = {(r.target_id, r.source_id) for r in annotate.match_tables_by_content(t, t.withColumn("path", F.concat(F.lit("p/"), "copy_id")), block=block).collect()}
    same = {"same numbers": "numbers"}  # equal as doubles; the first path wins
    assert got == {(k, same.get(k, k)) for k in ODD if k != "no cells"}


def test_copies_share_a_shuffle(spark, tmp_path):
    """Targets and sources come from one shuffle of the rows, and grouping them by table adds none."""
    from colsense.sources import fixtures
    li = spark.range(300).selectExpr("id DIV 3 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 3 AS INT) AS l_linenumber", "1.0D AS l_quantity", "2.0D AS l_extendedprice",
                                     "0.1D AS l_discount", "0.2D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP '1995-01-01 00:00:00' AS l_shipdate")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    targets, sources = fixtures.table_copies(fixtures.table_rows(spark, str(tmp_path)))
    assert targets.count() == 150 and sources.count() == 330
    blocks = annotate.table_blocks(targets.withColumn("path", F.lit("")).unionByName(sources), 64)
    assert len(blocks.collect()) == 50 + 110
    plan = blocks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2
