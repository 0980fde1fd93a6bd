"""Positional records: lines and one large array give the same three tables."""

import json
import random

import pytest

from colsense.sources import corpus

NASTY = ["", "plain", 'a "quoted" ]], ["x', "\\", '\\"', "]]", "[[", '", ["', "ünï 語", "line\nbreak", '\\\\"]], ["', "{}", "tab\t"]


def _records(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cols = rng.randint(1, 4)
        cells = [[[[r, c], [rng.randint(0, 99), rng.choice(NASTY)]] for r in range(rng.randint(0, 3))] for c in range(cols)]
        types = [[rng.choice(NASTY) for _ in range(rng.randint(0, 2))] for _ in range(cols)]
        out.append([f"id{i}", rng.choice(NASTY), 7, rng.choice(NASTY), None, [rng.choice(NASTY) for _ in range(cols)], cells, types])
    return out


def _tables(found):
    return tuple(sorted((tuple(r) for r in df.collect()), key=str) for df in (found.headers, found.cells, found.annotations))


def _want(records):
    headers = [(r[0], c, h) for r in records for c, h in enumerate(r[5])]
    cells = [(r[0], c, x[0][0], x[1][1]) for r in records for c, xs in enumerate(r[6]) for x in xs]
    types = [(r[0], c, t) for r in records for c, ts in enumerate(r[7]) for t in ts]
    return tuple(sorted(x, key=str) for x in (headers, cells, types))


@pytest.mark.parametrize("cut", ['], ["', "never", ']],["', ']], ['])
def test_forms(spark, tmp_path, cut):
    records = [_records(60, 1), _records(1, 2), [], _records(25, 3)]
    every = [r for rs in records for r in rs]
    (tmp_path / "lines").mkdir()
    (tmp_path / "arrays").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in every) + "\n\n")
    for i, rs in enumerate(records):
        (tmp_path / "arrays" / f"{i}.json").write_text("  " + json.dumps(rs, separators=(",", ":") if cut == ']],["' else None, ensure_ascii=i % 2 == 0) + "\n")
    assert _tables(corpus.scan_sparse_cell_json(spark, str(tmp_path / "lines"))) == _want(every)
    if cut == "never":
        with pytest.raises(ValueError):
            corpus.scan_sparse_cell_json(spark, str(tmp_path / "arrays"), cut)
        cut = "]]]]]], ["  # fits no place: a file is one text
    assert _tables(corpus.scan_sparse_cell_json(spark, str(tmp_path / "arrays"), cut)) == _want(every)


def test_arrays_are_split(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_records(200, 5)))
    assert corpus._array_records(spark, str(tmp_path), ']], ["').count() > 100


@pytest.mark.parametrize("size", [150, 400])
def test_arrays_of_many_blocks(spark, tmp_path, size):
    """Blocks of a file that begin inside strings and items."""
    every = [_records(60, 7), _records(40, 8)]
    for i, rs in enumerate(every):
        (tmp_path / f"{i}.json").write_text(json.dumps(rs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for cut in (']], ["', '], ["', "], ["):
            got = corpus._array_records(spark, str(tmp_path), cut)
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            records = [r for x in got.collect() for r in json.loads(f"[{x.value}]")]
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(records, key=str) == sorted(every[0] + every[1], key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_items_that_stand_alone_are_not_ordered(spark, tmp_path, monkeypatch):
    rows = [[f"id{i}", "", "", "", "", ["h"], [[[[0, 0], [1, "x"]]]], [["t"]]] for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    monkeypatch.setattr(corpus.sample, "prefix_sums", None)
    assert _tables(corpus.scan_sparse_cell_json(spark, str(tmp_path), ']], ["')) == _want(rows)


def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Pieces are summed where they are read, and only parsed records are staged."""
    (tmp_path / "a.json").write_text(json.dumps([[f"id{i}", "", "", "", "", ["h"], [[[[0, 0], [1, "x"]]]], [["t"]]] for i in range(50)]))
    seen, staged = [], corpus.staged

    def watched(df, name, *codec):
        seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name, *codec)

    monkeypatch.setattr(corpus, "staged", watched)
    corpus.scan_sparse_cell_json(spark, str(tmp_path), ']], ["')
    assert len(seen) == 1 and "value" not in seen[0][0]
    assert not any("start#" in line.split("Exchange", 1)[1] or "value#" in line.split("Exchange", 1)[1] for line in seen[0][1].split("\n") if "Exchange hash" in line)


def test_blocks_over_several_batches(spark, tmp_path):
    """A block's sums go on from one Arrow batch to the next."""
    every = _records(40, 11)
    (tmp_path / "a.json").write_text(json.dumps(every))
    names = {"spark.sql.files.maxPartitionBytes": 2000, "spark.sql.execution.arrow.maxRecordsPerBatch": 3}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        assert _tables(corpus.scan_sparse_cell_json(spark, str(tmp_path), "], [")) == _want(every)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_of_a_file_lie_together(spark, tmp_path):
    """Records dealt out by file are the same, made and ordered in one shuffle."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from colsense.plans import catalog
    spark.range(300).selectExpr("IF(id = 7, NULL, id DIV 3) AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 3 AS INT) AS l_linenumber", "1.0D AS l_quantity", "2.0D AS l_extendedprice",
                                "0.1D AS l_discount", "0.2D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP '1995-01-01 00:00:00' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    dealt = catalog._sparse_records(spark, str(tmp_path), 5)
    assert sorted(dealt.drop("part").collect()) == sorted(catalog._sparse_records(spark, str(tmp_path)).collect())
    assert dealt.groupBy("table_id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    ordered = dealt.withColumn("next", F.lead("table_id").over(Window.partitionBy("part").orderBy("table_id")))
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
