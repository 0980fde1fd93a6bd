"""CSV corpora of differing headers: against Python's csv module, with line breaks
in quotes, files that can't be read, and the profile computed from the scan."""

import csv
import io
import statistics

from pyspark.sql import functions as F

from colsense.constants import NA_TOKENS
from colsense.operators import profile
from colsense.sources import corpus

GOOD = {
    "a/one.csv": 'id,name,note\n1,x,"said ""hi"", then\nleft"\n2,NA,\n\n3,"",plain "inner" quote\n',
    "a/two.csv": "k;v\r\n1;2\r\n3;4\r\n",
    "b/wide.csv": ",".join(f"c{i}" for i in range(700)) + "\n" + "\n".join(",".join(str(i * r) for i in range(700)) for r in range(30)) + "\n",
    "b/short.csv": 'x,"two\nlines",z\n1\n1,2\n1,2,3\n,,\n',
    "b/single.csv": "only\n1\n2\n-7.5\n",
    "c/bare.csv": "x,y\n",
    "c/umlaut.csv": 'größe,"日本, 語"\n1,ä\n2,"' + "long " * 20_000 + '"\n',
}
BAD = {"c/empty.csv": b"", "c/blank.csv": b"\n\n", "c/long.csv": b"a,b\n1,2\n1,2,3\n", "c/open.csv": b'a,b\n1,"2\n3,4\n', "c/open1.csv": b'a\n"2\n3\n',
       "c/latin.csv": "a,b\n1,\xe9\n".encode("latin-1")}


def _write(tmp_path):
    for name, text in {**GOOD, **BAD}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "a" / "other.txt").write_text("not,a,table\n")


def _plain(text):
    head, *rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return head, [[None if i >= len(r) or r[i] in NA_TOKENS else r[i] for i in range(len(head))] for r in rows]


def test_scan(spark, tmp_path):
    _write(tmp_path)
    found = {}
    for r in corpus.scan_csv_corpus(spark, str(tmp_path)).collect():
        found.setdefault("/".join(r.path.split("/")[-2:]), []).append(r)
    assert set(found) == {*GOOD, *BAD}
    for name in BAD:
        assert [(r.row_idx, r.headers, r.cells, r.parse_error) for r in found[name]] == [(-1, None, None, True)], name
    for name, text in GOOD.items():
        head, rows = _plain(text)
        got = sorted(found[name], key=lambda r: r.row_idx)
        assert all(list(r.headers) == head and not r.parse_error for r in got), name
        if rows:
            assert [r.row_idx for r in got] == list(range(len(rows))) and [list(r.cells) for r in got] == rows, name
        else:
            assert [(r.row_idx, r.cells) for r in got] == [(-1, None)]


def test_other_separator(spark, tmp_path):
    _write(tmp_path)
    rows = corpus.scan_csv_corpus(spark, str(tmp_path / "a"), "two.csv", sep=";").orderBy("row_idx").collect()
    assert [(list(r.headers), list(r.cells)) for r in rows] == [(["k", "v"], ["1", "2"]), (["k", "v"], ["3", "4"])]


def test_profile_of_the_scan(spark, tmp_path):
    _write(tmp_path)
    rows = corpus.scan_csv_corpus(spark, str(tmp_path)).withColumnRenamed("path", "table_id").withColumn("dataset", F.lit("d")).cache()
    (got,) = profile.corpus_characteristics(rows.where("NOT parse_error"), rows.select("dataset", "table_id").distinct()).collect()
    tables = [_plain(t) for t in GOOD.values()]
    cols, n_rows = [len(h) for h, _ in tables], [len(r) for _, r in tables]
    sparse = [sum(x is None for r in rows for x in r) / (len(h) * len(rows)) for h, rows in tables if rows]

    def number(x):
        try:
            return x is None or float(x) is not None
        except ValueError:
            return False
    numeric = sum(bool(rows) and all(number(r[i]) for r in rows) for h, rows in tables for i in range(len(h)))
    assert (got.n_tables, got.parsing_failed) == (len(GOOD) + len(BAD), len(BAD))
    for x, want in ((got.mean_cols, statistics.mean(cols)), (got.median_cols, statistics.median(cols)), (got.p95_cols, statistics.quantiles(cols, n=20)[-1]),
                    (got.mean_rows, statistics.mean(n_rows)), (got.median_rows, statistics.median(n_rows)), (got.p95_rows, statistics.quantiles(n_rows, n=20)[-1]),
                    (got.mean_sparsity, statistics.mean(sparse)), (got.numerical_share, numeric / sum(cols)), (got.non_numerical_share, 1 - numeric / sum(cols))):
        assert abs(x - want) < 1e-9


def test_no_readable_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    rows = corpus.scan_csv_corpus(spark, str(tmp_path)).withColumnRenamed("path", "table_id").withColumn("dataset", F.lit("d"))
    (got,) = profile.corpus_characteristics(rows.where("NOT parse_error"), rows.select("dataset", "table_id")).collect()
    assert (got.n_tables, got.parsing_failed, got.mean_cols, got.p95_rows, got.numerical_share) == (1, 1, None, None, None)


def test_many_ranks_over_many_buckets(spark):
    import random
    rng = random.Random(3)
    values = {g: [rng.choice([rng.randint(0, 50), rng.randint(0, 10**7)]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 3), ("d", 5000))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)], "g string, v long")
    got = {r.g: r for r in profile.order_statistics(df, ["g"], "v", {f"r{k}": F.ceil(F.col("n") * k / 7) for k in range(1, 8)}).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g]["n"] == len(vs) and [got[g][f"r{k}"] for k in range(1, 8)] == [sorted(vs)[-(-len(vs) * k // 7) - 1] for k in range(1, 8)]
