"""Corpus profiling: shape, sparsity, data types, exact quantiles, characteristics.

Input is the row-array corpus ``table_rows(table_id, row_idx, cells)``.  Per
table statistics are one aggregation on ``table_id``; per corpus statistics
one more on ``dataset``.  Order statistics never sort a whole corpus in one
task: values are counted first, and one row per fixed-width value bucket gives
any number of ranks in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.functions.numeric import is_na_token, is_numeric_token

_BUCKET_WIDTH = 4096


def table_shape(rows: DataFrame) -> DataFrame:
    """``(table_id, n_rows, n_cols)``."""
    return rows.groupBy("table_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.max(F.size("cells")).cast("int").alias("n_cols"))


def _null_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, is_na_token))


def table_sparsity(rows: DataFrame) -> DataFrame:
    """``(table_id, sparsity)`` = missing cells / (rows * columns); null for empty tables."""
    agg = rows.groupBy("table_id").agg(
        F.sum(_null_cells(F.col("cells"))).alias("n_null"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("cells")).alias("n_cols"))
    return agg.select("table_id",
                      F.try_divide(F.col("n_null").cast("double"),
                                   F.col("n_rows") * F.col("n_cols")).alias("sparsity"))


def column_data_type(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, col_idx, data_type)``: numerical iff every present cell is a number.

    A column of only missing cells is numerical (it is read as floats).
    Aggregating on ``(table_id, col_idx)`` reuses the ``table_id`` partitioning
    of the corpus, so no extra exchange is planned when rows arrive clustered.
    """
    keys = keys or ["table_id"]
    cells = rows.select(*keys, F.posexplode("cells").alias("col_idx", "value"))
    ok = is_na_token(F.col("value")) | is_numeric_token(F.col("value"))
    return (cells.groupBy(*keys, "col_idx")
                 .agg(F.bool_and(ok).alias("numeric"))
                 .select(*keys, F.col("col_idx").cast("int"),
                         F.when(F.col("numeric"), F.lit("numerical"))
                          .otherwise(F.lit("non-numerical")).alias("data_type")))


def data_type_share(col_types: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Share and count of numerical / non-numerical columns."""
    g = group_cols or []
    num = F.col("data_type") == "numerical"
    return col_types.groupBy(*g).agg(
        F.count_if(num).alias("n_numerical"),
        F.count_if(~num).alias("n_non_numerical"),
        F.avg(num.cast("double")).alias("numerical_share"),
        F.avg((~num).cast("double")).alias("non_numerical_share"))


def annotated_column_counts(columns: DataFrame) -> DataFrame:
    """``(annotated, n_columns)``: columns with and without a label."""
    return (columns.groupBy((F.col("column_type").isNotNull()).alias("annotated"))
                   .agg(F.count(F.lit(1)).alias("n_columns")))


def annotated_per_table(columns: DataFrame) -> DataFrame:
    """``(table_id, n_annotated, n_columns)``."""
    return columns.groupBy("table_id").agg(
        F.count("column_type").alias("n_annotated"), F.count(F.lit(1)).alias("n_columns"))


def annotated_total(columns: DataFrame) -> DataFrame:
    """``(n_tables, n_annotated_tables, n_annotated, n_columns)`` of the corpus."""
    return annotated_per_table(columns).agg(
        F.count(F.lit(1)).alias("n_tables"), F.count_if(F.col("n_annotated") > 0).alias("n_annotated_tables"),
        F.sum("n_annotated").alias("n_annotated"), F.sum("n_columns").alias("n_columns"))


def _histogram(long: DataFrame, g: list[str]) -> DataFrame:
    """One row per group and value bucket: ``vs`` (its values in order, each with
    its count), ``bc`` and ``bt`` (rows and sum of ``x``), ``before`` (rows in
    lower buckets) and ``n`` (rows of the group).

    ``long`` has the group columns, an integral ``v`` (null where it isn't ranked)
    and ``x``.  Values are counted first (map-side combined), so a bucket holds at
    most its width of them however many rows there are.
    """
    counts = (long.groupBy(*g, "v").agg(F.count("x").alias("c"), F.sum("x").alias("t"))
                  .withColumn("b", F.floor(F.col("v") / _BUCKET_WIDTH)))
    buckets = counts.groupBy(*g, "b").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("vs"),
                                          F.sum("c").alias("bc"), F.sum("t").alias("bt"))
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    return (buckets.withColumn("before", F.coalesce(
                        F.sum("bc").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                   .withColumn("n", F.sum("bc").over(w)))


def _at_rank(r: Column) -> Column:
    """The value of 1-based rank ``r`` where a histogram's bucket holds it, else null."""
    def step(acc, e):
        return F.struct((acc["left"] - e["c"]).alias("left"),
                        F.when((acc["left"] > 0) & (acc["left"] <= e["c"]), e["v"]).otherwise(acc["v"]).alias("v"))
    start = F.struct((r - F.col("before")).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("v"))
    inside = (F.col("before") < r) & (r <= F.col("before") + F.col("bc"))
    return F.when(inside, F.aggregate("vs", start, step)["v"])


def order_statistics(df: DataFrame, group_cols: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``n`` and exact order statistics ``x_r`` (1-based rank ``r``) of an integral
    column per group, all ranks in one pass.

    ``ranks`` maps an output name to an expression over ``n`` (the group size).
    """
    v = F.col(value).cast("bigint")
    long = df.where(F.col(value).isNotNull()).select(*group_cols, v.alias("v"), v.alias("x"))
    h = _histogram(long, list(group_cols))
    return h.groupBy(*group_cols).agg(F.max("n").alias("n"), *[F.max(_at_rank(r)).alias(name) for name, r in ranks.items()])


def exclusive_quantile_ranks(k: int = 19, q: int = 20) -> dict[str, Column]:
    """Ranks used by the exclusive (R6) ``k``-th of ``q`` quantiles."""
    n = F.col("n")
    j = F.least(F.greatest(F.floor(F.lit(k) * (n + 1) / q), F.lit(1)), n - 1)
    return {"x_lo": j, "x_hi": j + 1}


def _between(n: Column, lo: Column, hi: Column, k: int = 19, q: int = 20) -> Column:
    """The exclusive quantile from the values of its two ranks; null when n < 2."""
    j = F.least(F.greatest(F.floor(F.lit(k) * (n + 1) / q), F.lit(1)), n - 1)
    delta = F.lit(k) * (n + 1) - F.lit(q) * j
    return F.when(n >= 2, (lo * (F.lit(q) - delta) + hi * delta) / F.lit(float(q)))


def exclusive_quantile(df: DataFrame, group_cols: list[str], values: dict[str, str], k: int = 19, q: int = 20) -> DataFrame:
    """``statistics.quantiles(x, n=q)[k-1]`` (exclusive method) per group of each
    column (result name -> column), in one pass; null when n < 2."""
    g = list(group_cols)
    long = df.select(*g, F.explode(F.array(*[F.struct(F.lit(a).alias("metric"), F.col(c).cast("bigint").alias("value"))
                                             for a, c in values.items()])).alias("m")).select(*g, "m.metric", "m.value")
    stats = order_statistics(long, [*g, "metric"], "value", exclusive_quantile_ranks(k, q))
    at = _between(F.col("n"), F.col("x_lo"), F.col("x_hi"), k, q)
    return stats.groupBy(*g).agg(*[F.max(F.when(F.col("metric") == a, at)).alias(a) for a in values])


def median_ranks() -> dict[str, Column]:
    n = F.col("n")
    return {"m_lo": F.floor((n + 1) / 2), "m_hi": F.ceil((n + 1) / 2)}


def _characteristics(long: DataFrame, d: str) -> DataFrame:
    """One row per dataset from a long table ``(dataset, metric, v, x)``: ranked
    metrics ``cols`` and ``rows``, sums ``sparsity``, ``numerical`` and
    ``non_numerical`` (columns), and ``listed`` (one row per table, read or not;
    without it all are read).  Everything comes from one histogram."""
    h = _histogram(long, [d, "metric"])
    ranks = {**exclusive_quantile_ranks(), **median_ranks()}
    of = lambda m, c: F.when(F.col("metric") == m, c)
    ranked = [F.max(of(m, _at_rank(r))).alias(f"{m}_{name}") for m in ("cols", "rows") for name, r in ranks.items()]
    sums = [F.sum(of(m, F.col(c))).alias(f"{m}_{c}") for m in ("cols", "rows", "sparsity", "numerical", "non_numerical", "listed") for c in ("bc", "bt")]
    s = h.groupBy(d).agg(*ranked, *sums)
    typed = F.col("numerical_bt") + F.col("non_numerical_bt")
    mean = lambda m: F.try_divide(F.col(f"{m}_bt"), F.col(f"{m}_bc"))

    def shape(m: str) -> list[Column]:
        return [mean(m).alias(f"mean_{m}"), ((F.col(f"{m}_m_lo") + F.col(f"{m}_m_hi")) / 2.0).alias(f"median_{m}"),
                _between(F.col(f"{m}_bc"), F.col(f"{m}_x_lo"), F.col(f"{m}_x_hi")).alias(f"p95_{m}")]

    n_tables = F.coalesce("listed_bc", "rows_bc")
    return s.select(d, n_tables.alias("n_tables"), *shape("cols"), *shape("rows"), mean("sparsity").alias("mean_sparsity"),
                    F.try_divide(F.col("non_numerical_bt"), typed).alias("non_numerical_share"),
                    F.try_divide(F.col("numerical_bt"), typed).alias("numerical_share"),
                    (n_tables - F.coalesce("rows_bc", F.lit(0))).alias("parsing_failed"))


def _metric(name: str, x: Column, ranked: bool = False) -> Column:
    return F.struct(F.lit(name).alias("metric"), (x if ranked else F.lit(None)).cast("bigint").alias("v"), x.cast("double").alias("x"))


def corpus_characteristics(rows: DataFrame, tables: DataFrame | None = None,
                           dataset_col: str = "dataset") -> DataFrame:
    """One row per corpus: count, mean / median / exclusive 95th of columns and
    rows, mean sparsity, data-type shares and failed-parse count.

    ``rows`` carries ``dataset``, and may hold tables without rows (null
    ``cells``, width from ``headers``; their columns are non-numerical).
    ``tables`` (optional) is the ledger of all tables; those without an entry in
    ``rows`` couldn't be read: they count as tables but not in means.  Rows are
    read once: one aggregation per column gives a table's shape, missing cells
    and types.
    """
    d = dataset_col
    width = F.size("headers") if "headers" in rows.columns else F.lit(None).cast("int")
    cells = rows.select(d, "table_id", width.alias("width"), F.col("cells").isNotNull().alias("row"), F.posexplode_outer("cells").alias("col_idx", "value"))
    na, value = is_na_token(F.col("value")), F.col("value")
    per_column = cells.groupBy(d, "table_id", "col_idx").agg(
        F.max("width").alias("width"), F.count_if("row").alias("n"), F.count_if(na).alias("n_null"),
        F.bool_and(na | is_numeric_token(value)).alias("numeric"))
    known = F.col("col_idx").isNotNull()
    per_table = per_column.groupBy(d, "table_id").agg(
        F.max("n").alias("n_rows"), F.coalesce(F.max(F.col("col_idx") + 1), F.max("width"), F.lit(0)).alias("n_cols"),
        F.sum(F.when(known, F.col("n_null"))).alias("n_null"), F.count_if(known & F.col("numeric")).alias("numerical"))
    metrics = [_metric("cols", F.col("n_cols"), True), _metric("rows", F.col("n_rows"), True),
               _metric("sparsity", F.try_divide(F.col("n_null").cast("double"), F.col("n_rows") * F.col("n_cols"))),
               _metric("numerical", F.col("numerical")), _metric("non_numerical", F.col("n_cols") - F.col("numerical"))]
    long = per_table.select(d, F.explode(F.array(*metrics)).alias("m")).select(d, "m.*")
    if tables is not None:
        long = long.unionByName(tables.select(d, _metric("listed", F.lit(1)).alias("m")).select(d, "m.*"))
    return _characteristics(long, d)


def precomputed_stats_profile(stats: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Characteristics from statistics documents, as ``corpus.scan_stats_documents``
    reads them: ``(dataset, num_cols, num_rows_json, sparsity, num_numerical_cols,
    num_non_numerical_cols)`` where ``num_rows_json`` is ``{"COUNT(*)":{"0":n}}``.
    """
    d = dataset_col
    n_rows = F.get_json_object("num_rows_json", "$['COUNT(*)']['0']").cast("bigint")
    metrics = [_metric("cols", F.col("num_cols"), True), _metric("rows", n_rows, True), _metric("sparsity", F.col("sparsity")),
               _metric("numerical", F.col("num_numerical_cols")), _metric("non_numerical", F.col("num_non_numerical_cols"))]
    return _characteristics(stats.select(d, F.explode(F.array(*metrics)).alias("m")).select(d, "m.*"), d).drop("parsing_failed")
