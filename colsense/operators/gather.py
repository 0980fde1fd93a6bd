"""Result assembly: pivots, series and rankings over experiment reports.

``report`` is the output of ``report.classification_report`` grouped by
``dataset`` and ``exp_name``.  Pivots always get their values explicitly
(no extra job, stable column order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsense.operators.annotate import strip_header_flag


def round_score(c, places: int = 2):
    return F.round(c, places)


def weighted_f1(report: DataFrame, slice_: str = "all") -> DataFrame:
    return (report.where((F.col("mode") == "padded") & (F.col("slice") == slice_)
                         & (F.col("label") == "weighted avg"))
                  .select("dataset", "exp_name", "slice_value", F.col("f1").alias("wf1")))


def discover_experiments(report: DataFrame) -> DataFrame:
    """(dataset, experiment) pairs that have results."""
    return report.select("dataset", "exp_name").distinct()


def main_results_pivot(report: DataFrame, datasets: list[str]) -> DataFrame:
    """Experiment (without header flag) x (dataset, with / w/out headers)."""
    w = strip_header_flag(weighted_f1(report))
    cols = [f"{d}|{h}" for d in datasets for h in ("with", "w/out")]
    piv = (w.withColumn("col", F.concat_ws("|", "dataset", "headers"))
             .groupBy("base_name").pivot("col", cols).agg(F.first(round_score(F.col("wf1")))))
    return piv.select("base_name", *[F.col(f"`{c}`").alias(c.replace("|", "_").replace("w/out", "wout"))
                                     for c in cols])


def data_type_pivot(report: DataFrame, datasets: list[str]) -> DataFrame:
    """Experiment x (dataset, non-num / num) weighted F1 of the data-type slices."""
    w = weighted_f1(report, "data_type").withColumn(
        "kind", F.when(F.col("slice_value") == "numerical", F.lit("num")).otherwise(F.lit("nonnum")))
    cols = [f"{d}|{k}" for d in datasets for k in ("nonnum", "num")]
    piv = (w.withColumn("col", F.concat_ws("|", "dataset", "kind"))
             .groupBy("exp_name").pivot("col", cols).agg(F.first(round_score(F.col("wf1")))))
    return piv.select("exp_name", *[F.col(f"`{c}`").alias(c.replace("|", "_")) for c in cols])


def metric_series(report: DataFrame, slice_: str) -> DataFrame:
    """Weighted F1 per numeric slice value as an x-sorted series: ``pos`` is the
    rank of ``x`` inside each (dataset, experiment) series (small groups)."""
    w = weighted_f1(report, slice_).select("dataset", "exp_name", F.col("slice_value").try_cast("double").alias("x"),
                                          "wf1")
    return w.withColumn("pos", F.row_number().over(Window.partitionBy("dataset", "exp_name").orderBy("x")))


def f1_ranking(report: DataFrame) -> DataFrame:
    """Labels by F1 descending per experiment; averages excluded."""
    labels = report.where((F.col("mode") == "padded") & (F.col("slice") == "all")
                          & ~F.col("label").isin("macro avg", "weighted avg", "micro avg", "accuracy"))
    return labels.select("dataset", "exp_name", "label", "f1").withColumn(
        "rank", F.row_number().over(Window.partitionBy("dataset", "exp_name").orderBy(F.desc("f1"), "label")))
