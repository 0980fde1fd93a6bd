"""Evaluation plan: responses + annotated tables -> scored pairs -> reports.

Shape of the plan: per-table label lists (one aggregation on ``table_id``),
per-table sparsity (one aggregation on ``table_id``) and parsed responses
meet in equi joins on the table key; both aggregated sides are already hash
partitioned on that key, so only the response scan is exchanged.  Alignment
runs as an expression on the joined row; the reports are one more small
aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.constants import ADJUST_UP_TO
from colsense.operators import parse, profile, report
from colsense.sources import fixtures as fx


def evaluated_tables(instances: DataFrame, predictions: DataFrame, sparsity: DataFrame) -> DataFrame:
    """``(table_id, true_types, data_types, pred_types, sparsity)``.

    Every instance needs its response (inner join; ``pair_request_response``
    audits the completeness separately).
    """
    preds = predictions.select(F.col("request_id").alias("table_id"), "pred_types")
    return (instances.join(preds, "table_id", "inner")
                     .join(sparsity, "table_id", "left"))


def fixture_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without any label are not evaluated."""
    inst = fx.instances(spark, sf_dir).where(F.exists("true_types", lambda x: x.isNotNull()))
    preds = parse.parse_predictions(fx.responses(spark, sf_dir))
    sp = profile.table_sparsity(fx.table_rows(spark, sf_dir))
    return evaluated_tables(inst, preds, sp).select("*", *fx.experiment_columns(F.col("table_id")))


def experiment_report(spark: SparkSession, sf_dir: str, slices: tuple[str, ...] = (report.ALL, *report.SLICES),
                      modes: tuple[str, ...] = report.MODES, cap: int = ADJUST_UP_TO) -> DataFrame:
    """Reports of every (dataset, experiment) for the wanted slices and modes."""
    keys = ["dataset", "exp_name"]
    pairs = report.both_modes(fixture_evaluated(spark, sf_dir), cap, keep=keys, modes=modes)
    return report.classification_report(pairs, fx.vocabulary(spark), slices, group_cols=keys)


def fixture_pairs(spark: SparkSession, sf_dir: str, cap: int = ADJUST_UP_TO,
                  modes: tuple[str, ...] = report.MODES) -> DataFrame:
    return report.both_modes(fixture_evaluated(spark, sf_dir), cap, modes=modes)


def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the overall report averages of both modes."""
    rep = report.classification_report(fixture_pairs(spark, sf_dir), fx.vocabulary(spark), (report.ALL,))
    rep = rep.where(F.col("label").isin("macro avg", "weighted avg", "micro avg", "accuracy"))
    return rounded(rep)


def rounded(rep: DataFrame, places: int = 6) -> DataFrame:
    """Metrics rounded for display; operators keep full precision."""
    return rep.withColumns({c: F.round(c, places) for c in ("precision", "recall", "f1")})
