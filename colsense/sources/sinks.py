"""Result sinks: partitioned writes and stage-output overwrite.

Writes are idempotent (``overwrite``), so a retried job after executor loss
produces the same output.  Stage outputs use dynamic partition overwrite:
re-running one (dataset, experiment) replaces only its partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/colsense-io/{name}-{uuid.uuid4().hex[:12]}"


def sink_results(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*partition_cols).format(fmt).save(path)


def overwrite_stage_output(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (others are kept)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).format(fmt).save(path))


def push_state(state: DataFrame, path: str, batch: str) -> None:
    """Store a mergeable state (counts) of one batch; pushing a batch again
    replaces it, so a retried batch counts once."""
    overwrite_stage_output(state.withColumn("batch", F.lit(batch)), path, ["batch"])


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all batches pushed so far; earlier input isn't read again."""
    return spark.read.parquet(path).drop("batch")
