"""colsense: table-corpus profiling and column-annotation evaluation on Spark.

Every operator is a plain function from DataFrame(s) to DataFrame built from
Spark SQL expressions; nothing is collected to the driver.
"""

from colsense.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
