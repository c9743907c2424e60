"""The size of what goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of texts or blocks; what is made of one in Python is several times as large.
BATCH_BYTES = 4 << 20
SETTING, USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Sets the session to send Python at most so many bytes at once, or one row, unless its setting was changed: a count of rows bounds no memory where rows
    hold whole pages or blocks of vectors."""
    spark = spark or SparkSession.getActiveSession()
    if spark and spark.conf.get(SETTING, USUAL) == USUAL:
        spark.conf.set(SETTING, BATCH_BYTES)
