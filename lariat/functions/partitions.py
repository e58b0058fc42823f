"""How rows are dealt out over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def dealt(df: DataFrame, *keys: str | Column, size: int = 4 << 20) -> DataFrame:
    """df by hash of the keys, into a partition for each ``size`` bytes of the columns that it reads, the session's number at least.

    For columns straight out of a file: what a task sorts or keeps then doesn't grow with the table.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(least, -(-read // size)), *keys)
