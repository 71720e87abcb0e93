"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys over twice the shuffle partitions and one.

    For rows that a small table was exploded into. Adaptive execution has merged that table's partitions by its bytes, and a
    shuffle by the same keys and number would be left out as needless, so that a sort or an aggregation of the exploded rows
    would hold many times what a partition is meant to.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)
